"""Tables over the rounds of a game: ``(round, g, err, n)`` holds the mean error of each group in each round.

Errors of a mixture of the first ``t`` members are running means over rounds, so rows never have to be kept. ``n`` is the number
of rows in the denominator of the group error.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import ratio
from ..lookup import pin


def _so_far(by: Sequence[str], order: str = "round"):
    return Window.partitionBy(*by, F.lit(0)).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)


def group_errors(history: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Group error of each round and of the mixture up to it."""
    return history.withColumn("mix_err", F.avg("err").over(_so_far([*by, "g"])))


def mixture_pop_error(history: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``(round, pop_err, mix_pop_err)``: population error per round and of the mixture.

    A ``pop_err`` column in the history (another error type for the population) takes precedence over the group average.
    """
    if "pop_err" in history.columns:
        err = F.max("pop_err")
    else:
        err = ratio(F.sum(F.col("err") * F.col("n")), F.sum("n"))
    rounds = history.groupBy(*by, "round").agg(err.alias("pop_err"))
    return rounds.withColumn("mix_pop_err", F.avg("pop_err").over(_so_far(by)))


def trajectory(history: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``(round, pop_err, max_group_err)`` of the mixture after each round."""
    history = pin(history).frame
    worst = group_errors(history, by).groupBy(*by, "round").agg(F.max("mix_err").alias("max_group_err"))
    pop = mixture_pop_error(history, by).select(*by, "round", F.col("mix_pop_err").alias("pop_err"))
    return pop.join(worst, [*by, "round"])


def highest_gamma(history: DataFrame, by: Sequence[str] = (), relaxed: bool = False) -> DataFrame:
    """Largest useful relaxation: the worst group error at the round with the lowest population error.

    All rounds take part; ties go to the lowest worst-group error. A relaxed run needs no bound and gives 0.
    """
    t = trajectory(history, by)
    best = F.min(F.struct("pop_err", "max_group_err"))["max_group_err"]
    return t.groupBy(*by).agg((F.lit(0.0) if relaxed else best).alias("highest_gamma"))
