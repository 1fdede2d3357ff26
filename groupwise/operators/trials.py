"""Parameter tables, run tables and the analysis of many trained models."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import hash_int, unit
from ..functions.numeric import ratio
from ..lookup import attach, pin
from .clean import tagged_union


@dataclass(frozen=True)
class Uniform:
    """Real or integer range; integers exclude ``high``. ``log`` draws the logarithm uniformly."""

    low: float
    high: float
    log: bool = False
    integer: bool = False

    def draw(self, u: Column) -> Column:
        if self.log:
            lo, hi = math.log(self.low), math.log(self.high)
            v = F.exp(F.lit(lo) + u * F.lit(hi - lo))
        else:
            v = F.lit(float(self.low)) + u * F.lit(float(self.high - self.low))
        return F.floor(v).cast("bigint") if self.integer else v


@dataclass(frozen=True)
class Choice:
    """One of several text options."""

    options: tuple[str, ...]

    def draw(self, u: Column) -> Column:
        return F.get(F.array(*[F.lit(o) for o in self.options]), F.floor(u * F.lit(len(self.options))).cast("int"))


Space = Mapping[str, Uniform | Choice]

# Search ranges of the model families.
_BOOST = {
    "min_child_weight": Uniform(1e-3, 1e3, log=True),
    "n_estimators": Uniform(20, 500, log=True, integer=True),
    "learning_rate": Uniform(1e-3, 0.1, log=True),
    "num_leaves": Uniform(2, 64, integer=True),
    "reg_lambda": Uniform(0.001, 1000, log=True),
}
_BOOST_REGRESSION = {
    "max_depth": Uniform(2, 10, integer=True),
    "min_child_weight": Uniform(1, 1e4, log=True),
    "n_estimators": Uniform(20, 500, log=True, integer=True),
    "learning_rate": Uniform(1e-3, 0.5, log=True),
}
_GAME = {
    "n_estimators": Uniform(10, 500, log=True, integer=True),
    "gamma": Uniform(0, 1),
    "C": Uniform(1e-4, 1e4, log=True),
    "a": Uniform(0.1, 1),
    "b": Uniform(1e-2, 1),
}
_ADAPTIVE = {
    "n_iterations": Uniform(10, 500, log=True, integer=True),
    "C": Uniform(1e-4, 1e4, log=True),
    "alpha": Uniform(0.1, 0.9),
    "Kmin": Uniform(10, 50, integer=True),
}
_SHORT = {"max_iter": Uniform(10, 11, integer=True)}
SPACES: dict[str, Space] = {
    "boost": _BOOST,
    "minmax_boost": _BOOST | {"fair_weight": Uniform(1e-3, 1, log=True), "multiplier_learning_rate": Uniform(1e-3, 0.1, log=True)},
    "boost_regressor": _BOOST_REGRESSION,
    "minmax_boost_regressor": _BOOST_REGRESSION
    | {"multiplier_learning_rate": Uniform(1e-3, 0.5, log=True), "fair_weight": Uniform(1e-3, 1, log=True)},
    "game": _GAME,
    "game_regressor": _GAME,
    "adaptive": _ADAPTIVE,
}
# Large datasets get fewer rounds for the learners that refit a linear model in every round.
LARGE_SPACES: dict[str, Space] = SPACES | {
    "game": _GAME | {"n_estimators": Uniform(10, 50, log=True, integer=True)} | _SHORT,
    "game_regressor": _GAME | {"n_estimators": Uniform(10, 50, log=True, integer=True)} | _SHORT,
    "adaptive": _ADAPTIVE | {"n_iterations": Uniform(10, 50, log=True, integer=True)} | _SHORT,
}


def number_rows(df: DataFrame, count: Column, out: str, block: int = 10_000) -> DataFrame:
    """Every row ``count`` times, numbered from 0 in ``out``.

    Rows fan out to blocks first and the blocks are spread over all tasks, so a single large count is not one task's work. The number
    of tasks is given explicitly, because sizes seen before the second fan-out say nothing about the work after it.
    """
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = df.withColumn("_n_", count.cast("bigint"))
    blocks = n.where(F.col("_n_") > 0).withColumn("_b_", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("_n_") - 1) / block))))
    blocks = blocks.repartition(tasks, F.xxhash64(*[c for c in blocks.columns if c != "_n_"]))
    low = F.col("_b_") * F.lit(block)
    high = F.least(low + F.lit(block), F.col("_n_")) - 1
    return blocks.withColumn(out, F.explode(F.sequence(low, high))).drop("_n_", "_b_")


def sample_params(trials: DataFrame, space: Space, seed: str | int = 0, number: str = "number") -> DataFrame:
    """Add one random value per parameter to every trial; the draw depends on seed, parameter name and trial number only."""
    return trials.withColumns({name: p.draw(unit(f"{seed}|{name}", number)) for name, p in space.items()})


def run_table(datasets: DataFrame, variants: Mapping[str, str], n_params: str = "n_params", large: str = "is_large", seed: str | int = 0) -> DataFrame:
    """Runs to execute: dataset x model variant x trial number, with the sampled parameters as a map of text to double.

    ``datasets`` holds ``(dataset, n_params, is_large)``; ``variants`` maps a model variant to its family. Trials are numbered per
    dataset by its own ``n_params``; the space depends on the family and the size class.
    """
    models = F.array(*[F.struct(F.lit(v).alias("model_name"), F.lit(f).alias("family")) for v, f in variants.items()])
    runs = number_rows(datasets.select("dataset", n_params, large, F.inline(models)), F.col(n_params), "number")
    params: Column | None = None
    for family in sorted(set(variants.values())):
        for is_large, spaces in ((False, SPACES), (True, LARGE_SPACES)):
            cells = [
                x
                for name, p in spaces[family].items()
                for x in (F.lit(name), p.draw(unit(f"{seed}|{name}", "dataset", "model_name", "number")).cast("double"))
            ]
            cond = (F.col("family") == family) & (F.col(large) == F.lit(is_large))
            params = F.when(cond, F.create_map(*cells)) if params is None else params.when(cond, F.create_map(*cells))
    return runs.select("dataset", "model_name", "family", "number", params.alias("params"))


def sweep_params(base: DataFrame, weights: Sequence[float], out: str = "fair_weight") -> DataFrame:
    """Every base parameter row once per fair weight."""
    return base.withColumn(out, F.explode(F.array(*[F.lit(float(w)) for w in weights])))


def sweep_curve(results: DataFrame, trials: DataFrame, by: Sequence[str] = ("fair_weight",)) -> DataFrame:
    """Join results with trials on all shared columns and average every numeric column per fair weight."""
    shared = [c for c in results.columns if c in trials.columns]
    joined = results.join(trials, shared)
    kinds = ("double", "float", "int", "bigint", "smallint", "tinyint")
    numeric = [f.name for f in joined.schema.fields if f.dataType.simpleString() in kinds and f.name not in by]
    return joined.groupBy(*by).agg(*[F.avg(c).alias(c) for c in numeric])


def select_models(
    val: DataFrame,
    test: DataFrame,
    perf: str,
    fair: str,
    reps: int = 1000,
    n: int = 100,
    alphas: Sequence[float] = tuple(i / 20 for i in range(21)),
    keys: Sequence[str] = ("dataset", "model_name"),
    number: str = "number",
    carry: Sequence[str] = ("duration",),
    maximize: bool = True,
    seed: str | int = 0,
) -> DataFrame:
    """Bootstrap model selection.

    For each key, alpha and repetition: draw ``n`` validation rows with replacement, take the best ``alpha * fair + (1 - alpha) * perf``
    (lowest model number on ties) and report that model's test metrics. Draws are hashed row positions, generated by all tasks
    and reduced to the best draw of each task before they move.
    """
    keys = list(keys)
    order = Window.partitionBy(*keys).orderBy(number)
    models = val.select(*keys, number, F.col(perf).alias("_p"), F.col(fair).alias("_f")).withColumn(
        "_i", (F.row_number().over(order) - 1).cast("bigint")
    )
    models = pin(models)
    sizes = models.frame.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    draws = number_rows(sizes, F.lit(len(alphas) * reps * n), "_d")
    table = F.array(*[F.lit(float(a)) for a in alphas])
    draws = draws.withColumn("_a", F.floor(F.col("_d") / (reps * n)).cast("int")).withColumns(
        {
            "alpha": F.get(table, F.col("_a")),
            "rep": (F.floor(F.col("_d") / n) % reps).cast("int"),
            "draw": (F.col("_d") % n).cast("int"),
        }
    )
    draws = draws.drop("_d").withColumn("_i", F.pmod(hash_int(seed, *keys, "_a", "rep", "draw"), F.col("_n")))
    scored = attach(draws, models, [*keys, "_i"]).withColumn("_s", F.col("alpha") * F.col("_f") + (1 - F.col("alpha")) * F.col("_p"))
    sign = 1.0 if maximize else -1.0
    best = scored.groupBy(*keys, "alpha", "rep").agg(F.max(F.struct(F.lit(sign) * F.col("_s"), -F.col(number)))["col2"].alias("_b"))
    chosen = best.withColumn(number, -F.col("_b")).drop("_b")
    out = attach(chosen, test.select(*keys, number, perf, fair, *carry), [*keys, number])
    return out.withColumn("score", (1 - F.col("alpha")) * F.col(perf) + F.col("alpha") * F.col(fair))


@lru_cache(maxsize=None)
def t_quantile(df: int, p: float = 0.975) -> float:
    """Quantile of Student's t by bisection on the integrated density."""
    log_c = math.lgamma((df + 1) / 2) - math.lgamma(df / 2) - 0.5 * math.log(df * math.pi)

    def upper_half(t: float) -> float:
        # substitute x = tan(a) * sqrt(df): the density becomes c * sqrt(df) * cos(a)^(df - 1) on a bounded interval
        top = math.atan(t / math.sqrt(df))
        a = np.linspace(0.0, top, 1001)
        f = math.exp(log_c) * math.sqrt(df) * np.cos(a) ** (df - 1)
        return float(top / 1000 / 3 * (f[0] + f[-1] + 4 * f[1:-1:2].sum() + 2 * f[2:-1:2].sum()))

    low, high = 0.0, 2000.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if upper_half(mid) < p - 0.5 else (low, mid)
    return (low + high) / 2


NORMAL_975 = 1.959963984540054
EXACT_DF = 199


def t_factor(n: Column, z: float = NORMAL_975, p: float = 0.975) -> Column:
    """t quantile for ``n - 1`` degrees of freedom: exact up to 199, beyond that the expansion in ``1/df`` (error below 1e-9)."""
    df = (n - 1).cast("double")
    exact = F.create_map(*[x for d in range(1, EXACT_DF + 1) for x in (F.lit(d), F.lit(t_quantile(d, p)))])
    g1 = (z**3 + z) / 4
    g2 = (5 * z**5 + 16 * z**3 + 3 * z) / 96
    g3 = (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384
    series = F.lit(z) + F.lit(g1) / df + F.lit(g2) / (df * df) + F.lit(g3) / (df * df * df)
    return F.when(n > 1, F.when(n - 1 <= EXACT_DF, F.element_at(exact, (n - 1).cast("int"))).otherwise(series))


def mean_ci(df: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Mean, sample standard deviation and half-width of the 95 % t-interval per key; NULL width for a single row."""
    aggs = [F.count(F.lit(1)).alias("n")]
    aggs += [a for c in cols for a in (F.avg(c).alias(f"{c}_mean"), F.stddev_samp(c).alias(f"{c}_std"))]
    t = df.groupBy(*keys).agg(*aggs)
    return t.withColumns({f"{c}_ci": t_factor(F.col("n")) * F.col(f"{c}_std") / F.sqrt("n") for c in cols})


def cost_ratio(df: DataFrame, baseline: str, dataset: str = "dataset", model: str = "model_name", duration: str = "duration") -> DataFrame:
    """Mean duration of each model relative to the baseline model on the same dataset."""
    means = pin(df.groupBy(dataset, model).agg(F.avg(duration).alias("mean_duration"))).frame
    base = means.where(F.col(model) == baseline).select(dataset, F.col("mean_duration").alias("_base"))
    return attach(means, base, [dataset]).withColumn("cost_ratio", ratio("mean_duration", "_base")).drop("_base")


def concat_runs(runs: Mapping[str, DataFrame], label: str = "run") -> DataFrame:
    """Stack result tables of several runs with a label column."""
    return tagged_union(runs, label)
