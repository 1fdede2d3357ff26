"""Metrics of probability vectors and their calibration, per group or any other key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import flag, ratio
from ..functions.vectors import argmax, brier, cross_entropy, entropy, scaled
from ..lookup import pin


def bin_edges(bins: int) -> list[float]:
    """Edges ``i * (1 / bins)`` in floating point, with 1 as the last; 0.3, 0.6 and 0.7 lie just below their edge."""
    step = 1.0 / bins
    return [i * step for i in range(bins)] + [1.0]


def confidence_bin(conf: Column, bins: int = 10) -> Column:
    """Half-open bins of [0, 1], the last one closed; values outside [0, 1] give NULL."""
    edges = bin_edges(bins)
    out = F.when((conf < F.lit(edges[0])) | (conf > F.lit(1.0)), F.lit(None).cast("int"))
    for i, edge in enumerate(edges[1:-1]):
        out = out.when(conf < F.lit(edge), F.lit(i))
    return out.otherwise(F.lit(bins - 1))


def _scored(pred: DataFrame, y: str, p: str) -> DataFrame:
    v = pred.withColumn("_conf", F.array_max(p)).withColumn("_hit", flag(argmax(p) == F.col(y)).cast("bigint"))
    return v


def vector_metrics(pred: DataFrame, by: Sequence[str] = (), y: str = "y", p: str = "p") -> DataFrame:
    """Brier score, cross-entropy, argmax accuracy, mean confidence and mean entropy."""
    return _scored(pred, y, p).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(brier(y, p)).alias("brier"),
        F.avg(cross_entropy(y, p)).alias("ce"),
        F.avg(F.col("_hit").cast("double")).alias("acc"),
        F.avg("_conf").alias("confidence"),
        F.avg(entropy(p)).alias("entropy"),
    )


def reliability(pred: DataFrame, by: Sequence[str] = (), bins: int = 10, y: str = "y", p: str = "p") -> DataFrame:
    """Reliability diagram: non-empty bins with size, mean confidence and accuracy."""
    v = _scored(pred, y, p).withColumn("bin", confidence_bin(F.col("_conf"), bins)).where(F.col("bin").isNotNull())
    return v.groupBy(*by, "bin").agg(
        F.count(F.lit(1)).alias("n"), F.avg("_conf").alias("mean_conf"), F.avg(F.col("_hit").cast("double")).alias("acc")
    )


def calibration_errors(pred: DataFrame, by: Sequence[str] = (), bins: int = 10, y: str = "y", p: str = "p") -> DataFrame:
    """Expected and maximum calibration error."""
    gap = F.abs(F.col("mean_conf") - F.col("acc"))
    r = reliability(pred, by, bins, y, p)
    return r.groupBy(*by).agg(ratio(F.sum(gap * F.col("n")), F.sum("n")).alias("ece"), F.max(gap).alias("mce"))


def majority_accuracy(pred: DataFrame, by: Sequence[str] = ("g",), y: str = "y") -> DataFrame:
    """Accuracy of always predicting the most frequent class of the key."""
    counts = pred.groupBy(*by, y).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(*by).agg(ratio(F.max("n"), F.sum("n")).alias("acc_prior"))


def group_report(pred: DataFrame, g: str = "g", y: str = "y", p: str = "p", bins: int = 10) -> DataFrame:
    """Share, accuracy, Brier score, cross-entropy, entropy, calibration errors and majority-class accuracy per group.

    One aggregation over (group, class, confidence bin) serves all of them. Probabilities are rescaled to sum 1 for the calibration
    part. The share divides by all rows.
    """
    v = _scored(pred, y, p).withColumn("_q", F.array_max(scaled(F.transform(F.col(p), lambda x: F.greatest(x, F.lit(0.0))))))
    cells = v.withColumn("_bin", confidence_bin(F.col("_q"), bins)).groupBy(g, F.col(y).alias("_y"), "_bin").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("_hit").alias("hit"),
        F.sum("_q").alias("conf"),
        F.sum(brier(y, p)).alias("bs"),
        F.sum(cross_entropy(y, p)).alias("ce"),
        F.sum(entropy(p)).alias("entropy"),
    )
    cells = pin(cells).frame
    total = cells.groupBy(F.lit(1).alias("_k")).agg(F.sum("n").alias("total"))
    whole = cells.groupBy(g).agg(*[F.sum(c).alias(c) for c in ("n", "hit", "bs", "ce", "entropy")]).withColumn("_k", F.lit(1))
    by_bin = cells.where(F.col("_bin").isNotNull()).groupBy(g, "_bin").agg(*[F.sum(c).alias(c) for c in ("n", "hit", "conf")])
    gap = F.abs(ratio("conf", "n") - ratio("hit", "n"))
    errors = by_bin.groupBy(g).agg(ratio(F.sum(gap * F.col("n")), F.sum("n")).alias("ece"), F.max(gap).alias("mce"))
    by_class = cells.groupBy(g, "_y").agg(F.sum("n").alias("n")).groupBy(g).agg(ratio(F.max("n"), F.sum("n")).alias("acc_prior"))
    rates = [ratio("hit", "n").alias("acc"), *[ratio(c, "n").alias(c) for c in ("bs", "ce", "entropy")]]
    return whole.join(total, "_k").select(g, ratio("n", "total").alias("ratio"), *rates).join(errors, g, "left").join(by_class, g)
