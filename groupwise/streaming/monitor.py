"""Group-metric monitor over event time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.metrics import rate_exprs, stat_exprs


def monitor(
    sf: DataFrame,
    ts: str = "ts",
    window: str = "1 hour",
    slide: str | None = None,
    watermark: str | None = None,
    g: str = "g",
    y: str = "y",
    pred: str = "pred",
    score: str | None = "score",
) -> DataFrame:
    """Sufficient statistics per (event-time window, group).

    The same plan runs on a batch frame and on a stream. On a stream, set ``watermark``: rows later than it are dropped and the state
    of closed windows is freed. A stream needs a ``timestamp`` column, so cast a ``timestamp_ntz`` one first.
    """
    if sf.isStreaming and watermark is None:
        raise ValueError("a streaming monitor needs a watermark, or its state grows without bound")
    if watermark is not None and sf.isStreaming:
        sf = sf.withWatermark(ts, watermark)
    span = F.window(ts, window, slide) if slide else F.window(ts, window)
    return sf.groupBy(span.alias("w"), F.col(g).alias("g")).agg(*stat_exprs(y, pred, score))


def monitor_rates(stats: DataFrame) -> DataFrame:
    """Window bounds, group, size and metric columns of :func:`monitor` rows; a projection, so it also runs on the stream."""
    exprs = rate_exprs(stats)
    picked = ("acc", "tpr", "fpr", "pr", "bal_acc", "logloss")
    return stats.select(
        F.col("w.start").alias("window_start"),
        F.col("w.end").alias("window_end"),
        "g",
        "n",
        *[exprs[m].alias(m) for m in picked if m in exprs],
    )


def worst_by_window(rated: DataFrame) -> DataFrame:
    """Lowest accuracy, balanced accuracy, TPR and positive rate and highest log-loss over the groups of each window."""
    return rated.groupBy("window_start", "window_end").agg(
        F.min("acc").alias("min_acc"),
        F.min("bal_acc").alias("min_bal_acc"),
        F.min("tpr").alias("min_tpr"),
        F.min("pr").alias("min_pr"),
        F.max("logloss").alias("max_logloss"),
    )
