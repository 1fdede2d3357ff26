"""Exact duplicates by a heavy-hitter split.

A text is its SHA-256 digest. A Misra-Gries summary of the digests (the frequent-items sketch of Spark SQL: counters that are
lowered together when the table is full, one summary per task, merged in two levels) names at most ``counters`` digests that may
be frequent; every digest with more than about ``rows / counters`` copies is among them. One map-side combined aggregation counts
these exactly. The verified groups, at most ``counters`` rows, are broadcast: their losing rows go where they are read. All other
digests have few copies each and take an ordinary shuffle. DataFrame functions only.

Of equal texts the row with the largest id stays (null ids are the smallest). Null text counts as empty text, empty texts equal one
another. Rows that repeat id and text are copies like any other: one of them stays. An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import settle
from .common import text_of

COUNTERS = 4096
MERGERS = 64


def digest_of(text_col: str):
    return F.unhex(F.sha2(text_of(text_col), 256))


def frequent_digests(digests: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """At most ``counters`` values of the binary column ``_d`` that may be frequent."""
    task = digests.select("_d", F.pmod(F.spark_partition_id(), F.lit(MERGERS)).alias("_m"))
    summaries = task.groupBy("_m").agg(F.expr(f"approx_top_k_accumulate(hex(_d), {counters})").alias("_s"))
    # all in one group, by a key: an empty task of an aggregation without a key would pass on a summary without a type
    one = summaries.select(F.floor(F.col("_m") / F.lit(MERGERS)).alias("_g"), "_s")
    whole = one.groupBy("_g").agg(F.expr(f"approx_top_k_combine(_s, {counters})").alias("_s"))
    items = whole.select(F.explode(F.expr(f"approx_top_k_estimate(_s, {counters})")).alias("_e"))
    return items.where(F.col("_e.item").isNotNull()).select(F.unhex("_e.item").alias("_d"))


def frequent_groups(rows: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """``(_d, _size, _keep)`` of the named digests that really have copies; ``rows`` has ``_d`` and the order ``_k``."""
    named = rows.join(F.broadcast(frequent_digests(rows, counters)), "_d")
    exact = named.groupBy("_d").agg(F.count(F.lit(1)).alias("_size"), F.max("_k").alias("_keep"))
    return exact.where(F.col("_size") > 1)


def mark_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = COUNTERS) -> DataFrame:
    """One row per row of ``docs``: ``id_col, keep_id, group_size, kept, text_sha256``.

    The digests are written out once, so the text is read and hashed once and a retry sees the same row numbers.
    """
    rows = settle(
        docs.select(F.col(id_col).alias("_id"), digest_of(text_col).alias("_d")).withColumn("_r", F.monotonically_increasing_id())
    ).withColumn("_k", F.struct("_id", "_r"))
    # the verified groups are bounded by the number of counters, which makes this broadcast safe at any size
    winners = settle(frequent_groups(rows, counters))
    hot = rows.join(F.broadcast(winners), "_d")
    copies = Window.partitionBy("_d")
    cold = rows.join(F.broadcast(winners), "_d", "left_anti").select(
        "*", F.count(F.lit(1)).over(copies).alias("_size"), F.max("_k").over(copies).alias("_keep")
    )
    return hot.select(*cold.columns).unionByName(cold).select(
        F.col("_id").alias(id_col),
        F.col("_keep._id").alias("keep_id"),
        F.col("_size").cast("bigint").alias("group_size"),
        (F.col("_k._r") == F.col("_keep._r")).alias("kept"),
        F.lower(F.hex("_d")).alias("text_sha256"),
    )


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = COUNTERS) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Losing rows of the frequent groups are filtered where they are read. The rest is ranked within its digest; Spark keeps only
    the best row per digest and task before the shuffle, so copies of one text do not meet in one task.
    """
    keyed = docs.select(F.struct("*").alias("_row"), F.col(id_col).alias("_id"), digest_of(text_col).alias("_d"))
    slim = keyed.select("_d", F.struct("_id").alias("_k"))
    winners = settle(frequent_groups(slim, counters)).select("_d", F.col("_keep._id").alias("_keep_id"), F.lit(True).alias("_hot"))
    left = keyed.join(F.broadcast(winners), "_d", "left").where(F.col("_hot").isNull() | F.col("_id").eqNullSafe(F.col("_keep_id")))
    best = Window.partitionBy("_d").orderBy(F.col("_id").desc_nulls_last())
    return left.withColumn("_n", F.row_number().over(best)).where(F.col("_n") == 1).select("_row.*")
