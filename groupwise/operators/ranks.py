"""Exact order statistics and prefix sums without an un-partitioned window or a window over a hot key.

Two tools carry the splits, ROC curves and simplex projections:

* :func:`rank_cuts` finds the key value at a given rank of each stratum by radix selection. Each pass counts rows by the next two
  hex digits, so shuffles carry counts, not rows; only the rows of the last, small bucket are ever sorted.
* :func:`prefix_sums` gives running sums along a numeric order. Rows are cut at pooled quantiles, so every task sorts about
  ``1/buckets`` of the rows whatever the skew of the key.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from operator import or_

import numpy as np
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..lookup import attach, join_null_safe, pin
from ..session import settle

SORT_ROWS = 200_000
BUCKET_ROWS = 500_000
POINTS = 1_000
EVEN = 8_193
MERGERS = 16
ACCURACY = 10_000
DIGITS = 2
KEY_DIGITS = 32


def rank_cuts(
    df: DataFrame, by: Sequence[str], key: str, cuts: Callable[[DataFrame], DataFrame], sort_rows: int = SORT_ROWS
) -> DataFrame:
    """Key value at rank ``k`` of each stratum.

    ``cuts`` turns the stratum sizes ``(*by, n)`` into ``(*by, cut, k)``, ranks counted from 1; the sizes come from the first digit count,
    so they cost no pass of their own. ``key`` is a fixed-length hex text column. Returns ``(*by, cut, at)``: exactly ``k`` rows of the
    stratum have ``key <= at`` as long as keys are distinct. NULL is a stratum like any other. Cuts with ``k = 0`` give an empty text, which is below every key. A rank
    above the stratum size gives ``'~'``, which is above every key.
    """
    by = list(by)
    rows = df.select(*by, key)
    first = pin(_digit_counts(rows.withColumn("prefix", F.lit("")), by, key, 0))
    sizes = first.frame.groupBy(*by).agg(F.sum("n").alias("n"))
    state = pin(cuts(sizes).select(*by, "cut", F.col("k").cast("bigint").alias("k"), F.lit("").alias("prefix")))
    done = []
    for depth in range(DIGITS, KEY_DIGITS + 1, DIGITS):
        open_cuts = state.frame.where(F.col("k") > 0).select(*by, "cut", "k", "prefix")
        done.append(state.frame.where(F.col("k") <= 0).select(*by, "cut", F.lit("").alias("at")))
        if depth == DIGITS:
            counts = first.frame
        else:
            near = rows.withColumn("prefix", F.substring(key, 1, depth - DIGITS))
            near = attach(near, state.derived(open_cuts.select(*by, "prefix").distinct()), [*by, "prefix"], null_safe=True)
            counts = _digit_counts(near, by, key, depth - DIGITS)
        w = Window.partitionBy(*by, "prefix").orderBy("digit").rowsBetween(Window.unboundedPreceding, 0)
        counts = counts.withColumn("upto", F.sum("n").over(w))
        asked = open_cuts.groupBy(*by, "prefix").agg(F.collect_list(F.struct("cut", "k")).alias("cuts"))
        hit = (
            attach(counts, state.derived(asked), [*by, "prefix"], null_safe=True)
            .withColumn("c", F.explode("cuts"))
            .where((F.col("c.k") > F.col("upto") - F.col("n")) & (F.col("c.k") <= F.col("upto")))
            .select(
                *by,
                F.col("c.cut").alias("cut"),
                (F.col("c.k") - F.col("upto") + F.col("n")).alias("k"),
                F.concat("prefix", "digit").alias("prefix"),
                "n",
            )
        )
        state = pin(hit)
        beyond = join_null_safe(open_cuts, state.frame.select(*by, "cut"), [*by, "cut"], "left_anti")
        done.append(beyond.select(*by, "cut", F.lit("~").alias("at")))
        if state.small:
            largest = max(state.rows["n"].to_pylist(), default=0)
        else:
            largest = state.frame.agg(F.max("n")).first()[0]
        if largest <= sort_rows or depth >= KEY_DIGITS:
            break
    buckets = state.frame.select(*by, "prefix").distinct()
    near = attach(rows.withColumn("prefix", F.substring(key, 1, depth)), state.derived(buckets), [*by, "prefix"], null_safe=True)
    ranked = near.withColumn("k", F.row_number().over(Window.partitionBy(*by, "prefix").orderBy(key)).cast("bigint"))
    asked = state.frame.select(*by, "prefix", "k").distinct()
    found = attach(ranked, state.derived(asked), [*by, "prefix", "k"], null_safe=True).select(*by, "prefix", "k", F.col(key).alias("at"))
    last = join_null_safe(state.frame, found, [*by, "prefix", "k"]).select(*by, "cut", "at")
    return reduce(DataFrame.unionByName, [last, *done])


def _digit_counts(rows: DataFrame, by: Sequence[str], key: str, depth: int) -> DataFrame:
    """Rows per stratum, prefix and the next digits: at most 256 counts per open prefix."""
    digit = F.substring(key, depth + 1, DIGITS).alias("digit")
    return rows.groupBy(*by, "prefix", digit).agg(F.count(F.lit(1)).alias("n"))


def pooled_points(df: DataFrame, columns: Sequence[str], points: int = POINTS, mergers: int = MERGERS) -> tuple[dict[str, np.ndarray], int]:
    """Sorted values of each column, about ``mergers * points`` of them, that stand for equal shares of its rows; and the number of rows. One pass.

    Two levels: ``mergers`` sketches, each of the rows of every ``mergers``-th task, so no task merges those of all tasks; what they say, ``points`` values each, meets on the
    driver, weighted by rows. NULL is left out. A column with few values shows all that make up more than ``1 / points`` of a sketch's rows.
    """
    probs = [i / points for i in range(points + 1)]
    key = F.pmod(F.spark_partition_id(), F.lit(mergers)).alias("key")
    values = [F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)]  # whatever the columns are called
    aggs = [F.percentile_approx(f"c{i}", probs, ACCURACY).alias(f"v{i}") for i in range(len(values))] + [F.count(f"c{i}").alias(f"n{i}") for i in range(len(values))]
    found = df.select(*values, key).groupBy("key").agg(F.count(F.lit(1)).alias("rows"), *aggs).collect()
    out = {}
    for i, c in enumerate(columns):
        parts = [(np.array(r[f"v{i}"]), r[f"n{i}"]) for r in found if r[f"n{i}"]]
        if not parts:
            out[c] = np.zeros(0)
            continue
        v = np.concatenate([p for p, _ in parts])
        w = np.concatenate([np.full(len(p), n / len(p)) for p, n in parts])
        order = np.argsort(v, kind="stable")
        out[c] = _even(v[order], np.cumsum(w[order]))
    return out, sum(r["rows"] for r in found)


def _even(values: np.ndarray, upto: np.ndarray) -> np.ndarray:
    """Values at evenly spaced weights; all of them where there are no more."""
    distinct = np.unique(values)
    if len(distinct) <= POINTS:
        return distinct
    at = np.searchsorted(upto, np.linspace(0, upto[-1], EVEN), "left")
    return values[np.minimum(at, len(values) - 1)]


def cuts_of(points: np.ndarray, parts: int) -> list[float]:
    """At most ``parts - 1`` distinct inner edges that cut what :func:`pooled_points` found into parts of similar size."""
    distinct = np.unique(points)
    if len(distinct) <= parts:
        return distinct[1:].tolist()
    return sorted({float(points[len(points) * i // parts]) for i in range(1, parts)} - {float(distinct[0])})


def quantile_edges(df: DataFrame, column: str, buckets: int | None = None) -> list[float]:
    """Distinct inner edges that cut the rows into ``buckets`` parts of similar size, by default of about ``BUCKET_ROWS`` rows each (sketches, one pass)."""
    points, rows = pooled_points(df.select(column), [column])
    return cuts_of(points[column], buckets or max(8, -(-rows // BUCKET_ROWS)))


def with_bucket(df: DataFrame, column: str, edges: Sequence[float], out: str) -> DataFrame:
    """``df`` plus the number of edges below or equal to ``column``, by binary search; NULL for NULL, one more for NaN."""
    if not edges:
        return df.withColumn(out, F.when(F.col(column).isNotNull(), F.lit(0)))
    split = Bucketizer(splits=[-float("inf"), *edges, float("inf")], inputCol="_value", outputCol="_place", handleInvalid="keep")
    placed = split.transform(df.withColumn("_value", F.col(column).cast("double")))
    return placed.withColumn(out, F.when(F.col(column).isNotNull(), F.col("_place").cast("int"))).drop("_value", "_place")


def edge_bucket(column: Column | str, edges: Sequence[float]) -> Column:
    """Number of edges below or equal to the value, as a balanced comparison tree (``log2`` comparisons per row)."""
    c = F.col(column) if isinstance(column, str) else column

    def tree(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(c < F.lit(float(edges[mid])), tree(lo, mid)).otherwise(tree(mid + 1, hi))

    return tree(0, len(edges))


def prefix_sums(
    table: DataFrame,
    by: Sequence[str],
    order: str,
    sums: Sequence[str],
    descending: bool = False,
    buckets: int | None = None,
    edges: Sequence[float] | None = None,
) -> DataFrame:
    """``table`` plus ``cum_<s>`` (inclusive running sum along ``order`` within ``by``) and ``all_<s>`` (the sum of the key) for every
    column in ``sums``.

    ``table`` must have one row per ``(*by, order)``. The running sum of a bucket starts from the totals of the buckets before it;
    those totals are at most ``buckets`` rows per key. Use every ``cum_`` column asked for: then both sides of the join read the
    same columns, and an aggregation behind ``table`` runs once and is shuffled once.
    """
    by = list(by)
    if edges is None:
        edges = quantile_edges(table, order, buckets)
    cut = with_bucket(table, order, edges, "_b")
    totals = cut.groupBy(*by, "_b").agg(*[F.sum(s).alias(f"_t_{s}") for s in sums])
    bucket_order = F.col("_b").desc() if descending else F.col("_b").asc()
    before = Window.partitionBy(*by, F.lit(0)).orderBy(bucket_order).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by, F.lit(0))
    offsets = totals.select(
        *by,
        "_b",
        *[F.coalesce(F.sum(f"_t_{s}").over(before), F.lit(0)).alias(f"_o_{s}") for s in sums],
        *[F.sum(f"_t_{s}").over(whole).alias(f"all_{s}") for s in sums],
    )
    row_order = F.col(order).desc() if descending else F.col(order).asc()
    inside = Window.partitionBy(*by, "_b").orderBy(row_order).rowsBetween(Window.unboundedPreceding, 0)
    joined = cut.join(offsets, [*by, "_b"])
    runs = [(F.sum(s).over(inside) + F.col(f"_o_{s}")).alias(f"cum_{s}") for s in sums]
    return joined.select(*table.columns, *runs, *[f"all_{s}" for s in sums])


def exact_quantiles(df: DataFrame, column: str, probs: Sequence[float]) -> list[float]:
    """Quantiles with linear interpolation between order statistics; NULL is left out.

    Brackets: sketches cut the values into cells, one pass counts the rows of each cell, which tells the cell that holds a wanted rank. Cells of more than
    ``SORT_ROWS`` rows of several values are cut again in the same way, in a pass over their rows only. What is left is counted by value: at
    most ``SORT_ROWS`` rows per wanted rank, whatever the table.
    """
    rows = df.select(F.col(column).cast("double").alias("v")).where(F.col("v").isNotNull())
    points, n = pooled_points(rows, ["v"])
    if not n:
        return []
    asked = {}
    for p in probs:
        at = float(p) * (n - 1)
        asked[p] = (int(at), min(int(at) + 1, n - 1), at - int(at))
    values = order_statistics(rows, sorted({r for a, b, _ in asked.values() for r in (a, b)}), cuts_of(points["v"], len(points["v"])))
    return [values[a] + (values[b] - values[a]) * part for a, b, part in asked.values()]


def order_statistics(rows: DataFrame, ranks: Sequence[int], edges: Sequence[float]) -> dict[int, float]:
    """The values at 0-based ``ranks`` of the column ``v`` (no NULL)."""
    cells = with_bucket(rows, "v", edges, "c").groupBy("c").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).orderBy("c").collect()
    ends = np.cumsum([r["n"] for r in cells])
    wanted: dict[int, list[int]] = {}
    for rank in ranks:
        wanted.setdefault(int(np.searchsorted(ends, rank, "right")), []).append(rank)
    out: dict[int, float] = {}
    small: dict[int, list[int]] = {}
    for i, mine in wanted.items():
        cell, before = cells[i], int(ends[i]) - cells[i]["n"]
        if cell["low"] == cell["high"]:
            out |= {r: cell["low"] for r in mine}
        elif cell["n"] <= SORT_ROWS:
            small[i] = mine
        else:
            part = rows.where((F.col("v") >= F.lit(cell["low"])) & (F.col("v") <= F.lit(cell["high"])))
            points, _ = pooled_points(part, ["v"])
            finer = cuts_of(points["v"], len(points["v"])) or [cell["high"]]
            out |= {r + before: v for r, v in order_statistics(part, [r - before for r in mine], finer).items()}
    if small:
        inside = [(F.col("v") >= F.lit(cells[i]["low"])) & (F.col("v") <= F.lit(cells[i]["high"])) for i in small]
        counts = rows.where(reduce(or_, inside)).groupBy("v").agg(F.count(F.lit(1)).alias("n")).orderBy("v").collect()
        v, n = np.array([r["v"] for r in counts]), np.array([r["n"] for r in counts])
        for i, mine in small.items():
            here = (v >= cells[i]["low"]) & (v <= cells[i]["high"])
            upto = np.cumsum(n[here]) + int(ends[i]) - cells[i]["n"]
            out |= {r: float(v[here][np.searchsorted(upto, r, "right")]) for r in mine}
    return out


def dense_codes(distinct: DataFrame, cols: Sequence[str], name: str) -> DataFrame:
    """``distinct`` (unique on ``cols``) plus its 0-based position in sort order.

    A table within the lookup bound is numbered by one window. A larger one is range-sorted and written; each sorted part is then
    numbered on its own and shifted by the size of the parts before it.
    """
    cols = list(cols)
    pinned = pin(distinct)
    if pinned.small:
        w = Window.orderBy(*cols)
        return pinned.frame.withColumn(name, (F.row_number().over(w) - 1).cast("int"))
    parts = settle(
        pinned.frame.sort(*cols).withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id())
    )
    sizes = parts.groupBy("_p").agg(F.count(F.lit(1)).alias("n"), F.min("_i").alias("first"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select("_p", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    return attach(parts, shifts, ["_p"]).select(
        *distinct.columns, (F.col("_i") - F.col("first") + F.col("shift")).cast("int").alias(name)
    )
