"""Non-dominated sets and lower-left hulls."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import settle
from .ranks import quantile_edges, with_bucket

CHUNK = 20_000
HELD = 20_000


def _skyline(v: np.ndarray) -> np.ndarray:
    """Rows of ``v`` that no other row is below or equal to in every objective; rows must be distinct."""
    rest = v[np.lexsort((*v.T, v.sum(axis=1)))]
    kept = []
    while len(rest):
        head, rest = rest[0], rest[1:]
        kept.append(head)
        rest = rest[(rest < head).any(axis=1)]
    return np.array(kept).reshape(-1, v.shape[1])


def _local_skyline(objectives: Sequence[str]):
    names = list(objectives)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = np.empty((0, len(names)))
        for pdf in batches:
            best = _skyline(np.unique(np.vstack([best, pdf[names].to_numpy(float)]), axis=0))
            if len(best) >= HELD:  # this step only thins the rows, so a task may start anew
                yield pd.DataFrame(best, columns=names)
                best = np.empty((0, len(names)))
        yield pd.DataFrame(best, columns=names)

    return run


def _undominated(objectives: Sequence[str], against: np.ndarray, eps: float):
    """Task filter: drop rows that some vector of ``against`` (other than an equal one) beats by ``eps`` everywhere."""
    names = list(objectives)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i, a in enumerate(against):
                if i % 64 == 0:
                    v = pdf[names].to_numpy(float)
                    alive = np.ones(len(v), bool)
                if eps > 0:
                    alive &= ~(v - a >= eps).all(axis=1)
                else:
                    alive &= ~((v >= a).all(axis=1) & (v > a).any(axis=1))
                if i % 64 == 63 or i == len(against) - 1:
                    pdf = pdf[alive]
            yield pdf

    return run


def _filter_by(rows: DataFrame, objectives: Sequence[str], front: DataFrame, eps: float, chunk: int) -> DataFrame:
    """Rows not beaten by ``front``, which is handed to the tasks in chunks of bounded size."""
    size = front.count()
    parts = max(1, -(-size // chunk))
    cut = front.withColumn("_part", F.pmod(F.xxhash64(*objectives), F.lit(parts)))
    for i in range(parts):
        sent = _skyline(cut.where(F.col("_part") == i).select(*objectives).toPandas().to_numpy(float))
        rows = rows.mapInPandas(_undominated(objectives, sent, eps), rows.schema)
        if parts > 1:
            rows = settle(rows)
    return rows


def skyline(df: DataFrame, objectives: Sequence[str], chunk: int = CHUNK) -> DataFrame:
    """Distinct objective vectors that no other vector weakly dominates (all objectives minimised).

    One or two objectives: a sweep over ranges of the first one. More: every task first reduces its rows to a local skyline. What is left is compared with itself in chunks of at most about ``chunk``
    vectors, so neither a task nor a broadcast grows with the table.
    """
    objectives = list(objectives)
    vectors = df.select(*[F.col(c).cast("double").alias(c) for c in objectives])
    if len(objectives) <= 2:
        return swept_skyline(vectors, objectives)
    local = settle(vectors.mapInPandas(_local_skyline(objectives), vectors.schema).distinct())
    return _filter_by(local, objectives, local, 0.0, chunk)


def swept_skyline(vectors: DataFrame, objectives: Sequence[str]) -> DataFrame:
    """The skyline of one or two objectives: in the order of the first, then the second, a vector stays if its second is below all before it.

    The vectors are cut into ranges of the first objective; a range starts from the least second value of the ranges before it, one number per range. A task holds
    running minima of its own range only, however long the front is.
    """
    x, y = objectives[0], objectives[-1]
    rows = vectors.select(*objectives).distinct()
    if len(objectives) == 1:
        return rows.join(rows.agg(F.min(x).alias(x)), x)
    cut = with_bucket(rows, x, quantile_edges(vectors, x), "_b")
    lows = cut.groupBy("_b").agg(F.min(y).alias("_low"))  # one row per range
    before = Window.partitionBy(F.lit(0)).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carried = lows.select("_b", F.min("_low").over(before).alias("_carried"))
    left = cut.join(F.broadcast(carried), "_b").where(F.col("_carried").isNull() | (F.col(y) < F.col("_carried")))
    inside = Window.partitionBy("_b").orderBy(x, y).rowsBetween(Window.unboundedPreceding, -1)
    least = F.min(y).over(inside)
    return left.withColumn("_least", least).where(F.col("_least").isNull() | (F.col(y) < F.col("_least"))).select(*objectives)


def pareto_flags(df: DataFrame, key: str, objectives: Sequence[str], eps: float = 0.0, chunk: int = CHUNK) -> DataFrame:
    """``(key, objectives, kept)``: an item is kept if against every other item it is better by more than ``-eps`` somewhere.

    With ``eps=0`` duplicates knock each other out. If nothing survives, the first item with the lowest sum is kept.
    """
    if eps < 0:
        raise ValueError("eps must not be negative")
    objectives = list(objectives)
    items = df.select(key, *[F.col(c).cast("double").alias(c) for c in objectives])
    front = settle(skyline(items, objectives, chunk))
    if eps > 0:
        safe = _filter_by(items, objectives, front, eps, chunk)
    else:
        # a lone copy of a skyline vector; copies of one vector beat each other
        alone = items.join(front, objectives, "left_semi").groupBy(*objectives).agg(
            F.count(F.lit(1)).alias("_c"), F.min(key).alias(key)
        )
        safe = alone.where(F.col("_c") == 1)
    kept = safe.select(key).withColumn("kept", F.lit(1))
    if kept.isEmpty():
        total = sum((F.col(c) for c in objectives[1:]), F.col(objectives[0]))
        first = items.agg(F.min(F.struct(total, F.col(key).alias("k")))["k"]).first()[0]
        return items.withColumn("kept", F.when(F.col(key) == F.lit(first), F.lit(1)).otherwise(F.lit(0)))
    return items.join(kept, [key], "left").withColumn("kept", F.coalesce("kept", F.lit(0)))


def lower_chain(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Lower convex hull from the leftmost point as long as ``y`` does not rise; rows are ``(x, y)``."""
    chain: list[tuple[float, float]] = []
    for p in np.unique(np.column_stack([x, y]), axis=0):
        while len(chain) > 1:
            (ax, ay), (bx, by) = chain[-2:]
            if (bx - ax) * (p[1] - ay) - (by - ay) * (p[0] - ax) > 0:
                break
            chain.pop()
        chain.append((p[0], p[1]))
    out = chain[:1]
    for p in chain[1:]:
        if p[1] > out[-1][1] or p[0] <= out[-1][0]:
            break
        out.append(p)
    return np.array(out)


def pareto_hull(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """Lower-left chain of the convex hull of the points of each key.

    Keys with fewer than three points, or with a single distinct ``x`` or ``y``, have no hull and give no rows. Each task reduces its
    points to chains first; a key's final step sees only chain points, not its rows.
    """
    by = list(by)
    points = df.select(*by, F.col(x).cast("double").alias(x), F.col(y).cast("double").alias(y)).na.drop(subset=[x, y])
    keyed = points if by else points.withColumn("_k", F.lit(1))
    keys = by or ["_k"]
    fit = keyed.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), F.min(x).alias("_x0"), F.max(x).alias("_x1"), F.min(y).alias("_y0"), F.max(y).alias("_y1")
    ).where((F.col("_n") > 2) & (F.col("_x1") > F.col("_x0")) & (F.col("_y1") > F.col("_y0"))).select(*keys)

    def chains(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = []
        for key, part in pdf.groupby(keys, sort=False, dropna=False):
            hull = pd.DataFrame(lower_chain(part[x].to_numpy(), part[y].to_numpy()), columns=[x, y])
            parts.append(hull.assign(**dict(zip(keys, key))))
        return pd.concat(parts)[list(pdf.columns)] if parts else pdf

    def reduce_task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = None
        for pdf in batches:
            best = chains(pdf if best is None else pd.concat([best, pdf]))
        if best is not None:
            yield best

    local = keyed.mapInPandas(reduce_task, keyed.schema)
    final = local.groupBy(*keys).applyInPandas(chains, local.schema)
    return final.join(fit, keys, "left_semi").select(*by, x, y)


__all__ = ["skyline", "pareto_flags", "pareto_hull", "lower_chain"]
