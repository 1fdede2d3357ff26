"""Joining rows with small derived tables (group sizes, weights, thresholds, category codes).

Such a table usually has a handful of rows, but nothing guarantees it. ``pin`` measures it: within the bound it becomes a
local relation that Spark broadcasts, beyond the bound it is written out once and joined with the row side salted, so that a
key holding a large share of the rows is spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import settle

LOOKUP_ROWS = 100_000
SALTS = 16


@dataclass(frozen=True)
class Pinned:
    """A derived table evaluated once. ``small`` tells whether it passed the row bound; ``rows`` then holds it on the driver."""

    frame: DataFrame
    small: bool
    rows: pa.Table | None = None

    def derived(self, frame: DataFrame) -> "Pinned":
        """A table made from this one that has no more rows."""
        return Pinned(frame, self.small)


def pin(dim: DataFrame, max_rows: int | None = None) -> Pinned:
    """Evaluate ``dim`` once: local relation if it has at most ``max_rows`` rows (default ``LOOKUP_ROWS``), written table otherwise."""
    spark = dim.sparkSession
    max_rows = LOOKUP_ROWS if max_rows is None else max_rows
    head = dim.limit(max_rows + 1).toArrow()
    if head.num_rows <= max_rows:
        return Pinned(spark.createDataFrame(head, schema=dim.schema), True, head)
    return Pinned(settle(dim), False)


def join_null_safe(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """An equi-join in which NULL keys equal each other; the key columns of ``left`` stay."""
    keys = {c: f"_on{i}" for i, c in enumerate(on)}
    other = right.withColumnsRenamed(keys)
    return left.join(other, [F.col(c).eqNullSafe(F.col(k)) for c, k in keys.items()], how).drop(*keys.values())


def attach(
    df: DataFrame,
    dim: DataFrame | Pinned,
    on: Sequence[str],
    how: str = "inner",
    max_rows: int | None = None,
    salts: int = SALTS,
    null_safe: bool = False,
) -> DataFrame:
    """Join the rows of ``df`` with the derived table ``dim`` (unique on ``on``) without shuffling a hot key into one task.

    ``null_safe`` lets a NULL key meet a NULL key.
    """
    on = list(on)
    join = join_null_safe if null_safe else DataFrame.join
    pinned = dim if isinstance(dim, Pinned) else pin(dim, max_rows)
    if pinned.small:
        return join(df, F.broadcast(pinned.frame), on, how)
    spread = pinned.frame.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*df.columns), F.lit(salts)).cast("int"))
    return join(salted, spread, [*on, "_salt"], how).drop("_salt")


def attach_totals(state: DataFrame, by: Sequence[str], **aggs) -> DataFrame:
    """A state table (already aggregated, one row per vector and group) with totals over ``by`` as extra columns.

    An ordinary join: Spark picks the strategy from the sizes it sees and splits a skewed key at run time.
    """
    return state.join(state.groupBy(*by).agg(*[expr.alias(name) for name, expr in aggs.items()]), list(by))
