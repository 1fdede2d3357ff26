"""Row and column cleaning on whole tables; every operator is a narrow plan unless stated."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import hash_key
from ..functions.numeric import all_of, any_of
from ..lookup import attach
from ..spec import TableSpec
from .ranks import dense_codes, rank_cuts


def replace_everywhere(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Replace text values in every text column."""
    texts = [f.name for f in df.schema.fields if f.dataType.simpleString() == "string"]
    return df.replace(dict(mapping), subset=texts) if texts else df


def select_roles(df: DataFrame, spec: TableSpec, rename: Mapping[str, str] | None = None) -> DataFrame:
    """Columns in the order key, categorical, numeric, label; optionally renamed."""
    cat, num = spec.roles(df.columns)
    names = [c for c in (spec.key, *cat, *num, spec.label) if c]
    rename = rename or {}
    return df.select(*[F.col(c).alias(rename.get(c, c)) for c in names])


def drop_positions(df: DataFrame, positions: Sequence[int]) -> DataFrame:
    """Drop columns by 0-based position."""
    gone = set(positions)
    return df.select(*[c for i, c in enumerate(df.columns) if i not in gone])


def drop_missing(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Rows without NULL or NaN in ``cols`` (default all columns)."""
    return df.na.drop(how="any", subset=list(cols) if cols else None)


def keep_all_equal(df: DataFrame, cols: Sequence[str], value) -> DataFrame:
    """Rows where every listed column equals ``value``; NULL counts as different."""
    return df.where(all_of([F.coalesce(F.col(c) == F.lit(value), F.lit(False)) for c in cols]))


def keep_values(df: DataFrame, column: str, values: Sequence) -> DataFrame:
    return df.where(F.col(column).isin(list(values)))


def drop_groups(df: DataFrame, rules: Sequence[str]) -> DataFrame:
    """Drop the subgroups written ``column@value``; rows with NULL in the column stay."""
    conds = []
    for rule in rules:
        column, sep, value = rule.partition("@")
        if not sep or column not in df.columns:
            raise ValueError(f"group rule must be column@value with a known column: {rule!r}")
        conds.append(F.coalesce(F.col(column).cast("string") == F.lit(value), F.lit(False)))
    return df.where(~any_of(conds)) if conds else df


def category_codes(df: DataFrame, cols: Sequence[str], name: str = "code", fitted: DataFrame | None = None) -> DataFrame:
    """Add the position of the value (or value tuple) among the sorted distinct values of ``fitted`` (default: of ``df``).

    Values absent from ``fitted`` give NULL, so codes of train, validation and test agree when all use the train frame.
    """
    cols = list(cols)
    base = (fitted if fitted is not None else df).select(*cols).distinct().na.drop(subset=cols)
    return attach(df, dense_codes(base, cols, name), cols, how="left")


def tagged_union(frames: Mapping[str, DataFrame], tag: str = "source") -> DataFrame:
    """Stack frames with the same columns, with a column telling where a row came from."""
    out = None
    for label, df in frames.items():
        part = df.withColumn(tag, F.lit(label))
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("tagged_union needs at least one frame")
    return out


def sample_n(df: DataFrame, n: int, key: str, seed: str | int = 0, top_rows: int = 10_000) -> DataFrame:
    """At most ``n`` rows without replacement, in the random order given by the hashed key.

    Small samples are a bounded top-n per task. Larger ones find the key at rank ``n`` by radix selection and filter, so nothing is
    sorted in one task.
    """
    hashed = df.withColumn("_h", hash_key(seed, key))
    if n <= top_rows:
        return hashed.orderBy("_h").limit(n).drop("_h")
    at = rank_cuts(hashed.withColumn("one", F.lit(0)), ["one"], "_h", lambda s: s.select("one", F.lit("n").alias("cut"), F.lit(n).alias("k")))
    at = at.first()["at"]
    return hashed.where(F.col("_h") <= F.lit(at)).drop("_h")
