"""Subgroup derivation, group sizes and the weights built from them."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import poisson
from ..functions.numeric import ratio
from ..functions.recode import argmax_name, bands, keep_listed
from ..lookup import attach, pin
from .ranks import dense_codes


@dataclass(frozen=True)
class Keep:
    """Attribute whose listed values stay and whose other values become ``other``; ``initcap`` capitalises the name."""

    column: str
    values: tuple[str, ...] | None = None
    other: str = "Other"
    initcap: bool = False

    def expr(self) -> Column:
        c = F.col(self.column).cast("string")
        out = keep_listed(c, self.values, self.other) if self.values is not None else c
        return F.initcap(out) if self.initcap else out


@dataclass(frozen=True)
class Bands:
    """Attribute cut into named bands: ``names[i]`` for ``x < cuts[i]``, the last name above."""

    column: str
    cuts: tuple[float, ...]
    names: tuple[str, ...]

    def expr(self) -> Column:
        return bands(self.column, self.cuts, self.names)


@dataclass(frozen=True)
class Above:
    """Boolean band: ``yes`` where the attribute exceeds ``cut``."""

    column: str
    cut: float
    yes: str = "True"
    no: str = "False"

    def expr(self) -> Column:
        return F.when(F.col(self.column) > F.lit(self.cut), F.lit(self.yes)).otherwise(F.lit(self.no))


def subgroup(df: DataFrame, rules: Sequence[Keep | Bands | Above], sep: str = "_", out: str = "group_name") -> DataFrame:
    """Name of the intersection of several attributes."""
    return df.withColumn(out, F.concat_ws(sep, *[r.expr() for r in rules]))


def subgroup_from_onehot(df: DataFrame, prefix: str, out: str = "group_name") -> DataFrame:
    """Group name from a block of 0/1 columns that share a prefix."""
    cols = [c for c in df.columns if c.startswith(prefix)]
    return df.withColumn(out, argmax_name(cols, [c[len(prefix):] for c in cols]))


def encode_groups(df: DataFrame, columns: str | Sequence[str], out: str = "g") -> tuple[DataFrame, dict[str, DataFrame]]:
    """Dense ids ordered by group name. One column gives ``g``; several give ``g_0 .. g_k``. Also returns the id tables."""
    single = isinstance(columns, str)
    names = [columns] if single else list(columns)
    dims = {}
    for i, column in enumerate(names):
        target = out if single else f"{out}_{i}"
        distinct = df.select(column).where(F.col(column).isNotNull()).distinct()
        dims[column] = dense_codes(distinct, [column], target)
        df = attach(df, dims[column], [column], how="left")
    return df, dims


def group_sizes(df: DataFrame, by: Sequence[str] = ("g",), y: str = "y") -> DataFrame:
    """Rows, positives and negatives per group."""
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col(y).cast("bigint")).alias("n_pos"),
        F.sum((1 - F.col(y)).cast("bigint")).alias("n_neg"),
    )


def _with_total(sizes: DataFrame) -> DataFrame:
    """Group sizes joined with the table total, which is one row. The sizes are evaluated once for both."""
    sizes = pin(sizes).frame
    total = sizes.agg(F.sum("n").alias("total")).withColumn("_k", F.lit(1))
    return sizes.withColumn("_k", F.lit(1)).join(total, "_k").drop("_k")


def group_profile(df: DataFrame, by: Sequence[str] = ("g",), y: str = "y") -> DataFrame:
    """Size, share and label counts per group; both label rates are relative to all rows of the table."""
    t = _with_total(group_sizes(df, by, y))
    return t.select(
        *by,
        "n",
        "n_pos",
        "n_neg",
        ratio("n", "total").alias("share"),
        ratio("n_pos", "total").alias("positive_rate"),
        ratio("n_neg", "total").alias("negative_rate"),
    )


def group_ratio(df: DataFrame, by: Sequence[str] = ("g",)) -> DataFrame:
    """``N / n_g`` per group."""
    sizes = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    return _with_total(sizes).select(*by, ratio("total", "n").alias("ratio"))


def inverse_frequency_weight(df: DataFrame, column: str, out: str = "weight") -> DataFrame:
    """Row weight ``N / n`` of the row's value."""
    return attach(df, group_ratio(df, [column]).withColumnRenamed("ratio", out), [column])


def group_scale(df: DataFrame, g: str = "g", out: str = "n_over_ng") -> DataFrame:
    """Row scale ``n / n_g`` used by the constraint gradients."""
    return inverse_frequency_weight(df, g, out)


def resample_balanced(df: DataFrame, key: str, weight: str, n: float | None = None, seed: str | int = 0) -> DataFrame:
    """Resample rows with replacement in proportion to ``weight``.

    Each row draws its own Poisson number of copies with mean ``n * w / sum(w)`` from its hashed key, so no rows move. The result has
    ``n`` rows in expectation rather than exactly (default ``n``: the size of the input). ``copy`` numbers the copies from 1.
    """
    stats = df.agg(F.sum(weight).alias("s"), F.count(F.lit(1)).alias("n")).first()
    size = float(stats["n"] if n is None else n)
    drawn = df.withColumn("_c", poisson(F.col(weight) * F.lit(size / stats["s"]), seed, key))
    return drawn.where(F.col("_c") > 0).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("_c")))).drop("_c")


def row_weights_mu(df: DataFrame, mu: DataFrame, g: str = "g", out: str = "weight") -> DataFrame:
    """Row weight ``mu`` of the row's group; ``mu`` is a table ``(g, mu)``."""
    return attach(df, mu.select(g, F.col("mu").alias(out)), [g])


def game_weight_table(
    sizes: DataFrame, error_type: str = "0/1 Loss", constrained: bool = False, group: str = "g", total: str = "total"
) -> DataFrame:
    """Weight of the positives and of the negatives of each group in a game round.

    ``sizes`` holds ``(group, w, lam, n, n_pos, n_neg, total)``: group weight, multiplier, counts and the table size. Without an FP/FN
    constraint every row weighs ``w / n``. With one (relaxed or equal-error game) rows weigh ``1 / total``, and the label on which the
    error occurs gets ``lam / n_label`` on top.
    """
    base = ratio(F.lit(1.0), total)
    if constrained and error_type[:2] in ("FP", "FN"):
        count = "n_neg" if error_type.startswith("FP") else "n_pos"
        hit = base + F.coalesce(ratio("lam", count), F.lit(0.0))
        pos, neg = (base, hit) if error_type.startswith("FP") else (hit, base)
    else:
        pos = neg = ratio("w", "n")
    return sizes.select(group, pos.alias("w_pos"), neg.alias("w_neg"))


def row_weights(
    df: DataFrame, tables: dict[str, DataFrame], y: str = "y", out: str = "weight", shift_negative: bool = False
) -> DataFrame:
    """Row weight averaged over group types; ``tables`` maps a group column to its :func:`game_weight_table`.

    ``shift_negative`` lifts all weights by the lowest one over all group types when that is negative.
    """
    parts = []
    lows = [t.agg(F.min(F.least("w_pos", "w_neg"))).first()[0] for t in tables.values()] if shift_negative else []
    low = min([x for x in lows if x is not None], default=0.0)
    for i, (column, table) in enumerate(tables.items()):
        t = table.select(F.col(table.columns[0]).alias(column), F.col("w_pos").alias(f"_p{i}"), F.col("w_neg").alias(f"_n{i}"))
        if low < 0:
            t = t.withColumns({f"_p{i}": F.col(f"_p{i}") - F.lit(low), f"_n{i}": F.col(f"_n{i}") - F.lit(low)})
        df = attach(df, t, [column])
        parts.append(F.when(F.col(y) == 1, F.col(f"_p{i}")).otherwise(F.col(f"_n{i}")))
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    names = [f"_{k}{i}" for i in range(len(parts)) for k in "pn"]
    return df.withColumn(out, total / F.lit(float(len(parts)))).drop(*names)
