"""Deterministic splits by hash order.

Rows are ordered by ``md5(seed|key)``; a split is a rank cut in that order inside each stratum. The cut values come from
:func:`rank_cuts`, after which assigning a row is a comparison with the thresholds of its stratum: no row is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import hash_key
from ..functions.numeric import ratio
from ..lookup import attach
from .ranks import rank_cuts

HASH = "_hash"
ONE = "_all"


def allocate(counts: DataFrame, by: Sequence[str], label: str, n: str, take: str, out: str) -> DataFrame:
    """Share ``take`` (per ``by``) over the labels in proportion to ``n`` by largest remainder; ties go to the lower label.

    ``counts`` has one row per ``(*by, label)``, so the windows see a handful of labels per group.
    """
    w = Window.partitionBy(*by)
    quota = ratio(F.col(take) * F.col(n), F.sum(n).over(w))
    t = counts.withColumn("_q", F.coalesce(quota, F.lit(0.0))).withColumn("_f", F.floor("_q").cast("bigint"))
    order = Window.partitionBy(*by).orderBy(F.round(F.col("_q") - F.col("_f"), 9).desc(), F.col(label).asc())
    t = t.withColumn("_left", F.col(take) - F.sum("_f").over(w)).withColumn("_r", F.row_number().over(order))
    return t.withColumn(out, F.col("_f") + F.when(F.col("_r") <= F.col("_left"), F.lit(1)).otherwise(F.lit(0))).drop(
        "_q", "_f", "_left", "_r"
    )


def assign_by_cuts(df: DataFrame, by: Sequence[str], cuts: Callable[[DataFrame], DataFrame], names: Sequence, out: str) -> DataFrame:
    """Label rows by the first cut whose threshold their hash does not exceed; the last name covers the rest.

    ``cuts`` turns stratum sizes ``(*by, n)`` into ``(*by, cut, k)`` with ``cut`` 0..len(names)-2 and cumulative ranks ``k``. ``df`` carries
    the hash column. Two passes find the thresholds, the third labels the rows.
    """
    by = list(by)
    at = rank_cuts(df, by, HASH, cuts)
    wide = at.groupBy(*by).agg(*[F.max(F.when(F.col("cut") == F.lit(i), F.col("at"))).alias(f"_at{i}") for i in range(len(names) - 1)])
    labelled = attach(df, wide, by, how="left", null_safe=True)
    expr: Column | None = None
    for i, name in enumerate(names[:-1]):
        cond = F.col(HASH) <= F.col(f"_at{i}")
        expr = F.when(cond, F.lit(name)) if expr is None else expr.when(cond, F.lit(name))
    expr = F.lit(names[-1]) if expr is None else expr.otherwise(F.lit(names[-1]))
    return labelled.withColumn(out, expr).drop(*[f"_at{i}" for i in range(len(names) - 1)])


def _long_cuts(counts: DataFrame, by: Sequence[str], ks: Sequence[Column]) -> DataFrame:
    """``(*by, cut, k)`` from per-stratum rank expressions."""
    pairs = F.array(*[F.struct(F.lit(i).alias("cut"), k.cast("bigint").alias("k")) for i, k in enumerate(ks)])
    return counts.select(*by, F.inline(pairs))


def _hashed(df: DataFrame, key: str, seed) -> DataFrame:
    return df.withColumn(HASH, hash_key(seed, key))


def split_by_group(
    df: DataFrame, key: str, pct: int = 20, g: str = "g", y: str | None = "y", seed: str | int = "split", out: str = "split"
) -> DataFrame:
    """Train/validation/test inside every subgroup: validation and test each get ``int(n_g * pct / 100)`` rows.

    With ``y`` the counts are shared over the labels by largest remainder; validation is shared over what test left. ``y=None`` splits
    without label strata (regression).
    """
    strata = [g, y] if y else [g]

    def cuts(sizes: DataFrame) -> DataFrame:
        total = F.sum("n").over(Window.partitionBy(g))
        counts = sizes.withColumn("_take", F.floor(total * F.lit(pct) / F.lit(100)).cast("bigint"))
        if y:
            counts = allocate(counts, [g], y, "n", "_take", "n_test")
            counts = counts.withColumn("_rest", F.col("n") - F.col("n_test"))
            counts = allocate(counts, [g], y, "_rest", "_take", "n_val")
        else:
            counts = counts.withColumns({"n_test": F.col("_take"), "n_val": F.col("_take")})
        return _long_cuts(counts, strata, [F.col("n_test"), F.col("n_test") + F.col("n_val")])

    return assign_by_cuts(_hashed(df, key, seed), strata, cuts, ["test", "val", "train"], out).drop(HASH)


def fold_cuts(sizes: DataFrame, by: Sequence[str], k: int) -> DataFrame:
    """Cumulative fold sizes per stratum; the first ``n mod k`` folds hold one row more."""
    small, extra = F.floor(F.col("n") / k), F.col("n") % k
    return _long_cuts(sizes, by, [small * (i + 1) + F.least(F.lit(i + 1), extra) for i in range(k - 1)])


def assign_folds(df: DataFrame, key: str, k: int, stratify: str | None = "y", seed: str | int = "fold", out: str = "fold") -> DataFrame:
    """Fold number 0..k-1 of every row, label-stratified or plain."""
    base = _hashed(df.withColumn(ONE, F.lit(0)), key, seed)
    by = [stratify] if stratify else [ONE]
    return assign_by_cuts(base, by, lambda sizes: fold_cuts(sizes, by, k), list(range(k)), out).drop(HASH, ONE)


def _cut_first(df: DataFrame, key: str, by: str | None, size: Column, names: tuple[str, str], seed, out: str) -> DataFrame:
    """Two-way cut: the first ``size`` (an expression of the stratum size ``n``) rows of each stratum in hash order get ``names[0]``."""
    base = _hashed(df.withColumn(ONE, F.lit(0)), key, seed)
    strata = [by] if by else [ONE]
    return assign_by_cuts(base, strata, lambda sizes: _long_cuts(sizes, strata, [size]), list(names), out).drop(HASH, ONE)


def _proportional_val(train: DataFrame, key: str, g: str, share: tuple[int, int], seed, out: str) -> DataFrame:
    """Group-stratified validation cut of ``ceil(n * a / b)`` rows in total, shared over groups by largest remainder."""
    a, b = share

    def cuts(sizes: DataFrame) -> DataFrame:
        counts = sizes.withColumn(ONE, F.lit(0))
        total = F.sum("n").over(Window.partitionBy(ONE))
        counts = counts.withColumn("_take", F.ceil(total * F.lit(a) / F.lit(b)).cast("bigint"))
        return _long_cuts(allocate(counts, [ONE], g, "n", "_take", "n_val"), [g], [F.col("n_val")])

    return assign_by_cuts(_hashed(train, key, seed), [g], cuts, ["val", "train"], out).drop(HASH)


def kfold(
    df: DataFrame, key: str, k: int, fold: int, g: str = "g", stratify: str | None = "y", seed: str | int = "fold", out: str = "split"
) -> DataFrame:
    """One fold as test; of the rest a group-stratified part of ``1/(k-1)`` as validation."""
    folded = assign_folds(df, key, k, stratify, seed, out="_fold")
    test = folded.where(F.col("_fold") == fold).withColumn(out, F.lit("test"))
    rest = _proportional_val(folded.where(F.col("_fold") != fold), key, g, (1, k - 1), f"{seed}-val", out)
    return rest.unionByName(test).drop("_fold")


def holdout_kfold(
    df: DataFrame,
    key: str,
    k: int,
    fold: int,
    test_pct: int = 20,
    stratify: str | None = "y",
    seed: str | int = "fold",
    out: str = "split",
) -> DataFrame:
    """Hold-out test (``ceil`` of the share), then one fold of the rest as validation."""
    size = F.ceil(F.col("n") * F.lit(test_pct) / F.lit(100))
    cut = _cut_first(df, key, None, size, ("test", "rest"), f"{seed}-test", out)
    rest = assign_folds(cut.where(F.col(out) == "rest"), key, k, stratify, seed, out="_fold")
    rest = rest.withColumn(out, F.when(F.col("_fold") == fold, F.lit("val")).otherwise(F.lit("train"))).drop("_fold")
    return rest.unionByName(cut.where(F.col(out) == "test"))


def validation_split(
    df: DataFrame, key: str, pct: int = 20, groups: Sequence[str] = ("g",), seed: str | int = "val", out: str = "split"
) -> DataFrame:
    """Validation part of ``ceil(n * pct / 100)`` rows: per group with one group type, over the whole table with several."""
    size = F.ceil(F.col("n") * F.lit(pct) / F.lit(100))
    by = groups[0] if len(groups) == 1 else None
    return _cut_first(df, key, by, size, ("val", "train"), seed, out)


def ratio_split(
    df: DataFrame, key: str, ratios: Sequence[int] = (60, 20, 20), names: Sequence[str] = ("train", "val", "test"), seed: str | int = "ratio", out: str = "split"
) -> DataFrame:
    """Cut the hash order at the cumulative percentages ``int(cum * n / 100)``."""
    base = _hashed(df.withColumn(ONE, F.lit(0)), key, seed)
    cums = [sum(ratios[: i + 1]) for i in range(len(ratios) - 1)]
    ranks = [F.floor(F.col("n") * F.lit(c) / F.lit(100)) for c in cums]
    return assign_by_cuts(base, [ONE], lambda sizes: _long_cuts(sizes, [ONE], ranks), list(names), out).drop(HASH, ONE)


__all__ = [
    "allocate",
    "assign_by_cuts",
    "assign_folds",
    "holdout_kfold",
    "kfold",
    "ratio_split",
    "split_by_group",
    "validation_split",
]
