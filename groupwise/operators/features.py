"""Feature transforms: ``fit`` on the train rows with one aggregation, ``transform`` any frame with a projection."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import ratio
from ..lookup import pin
from .ranks import exact_quantiles

MAX_CATEGORIES = 1_000


def _aggregate(df: DataFrame, exprs: dict[str, Column]) -> dict:
    return df.agg(*[e.alias(k) for k, e in exprs.items()]).first().asDict() if exprs else {}


@dataclass
class Standardize:
    """Centre and scale by the population standard deviation; a constant column is only centred."""

    cols: Sequence[str]
    moments: dict[str, tuple[float, float]] = field(default_factory=dict)

    def fit(self, df: DataFrame) -> "Standardize":
        got = _aggregate(df, {f"{c}\0m": F.avg(c) for c in self.cols} | {f"{c}\0s": F.stddev_pop(c) for c in self.cols})
        self.moments = {c: (got[f"{c}\0m"], got[f"{c}\0s"] or 1.0) for c in self.cols}
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: (F.col(c) - F.lit(m)) / F.lit(s) for c, (m, s) in self.moments.items()})


@dataclass
class OneHot:
    """One 0/1 column ``<column>_<value>`` per category seen in train, categories sorted; unseen values give all zeros.

    ``drop``: ``None`` keeps all, ``"if_binary"`` keeps only the second of two categories, ``"last"`` drops the last one.
    ``infer=True`` takes every text column on top of ``cols``. Category counts are checked against ``max_categories``, because each
    one becomes a column.
    """

    cols: Sequence[str] = ()
    drop: str | None = "if_binary"
    infer: bool = False
    max_categories: int = MAX_CATEGORIES
    categories: dict[str, list] = field(default_factory=dict)

    def fit(self, df: DataFrame) -> "OneHot":
        cols = list(self.cols)
        if self.infer:
            cols += [f.name for f in df.schema.fields if f.dataType.simpleString() == "string" and f.name not in cols]
        sizes = _aggregate(df, {c: F.approx_count_distinct(c) for c in cols})
        wide = [c for c in cols if sizes[c] > 1.2 * self.max_categories]
        if wide:
            raise ValueError(f"more than {self.max_categories} categories in {wide}")
        seen = _aggregate(df, {c: F.sort_array(F.collect_set(c)) for c in cols})
        self.categories = {}
        for c in cols:
            values = list(seen[c])
            if len(values) > self.max_categories:
                raise ValueError(f"more than {self.max_categories} categories in {c}")
            if self.drop == "last":
                values = values[:-1]
            elif self.drop == "if_binary" and len(values) == 2:
                values = values[1:]
            self.categories[c] = values
        return self

    def names(self) -> list[str]:
        return [f"{c}_{v}" for c, values in self.categories.items() for v in values]

    def transform(self, df: DataFrame) -> DataFrame:
        made = {
            f"{c}_{v}": F.coalesce(F.col(c) == F.lit(v), F.lit(False)).cast("int")
            for c, values in self.categories.items()
            for v in values
        }
        kept = [F.col(c) for c in df.columns if c not in self.categories]
        return df.select(*kept, *[e.alias(n) for n, e in made.items()])


@dataclass
class MinMax:
    """Scale to [0, 1]; a constant column becomes 0."""

    cols: Sequence[str] | None = None
    exclude: Sequence[str] = ()
    bounds: dict[str, tuple[float, float]] = field(default_factory=dict)

    def fit(self, df: DataFrame) -> "MinMax":
        cols = [c for c in (self.cols or df.columns) if c not in self.exclude]
        got = _aggregate(df, {f"{c}\0l": F.min(c) for c in cols} | {f"{c}\0h": F.max(c) for c in cols})
        self.bounds = {c: (got[f"{c}\0l"], got[f"{c}\0h"]) for c in cols}
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        def scaled(c: str, low, high) -> Column:
            if low is None or high == low:
                return F.when(F.col(c).isNotNull(), F.lit(0.0))
            return (F.col(c) - F.lit(low)) / F.lit(float(high - low))

        return df.withColumns({c: scaled(c, *b) for c, b in self.bounds.items()})


def magnitude_rescale(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Divide each column by the power of ten of its largest absolute value; results lie strictly inside (-10, 10)."""
    top = _aggregate(df, {c: F.max(F.abs(F.col(c))) for c in cols})
    powers = _aggregate(
        df.sparkSession.range(1), {c: F.pow(F.lit(10.0), F.floor(F.log10(F.lit(float(top[c]))))) for c in cols if top[c]}
    )
    return df.withColumns({c: F.col(c) / F.lit(powers[c]) for c in powers})


def quantile_cut(df: DataFrame, column: str, n: int, out: str | None = None, exact: bool = True) -> DataFrame:
    """Bin number 0..n-1 by right-closed quantile bins of the whole column; the minimum itself falls outside and gives NULL.

    ``exact=True`` interpolates linearly between order statistics; ``exact=False`` uses the sketch, in a single pass.
    """
    probs = [i / n for i in range(n + 1)]
    edges = exact_quantiles(df, column, probs) if exact else df.agg(F.percentile_approx(column, probs, 100_000)).first()[0]
    c = F.col(column)
    binned = F.when(c <= F.lit(edges[0]), F.lit(None).cast("int"))
    for i, edge in enumerate(edges[1:]):
        binned = binned.when(c <= F.lit(edge), F.lit(i))
    return df.withColumn(out or f"{column}_bin", binned)


def priors(df: DataFrame, column: str) -> DataFrame:
    """``(column, prior)``: relative frequency of each value."""
    counts = pin(df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))).frame
    total = counts.agg(F.sum("n").alias("total"))
    keyed = counts.withColumn("_k", F.lit(1)).join(total.withColumn("_k", F.lit(1)), "_k")
    return keyed.select(column, ratio("n", "total").alias("prior"))


__all__ = ["Standardize", "OneHot", "MinMax", "magnitude_rescale", "quantile_cut", "priors"]
