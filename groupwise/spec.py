"""Column roles of a table and the checks of a scored frame."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions.numeric import flag


@dataclass(frozen=True)
class TableSpec:
    """Roles of the columns of a table.

    ``cat`` columns are read as text, ``num`` columns as double. ``"all"`` in one role claims every column the other roles do
    not name; ``"none"`` (or an empty tuple) claims nothing.
    """

    cat: tuple[str, ...] | str = ()
    num: tuple[str, ...] | str = ()
    label: str | None = None
    key: str | None = None
    groups: tuple[str, ...] = ()
    extra: dict[str, T.DataType] = field(default_factory=dict)

    def roles(self, columns: list[str]) -> tuple[list[str], list[str]]:
        """``(cat, num)`` with the wildcards resolved against the columns of a table."""
        if self.cat == "all" and self.num == "all":
            raise ValueError("only one role can be 'all'")

        def named(role) -> list[str]:
            return [] if role in ("none", "all", None) else list(role)

        taken = {self.label, self.key, *self.extra}
        cat, num = named(self.cat), named(self.num)
        rest = [c for c in columns if c not in taken and c not in cat and c not in num]
        if self.cat == "all":
            cat = [c for c in columns if c in cat or c in rest]
        elif self.num == "all":
            num = [c for c in columns if c in num or c in rest]
        return cat, num

    def schema(self, columns: list[str]) -> T.StructType:
        """Physical schema for a file with these columns, in file order."""
        cat, num = self.roles(columns)
        kinds = {c: T.StringType() for c in cat} | {c: T.DoubleType() for c in num}
        if self.label:
            kinds.setdefault(self.label, T.StringType())
        if self.key:
            kinds.setdefault(self.key, T.LongType())
        kinds.update(self.extra)
        return T.StructType([T.StructField(c, kinds.get(c, T.StringType())) for c in columns])


def usable_features(spec: TableSpec, columns: list[str], usable=None, drop_groups: bool = False) -> list[str]:
    """Training columns: ``usable`` (empty or None means all), without label and key, optionally without the group columns."""
    picked = list(usable) if usable else list(columns)
    unknown = [c for c in picked if c not in columns]
    if unknown:
        raise ValueError(f"no such columns: {unknown}")
    out = {spec.label, spec.key} | (set(spec.groups) if drop_groups else set())
    return [c for c in picked if c not in out]


def normalize_binary(y: Column | str) -> Column:
    """``{-1, 1}``, boolean or ``{0, 1}`` label to 0/1; any other value stops the job, NULL stays NULL."""
    y = F.col(y) if isinstance(y, str) else y
    v = y.cast("double")
    bad = v.isNotNull() & ~v.isin(-1.0, 0.0, 1.0)
    return F.when(bad, F.raise_error(F.concat(F.lit("not a binary label: "), y.cast("string")))).when(
        v.isNotNull(), flag(v == 1.0)
    )


def is_binary(df: DataFrame, label: str) -> bool:
    """True when the label has exactly two distinct values (at most three reach the driver)."""
    return len(df.select(label).where(F.col(label).isNotNull()).distinct().limit(3).collect()) == 2


def require_columns(df: DataFrame, *cols: str) -> DataFrame:
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"scored frame lacks {missing}; it has {df.columns}")
    return df
