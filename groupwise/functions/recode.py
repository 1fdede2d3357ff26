"""Value recoding: label maps, bands, thresholds, label normalisation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import col, flag


def map_value(c: Column | str, mapping: Mapping, on_missing: str = "null") -> Column:
    """Look a code up in ``mapping``; an unmapped code gives NULL, or stops the job with ``on_missing='error'``.

    A NULL code stays NULL in both modes.
    """
    if on_missing not in ("null", "error"):
        raise ValueError(f"on_missing must be 'null' or 'error', not {on_missing!r}")
    c = col(c)
    table = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    found = F.element_at(table, c)
    if on_missing == "null":
        return found
    unknown = c.isNotNull() & ~F.map_contains_key(table, c)
    return F.when(unknown, F.raise_error(F.concat(F.lit("unmapped value: "), c.cast("string")))).otherwise(found)


def map_index(c: Column | str, names: Sequence[str]) -> Column:
    """Positional lookup: 1 is the first name; 0 and positions outside the list give NULL."""
    return F.get(F.array(*[F.lit(n) for n in names]), col(c) - 1)


def binarize(c: Column | str, positives: Sequence[str], negatives: Sequence[str]) -> Column:
    """Text variants of a label to 1/0; anything else is NULL."""
    c = col(c)
    return F.when(c.isin(list(positives)), F.lit(1)).when(c.isin(list(negatives)), F.lit(0))


def invert_label(c: Column | str) -> Column:
    return F.lit(1) - col(c).cast("int")


def bool_to_int(c: Column | str) -> Column:
    return col(c).cast("int")


def code_suffix(c: Column | str) -> Column:
    """Integer value of the last character of a code such as ``A34``."""
    return F.substring(col(c), -1, 1).cast("int")


def width_bin(c: Column | str, width: float, cap: int | None = None) -> Column:
    """``floor(x / width)``, not above ``cap``."""
    bin_id = F.floor(col(c) / F.lit(width)).cast("int")
    return F.least(bin_id, F.lit(cap)) if cap is not None else bin_id


def threshold(c: Column | str, at, op: str = ">=") -> Column:
    """0/1 flag of a comparison with a constant."""
    c = col(c)
    tests = {">=": c >= at, ">": c > at, "<=": c <= at, "<": c < at, "==": c == at}
    return flag(tests[op])


def one_vs_rest(c: Column | str, code) -> Column:
    return flag(col(c) == F.lit(code))


def keep_listed(c: Column | str, values: Sequence[str], other: str = "Other") -> Column:
    """Listed values stay, all others (also NULL) become ``other``."""
    c = col(c).cast("string")
    return F.when(c.isin(list(values)), c).otherwise(F.lit(other))


def bands(c: Column | str, cuts: Sequence[float], names: Sequence[str]) -> Column:
    """Name of the first band with ``x < cut``; the last name covers the rest. NULL stays NULL."""
    if len(names) != len(cuts) + 1:
        raise ValueError("bands needs one name more than cuts")
    c = col(c)
    out = F.when(c.isNull(), F.lit(None).cast("string"))
    for cut, name in zip(cuts, names):
        out = out.when(c < F.lit(cut), F.lit(name))
    return out.otherwise(F.lit(names[-1]))


def argmax_name(cols: Sequence[str], names: Sequence | None = None) -> Column:
    """Name of the largest of several columns; the first maximum wins, NULL columns are passed over."""
    names = list(names or cols)
    top = F.greatest(*[F.col(c) for c in cols])
    out = F.when(F.col(cols[0]) == top, F.lit(names[0]))
    for c, name in zip(cols[1:], names[1:]):
        out = out.when(F.col(c) == top, F.lit(name))
    return out


def duration_seconds(c: Column | str) -> Column:
    """Seconds of a duration text ``[D days ]HH:MM:SS[.f]``; a text of another form gives NULL."""
    c = col(c)
    form = r"^(?:(\d+) days? )?(\d+):(\d+):(\d+(?:\.\d+)?)$"

    def part(i: int) -> Column:
        return F.regexp_extract(c, form, i)

    days = F.when(part(1) == "", F.lit("0")).otherwise(part(1))
    total = (
        days.try_cast("double") * 86400.0
        + part(2).try_cast("double") * 3600.0
        + part(3).try_cast("double") * 60.0
        + part(4).try_cast("double")
    )
    return F.when(c.rlike(form), total)
