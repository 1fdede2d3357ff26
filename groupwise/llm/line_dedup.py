"""Line dedup by winnowing over line hashes.

A document is a sequence of units: a line with words gives one unit per started ``unit_words`` words (the line's hash with the
unit's number), so that a run is long enough either by many short lines or by a long one. Lines without words have no unit; they
stay unless they lie inside a deleted run. Of every ``window`` consecutive unit hashes the smallest (the last of equals) is a fingerprint; two runs of ``window`` equal
units always select the same one, so none is missed. With 3 units of 25 words, every repeated run of whole lines with more than 50
words is found. Text that shares a line with other text is not found: the units of a line carry the hash of the whole line.

Positions of a fingerprint are joined through its first and last occurrence: a fingerprint that occurs once is dropped. From the positions
left the match is extended both ways: every window that selected the position is compared by content (a 128-bit digest of its
lines), and overlapping windows chain to the maximal run. The first occurrence of a window, in order of document id and position, stays; a line is
deleted when a later window covers it. Each window meets only its first occurrence, so a passage shared by many documents gives
one row per occurrence and no pairs; the aggregations combine in the tasks first, and the joins are ordinary ones whose skewed partitions Spark
splits. DataFrame functions only.

Null texts count as empty: one empty line, nothing deleted. Null ids come first. Rows that repeat id and text are one place: neither is
the later one. Repeated rows are all returned. An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import settle
from .common import WORD, text_of

UNIT_WORDS = 25
WINDOW = 3


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def positions(docs: DataFrame, id_col: str, text_col: str, unit_words: int = UNIT_WORDS, window: int = WINDOW) -> DataFrame:
    """``place, fp, windows``: the selected fingerprints of every document with the windows that select them.

    ``place`` is the id and a hash of the text; a window has its start, its first and last line, and the digest of its content.
    """
    text = text_of(text_col)
    rows = docs.select(F.struct(F.col(id_col).alias("id"), F.xxhash64(text).alias("t")).alias("place"), _lines(text).alias("lines"))
    per_line = F.transform(
        "lines",
        lambda line, i: F.struct(i.alias("i"), F.md5(line).alias("d"), F.ceil(F.regexp_count(line, F.lit(WORD)) / F.lit(unit_words)).alias("n")),
    )
    full = F.filter(per_line, lambda x: x["n"] > 0)
    units = F.flatten(
        F.transform(
            full,
            lambda x: F.transform(
                F.sequence(F.lit(1), x["n"].cast("int")),
                lambda j: F.struct(F.xxhash64(x["d"], j).alias("h"), x["i"].alias("i"), F.concat_ws(":", x["d"], j).alias("c")),
            ),
        )
    )
    rows = rows.select("place", units.alias("u")).where(F.size("u") >= window)
    starts = F.sequence(F.lit(1), F.size("u") - F.lit(window - 1))

    def one(s: Column) -> Column:
        part = F.slice("u", s, window)
        best = F.array_min(F.transform(part, lambda x, k: F.struct(x["h"].alias("h"), (-k).alias("k"))))
        return F.struct(
            (s - best["k"]).alias("p"),
            best["h"].alias("fp"),
            s.alias("s"),
            part[0]["i"].alias("lo"),
            part[window - 1]["i"].alias("hi"),
            F.unhex(F.md5(F.array_join(F.transform(part, lambda x: x["c"]), ","))).alias("c"),
        )

    found = rows.select("place", F.explode(F.transform(starts, one)).alias("w"))
    window_of = F.struct("w.s", "w.lo", "w.hi", "w.c")
    return found.select("place", F.col("w.fp").alias("fp"), F.col("w.p").alias("p"), window_of.alias("w"))


def repeated_windows(docs: DataFrame, id_col: str, text_col: str, **options) -> DataFrame:
    """``place, s, lo, hi``: the windows whose content occurs before."""
    found = settle(positions(docs, id_col, text_col, **options))
    ends = found.groupBy("fp").agg(F.min(F.struct("place", "p")).alias("a"), F.max(F.struct("place", "p")).alias("b"))
    shared = ends.where(F.col("a") != F.col("b")).select("fp")
    near = found.join(shared, "fp").select("place", "w.*")
    first = near.groupBy("c").agg(F.min(F.struct("place", "s")).alias("first"), F.max(F.struct("place", "s")).alias("last"))
    first = first.where(F.col("first") != F.col("last")).select("c", "first")
    return near.join(first, "c").where(F.struct("place", "s") > F.col("first")).select("place", "s", "lo", "hi")


def deleted_runs(docs: DataFrame, id_col: str, text_col: str, **options) -> DataFrame:
    """``place, runs``: per document its deleted runs of lines, maximal, ``lo`` and ``hi`` included, from 0."""
    rows = repeated_windows(docs, id_col, text_col, **options).groupBy("place").agg(F.collect_set(F.struct("lo", "hi")).alias("w"))

    def chain(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        grown = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last["lo"].alias("lo"), F.greatest(last["hi"], x["hi"]).alias("hi"))))
        return F.when((F.size(acc) > 0) & (x["lo"] <= last["hi"] + 1), grown).otherwise(F.concat(acc, F.array(x)))

    none = F.expr("cast(array() as array<struct<lo: int, hi: int>>)")
    return rows.select("place", F.aggregate(F.array_sort("w"), none, chain).alias("runs"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit_words: int = UNIT_WORDS, window: int = WINDOW) -> DataFrame:
    """Every row of ``docs`` with all its columns; ``text_col`` without the deleted lines, and a new column ``deleted_runs``."""
    if "deleted_runs" in docs.columns:
        raise ValueError("the documents have a column deleted_runs already; rename it")
    runs = deleted_runs(docs, id_col, text_col, unit_words=unit_words, window=window)
    text = text_of(text_col)
    rows = docs.select(F.struct("*").alias("_row"), F.struct(F.col(id_col).alias("id"), F.xxhash64(text).alias("t")).alias("_place"))
    joined = rows.join(runs, rows["_place"].eqNullSafe(runs["place"]), "left")
    lines = _lines(F.coalesce(F.col(f"_row.{text_col}").cast("string"), F.lit("")))
    stay = F.filter(lines, lambda x, i: ~F.exists("runs", lambda r: (r["lo"] <= i) & (i <= r["hi"])))
    clean = F.when(F.col("runs").isNull(), F.col(f"_row.{text_col}")).otherwise(F.array_join(stay, "\n"))
    others = [F.col(f"_row.`{c}`") for c in docs.columns if c != text_col]
    none = F.expr("cast(array() as array<struct<lo: int, hi: int>>)")
    return joined.select(*others, clean.alias(text_col), F.coalesce("runs", none).alias("deleted_runs"))
