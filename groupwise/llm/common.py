"""Helpers the operators of this subpackage share."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..lookup import attach

IN_ROWS = 500
OUT_ROWS = 2_000
WORD = r"[^\x20\x09-\x0D]+"


def text_of(column: str = "text") -> Column:
    """The text, with null as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def crc_bucket(column: str, buckets: int) -> Column:
    """``crc32(id as text) mod buckets``; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))), F.lit(buckets)).cast("int")


def word_count(column: Column) -> Column:
    return F.regexp_count(column, F.lit(WORD)).cast("bigint")


def bounded_ids(rows: DataFrame, id_col: str, by: str, most: int) -> DataFrame:
    """``(id_col, by)`` of at most ``most`` rows per value of ``by``: those with the smallest md5 of the id.

    Only ids move. The size of each value tells below which hash its smallest lie, so only somewhat more than ``most`` rows per value
    are ranked, however many there are.
    """
    order = F.md5(F.concat_ws("|", F.lit("sample"), F.col(id_col).cast("string")))
    keyed = rows.select(id_col, by, order.alias("_order"))
    near = (F.conv(F.substring("_order", 1, 12), 16, 10).cast("double") + 1) / F.lit(16.0**12)
    sizes = keyed.groupBy(by).agg(F.count(F.lit(1)).alias("_n"))
    margin = 1.3 * most + 300
    while True:
        cut = attach(keyed, sizes, [by], null_safe=True).where(near <= F.lit(margin) / F.col("_n"))
        found = attach(sizes, cut.groupBy(by).agg(F.count(F.lit(1)).alias("_c")), [by], how="left", null_safe=True)
        if found.where(F.coalesce("_c", F.lit(0)) < F.least("_n", F.lit(most))).isEmpty():
            break
        margin *= 2
    w = Window.partitionBy(by).orderBy("_order", id_col)
    return cut.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= most).select(id_col, by)


def sampled_texts(docs: DataFrame, labelled: DataFrame, id_col: str, text_col: str, by: str, most: int) -> DataFrame:
    """``(text, by)`` of the rows chosen by :func:`bounded_ids`. Their ids are broadcast: ``most`` rows per value of ``by``."""
    ids = bounded_ids(labelled, id_col, by, most).dropDuplicates([id_col])
    return docs.select(F.col(id_col), text_of(text_col).alias("text")).join(F.broadcast(ids), id_col).select("text", by)


def hand_back() -> None:
    """Return what a task has freed to the system: Python workers stay for later tasks, and an executor's limit counts all of them."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc
    if trim:
        trim(0)


_CACHES: dict[str, dict] = {}


def worker_cache(kind: str = "") -> dict:
    """What tasks of one kind keep in a worker process for later ones; when a task of another kind starts, it goes back to the system."""
    if kind not in _CACHES and _CACHES:
        _CACHES.clear()
        hand_back()
    return _CACHES.setdefault(kind, {})


def map_rows(df: DataFrame, fn, schema: str, kind: str = "") -> DataFrame:
    """``mapInArrow`` for a function from an iterator of row tuples to an iterator of row tuples. ``kind``: of its :func:`worker_cache`."""
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache(kind)

        def rows() -> Iterator[tuple]:
            for batch in batches:
                for start in range(0, batch.num_rows, IN_ROWS):  # Python's copies of texts are made for a few rows at a time
                    yield from zip(*[c.to_pylist() for c in batch.slice(start, IN_ROWS).columns])

        def pack(part: list[tuple]) -> pa.RecordBatch:
            columns = [pa.array(list(c), type=f.type) for c, f in zip(zip(*part), arrow)]
            return pa.RecordBatch.from_arrays(columns, names=arrow.names)

        part: list[tuple] = []
        for row in fn(rows()):
            part.append(row)
            if len(part) >= OUT_ROWS:
                yield pack(part)
                part = []
        if part:
            yield pack(part)
        hand_back()

    return df.mapInArrow(run, schema)
