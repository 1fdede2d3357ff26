"""Ranked lexical search in reverse: the items are indexed, the documents are streamed.

The terms of the items form an inverted index (term to items, with the term's weight times its count in the item), which is broadcast.
Every task streams its documents: a document's term counts go through the index once and give its score for all items, and every item keeps a
heap of its ``top`` best documents. Heaps are merged per item in two levels, so an item's merge reads at most ``MERGERS * top`` rows in its last
task. Documents are never shuffled.

The index is bounded: items are dealt into batches of about ``postings`` term occurrences (one longer item is a batch by itself), and every batch is one pass over
the documents, after one pass for the counts (documents, terms, documents per term of the items). Items are therefore no limit to
memory; the number of passes grows with them.

Terms are the maximal runs of ASCII letters, digits and characters beyond ASCII; only A-Z are lower-cased. Weights, lengths and scores are
whole numbers (see :func:`term_weight`, :func:`length_factor`), so results do not depend on the order of summing. Null and empty texts have no terms: as
documents they are found by nothing, as items they find nothing. Rows that repeat are documents of their own; null document ids are last among
equal scores. Rows of one item id (null is an id like others) are one item: its different texts one after the other. Long texts are read whole. Empty tables give an empty table, further columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import settle
from .common import map_rows, text_of

TOP = 20
POSTINGS = 500_000
MERGERS = 64
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms(text: bytes | None) -> list[bytes]:
    """The terms of a UTF-8 text, in order."""
    return text.translate(TABLE).split() if text else []


def term_weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


def length_factor(n: int, documents: int, length: int) -> int:
    return 100 - 25 + (25 * n * documents) // length


def item_batches(items: DataFrame, id_col: str, text_col: str, postings: int) -> list[DataFrame]:
    """``id, text`` of the items in batches of at most ``postings`` terms (counted as half the bytes), a longer item by itself."""
    texts = items.select(F.col(id_col).alias("id"), text_of(text_col).alias("text")).distinct()
    whole = settle(texts.groupBy("id").agg(F.array_join(F.array_sort(F.collect_list("text")), "\n").alias("text")))
    size = F.floor(F.octet_length("text") / 2).cast("bigint") + 1  # a term and what ends it take two bytes at least
    small, n = whole.where(size <= postings), 1
    while True:
        bucket = F.pmod(F.xxhash64("id", "text"), F.lit(n))
        if (small.groupBy(bucket.alias("b")).agg(F.sum(size).alias("s")).agg(F.max("s")).first()[0] or 0) <= postings:
            break
        n *= 2
    batches = [small.where(bucket == i) for i in range(n)]
    return batches + [whole.where(F.col("id").eqNullSafe(F.lit(r["id"]))) for r in whole.where(size > postings).select("id").collect()]


def _documents(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"))


def corpus_counts(docs: DataFrame, vocabulary: frozenset[bytes]) -> tuple[int, int, dict[bytes, int]]:
    """Documents with terms, all their terms, and documents per term of the vocabulary. Every task counts; the sums are one row per term."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def count(rows: Iterator[tuple]) -> Iterator[tuple]:
        documents, length, holding = 0, 0, Counter()
        for _, text in rows:
            found = terms(text)
            if found:
                documents, length = documents + 1, length + len(found)
                holding.update(shared.value.intersection(found))
        yield None, documents, length
        for t, n in holding.items():
            yield t, n, 0

    rows = map_rows(docs, count, "term binary, n bigint, m bigint").groupBy("term").agg(F.sum("n").alias("n"), F.sum("m").alias("m")).collect()
    totals = [r for r in rows if r["term"] is None]
    return sum(r["n"] for r in totals), sum(r["m"] for r in totals), {bytes(r["term"]): r["n"] for r in rows if r["term"] is not None}


def inverted_index(items: list[Counter], documents: int, holding: dict[bytes, int]) -> dict[bytes, tuple[np.ndarray, np.ndarray]]:
    """Term to the items that hold it and their gains: weight times count."""
    lists: dict[bytes, tuple[list, list]] = {}
    for i, counts in enumerate(items):
        for t, n in counts.items():
            if t in holding:
                at, gain = lists.setdefault(t, ([], []))
                at.append(i)
                gain.append(n * term_weight(documents, holding[t]))
    return {t: (np.array(at, "int64"), np.array(gain, "int64")) for t, (at, gain) in lists.items()}


def search_batch(docs: DataFrame, items: list[Counter], documents: int, length: int, holding: dict[bytes, int], top: int) -> DataFrame:
    """``i int, doc_id bigint, score bigint``: the heaps of all tasks."""
    shared = docs.sparkSession.sparkContext.broadcast(inverted_index(items, documents, holding))
    n_items = len(items)

    def stream(rows: Iterator[tuple]) -> Iterator[tuple]:
        index = shared.value
        heaps: list[list] = [[] for _ in range(n_items)]
        floor = np.ones(n_items, "int64")  # scores below do not enter the heap
        for doc, text in rows:
            found = terms(text)
            if not found:
                continue
            counts = Counter(found)
            m = 12 * length_factor(len(found), documents, length)
            score = np.zeros(n_items, "int64")
            for t in index.keys() & counts.keys():
                at, gain = index[t]
                score[at] += gain * ((10**9 * counts[t]) // (1000 * counts[t] + m))
            for i in np.flatnonzero(score >= floor).tolist():
                entry = (int(score[i]), doc is not None, -(doc or 0))
                if len(heaps[i]) < top:
                    heapq.heappush(heaps[i], entry)
                else:
                    heapq.heappushpop(heaps[i], entry)
                if len(heaps[i]) == top:
                    floor[i] = heaps[i][0][0]
        for i, heap in enumerate(heaps):
            for s, known, minus in heap:
                yield i, -minus if known else None, s

    return map_rows(docs, stream, "i int, doc_id bigint, score bigint")


def search(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    top: int = TOP,
    postings: int = POSTINGS,
) -> DataFrame:
    """``item_col, rank, doc_id, score``: of every item its ``top`` documents with the highest score above 0, ties to the smaller id."""
    spark = docs.sparkSession
    rows = _documents(docs, id_col, text_col)
    kind = items.schema[item_col].dataType.simpleString()
    out = spark.createDataFrame([], f"item {kind}, doc_id bigint, score bigint, task int")
    for batch in item_batches(items, item_col, item_text_col, postings):
        held = batch.select("id", F.col("text").cast("binary").alias("text")).collect()  # at most `postings` terms, or one item
        names = [r["id"] for r in held]
        counted = [Counter(terms(bytes(r["text"]))) for r in held]
        documents, length, holding = corpus_counts(rows, frozenset().union(*counted))
        if not documents or not holding:
            continue
        heaps = search_batch(rows, counted, documents, length, holding, top).withColumn("task", F.pmod(F.spark_partition_id(), F.lit(MERGERS)))
        named = spark.createDataFrame(list(enumerate(names)), f"i int, item {kind}")
        found = heaps.join(F.broadcast(named), "i").select("item", "doc_id", "score", "task")
        out = out.unionByName(found)
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    first = out.withColumn("n", F.row_number().over(Window.partitionBy("item", "task").orderBy(*order))).where(F.col("n") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= top)
    return ranked.select(F.col("item").alias(item_col), "rank", "doc_id", "score")
