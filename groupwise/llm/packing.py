"""Best-fit packing of token sequences under several capacities.

A document becomes token ids, then the end id; only documents longer than a sequence are cut. A piece is a vector of demands
(tokens, one document, attention cost = square of its length), a bin has a capacity for each. Pieces are placed longest first, each
into the feasible bin with the best score: the smallest norm of the residual left, or the largest weighted dot product of demand and
residual.

Pieces of equal length have equal demands and bins in equal states are interchangeable, so the placement works on *counts*: pieces
per length (at most ``capacity`` numbers, whatever the corpus) and bins per residual state. The driver turns these counts into
slots, each a range of equal pieces for a range of bins, and every piece finds its slot from its rank within its length on the
executors. Ranks are counted in two levels, so one common length is spread over many tasks. No list of pieces or bins reaches
the driver.

Null text counts as empty; an empty document is its end id alone. Repeated rows are packed one by one. Null ids are kept. An empty
table gives an empty table.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..lookup import attach
from ..session import settle
from .common import map_rows, text_of, worker_cache

CAPACITY = 4096
END_ID = 1
CACHE_WORDS = 400_000
RANK_PIECE = 500
# str.split() also cuts at these four, which the tokenizer gives ids
SEPARATORS = "\x1c\x1d\x1e\x1f"
TOKENIZER_WORD = re.compile(r"[^\x09-\x0d\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")


@dataclass(frozen=True)
class Limits:
    """Capacities of one sequence: tokens, documents, and the sum of squared lengths of its pieces."""

    tokens: int = CAPACITY
    documents: int = CAPACITY
    attention: int = CAPACITY * CAPACITY

    def most(self, length: int, left: tuple[int, int, int]) -> int:
        """How many pieces of this length fit into what is left of a bin."""
        return min(left[0] // length, left[1], left[2] // (length * length))


class WordEncoder:
    """Ids of a text by a word-level tokenizer file, as little-endian unsigned 32-bit bytes.

    The white space the tokenizer removes always ends a word, so ids are kept per word. Words of Latin letters are also kept in lower
    case and without a full stop or comma after them, so that their other spellings need no tokenizing. Caches are emptied when full.
    """

    def __init__(self, content: str, cache_words: int = CACHE_WORDS):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(content)
        self.model = self.tokenizer.model
        self.most = cache_words
        self.seen: dict[str, bytes] = {}
        self.units: dict[str, bytes] = {}
        self.packed = [i.to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size())]
        # bytes shown as letters by byte-level vocabularies: printable ones stand for themselves, the others follow from 256 on
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in shown]
        self.letters = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}

    def _unit(self, word: str) -> bytes:
        """Ids of a word of letters below U+0100, which is one unit of the model."""
        low = word.lower()
        got = self.units.get(low)
        if got is None:
            unit = low if low.isascii() else "".join(map(self.letters.__getitem__, unicodedata.normalize("NFC", low).encode()))
            got = b"".join([self.packed[t.id] for t in self.model.tokenize(unit)])
            if len(self.units) >= self.most:
                self.units.clear()
            self.units[low] = got
        return got

    def _ids(self, word: str) -> bytes:
        if word.isalpha() and max(word) < "Ā":
            return self._unit(word)
        return b"".join([self.packed[i] for i in self.tokenizer.encode(word, add_special_tokens=False).ids])

    def _add(self, word: str) -> bytes:
        core = word[:-1]
        if word[-1] in ".," and core.isalpha():
            got = self._ids(core) + (self.seen.get(word[-1]) or self._add(word[-1]))
        else:
            got = self._ids(word)
        if len(self.seen) >= self.most:
            self.seen.clear()
        self.seen[word] = got
        return got

    def __call__(self, text: str) -> bytes:
        get, add = self.seen.get, self._add
        words = TOKENIZER_WORD.findall(text) if any(c in text for c in SEPARATORS) else text.split()
        return b"".join([get(w) or add(w) for w in words])


def _encoder(content: str) -> WordEncoder:
    """One encoder per worker process, so that its word cache serves all tasks."""
    key, held = zlib.crc32(content.encode()), worker_cache("packing")
    if key not in held:
        held.clear()
        held[key] = WordEncoder(content)
    return held[key]


def token_pieces(
    docs: DataFrame,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    keep_ids: bool = True,
) -> DataFrame:
    """``id_col, piece, start, length, ids_crc32`` and, with ``keep_ids``, ``ids``: the pieces of every document."""
    sc = docs.sparkSession.sparkContext
    content = sc.broadcast(Path(tokenizer_path).read_text(encoding="utf-8"))  # a vocabulary file, of fixed size
    kind = docs.select(F.col(id_col)).schema[0].dataType.simpleString()

    def cut(rows: Iterator[tuple]) -> Iterator[tuple]:
        encode = _encoder(content.value)
        end = np.array([end_id], "<u4").tobytes()
        for doc, text in rows:
            data = encode(text) + end
            for piece, at in enumerate(range(0, len(data), 4 * capacity)):
                part = data[at : at + 4 * capacity]
                row = (doc, piece, at // 4, len(part) // 4, zlib.crc32(part))
                yield (*row, np.frombuffer(part, "<u4").astype("<i4").tolist()) if keep_ids else row

    schema = f"`{id_col}` {kind}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<int>" * keep_ids
    return map_rows(docs.select(F.col(id_col), text_of(text_col)), cut, schema, "packing")


def plan_slots(counts: dict[int, int], limits: Limits, score: str = "norm", weights: tuple = (1.0, 1.0, 1.0)) -> pd.DataFrame:
    """Slots ``length, rank, bin, each, offset``: pieces of a length from ``rank`` on fill bins from ``bin`` on, ``each`` per bin,
    starting at ``offset`` in the bin."""
    full = (limits.tokens, limits.documents, limits.attention)
    scale = np.array(weights, float) / np.array(full, float)
    states: dict[tuple, list[tuple[int, int]]] = {}  # residual -> ranges (first bin, bins)
    slots, bins = [], 0

    def put(left: tuple, first: int, n: int, each: int, length: int, rank: int) -> int:
        slots.append((length, rank, first, each, limits.tokens - left[0]))
        after = (left[0] - each * length, left[1] - each, left[2] - each * length * length)
        if after[0] and after[1]:
            states.setdefault(after, []).append((first, n))
        return n * each

    for length in sorted(counts, reverse=True):
        rank, todo = 0, counts[length]
        demand = np.array((length, 1, length * length), float) * scale
        while rank < todo:
            fit = [s for s in states if s[0] >= length and s[2] >= length * length]
            if fit:
                left = np.array(fit, float) * scale
                value = -np.linalg.norm(left - demand, axis=1) if score == "norm" else left @ demand
                best = fit[int(np.argmax(value))]
                first, n = states[best].pop()
                if not states[best]:
                    del states[best]
            else:
                best, first, n = full, bins, -(-(todo - rank) // limits.most(length, full))
                bins += n
            each = limits.most(length, best)
            whole = min(n, (todo - rank) // each)
            if whole:
                rank += put(best, first, whole, each, length, rank)
            if whole < n and rank < todo:  # fewer are left than one bin takes
                rank += put(best, first + whole, 1, todo - rank, length, rank)
                whole += 1
            if whole < n:
                states.setdefault(best, []).append((first + whole, n - whole))
    return pd.DataFrame(slots, columns=["length", "rank", "bin", "each", "offset"])


def pack_pieces(pieces: DataFrame, limits: Limits = Limits(), score: str = "norm", weights: tuple = (1.0, 1.0, 1.0)) -> DataFrame:
    """``pieces`` (with a column ``length``) plus ``sequence_id`` and ``offset``.

    A piece that no empty bin could take is an error: cut the documents to ``limits.tokens`` first, and allow at least one document
    and ``tokens * tokens`` of attention.
    """
    rows = settle(pieces.withColumn("_r", F.monotonically_increasing_id()))
    counts = {int(x["length"]): x["count"] for x in rows.groupBy("length").count().collect()}  # at most limits.tokens numbers
    if any(limits.most(n, (limits.tokens, limits.documents, limits.attention)) < 1 for n in counts):
        raise ValueError("a piece is larger than an empty sequence")
    slots = plan_slots(counts, limits, score, weights)
    lengths = {n: tuple(t[c].to_numpy("int64") for c in ("rank", "bin", "each", "offset")) for n, t in slots.groupby("length")}

    spark = rows.sparkSession
    sizes = spark.createDataFrame([(n, -(-c // RANK_PIECE)) for n, c in counts.items()] or [(0, 1)], "length bigint, _parts bigint")
    cut = attach(rows, sizes, ["length"]).withColumn("_part", F.pmod(F.xxhash64("_r"), F.col("_parts")))
    sums = cut.groupBy("length", "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    ahead = sums.select("length", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_ahead"))
    narrow = cut.select("length", "_part", "_r")
    inside = Window.partitionBy("length", "_part").orderBy("_r")
    ranked = narrow.withColumn("_i", F.row_number().over(inside) - 1).join(ahead, ["length", "_part"])
    table = spark.sparkContext.broadcast(lengths)

    @F.pandas_udf("sequence_id bigint, offset bigint")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        seq, off = np.zeros(len(length), "int64"), np.zeros(len(length), "int64")
        sizes_, ranks = length.to_numpy(), rank.to_numpy()
        for n in np.unique(sizes_):
            at = sizes_ == n
            start, first, each, offset = table.value[n]
            slot = np.searchsorted(start, ranks[at], "right") - 1
            j = ranks[at] - start[slot]
            seq[at] = first[slot] + j // each[slot]
            off[at] = offset[slot] + (j % each[slot]) * n
        return pd.DataFrame({"sequence_id": seq, "offset": off})

    placed = ranked.select("_r", place("length", (F.col("_i") + F.col("_ahead")).cast("bigint")).alias("_p"))
    return rows.join(placed, "_r").select(*pieces.columns, "_p.sequence_id", "_p.offset")


def pack_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", limits: Limits = Limits(),
                   end_id: int = END_ID, keep_ids: bool = True, score: str = "norm") -> DataFrame:
    """Pieces of all documents with their ids and places."""
    pieces = token_pieces(docs, tokenizer_path, id_col, text_col, limits.tokens, end_id, keep_ids)
    return pack_pieces(pieces, limits, score)


def sequences(packed: DataFrame) -> DataFrame:
    """``sequence_id, ids, starts``: the token sequences; a sequence has at most the capacity's tokens."""
    parts = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    return parts.select("sequence_id", F.flatten(F.col("p.ids")).alias("ids"), F.col("p.offset").alias("starts"))
