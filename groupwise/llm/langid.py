"""Language identification by words first, then ever shorter character n-grams.

Training counts words and character n-grams (lengths 4 to 1, word ends marked) per language on a bounded sample: at most
``per_language`` documents of each language, those with the smallest hash of their id. The counting is a Spark aggregation; the
model keeps the ``entries`` most frequent words and n-grams of each length.

A known word scores its smoothed log frequency in each language. An unseen word is covered from the left by the longest known
n-gram at each place, backing off from 4 characters to 1 with a constant penalty for every step; characters never seen say
nothing. The language with the largest sum over the whole text wins, ties go to the smaller name; the score is its share of the
likelihood.

Null texts and texts without a letter are ``und`` with score 0. Null languages are not learned from. Without training rows every
text is ``und``. Repeated rows are scored one by one.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import settle
from .common import map_rows, sampled_texts

LETTERS = re.compile(r"[^\W\d_]+")
LONGEST = 4
PER_LANGUAGE = 3_000
ENTRIES = 60_000
SMOOTHING = 0.3
STEP = math.log(0.4)
CACHE_CELLS = 4_000_000
CHUNK = 4_096
PART = 50_000


def grams(word: str, n: int) -> Iterator[str]:
    marked = f"^{word}$"
    return (marked[i : i + n] for i in range(len(marked) - n + 1))


def count_grams(texts: DataFrame) -> DataFrame:
    """``lang, kind, gram, n`` from ``(text, lang)``; kind 0 is whole words, else the n-gram length. Combined in the task first."""

    def count(rows: Iterator[tuple]) -> Iterator[tuple]:
        words: dict[str, Counter] = {}

        def flush() -> Iterator[tuple]:
            for lang, counted in words.items():
                seen: Counter = Counter()
                for word, n in counted.items():
                    seen[0, word] += n
                    for k in range(1, LONGEST + 1):
                        for gram in grams(word, k):
                            seen[k, gram] += n
                for (kind, gram), n in seen.items():
                    yield lang, kind, gram, n
            words.clear()

        for text, lang in rows:
            words.setdefault(lang, Counter()).update(LETTERS.findall(text.lower()))
            if sum(map(len, words.values())) > PART:
                yield from flush()
        yield from flush()

    parts = map_rows(texts.select("text", "lang"), count, "lang string, kind int, gram string, n bigint")
    return parts.groupBy("lang", "kind", "gram").agg(F.sum("n").alias("n"))


class LanguageModel:
    """Log frequencies by word and n-gram, one column per language."""

    def __init__(self, counts: list[tuple[str, int, str, int]], smoothing: float = SMOOTHING):
        self.langs = sorted({lang for lang, *_ in counts})
        at = {lang: i for i, lang in enumerate(self.langs)}
        self.tables: list[dict[str, np.ndarray]] = []
        for kind in range(LONGEST + 1):
            table: dict[str, np.ndarray] = {}
            for lang, k, gram, n in counts:
                if k == kind:
                    table.setdefault(gram, np.zeros(len(self.langs)))[at[lang]] += n
            total = sum(table.values(), np.zeros(len(self.langs))) + smoothing * max(1, len(table))
            for gram, row in table.items():
                score = np.log((row + smoothing) / total)
                table[gram] = score - score.mean()  # what all languages share decides nothing
            self.tables.append(table)
        # the n-grams of all lengths in one matrix, with the penalty of their length; row 0 stands for none
        longer = [(gram, row * math.exp(STEP * (LONGEST - k))) for k in range(1, LONGEST + 1) for gram, row in self.tables[k].items()]
        self.places = {gram: i for i, (gram, _) in enumerate(longer, 1)}
        self.weakened = np.array([np.zeros(len(self.langs)), *[row for _, row in longer]])
        self.tables = self.tables[:1]
        self.rows: _WordRows | None = None

    def unseen(self, word: str) -> np.ndarray:
        """Longest known n-gram at each place; its evidence is weakened by ``exp(STEP)`` for each step of backing off."""
        m, get = f"^{word}$", self.places.get
        found = [get(m[i : i + 4]) or get(m[i : i + 3]) or get(m[i : i + 2]) or get(m[i]) or 0 for i in range(len(m))]
        return self.weakened[found].sum(0) / LONGEST

    def predict(self, text: str | None) -> tuple[str, float]:
        words = LETTERS.findall(text.lower()) if text and self.langs else []
        if not any(any(c.isalpha() for c in w) for w in words):
            return "und", 0.0
        if self.rows is None:
            self.rows = _WordRows(self)
        total = np.zeros(len(self.langs))
        for start in range(0, len(words), CHUNK):  # bounded rows in memory, whatever the length of the text
            total += self.rows.of(words[start : start + CHUNK]).sum(0)
        best = int(np.argmax(total))
        return self.langs[best], float(1 / np.exp(total - total[best]).sum())


class _WordRows(dict):
    """Place of a word in one matrix of scores. Unseen words are added as they come, and forgotten when the matrix is full."""

    def __init__(self, model: LanguageModel):
        known = model.tables[0]
        super().__init__((word, i) for i, word in enumerate(known))
        self.model, self.known = model, len(known)
        room = max(2 * CHUNK, CACHE_CELLS // max(1, len(model.langs)))
        self.scores = np.zeros((self.known + room, len(model.langs)))
        for i, row in enumerate(known.values()):
            self.scores[i] = row

    def __missing__(self, word: str) -> int:
        i = self[word] = len(self)
        self.scores[i] = self.model.unseen(word)
        return i

    def of(self, words: list[str]) -> np.ndarray:
        if len(self) + len(words) > len(self.scores):
            for word in list(self)[self.known :]:
                del self[word]
        return self.scores[list(map(self.__getitem__, words))]


def train(docs: DataFrame, labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          per_language: int = PER_LANGUAGE, entries: int = ENTRIES) -> LanguageModel:
    """Learn from the rows of ``labelled`` (``id_col, lang_col``) with a language. The model has at most ``entries`` words and
    ``entries`` n-grams of each length per run, so it is safe to collect and broadcast."""
    labels = labelled.where(F.col(lang_col).isNotNull() & F.col(id_col).isNotNull()).select(id_col, F.col(lang_col).alias("lang"))
    texts = sampled_texts(docs, labels, id_col, text_col, "lang", per_language)
    counts = settle(count_grams(texts))
    rows: list[tuple[str, int, str, int]] = []
    for kind in range(LONGEST + 1):
        top = counts.where(F.col("kind") == kind).orderBy(F.col("n").desc(), "gram", "lang").limit(entries)
        rows += [(r["lang"], kind, r["gram"], r["n"]) for r in top.collect()]
    return LanguageModel(rows)


def predict(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, lang_pred, score`` of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.select(F.col(id_col)).schema[0].dataType.simpleString()

    def score(rows: Iterator[tuple]) -> Iterator[tuple]:
        known = shared.value
        for doc, text in rows:
            yield doc, *known.predict(text)

    return map_rows(docs.select(F.col(id_col), F.col(text_col).cast("string")), score, f"`{id_col}` {kind}, lang_pred string, score double")
