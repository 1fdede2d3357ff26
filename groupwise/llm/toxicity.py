"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence has probability ``sigmoid(bias + sum of feature weights)``; the document's probability
is the noisy-or ``1 - prod(1 - p)``. Only document labels are needed: the gradient of the document likelihood tells each sentence
its share, so the offending sentences are found without ever being labelled.

Features of a sentence are its lower-case words and the starts of longer words (inflected forms share them). Training uses a bounded sample: at most
``per_class`` labelled documents of each label, those with the smallest hash of their id, brought to the driver. Their most telling
features (chi-square over documents of at least ``LEAST_CHI``, at most ``features``) are weighted by full-batch gradient steps, all in numpy. Scoring runs
on the executors over whole texts.

Null and empty texts have no sentence and score 0. Labels other than 0 and 1 are ignored; without a labelled document of both
kinds every score is 0. Repeated rows are scored one by one.
"""

from __future__ import annotations

import math
import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hand_back, map_rows, sampled_texts, worker_cache

SENTENCE = re.compile(r"[.!?\n]+")
WORDS = re.compile(r"[^\W\d_]+")
STARTS = (4, 5, 6)
PER_CLASS = 3_000
FEATURES = 4_000
MIN_DOCS = 4
STEPS = 250
RATE = 0.15
RIDGE = 2e-5
START_BIAS = -9.0
LEAST_CHI = 20.0
PIECE = 1 << 17
CACHE_WORDS = 100_000
THRESHOLD = 0.5


def features_of(word: str) -> list[str]:
    return [word] + [word[:n] + "*" for n in STARTS if len(word) > n]


def sentences_of(text: str) -> list[tuple[int, int]]:
    """Code point spans of the sentences, without the marks between them."""
    out, at = [], 0
    for m in SENTENCE.finditer(text):
        if m.start() > at:
            out.append((at, m.start()))
        at = m.end()
    if at < len(text):
        out.append((at, len(text)))
    return out


class _WordWeights(dict):
    """Weight of a word, worked out when first asked for; emptied when full."""

    def __init__(self, weights: dict[str, float]):
        super().__init__()
        self.weights = weights

    def __missing__(self, word: str) -> float:
        if len(self) > CACHE_WORDS:
            self.clear()
        value = self[word] = sum(self.weights.get(f, 0.0) for f in features_of(word)) or 0.0  # most words share this zero
        return value

    def __reduce__(self):
        return _WordWeights, (self.weights,)


class ToxicityModel:
    """Feature weights and bias; the number of weights is bounded by the features kept in training."""

    def __init__(self, weights: dict[str, float], bias: float):
        self.weights, self.bias = weights, bias
        self.words = _WordWeights(weights)

    def stay(self, evidence: float) -> float:
        """Log probability that a sentence with this sum of weights does not offend."""
        z = self.bias + evidence
        return -(z + math.log1p(math.exp(-z))) if z > 0 else -math.log1p(math.exp(z))

    def document(self, text: str | None) -> tuple[float, list[tuple[int, int, float]]]:
        """Noisy-or of the sentences, and the spans of the sentences that reach the threshold alone."""
        weight, words = self.words.__getitem__, WORDS.findall
        plain, evidence = 0, []
        for sentence in SENTENCE.split((text or "").lower()):
            if sentence:
                e = sum(map(weight, words(sentence)))
                if e:
                    evidence.append(e)
                else:
                    plain += 1
        if not plain and not evidence:
            return 0.0, []
        total = plain * self.stay(0.0) + sum(map(self.stay, evidence))
        found = []
        if evidence and -math.expm1(self.stay(max(evidence))) >= THRESHOLD:
            for a, b in sentences_of(text):
                p = -math.expm1(self.stay(sum(map(weight, words(text[a:b].lower())))))
                if p >= THRESHOLD:
                    found.append((a, b, p))
        return -math.expm1(total), found


def fit(texts: Iterable[str], labels: list[int], features: int = FEATURES, steps: int = STEPS) -> ToxicityModel:
    """Noisy-or likelihood over the bags, by Adam steps with a ridge. The texts are read once, one by one."""
    y = np.array(labels)
    if not (y == 1).any() or not (y == 0).any():
        return ToxicityModel({}, -60.0)
    # words as numbers: the texts of the sample would take ten times their size as lists of words
    number: dict[str, int] = {}
    words, ends, doc, bounds = array("i"), array("i"), array("i"), array("i", [0])
    for d, t in enumerate(texts):
        for a, b in sentences_of(t):
            words.extend([number.setdefault(w, len(number)) for w in WORDS.findall(t[a:b].lower())])
            ends.append(len(words))
            doc.append(d)
        bounds.append(len(words))
    words, ends, doc = np.frombuffer(words, "int32"), np.frombuffer(ends, "int32"), np.array(doc, int)
    known: dict[str, int] = {}
    flat, starts = array("i"), array("i", [0])
    for w in number:
        flat.extend([known.setdefault(f, len(known)) for f in features_of(w)])
        starts.append(len(flat))
    del number
    flat, starts = np.frombuffer(flat, "int32"), np.frombuffer(starts, "int32")

    def spread(word_ids: np.ndarray, beside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The features of each word, with the value beside it."""
        sizes = starts[word_ids + 1] - starts[word_ids]
        inside = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        return flat[np.repeat(starts[word_ids], sizes) + inside], np.repeat(beside, sizes)

    seen = np.zeros((2, len(known)), int)
    for d, label in enumerate(labels):
        own = np.unique(words[bounds[d] : bounds[d + 1]])
        seen[int(label == 1), np.unique(spread(own, own)[0])] += 1
    total = np.array([(y == 0).sum(), (y == 1).sum()], float)

    def chi(f: int) -> float:
        a, b = int(seen[1, f]), int(seen[0, f])
        c, d = total[1] - a, total[0] - b
        n, top = a + b + c + d, a * d - b * c
        return n * top * top / max(1.0, (a + b) * (c + d) * (a + c) * (b + d)) if top > 0 else 0.0

    spelled = list(known)
    often = np.flatnonzero((seen[1] > 0) & (seen.sum(0) >= MIN_DOCS)).tolist()
    telling = {f: c for f in often if (c := chi(f)) >= LEAST_CHI}
    chosen = sorted(telling, key=lambda f: (-telling[f], spelled[f]))[:features]
    names = [spelled[f] for f in chosen]
    at = np.full(len(known), -1)
    at[chosen] = np.arange(len(chosen))
    hits = np.append(0, np.cumsum(at[flat] >= 0))
    told = hits[starts[1:]] > hits[starts[:-1]]  # words with a chosen feature
    pieces = [(np.zeros(0, int), np.zeros(0, int))]
    for start in range(0, len(words), PIECE):  # the features of all words at once would take many times what is kept of them
        place = start + np.flatnonzero(told[words[start : start + PIECE]])
        feat, sent = spread(words[place], np.searchsorted(ends, place, "right"))
        pieces.append((at[feat[at[feat] >= 0]], sent[at[feat] >= 0]))
    feat, sent = (np.concatenate(x) for x in zip(*pieces))
    del pieces, words, ends, known, spelled, flat, starts, seen
    theta = np.append(np.zeros(len(names)), START_BIAS)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        z = np.bincount(sent, theta[feat], len(doc)) + theta[-1]
        soft = np.logaddexp(0, z)
        bag_sum = np.maximum(np.bincount(doc, soft, len(y)), 1e-9)  # -log of "no sentence offends"
        slope = np.where(y == 1, -1 / np.expm1(np.minimum(bag_sum, 50.0)), 1.0)
        dz = slope[doc] / (1 + np.exp(-np.clip(z, -50, 50)))
        grad = np.append(np.bincount(feat, dz[sent], len(names)), dz.sum()) / len(y)
        grad[:-1] += RIDGE * theta[:-1]
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        theta = theta - RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return ToxicityModel({f: float(w) for f, w in zip(names, theta) if w}, float(theta[-1]))


def train(docs: DataFrame, labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
          per_class: int = PER_CLASS) -> ToxicityModel:
    """Learn from the rows of ``labelled`` (``id_col, label_col``), at most ``per_class`` documents of each label."""
    labels = labelled.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).select(id_col, F.col(label_col).alias("label"))
    rows = sampled_texts(docs, labels, id_col, text_col, "label", per_class).toArrow()
    order = pc.sort_indices(rows, [("label", "ascending"), ("text", "ascending")]).to_pylist()
    texts = rows["text"]
    model = fit((texts[i].as_py() for i in order), [rows["label"][i].as_py() for i in order])
    del rows, texts
    hand_back()  # the driver has a limit too
    return model


def score(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, score, predicted, spans`` of every row; ``spans`` are the offending sentences: start, end (code points), probability."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.select(F.col(id_col)).schema[0].dataType.simpleString()

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        known = shared.value
        for doc, text in rows:
            p, found = known.document(text)
            yield doc, p, int(p >= THRESHOLD), [{"start": a, "end": b, "p": q} for a, b, q in found]
        known.words.clear()  # workers keep broadcast values

    schema = f"`{id_col}` {kind}, score double, predicted int, spans array<struct<start: int, end: int, p: double>>"
    return map_rows(docs.select(F.col(id_col), F.col(text_col).cast("string")), run, schema)


def keep_clean(docs: DataFrame, model: ToxicityModel, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` below the threshold, with all their columns; the text is scored in place and nothing moves."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("boolean")
    def clean(texts: pa.Array) -> pa.Array:
        known = shared.value
        worker_cache()
        kept = pa.array([known.document(t.as_py())[0] < THRESHOLD for t in texts], pa.bool_())
        known.words.clear()  # workers keep broadcast values
        hand_back()
        return kept

    return docs.where(clean(F.coalesce(F.col(text_col).cast("string"), F.lit(""))))
