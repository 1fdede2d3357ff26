"""Secret scans by grammar inference.

Credentials found by the base patterns are the labelled examples. For each kind with any example a probabilistic automaton is inferred
from a bounded sample of them (at most ``per_kind`` distinct values, those with the smallest hash): a prefix tree over character classes whose
states are merged, in breadth-first order, when their outgoing frequencies agree within the Hoeffding bound, recursively. A further automaton is inferred in the same way from
ordinary runs of credential characters (``ORDINARY`` distinct ones outside base spans, by hash, without those that look like hidden credentials: as likely as the
examples of a kind and of a shape that at most ``RARE`` of the runs have). Merging forgets lengths, so each automaton also keeps the
lengths of its examples. Every candidate of the corpus (a run of 6 or more credential characters, the least length an example can have) is scored by the log of how
much likelier a kind's automaton makes it than the ordinary one; it is added as a span if that is at least ``MARGIN`` and at least what all but ``TAIL`` of the kind's own
examples reach, and it overlaps no base span. Numbers, dates and words are what ordinary text is made of, or have lengths no example has. Few
examples make a wide bound when states are merged.

The text is read twice, first for the base values from which the automata are inferred, then for the spans; nothing is written out between. Likelihoods
depend on character classes only, so a task keeps its verdicts per class string (at most ``CACHE_WORDS`` of up to ``CACHE_CHARS``).

Null texts count as empty. A text without matches has no spans. Without labelled examples nothing is added. Base spans always stay.
Repeated rows are scanned one by one. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter, deque
from collections.abc import Iterator
from itertools import accumulate
from zlib import crc32

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_rows, text_of

# fixed values: the patterns of the base kinds, and their least lengths
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KEYS = ("password", "passwd", "secret", "token", "api_key", "apikey")
LEAST_ASSIGN, LEAST_ACCESS = 6, 20
KINDS = ("assign", "access", "hex")
LEARNED = "learned"
PLAIN = "ordinary"

CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{%d,}" % min(LEAST_ASSIGN, LEAST_ACCESS))
PER_KIND = 400
CACHE_WORDS, CACHE_CHARS = 200_000, 64
ORDINARY = 1_500
MARGIN = math.log(1e4)
RARE = 0.01
TAIL = 0.03
CONFIDENCE = 0.05
END = "$"


def base_spans(text: str) -> list[tuple[str, int, int, str]]:
    """``(kind, start, end, value)`` by start, then kind as listed."""
    found = []
    low = text.lower()
    if any(k in low for k in KEYS):
        for m in ASSIGN.finditer(text):
            if len(m[2]) >= LEAST_ASSIGN:
                found.append((KINDS[0], m.start(), m.end(), m[2]))
    if "AKIA" in text:
        for m in ACCESS.finditer(text):
            if len(m[0]) >= LEAST_ACCESS:
                found.append((KINDS[1], m.start(), m.end(), m[0]))
    for m in HEX.finditer(text):
        found.append((KINDS[2], m.start(), m.end(), m[0]))
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


CLASSES = str.maketrans({c: k for k, letters in (("d", "0123456789"), ("h", "abcdef"), ("l", "ghijklmnopqrstuvwxyz"),
                                               ("u", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")) for c in letters})


def symbols(value: str) -> str:
    """Character classes: digits, hexadecimal letters, other lower case, upper case; signs stand for themselves."""
    return value.translate(CLASSES)


class Automaton:
    """Probabilistic automaton: per state, counts and targets of its symbols; ``END`` counts the words that stop there."""

    def __init__(self, words: list[str], confidence: float = CONFIDENCE):
        self.count: list[dict[str, int]] = [{}]
        self.to: list[dict[str, int]] = [{}]
        for word in words:
            self._insert(word)
        self.bound = math.sqrt(0.5 * math.log(2 / confidence))
        self.start = 0
        self._merge()
        self.alphabet = len({s for w in words for s in w}) + 1
        self.lengths = Counter(map(len, words))
        self.seen = len(words)

    def _insert(self, word: str) -> None:
        at = 0
        for s in [*word, END]:
            self.count[at][s] = self.count[at].get(s, 0) + 1
            if s != END:
                if s not in self.to[at]:
                    self.to[at][s] = len(self.count)
                    self.count.append({})
                    self.to.append({})
                at = self.to[at][s]

    def _alike(self, a: int, b: int) -> bool:
        """Hoeffding test of every symbol's share, here and below."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            na, nb = sum(self.count[a].values()), sum(self.count[b].values())
            if not na or not nb:
                continue
            most = self.bound * (na**-0.5 + nb**-0.5)
            for s in self.count[a].keys() | self.count[b].keys():
                if abs(self.count[a].get(s, 0) / na - self.count[b].get(s, 0) / nb) > most:
                    return False
            todo += [(self.to[a][s], self.to[b][s]) for s in self.to[a].keys() & self.to[b].keys()]
        return True

    def _fold(self, a: int, b: int) -> None:
        """Add the subtree at ``b`` to ``a``."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            for s, n in self.count[b].items():
                self.count[a][s] = self.count[a].get(s, 0) + n
            for s, t in self.to[b].items():
                if s in self.to[a]:
                    todo.append((self.to[a][s], t))
                else:
                    self.to[a][s] = t

    def _merge(self) -> None:
        kept, edge = [0], deque((0, s) for s in sorted(self.to[0]))
        while edge:
            parent, s = edge.popleft()
            state = self.to[parent].get(s)
            if state is None or state in kept:
                continue
            same = next((k for k in kept if self._alike(k, state)), None)
            if same is None:
                kept.append(state)
                edge.extend((state, x) for x in sorted(self.to[state]))
            else:
                self.to[parent][s] = same
                self._fold(same, state)
                edge.extend((same, x) for x in sorted(self.to[same]) if self.to[same][x] not in kept)

    def likelihood(self, word: str) -> float:
        """Log probability of the symbols, given their number, and of that number; with a small share for what was never seen. Nothing is known past an unseen step."""
        near = sum(self.lengths[len(word) + i] for i in (-1, 0, 1))
        total, at = math.log((near + 0.01) / (3 * self.seen + 1)), self.start
        for s in word:
            n = sum(self.count[at].values()) - self.count[at].get(END, 0) if at is not None else 0
            c = self.count[at].get(s, 0) if at is not None else 0
            total += math.log((c + 0.01) / (n + 0.01 * self.alphabet)) if n else math.log(1e-3)
            at = self.to[at].get(s) if at is not None else None
        return total


class FormatModel:
    """One automaton per kind with the least ratio to the ordinary one that its examples reach."""

    def __init__(self, examples: dict[str, list[str]], ordinary: list[str] = (), tail: float = TAIL):
        self.kinds: dict[str, tuple[Automaton, float]] = {}
        self.known: dict[str, bool] = {}
        learned = {}
        for kind, values in sorted(examples.items()):
            words = [symbols(v) for v in sorted(set(values))]
            learned[kind] = (Automaton(words), words)
        plain = self._without_hidden(sorted(ordinary), [a for a, _ in learned.values()], [w for _, w in learned.values()], tail)
        self.plain = Automaton([symbols(v) for v in plain]) if plain else None
        for kind, (auto, words) in learned.items():
            reached = sorted(auto.likelihood(w) - self.ordinary(w) for w in words)
            self.kinds[kind] = (auto, max(MARGIN, reached[int(tail * len(reached))]))

    @staticmethod
    def _without_hidden(ordinary: list[str], autos: list[Automaton], words: list[list[str]], tail: float) -> list[str]:
        """The ordinary runs without those that are credentials themselves: as likely as a kind's examples, and of a shape few runs have."""
        shapes = Counter(symbols(v).replace("h", "l") for v in ordinary)
        few = max(2, RARE * len(ordinary))
        least = [sorted(map(a.likelihood, w))[int(tail * len(w))] for a, w in zip(autos, words)]

        def hidden(v: str) -> bool:
            word = symbols(v)
            return shapes[word.replace("h", "l")] <= few and any(a.likelihood(word) >= low for a, low in zip(autos, least))

        return [v for v in ordinary if not hidden(v)]

    def ordinary(self, word: str) -> float:
        """Log likelihood in ordinary text; without any, every symbol and a length is as likely as one of a hundred."""
        return self.plain.likelihood(word) if self.plain else -math.log(100) * (len(word) + 1)

    def _judge(self, word: str) -> bool:
        plain = self.ordinary(word)
        return any(auto.likelihood(word) - plain >= least for auto, least in self.kinds.values())

    def accepts(self, value: str) -> bool:
        word = symbols(value)
        if len(word) > CACHE_CHARS:
            return self._judge(word)
        if word not in self.known:
            if len(self.known) >= CACHE_WORDS:
                self.known.clear()
            self.known[word] = self._judge(word)
        return self.known[word]


def all_spans(text: str, model: FormatModel) -> tuple[list[tuple], list[tuple]]:
    """``base_spans`` of the text, and all spans ``(start, place of the kind, end)`` in order."""
    base = base_spans(text)
    starts, reach = [s[1] for s in base], list(accumulate((s[2] for s in base), max))
    spans = [(a, KINDS.index(k), b) for k, a, b, _ in base]
    for m in CANDIDATE.finditer(text) if model.kinds else ():
        if model.accepts(m[0]):
            before = bisect_left(starts, m.end())  # so many base spans start before its end
            if not before or reach[before - 1] <= m.start():
                spans.append((m.start(), len(KINDS), m.end()))
    return base, sorted(spans)


def examples_of(docs: DataFrame, text_col: str = "text", ordinary: int = ORDINARY) -> DataFrame:
    """``kind, value`` of every base span, and from each task its ``ordinary`` runs with the smallest checksum outside base spans (kind ``ordinary``)."""

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        few: dict[str, int] = {}
        most = 1 << 32
        for (text,) in rows:
            base = base_spans(text)
            yield from ((k, v) for k, _, _, v in base)
            for m in CANDIDATE.finditer(text):
                h = crc32(m[0].encode())
                if h < most and m[0] not in few and not any(a < m.end() and m.start() < b for _, a, b, _ in base):
                    few[m[0]] = h
                    if len(few) >= 2 * ordinary:
                        few = dict(sorted(few.items(), key=lambda x: (x[1], x[0]))[:ordinary])
                        most = max(few.values())
        yield from ((PLAIN, v) for v in sorted(few, key=lambda v: (few[v], v))[:ordinary])

    return map_rows(docs.select(text_of(text_col)), run, "kind string, value string")


def learn(values: DataFrame, per_kind: int = PER_KIND, ordinary: int = ORDINARY) -> FormatModel:
    """Automata from at most ``per_kind`` distinct values of each kind and ``ordinary`` others; only these reach the driver."""
    order = F.when(F.col("kind") == PLAIN, F.lpad(F.crc32("value").cast("string"), 10, "0")).otherwise(F.md5("value"))
    distinct = values.select("kind", "value", order.alias("h")).distinct()
    # the rows of a kind are ranked in parts first, so no task holds the values of a kind
    part = Window.partitionBy("kind", F.pmod(F.xxhash64("value"), F.lit(64))).orderBy("h", "value")
    whole = Window.partitionBy("kind").orderBy("h", "value")
    most = F.when(F.col("kind") == PLAIN, ordinary).otherwise(per_kind)
    some = distinct.withColumn("n", F.row_number().over(part)).where(F.col("n") <= most)
    some = some.withColumn("n", F.row_number().over(whole)).where(F.col("n") <= most).select("kind", "value").collect()
    examples: dict[str, list[str]] = {}
    for row in some:
        examples.setdefault(row["kind"], []).append(row["value"])
    plain = examples.pop(PLAIN, [])
    return FormatModel(examples, plain)


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", per_kind: int = PER_KIND) -> DataFrame:
    """``id_col, base, spans``: base spans, and all spans (``kind, start, end``) by start, then kind; added ones last of a start."""
    shared = docs.sparkSession.sparkContext.broadcast(learn(examples_of(docs, text_col), per_kind))
    kind = docs.select(F.col(id_col)).schema[0].dataType.simpleString()

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        model = shared.value
        for doc, text in rows:
            base, spans = all_spans(text, model)
            named = [{"kind": [*KINDS, LEARNED][k], "start": a, "end": b} for a, k, b in spans]
            yield doc, [{"kind": k, "start": a, "end": b} for k, a, b, _ in base], named

    span = "array<struct<kind: string, start: int, end: int>>"
    return map_rows(docs.select(F.col(id_col), text_of(text_col)), run, f"`{id_col}` {kind}, base {span}, spans {span}")
