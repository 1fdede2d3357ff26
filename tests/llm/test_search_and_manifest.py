"""Pivot index, Merkle manifest and ranked search against brute force, with their edge cases."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from groupwise.llm import merkle, pivots, ranked_search

VECTORS = "vec_id bigint, embedding array<double>, e string, h int"


def planted(seed: int, n: int, groups: list[tuple[int, float]], d: int = 32) -> np.ndarray:
    rng = np.random.default_rng(seed)
    parts = [rng.normal(size=(n, d))]
    for size, noise in groups:
        parts.append(rng.normal(size=d) + noise * rng.normal(size=(size, d)))
    return np.concatenate(parts)


def brute_links(x: np.ndarray) -> np.ndarray:
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = unit @ unit.T >= pivots.COSINE
    np.fill_diagonal(near, False)
    return near


def components(near: np.ndarray) -> list[int]:
    out = list(range(len(near)))
    for i in range(len(near)):
        todo = [i] if out[i] == i else []
        while todo:
            for j in np.flatnonzero(near[todo.pop()]).tolist():
                if out[j] > i:
                    out[j] = i
                    todo.append(j)
    return out


@pytest.mark.parametrize("long_list", [pivots.LONG_LIST, 20])
def test_pivot_links_match_brute_force(spark, long_list):
    """With long lists and with lists cut by several pivots: every link once, nothing below the threshold."""
    x = planted(3, 400, [(2, 0.1)] * 40 + [(90, 0.12), (60, 0.2)])
    rows = [(i, v.tolist(), "x", 1) for i, v in enumerate(x)]
    got = pivots.near_duplicates(spark.createDataFrame(rows, VECTORS), pivots=128, long_list=long_list).collect()
    near = brute_links(x)
    comp = components(near)
    found = {r["vec_id"]: r for r in got}
    assert len(got) == len(x) and all(found[i]["n_links"] <= near[i].sum() for i in found)
    assert sum(r["n_links"] for r in got) >= 0.97 * near.sum()
    assert np.mean([found[i]["component_id"] == comp[i] for i in found]) > 0.98
    assert all(r["kept"] == (r["component_id"] == r["vec_id"]) for r in got)


def test_pivot_lists_hold_every_candidate(spark):
    """All pairs that share enough pivots meet in exactly one list where none of their shared pivots is passed over."""
    x = planted(4, 150, [(30, 0.15)])
    df = spark.createDataFrame([(i, v.tolist(), "x", 1) for i, v in enumerate(x)], VECTORS)
    _, entries = pivots.entries_of(df, "vec_id", "embedding")
    prefixes = pivots.rare_first(pivots.describe(entries, 64, 8))
    pre = {r["e"]: set(r["pre"]) for r in prefixes.collect()}
    for long_list in (1_000, 10):
        lists, _ = pivots.inverted_lists(prefixes, 8, 3, long_list)
        members = defaultdict(set)
        for r in lists.collect():
            members[tuple(r["key"])].add(r["e"])
        met = Counter()
        for key, at in members.items():
            for a in at:
                for b in at:
                    common = sorted(pre[a] & pre[b])
                    if a < b and tuple(common[: len(key)]) == key:
                        met[a, b] += 1
        want = {(a, b) for a in pre for b in pre if a < b and len(pre[a] & pre[b]) >= 3}
        assert want <= set(met) and max(met.values()) == 1


def test_pivot_edges(spark):
    nan, v, w = float("nan"), [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]
    rows = [(5, v), (2, v), (9, [3.0, 0.0, 0.0]), (2, w), (None, w), (7, None), (8, []), (10, [0.0] * 3), (11, [nan, 1.0, 0.0]),
            (12, [None, 1.0, 0.0]), (13, [1.0, 0.0]), (14, [1.0, 0.04, 0.0]), (None, [0.0, 0.0, 1.0])]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], VECTORS)
    got = sorted(map(str, (tuple(r) for r in pivots.near_duplicates(df).collect())))
    want = [(5, 3, 2, False), (2, 3, 2, True), (9, 3, 2, False), (2, 1, 2, True), (None, 1, 2, False), (14, 3, 2, False), (None, 0, None, True)]
    want += [(i, 0, i, True) for i in (7, 8, 10, 11, 12, 13)]
    assert got == sorted(map(str, want))
    assert pivots.near_duplicates(spark.createDataFrame([], VECTORS)).count() == 0
    many = spark.range(2_500).select(F.col("id").alias("vec_id"), F.expr("array(1D, 2D)").alias("embedding"))
    assert pivots.near_duplicates(many).distinct().where("n_links = 2499 and component_id = 0").count() == 2_500


def h(*parts) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_tree(nodes: list[str]) -> tuple[str, list[list[tuple[str, str]]]]:
    """Root and the siblings (before, after) of every leaf."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, path in enumerate(paths):
            p = at[i]
            run = p - p % 3
            path.append(("".join(nodes[run:p]), "".join(nodes[p + 1 : run + 3])))
            at[i] = p // 3
        nodes = [h(*nodes[i : i + 3]) for i in range(0, len(nodes), 3)]
    return nodes[0], paths


def brute_leaf(row) -> str:
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


DOCS = "doc_id bigint, source string, lang string, n_chars bigint, text string, leaf string, place int, n int"


def manifest_rows():
    rows = []
    for s, n in (("a", 1), ("b", 28), ("é", 10), (None, 4), ("", 2), ("B", 82)):
        rows += [(i * 7 % 101, s, None if i % 5 == 0 else "en", i, None if i % 7 == 0 else "" if i % 7 == 1 else f"té\nxt {i}") for i in range(n)]
    return rows + [(None, "b", None, None, None), (3, "B", "en", 1, "twice"), (3, "B", "en", 1, "twice"), (4, "a", "en", 5, "long \n" * 20_000)]


@pytest.mark.parametrize("part", [1, 7, merkle.PART])
def test_merkle_proofs_match_brute_force(spark, part):
    rows = manifest_rows()
    got = merkle.prove_all(spark.createDataFrame([(*r, "x", 1, 2) for r in rows], DOCS), part=part)
    got = got.withColumn("folded", merkle.fold(F.col("leaf"), F.col("proof"))).withColumn("text", merkle.proof_text(F.col("proof"))).collect()
    by: dict = defaultdict(list)
    for r in rows:
        by[r[1]].append((r[0] is not None, r[0] or 0, brute_leaf(r), r[0]))
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: brute_tree([x[2] for x in sorted(by[s])]) for s in order}
    root, tops = brute_tree([trees[s][0] for s in order])
    want = []
    for k, s in enumerate(order):
        for leaf, path in zip(sorted(by[s]), trees[s][1]):
            text = "".join(a + b for a, b in path + tops[k])
            want.append((leaf[3], s, leaf[2], trees[s][0], root, text))
    assert sorted(map(str, want)) == sorted(str((r["id"], r["source"], r["leaf"], r["subroot"], r["root"], r["text"])) for r in got)
    assert all(r["folded"] == root for r in got)


def test_merkle_multiproof_is_minimal():
    """Every fetched node is needed, none can be derived, and they are enough for all proofs."""
    for n, places in ((28, [0, 1, 2, 5]), (28, list(range(28))), (10, [9]), (1, [0]), (100, [3, 50, 99])):
        nodes = [h(str(i)) for i in range(n)]
        root, paths = brute_tree(list(nodes))
        have = {(0, 0, i): d for i, d in enumerate(nodes)}
        level, below = 0, nodes
        while len(below) > 1:
            below, level = [h(*below[i : i + 3]) for i in range(0, len(below), 3)], level + 1
            have |= {(0, level, i): d for i, d in enumerate(below)}
        asked = [(0, p, n) for p in places]
        need = merkle.missing_nodes(asked, 1)
        proofs = merkle.expand([(*a, nodes[a[1]]) for a in asked], 1, {k: have[k] for k in need})
        assert [[(s["before"], s["after"]) for s in p] for p in proofs] == [paths[p] for p in places]
        for k in need:
            with pytest.raises(KeyError):
                merkle.expand([(*a, nodes[a[1]]) for a in asked], 1, {j: have[j] for j in need if j != k})
    assert merkle.missing_nodes([(0, p, 28) for p in range(28)], 1) == []


def test_merkle_edges(spark):
    df = spark.createDataFrame([], DOCS)
    assert merkle.prove_all(df).count() == 0
    one = merkle.prove_all(spark.createDataFrame([(1, None, None, None, None, "", 0, 0)], DOCS)).first()
    assert one["leaf"] == one["subroot"] == one["root"] == brute_leaf((1, None, None, None, None)) and one["proof"] == []
    hot = spark.range(7_000).select(F.lit(1).cast("bigint").alias("doc_id"), F.lit("s").alias("source"), F.lit(None).cast("string").alias("lang"), F.lit(1).alias("n_chars"), F.lit("t").alias("text"))
    proved = merkle.prove_all(hot, part=500)
    assert proved.where(merkle.fold(F.col("leaf"), F.col("proof")) == F.col("root")).count() == 7_000


def brute_search(docs, items, top):
    cut = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    said = [(d, cut.findall((t or "").translate(lower))) for d, t in docs]
    said = [(d, w) for d, w in said if w]
    n, length = len(said), sum(len(w) for _, w in said)
    df = Counter(t for _, w in said for t in set(w))
    out = []
    for item, text in items:
        scores = []
        for d, w in said:
            tf, m = Counter(w), 100 - 25 + (25 * len(w) * n) // length
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * tf[t]) // (1000 * tf[t] + 12 * m)) for t in cut.findall((text or "").translate(lower)) if t in tf)
            if s > 0:
                scores.append((-s, d is None, d))
        scores.sort(key=lambda x: (x[0], x[1], x[2] or 0))
        out += [(item, i + 1, d, -s) for i, (s, _, d) in enumerate(scores[:top])]
    return sorted(map(str, out))


@pytest.mark.parametrize("postings", [ranked_search.POSTINGS, 40])
def test_ranked_search_matches_brute_force(spark, postings):
    """One batch and many; ties, repeated rows, null and empty texts, control and other characters, one very long text."""
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(40)] + ["Ünder", "ünder", "a_b", "x\x1cy", "日本", "W1", "İ", "\x85q"]
    docs = [(i, " ".join(rng.choice(words, rng.integers(1, 30)))) for i in range(200)]
    docs += [(None, "w1 w2"), (None, "w1 w2"), (300, "w1 w2"), (301, "w1 w2"), (301, "w1 w2"), (400, None), (401, ""), (402, "...\n"), (403, "w3 filler " * 30_000)]
    items = [(i, " ".join(rng.choice(words, 12))) for i in range(15)] + [(50, None), (51, ""), (52, "nowhere"), (None, "w1 w1 日本"), (53, "w5 " * 60)]
    got = ranked_search.search(
        spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id bigint, text string, item string, rank int").repartition(5),
        spark.createDataFrame([(*i, "x", 1) for i in items], "item_id bigint, text string, doc_id string, score int"), top=7, postings=postings,
    )
    assert sorted(str(tuple(r)) for r in got.collect()) == brute_search(docs, items, 7)


def test_ranked_search_edges(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id bigint, text string")
    items = spark.createDataFrame([("p", "b"), ("p", "b"), ("p", "a a"), ("q", None)], "item_id string, text string")
    rows = ranked_search.search(docs, items).collect()
    assert [(r["item_id"], r["rank"], r["doc_id"]) for r in rows] == [("p", 1, 1)]
    # repeated rows of an item count once, its different texts add up
    (want,) = brute_search([(1, "a b")], [("p", "a a\nb")], 20)
    assert str(tuple(rows[0])) == want
    assert ranked_search.search(docs.limit(0), items).count() == ranked_search.search(docs, items.limit(0)).count() == 0
    assert ranked_search.search(docs.where("doc_id = 2"), items).count() == 0
