"""Approximate nearest neighbours by a forest of random-projection trees.

Trees: each node splits at the median along the difference of two random points, down to about ``leaf`` points of a bounded,
documented sample (at most ``sample`` distinct vectors, those with the smallest hash; they and the split planes are what reaches the
driver). Every vector of the table is then put into one leaf of each tree. Equal vectors are one entry that carries its
``top + 1`` smallest ids: no query can ever use more of them.

Search: one priority queue per query, shared by all trees, holds subtrees by the margin at which the path to them was left; the
nearest are opened first until ``probes`` leaves are open, and on until these hold enough vectors for the answer. Queries and
vectors meet per block of leaves and are compared there by matrix products, in double precision. A block is cut further by hash where its
leaves hold many vectors or are asked by many queries, so no group grows with the table. The best of every block
are merged by query.

Nearness is the inner product. Planes are laid through unit-length copies, with one more coordinate that completes each vector to the
longest length, so that near means large inner product for vectors of any length.

Vectors that are null, empty, zero, of another length than the most common one, or hold null or non-finite components take no part, neither as queries nor
as candidates. Null ids take no part. Of repeated ids with different vectors, the nearest counts
as candidate, and one fixed by hash asks; with equal vectors they are one. Ties go to the smaller id. An empty table gives an empty table.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import settle

TOP = 20
TREES = 12
LEAF = 32
SAMPLE = 20_000
PROBES = 640
LEAVES_PER_BLOCK = 64
BLOCK = 8_192
SEED = 17


@dataclass(frozen=True)
class Forest:
    """Complete binary trees in heap order: ``planes[t][node]`` and ``cuts[t][node]``; leaves are numbered from 0."""

    planes: np.ndarray
    cuts: np.ndarray
    depth: int
    longest: float

    def lift(self, x: np.ndarray, query: bool) -> np.ndarray:
        """Vectors with the coordinate that completes them to the longest length (0 for queries), of length 1."""
        norm = (x * x).sum(1)
        extra = np.zeros(len(x)) if query else np.sqrt(np.maximum(0.0, self.longest**2 - norm))
        y = np.column_stack([x, extra])
        return y / np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-300)

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """Leaf of every vector in every tree, ``[vector, tree]``."""
        y = self.lift(x, False)
        out = np.zeros((len(y), len(self.planes)), int)
        for t, (planes, cuts) in enumerate(zip(self.planes, self.cuts)):
            node = np.zeros(len(y), int)
            for _ in range(self.depth):
                node = 2 * node + 1 + (np.einsum("ij,ij->i", y, planes[node]) > cuts[node])
            out[:, t] = node - (2**self.depth - 1)
        return out

    def search(self, q: np.ndarray, probes: int, sizes: np.ndarray, least: int) -> Iterator[list[tuple[int, int]]]:
        """For every query the leaves to open, as ``(tree, leaf)``; ``sizes[tree][leaf]`` vectors lie in a leaf."""
        inner = 2**self.depth - 1
        for y in self.lift(q, True):
            margin = np.einsum("tnd,d->tn", self.planes, y) - self.cuts
            queue = [(0.0, t, 0) for t in range(len(self.planes))]
            opened, held = [], np.zeros(len(self.planes), int)
            while queue and (len(opened) < probes or held.max() < least):
                far, t, node = heapq.heappop(queue)
                while node < inner:
                    m = margin[t, node]
                    right = int(m > 0)
                    heapq.heappush(queue, (max(far, abs(m)), t, 2 * node + 2 - right))
                    node = 2 * node + 1 + right
                if sizes[t, node - inner]:
                    opened.append((t, node - inner))
                    held[t] += sizes[t, node - inner]  # leaves of one tree hold different vectors
            yield opened


def grow(sample: np.ndarray, longest: float, trees: int = TREES, leaf: int = LEAF, seed: int = SEED) -> Forest:
    """A forest over the sample."""
    depth = max(0, int(np.ceil(np.log2(max(1, len(sample)) / leaf))))
    nodes = 2**depth - 1
    forest = Forest(np.zeros((trees, nodes, sample.shape[1] + 1)), np.zeros((trees, nodes)), depth, longest)
    y = forest.lift(sample, False)
    for t in range(trees):
        rng = np.random.default_rng([seed, t])
        parts = {0: np.arange(len(y))}
        for node in range(nodes):
            at = parts.pop(node)
            if len(at) > 1:
                a, b = rng.choice(at, 2, replace=False)
                plane = y[a] - y[b]
            else:
                plane = rng.normal(size=y.shape[1])
            plane = plane / max(np.linalg.norm(plane), 1e-300)
            p = y[at] @ plane
            forest.planes[t, node], forest.cuts[t, node] = plane, np.median(p) if len(at) else 0.0
            parts[2 * node + 1], parts[2 * node + 2] = at[p <= forest.cuts[t, node]], at[p > forest.cuts[t, node]]
    return forest


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``id, v`` of the vectors that take part."""
    kept = dict(vectors.dtypes)[vec_col] in ("array<float>", "array<double>")
    v = F.col(vec_col) if kept else F.col(vec_col).cast("array<double>")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull())
    rows = rows.where(finite & F.exists("v", lambda x: x != 0))
    common = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.col("count").desc(), "d").first()
    return rows.where(F.size("v") == F.lit(common["d"] if common else 0))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype("float64")
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def nearest(
    vectors: DataFrame,
    queries: DataFrame,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    top: int = TOP,
    trees: int = TREES,
    leaf: int = LEAF,
    probes: int = PROBES,
    sample: int = SAMPLE,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: for every row of ``queries`` the ``top`` nearest rows of ``vectors`` found, without itself."""
    spark = vectors.sparkSession
    out = "query_id bigint, rank int, vec_id bigint, score double"
    kind = usable(vectors, id_col, vec_col).schema["v"].dataType.simpleString()
    key = F.sha2(F.concat_ws(",", F.col("v").cast("array<string>")), 256)
    ranked = usable(vectors, id_col, vec_col).select("id", "v", key.alias("h")).dropDuplicates(["id", "h"])
    smallest = Window.partitionBy("h").orderBy("id")
    few = ranked.withColumn("n", F.row_number().over(smallest)).where(F.col("n") <= top + 1)
    entries = settle(few.groupBy("h").agg(F.first("v").alias("v"), F.array_sort(F.collect_list("id")).alias("ids")))
    facts = entries.agg(F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x)))).first()[0]
    if facts is None:
        return spark.createDataFrame([], out)
    picked = entries.select("v", "h").orderBy("h").limit(sample).select("v").toArrow()
    forest = grow(_matrix(picked.column("v").combine_chunks()), float(facts), trees, leaf)
    shared = spark.sparkContext.broadcast(forest)  # trees * 2^depth planes, bounded by the sample

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_rows
            found = shared.value.leaves(_matrix(b.column("v"))) if n else np.zeros((0, trees), int)
            rows = np.repeat(np.arange(n), trees)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.tile(np.arange(trees, dtype="int32"), n)), pa.array(found.astype("int32").ravel()), *[b.column(c).take(pa.array(rows)) for c in ("h", "v", "ids")]],
                names=["tree", "leaf", "h", "v", "ids"],
            )

    indexed = entries.select("h", "v", "ids").mapInArrow(put, f"tree int, leaf int, h string, v {kind}, ids array<bigint>")
    counts = indexed.groupBy("tree", "leaf").count().toArrow()  # one row per leaf
    sizes = np.zeros((trees, 2**forest.depth), int)
    sizes[counts.column("tree").to_numpy(), counts.column("leaf").to_numpy()] = counts.column("count").to_numpy()
    held = spark.sparkContext.broadcast(sizes)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = _matrix(b.column("v"))
            for i, opened in enumerate(shared.value.search(x, probes, held.value, top + 1)):
                t, blk, leaves = _by_block(opened)
                n = len(t)
                take = pa.array(np.full(n, i))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(t), pa.array(blk), b.column("id").take(take), b.column("v").take(take), pa.array(leaves, pa.list_(pa.int32()))],
                    names=["tree", "blk", "qid", "q", "leaves"],
                )

    asked = usable(queries, id_col, vec_col).withColumn("h", key).groupBy("id").agg(F.min_by("v", "h").cast(kind).alias("v"))
    asked = settle(asked.mapInArrow(probe, f"tree int, blk int, qid bigint, q {kind}, leaves array<int>"))
    found = _compare(indexed, asked, top)
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    one = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return one.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")


def _by_block(opened: list[tuple[int, int]]) -> tuple:
    blocks: dict[tuple[int, int], list[int]] = {}
    for t, leaf in opened:
        blocks.setdefault((t, leaf // LEAVES_PER_BLOCK), []).append(leaf)
    keys = sorted(blocks)
    return np.array([k[0] for k in keys], "int32"), np.array([k[1] for k in keys], "int32"), [sorted(blocks[k]) for k in keys]


def _parts(df: DataFrame, most: int, name: str) -> DataFrame:
    """Into how many parts of about ``most`` rows each ``(tree, blk)`` of ``df`` is cut."""
    return df.groupBy("tree", "blk").agg(F.ceil(F.count(F.lit(1)) / F.lit(most)).cast("int").alias(name))


def _compare(indexed: DataFrame, asked: DataFrame, top: int) -> DataFrame:
    """``query_id, vec_id, score``: the best of every part of a block for the queries that open it."""

    def numbers(count: Column) -> Column:
        return F.explode(F.sequence(F.lit(0), count - 1))

    rows = indexed.withColumn("blk", F.floor(F.col("leaf") / LEAVES_PER_BLOCK).cast("int"))
    cut = F.broadcast(_parts(rows, BLOCK, "vn").join(_parts(asked, BLOCK, "qn"), ["tree", "blk"]))  # one row per block of leaves
    left = rows.join(cut, ["tree", "blk"]).withColumn("vp", F.pmod(F.xxhash64("h"), F.col("vn")).cast("int"))
    left = left.withColumn("qp", numbers(F.col("qn"))).select("tree", "blk", "vp", "qp", "leaf", "v", "ids")
    right = asked.join(cut, ["tree", "blk"]).withColumn("qp", F.pmod(F.xxhash64("qid"), F.col("qn")).cast("int"))
    right = right.withColumn("vp", numbers(F.col("vn"))).select("tree", "blk", "vp", "qp", "qid", "q", "leaves")

    def compare(a: pa.Table, b: pa.Table) -> pa.Table:
        got: tuple[list, list, list] = ([], [], [])
        if a.num_rows and b.num_rows:
            x, q = _matrix(a.column("v").combine_chunks()), _matrix(b.column("q").combine_chunks())
            leaf, ids = a.column("leaf").to_numpy(), a.column("ids").to_pylist()
            first = np.array([i[0] for i in ids])
            order = np.lexsort((first, leaf))
            x, leaf, first, ids = x[order], leaf[order], first[order], [ids[i] for i in order]
            names = b.column("qid").to_numpy()
            for i, leaves in enumerate(b.column("leaves").to_pylist()):
                lo, hi = np.searchsorted(leaf, leaves, "left"), np.searchsorted(leaf, leaves, "right")
                at = np.concatenate([np.arange(s, e) for s, e in zip(lo, hi)]) if len(leaves) else np.zeros(0, int)
                if not len(at):
                    continue
                s = np.einsum("ij,j->i", x[at], q[i])
                if len(s) > top + 1:
                    least = np.partition(s, len(s) - top - 1)[len(s) - top - 1]
                    near = np.flatnonzero(s >= least)
                    near = near[np.lexsort((first[at[near]], -s[near]))]
                else:
                    near = np.lexsort((first[at], -s))
                mine = sorted(((-s[j], v) for j in near[: top + 1] for v in ids[at[j]] if v != names[i]))[:top]
                got[0].extend([int(names[i])] * len(mine))
                got[1].extend(v for _, v in mine)
                got[2].extend(-p for p, _ in mine)
        return pa.table({"query_id": pa.array(got[0], pa.int64()), "vec_id": pa.array(got[1], pa.int64()), "score": pa.array(got[2], pa.float64())})

    keys = ["tree", "blk", "vp", "qp"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(compare, "query_id bigint, vec_id bigint, score double")
