"""Merkle manifest of a table, with octopus multiproofs.

Tree: a row is a leaf, the hash of its fields. Per source the leaves ascend by id (null ids first, equal ids by leaf hash, so equal rows are
neighbours); every ``ARITY`` consecutive nodes become their hash until one node, the subroot, remains. The subroots ascend by source (null first,
then by bytes) and become the root in the same way. A lone node is its own root. Leaves get their place by one range sort of the slim
leaf table (source, id, two hashes); the levels of a tree are folded ``LEVELS`` at a time, so a group holds at most ``ARITY ** LEVELS`` hashes
and a table of n rows takes ``log(n) / (LEVELS log ARITY)`` aggregations. Nodes are rows ``tree, level, at, digest``; the tree of the subroots is tree -1.

Proofs: leaves are dealt into partitions of ``part`` consecutive places, across sources. A partition is an octopus: it lists the
nodes that its leaves' proofs need and that no other node of the partition gives (the minimal union), fetches these by one join, derives the shared
interior nodes once, and writes every leaf's own proof from them. A proof is an array of levels ``(before, after)``: the siblings left and
right of the path, joined. :func:`fold` leads a leaf along it to the root again.

Nulls in any field hash as ``-``, an empty text as ``0:``; long texts are hashed where they are read and are not moved. Null sources are a
source of their own. Rows that repeat in all fields are leaves of their own with equal hashes and neighbouring places. Further columns are
ignored. An empty table has no rows and no root.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..lookup import attach, join_null_safe
from ..session import release, settle

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
ARITY = 3
LEVELS = 7
PART = 4_096
TOP = -1
PROOF = "array<struct<before:string,after:string>>"


def leaf_hash(fields: Sequence[Column]) -> Column:
    """Hash of the fields, each with its length in bytes before it."""

    def framed(c: Column) -> Column:
        text = c.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return F.sha2(F.concat(*[framed(c) for c in fields]), 256)


def _fold_once(nodes: Column) -> Column:
    runs = F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / ARITY).cast("int"))
    return F.transform(runs, lambda i: F.sha2(F.array_join(F.slice(nodes, i * ARITY + 1, ARITY), ""), 256))


def height(n: Column) -> Column:
    """Levels above the leaves in a tree of ``n`` leaves."""
    powers = [F.lit(ARITY**k).cast("bigint") for k in range(64) if ARITY**k < 2**63]
    return F.size(F.filter(F.array(*powers), lambda p: p < n))


def interior(leaves: DataFrame, most: int, levels: int = LEVELS) -> DataFrame:
    """All nodes ``tree, level, at, digest`` of the trees whose leaves are ``tree, at, digest, n`` (``n`` leaves in the tree, ``most`` in the largest).

    The interior ones are written out.
    """
    nodes = leaves.select("tree", F.lit(0).alias("level"), "at", "digest")
    state, done, depth = leaves.where(F.col("n") > 1), 0, 0
    while ARITY**depth < most:
        depth += 1
    while done < depth:
        steps = min(levels, depth - done)
        group = state.groupBy("tree", F.floor(F.col("at") / ARITY**steps).cast("bigint").alias("block"), "n")
        rows = group.agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "digest"))), lambda s: s["digest"]).alias("d"))
        powers = F.array(*[F.lit(ARITY ** (done + k)).cast("bigint") for k in range(steps)])

        def climb(levels: Column, nodes_below: Column) -> Column:
            # a tree that has come down to one node ends there
            return F.when(nodes_below < F.col("n"), F.concat(levels, F.array(_fold_once(F.element_at(levels, -1))))).otherwise(levels)

        folded = rows.select("tree", "n", "block", F.aggregate(powers, F.array("d"), climb).alias("levels"))
        flat = folded.select("tree", "n", "block", F.posexplode("levels").alias("k", "d")).where(F.col("k") > 0)
        flat = flat.select("tree", "n", "block", "k", F.posexplode("d").alias("i", "digest"))
        width = F.pow(F.lit(ARITY), F.lit(steps) - F.col("k")).cast("bigint")
        flat = settle(flat.select("tree", (F.col("k") + done).alias("level"), (F.col("block") * width + F.col("i")).alias("at"), "digest", "n"))
        nodes = nodes.unionByName(flat.drop("n"))
        done += steps
        state = flat.where((F.col("level") == done) & (F.col("n") > ARITY**done)).select("tree", "at", "digest", "n")
    return nodes


def number_rows(rows: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """``rows`` plus their 0-based place in the order, by a range sort; written out. Only the sizes of the sorted parts are added up in one place."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    parts = max(cores, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    keys = [F.col(c).asc_nulls_first() for c in order]
    placed = rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn("_m", F.monotonically_increasing_id())
    placed = settle(placed)
    part, inside = F.shiftright("_m", 33), F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = placed.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).orderBy("p").collect()  # one row per sorted part
    shifts, total = [], 0
    for r in sizes:
        shifts.append((r["p"], total))
        total += r["n"]
    table = rows.sparkSession.createDataFrame(shifts, "_p bigint, _shift bigint")
    out = placed.withColumn("_p", part).join(F.broadcast(table), "_p").withColumn(name, F.col("_shift") + inside)
    return out.drop("_p", "_shift", "_m")


def manifest(docs: DataFrame, fields: Sequence[str] = FIELDS, id_col: str = "doc_id", source_col: str = "source", **extra: Column) -> tuple[DataFrame, DataFrame]:
    """``(leaves, nodes)``. Leaves: ``id, source, leaf``, the ``extra`` columns, ``place`` (over all), ``tree`` and ``at`` (the source and the place in it), ``n`` leaves of the
    tree, ``trees``. Nodes: see :func:`interior`; they include those of the tree of subroots."""
    leaf = leaf_hash([F.col(c) for c in fields])
    rows = settle(
        docs.select(
            F.col(id_col).alias("id"), F.col(source_col).alias("source"), leaf.alias("leaf"), *[c.alias(k) for k, c in extra.items()],
            F.monotonically_increasing_id().alias("_r"),
        )
    )
    placed = number_rows(rows, ["source", "id", "leaf", "_r"], "place").drop("_r")
    release(rows)
    sources = placed.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("first"))
    sources = settle(number_rows(sources, ["source"], "tree"))
    trees, most = sources.agg(F.count(F.lit(1)), F.coalesce(F.max("n"), F.lit(0))).first()
    leaves = attach(placed, sources, ["source"], null_safe=True).withColumn("at", F.col("place") - F.col("first")).withColumn("trees", F.lit(trees).cast("bigint"))
    leaves = leaves.drop("first")
    below = interior(leaves.select("tree", "at", F.col("leaf").alias("digest"), "n"), most)
    tops = join_null_safe(below, sources.select("tree", height(F.col("n")).alias("level")), ["tree", "level"])
    above = tops.select(F.lit(TOP).cast("bigint").alias("tree"), F.col("tree").alias("at"), "digest", F.lit(trees).cast("bigint").alias("n"))
    return leaves, below.unionByName(interior(settle(above), trees))


def _levels(n: int) -> int:
    k = 0
    while ARITY**k < n:
        k += 1
    return k


def _siblings(at: int, level: int, n: int) -> tuple[range, range]:
    """Places left and right of ``at`` in its run; ``n`` leaves in the tree."""
    last = -(-n // ARITY**level)
    run = at - at % ARITY
    return range(run, at), range(at + 1, min(run + ARITY, last))


def missing_nodes(leaves: list[tuple[int, int, int]], trees: int) -> list[tuple[int, int, int]]:
    """The least set of nodes ``(tree, level, at)`` that the proofs of ``(tree, at, n)`` need besides the leaves and what they give."""
    sizes = {t: n for t, _, n in leaves}
    known: dict[int, set[int]] = defaultdict(set)
    for t, at, _ in leaves:
        known[t].add(at)
    missing = []

    def climb(tree: int, level_nodes: set[int], n: int) -> None:
        for level in range(_levels(n)):
            for at in level_nodes:
                before, after = _siblings(at, level, n)
                missing.extend((tree, level, s) for s in (*before, *after) if s not in level_nodes)
            level_nodes = {at // ARITY for at in level_nodes}

    for t, places in known.items():
        climb(t, places, sizes[t])
    climb(TOP, set(sizes), trees)
    return sorted(set(missing))


def expand(leaves: list[tuple[int, int, int, str]], trees: int, fetched: dict[tuple[int, int, int], str]) -> list[list[dict]]:
    """The proof of every leaf ``(tree, at, n, digest)``: shared interior nodes are derived once."""
    node = dict(fetched)
    sizes = {t: n for t, _, n, _ in leaves}
    paths: dict[int, set[int]] = defaultdict(set)
    for t, at, _, digest in leaves:
        node[t, 0, at] = digest
        paths[t].add(at)
    steps: dict[tuple[int, int, int], dict] = {}

    def climb(tree: int, places: set[int], n: int) -> None:
        for level in range(_levels(n)):
            for at in places:
                before, after = _siblings(at, level, n)
                left, right = ("".join(node[tree, level, s] for s in side) for side in (before, after))
                steps[tree, level, at] = {"before": left, "after": right}
                up = (tree, level + 1, at // ARITY)
                if up not in node:
                    node[up] = hashlib.sha256((left + node[tree, level, at] + right).encode()).hexdigest()
            places = {at // ARITY for at in places}

    for t, places in paths.items():
        climb(t, places, sizes[t])
        node[TOP, 0, t] = node[t, _levels(sizes[t]), 0]
    climb(TOP, set(sizes), trees)
    top = {t: [steps[TOP, k, t // ARITY**k] for k in range(_levels(trees))] for t in sizes}
    return [[steps[t, k, at // ARITY**k] for k in range(_levels(n))] + top[t] for t, at, n, _ in leaves]


def prove(leaves: DataFrame, nodes: DataFrame, part: int = PART) -> DataFrame:
    """``place, proof`` of the given leaves (all those of :func:`manifest`, or some), by one multiproof per ``part`` places."""
    asked = leaves.select(F.floor(F.col("place") / part).cast("bigint").alias("octopus"), "place", "tree", "at", "n", "trees", F.col("leaf").alias("digest"))

    def arms(t: pa.Table) -> pa.Table:
        rows = list(zip(*(t.column(c).to_pylist() for c in ("tree", "at", "n"))))
        need = missing_nodes(rows, t.column("trees")[0].as_py())
        cols = zip(*need) if need else ((), (), ())
        tree, level, at = (list(c) for c in cols)
        one = pa.array([t.column("octopus")[0].as_py()] * len(need), pa.int64())
        return pa.table([one, pa.array(tree, pa.int64()), pa.array(level, pa.int32()), pa.array(at, pa.int64())], names=["octopus", "tree", "level", "at"])

    need = asked.groupBy("octopus").applyInArrow(arms, "octopus bigint, tree bigint, level int, at bigint")
    fetched = need.join(nodes, ["tree", "level", "at"])

    def write(t: pa.Table, f: pa.Table) -> pa.Table:
        have = dict(zip(zip(*(f.column(c).to_pylist() for c in ("tree", "level", "at"))), f.column("digest").to_pylist()))
        rows = list(zip(*(t.column(c).to_pylist() for c in ("tree", "at", "n", "digest"))))
        proofs = expand(rows, t.column("trees")[0].as_py(), have) if rows else []
        step = pa.struct([("before", pa.string()), ("after", pa.string())])
        return pa.table([t.column("place").combine_chunks() if rows else pa.array([], pa.int64()), pa.array(proofs, pa.list_(step))], names=["place", "proof"])

    return asked.groupBy("octopus").cogroup(fetched.groupBy("octopus")).applyInArrow(write, f"place bigint, proof {PROOF}")


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf leads to along a proof."""
    return F.aggregate(proof, leaf, lambda h, s: F.sha2(F.concat(s["before"], h, s["after"]), 256))


def proof_text(proof: Column) -> Column:
    """All siblings of a proof, level by level, left to right."""
    return F.array_join(F.transform(proof, lambda s: F.concat(s["before"], s["after"])), "")


def prove_all(docs: DataFrame, fields: Sequence[str] = FIELDS, id_col: str = "doc_id", source_col: str = "source", part: int = PART, **extra: Column) -> DataFrame:
    """One row per row of ``docs``: ``id, source, leaf``, the ``extra`` columns, ``subroot, root, proof``."""
    leaves, nodes = manifest(docs, fields, id_col, source_col, **extra)
    proofs = prove(leaves, nodes, part)
    trees = leaves.select("tree", "trees").limit(1).first()
    if trees is None:
        root = F.lit(None).cast("string")
    else:
        at_top = nodes.where((F.col("tree") == TOP) & (F.col("level") == _levels(trees["trees"]))).first()
        root = F.lit(at_top["digest"])
    subroots = nodes.where((F.col("tree") == TOP) & (F.col("level") == 0)).select(F.col("at").alias("tree"), F.col("digest").alias("subroot"))
    out = attach(leaves, subroots, ["tree"]).join(proofs, "place")
    return out.select("id", "source", "leaf", *extra, "subroot", root.alias("root"), "proof")
