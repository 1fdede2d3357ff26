"""Near duplicates among vectors by a pivot-permutation index.

Index: reference points (pivots) are chosen far from one another out of a bounded, documented sample (``sample`` distinct vectors
with the smallest hash; only the sample and the ``pivots`` reach the driver). Every distinct vector of the table is described by its
``near`` nearest pivots, in order of nearness.

Retrieval: an inverted list per pivot holds the vectors described by it. Two vectors are candidates when they share at least
``shared`` pivots. Pivots are numbered from rare to frequent, and a vector enters the lists of its first ``near - shared + 1`` pivots only:
two candidates always meet in the list of their rarest shared pivot, and are counted there alone. A list of more than ``long_list``
vectors is cut by the next shared pivot, as long as that halves the comparisons; nothing is capped. Lists are compared in blocks of
``BLOCK`` vectors: shared pivots are counted on bit sets, candidates verified by their cosine in double precision. A block returns the
number of links per vector and a spanning forest of them, never the pairs.

Cost: a vector meets about ``near / pivots`` of the table in lists, before long lists are cut. Vectors that are all alike stay in one
list, as every pair of them is a link to be counted: that work grows with the square of such a group, without pairs being stored.

Vectors that are null, empty, zero, of another length than the most common one, or hold null or non-finite components link with
nothing. Rows are nodes, also with repeated or null ids; equal vectors are one entry of the index, their rows link to each other. The component of a
row is the smallest non-null id reachable, null where there is none. Of the rows with that id every one is kept, so are rows of a component without ids. Tables may
be empty; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..lookup import attach
from ..session import release, settle
from .ann import _matrix
from .components import connected_components

COSINE = 0.95
PIVOTS = 512
NEAR = 16
SHARED = 7
SAMPLE = 8_192
LONG_LIST = 8_192
BLOCK = 1_024
HOT_COPIES = 1_000
LINKS = "e bigint, n bigint, to bigint"


def spread_pivots(sample: np.ndarray, pivots: int) -> np.ndarray:
    """Unit vectors, each taken farthest from those before it, so that a group of alike vectors gives few of them."""
    unit = sample / np.linalg.norm(sample, axis=1, keepdims=True)
    chosen = [0]
    nearest = unit @ unit[0]
    while len(chosen) < min(pivots, len(unit)):
        chosen.append(int(np.argmin(nearest)))
        nearest = np.maximum(nearest, unit @ unit[chosen[-1]])
    return unit[chosen]


def entries_of(vectors: DataFrame, id_col: str, vec_col: str) -> tuple[DataFrame, DataFrame]:
    """``(rows, entries)``, both written out: rows ``r, id, h`` (``h`` null: takes no part), entries ``e, v, h, copies, least``."""
    v = F.col(vec_col)
    if dict(vectors.dtypes)[vec_col] not in ("array<float>", "array<double>"):
        v = v.cast("array<double>")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), v.alias("v"))
    good = F.coalesce(finite & F.exists("v", lambda x: x != 0), F.lit(False))
    common = rows.where(good).groupBy(F.size("v").alias("d")).count().orderBy(F.col("count").desc(), "d").first()
    key = F.unhex(F.sha2(F.concat_ws(",", F.col("v").cast("array<string>")), 256))
    h = F.when(good & (F.size("v") == F.lit(common["d"] if common else 0)), key)
    rows = settle(rows.select("id", "v", h.alias("h"), F.monotonically_increasing_id().alias("r")))
    one = rows.where(F.col("h").isNotNull()).groupBy("h").agg(F.first("v").alias("v"), F.count(F.lit(1)).alias("copies"), F.min("id").alias("least"))
    return rows, settle(one.withColumn("e", F.monotonically_increasing_id()))


def describe(entries: DataFrame, pivots: int = PIVOTS, near: int = NEAR, sample: int = SAMPLE) -> DataFrame:
    """``entries`` plus ``order``, their nearest pivots from the nearest on, written out."""
    picked = entries.orderBy("h").limit(sample).select("v").toArrow()
    points = spread_pivots(_matrix(picked.column("v").combine_chunks()), pivots) if picked.num_rows else np.zeros((0, 0))
    shared = entries.sparkSession.sparkContext.broadcast(points)  # at most `pivots` vectors
    kind = entries.schema["v"].dataType.simpleString()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column("v"))
            if not len(x):
                continue
            order = np.argsort(-(x @ shared.value.T), axis=1, kind="stable")[:, :near].astype("int32")  # lengths do not change the order
            yield pa.RecordBatch.from_arrays(
                [b.column("e"), b.column("v"), b.column("copies"), pa.FixedSizeListArray.from_arrays(order.ravel(), order.shape[1]).cast(pa.list_(pa.int32()))],
                names=["e", "v", "copies", "order"],
            )

    return settle(entries.select("e", "v", "copies").mapInArrow(place, f"e bigint, v {kind}, copies bigint, order array<int>"))


def rare_first(described: DataFrame) -> DataFrame:
    """``e, pre``: the pivots of an entry, renumbered from rare to frequent and sorted. The renumbering has a row per pivot."""
    used = described.select(F.explode("order").alias("p")).groupBy("p").count().orderBy("count", "p").collect()
    numbers = {r["p"]: i for i, r in enumerate(used)}
    if not numbers:
        return described.select("e", F.col("order").alias("pre"))
    table = F.array(*[F.lit(numbers.get(p, -1)) for p in range(max(numbers) + 1)])
    return described.select("e", F.array_sort(F.transform("order", lambda p: F.get(table, p))).alias("pre"))


def inverted_lists(prefixes: DataFrame, near: int, shared: int, long_list: int = LONG_LIST) -> tuple[DataFrame, DataFrame]:
    """``(lists, sizes)``: ``key array<int>, e, pre`` and ``key, rows``; long lists are cut by further pivots where that halves their comparisons."""

    def start(rows: DataFrame) -> DataFrame:
        heads = rows.select("e", "pre", F.posexplode(F.slice("pre", 1, F.greatest(F.size("pre") - (shared - 1), F.lit(1)))).alias("at", "p"))
        return heads.select(F.array("p").alias("key"), "e", "pre", "at")

    def further(rows: DataFrame, depth: int) -> DataFrame:
        upto = F.size("pre") - shared + depth + 1
        tails = rows.select("key", "e", "pre", F.posexplode("pre").alias("i", "p"), "at").where((F.col("i") > F.col("at")) & (F.col("i") < upto))
        return tails.select(F.concat("key", F.array("p")).alias("key"), "e", "pre", F.col("i").alias("at"))

    lists, sizes = None, None
    level = settle(start(prefixes))
    for depth in range(1, shared + 1):
        counts = settle(level.groupBy("key").agg(F.count(F.lit(1)).alias("rows")))
        most = counts.agg(F.max("rows")).first()[0] or 0
        cut = None
        if depth < shared and most > long_list:
            long = counts.where(F.col("rows") > long_list)
            deeper = further(attach(level, long, ["key"]), depth)
            work = deeper.groupBy("key").agg(F.count(F.lit(1)).cast("double").alias("n"))
            work = work.groupBy(F.slice("key", 1, depth).alias("key")).agg(F.sum(F.col("n") * F.col("n")).alias("pairs"))
            worth = F.col("pairs") * 2 <= F.col("rows").cast("double") * F.col("rows")
            cut = settle(long.join(work, "key", "left").where(F.coalesce(worth, F.lit(True))).select("key", F.lit(True).alias("_cut")))
        whole, sized = level, counts
        if cut is not None:
            whole = attach(level, cut, ["key"], how="left").where(F.col("_cut").isNull()).drop("_cut")
            sized = counts.join(cut, "key", "left_anti")
        whole = whole.select("key", "e", "pre")
        lists = whole if lists is None else lists.unionByName(whole)
        sizes = sized if sizes is None else sizes.unionByName(sized)
        if cut is None or cut.isEmpty():
            break
        level = settle(further(attach(level, cut, ["key"]).drop("_cut"), depth))
    return lists, sizes


def bit_sets(prefixes: np.ndarray) -> np.ndarray:
    """One row of 64-bit words per prefix."""
    words = np.zeros((len(prefixes), int(prefixes.max(initial=0)) // 64 + 1), "uint64")
    rows = np.arange(len(prefixes))
    for column in prefixes.T:
        words[rows, column // 64] |= np.uint64(1) << (column % 64).astype("uint64")
    return words


def links_of_block(key: list[int], pre: np.ndarray, x: np.ndarray, e: np.ndarray, copies: np.ndarray, side: np.ndarray, shared: int, cosine: float):
    """``e, n, to``: links counted at this list between the two sides of a block (within it, where there is one side only)."""
    sets = bit_sets(pre)
    below = np.zeros(sets.shape[1], "uint64")
    for b in range(key[-1]):
        if b not in key:
            below[b // 64] |= np.uint64(1) << np.uint64(b % 64)
    a = np.flatnonzero(side == 0)
    two = bool((side == 1).any())
    b = np.flatnonzero(side == 1) if two else a
    common = np.zeros((len(a), len(b)), "uint8")
    for w in range(sets.shape[1]):
        common += np.bitwise_count(sets[a, w][:, None] & sets[b, w][None, :])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    close = (common >= shared) & (unit[a] @ unit[b].T >= cosine)
    if not two:
        close = np.triu(close, 1)
    i, j = np.nonzero(close)
    i, j = a[i], b[j]
    here = np.ones(len(i), bool)
    for w in range(sets.shape[1]):  # no shared pivot before the key: pairs are counted at one list only
        here &= (sets[i, w] & sets[j, w] & below[w]) == 0
    i, j = i[here], j[here]
    n = np.bincount(i, copies[j], len(e)) + np.bincount(j, copies[i], len(e))
    to = np.arange(len(e))
    while True:
        low = np.minimum(to[i], to[j])
        new = to.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == to).all():
            break
        to = new
    got = n > 0
    return e[got], n[got].astype("int64"), e[to[got]]


def links(described: DataFrame, near: int = NEAR, shared: int = SHARED, cosine: float = COSINE, long_list: int = LONG_LIST) -> DataFrame:
    """``e, n, to``: per list and block the links counted there, weighted by copies, and an entry reached by them. Written out."""
    prefixes = rare_first(described)
    lists, sizes = inverted_lists(prefixes, near, shared, long_list)
    parts = sizes.where(F.col("rows") > 1).select("key", F.ceil(F.col("rows") / F.lit(BLOCK)).cast("int").alias("parts"))
    held = attach(lists, parts, ["key"]).withColumn("part", F.pmod(F.xxhash64("e"), F.col("parts")).cast("int"))
    others = F.transform(
        F.sequence(F.lit(0), F.col("parts") - 1),
        lambda o: F.struct(F.least("part", o).alias("i"), F.greatest("part", o).alias("j"), F.when(o < F.col("part"), 1).otherwise(0).alias("side")),
    )
    met = held.join(described.select("e", "v", "copies"), "e").select("key", "pre", "e", "v", "copies", F.inline(others))

    def compare(t: pa.Table) -> pa.Table:
        pre = np.array(t.column("pre").to_pylist())
        found = links_of_block(
            t.column("key")[0].as_py(), pre, _matrix(t.column("v").combine_chunks()), t.column("e").to_numpy(),
            t.column("copies").to_numpy(), t.column("side").to_numpy(), min(shared, pre.shape[1]), cosine,
        )
        return pa.table(dict(zip(("e", "n", "to"), (pa.array(c, pa.int64()) for c in found))))

    return settle(met.groupBy("key", "i", "j").applyInArrow(compare, LINKS))


def near_duplicates(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    cosine: float = COSINE,
    pivots: int = PIVOTS,
    near: int = NEAR,
    shared: int = SHARED,
    sample: int = SAMPLE,
    long_list: int = LONG_LIST,
) -> DataFrame:
    """One row per row of ``vectors``: ``id_col, n_links, component_id, kept``."""
    rows, entries = entries_of(vectors, id_col, vec_col)
    described = describe(entries, pivots, near, sample)
    found = links(described, near, shared, cosine, long_list)
    comps = connected_components(found.select(F.col("e").alias("a"), F.col("to").alias("b")))
    slim = entries.select("e", "h", "copies", "least")
    homes = slim.join(comps.withColumnRenamed("v", "e"), "e", "left").withColumn("comp", F.coalesce("comp", "e"))
    least = homes.groupBy("comp").agg(F.min("least").alias("component_id"))
    counted = found.groupBy("e").agg(F.sum("n").alias("n"))
    known = settle(
        homes.join(least, "comp").join(counted, "e", "left").select(
            "h", "copies", "component_id", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links")
        )
    )
    release(described, found)
    hot = attach(rows.select("id", "h"), known.where(F.col("copies") >= HOT_COPIES), ["h"], how="left")
    cold = hot.where(F.col("copies").isNull()).select("id", "h").join(known.where(F.col("copies") < HOT_COPIES), "h", "left")
    alone = F.col("copies").isNull()
    component = F.when(alone, F.col("id")).otherwise(F.col("component_id"))
    return hot.where(F.col("copies").isNotNull()).unionByName(cold).select(
        F.col("id").alias(id_col),
        F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        component.alias("component_id"),
        F.col("id").eqNullSafe(component).alias("kept"),
    )
