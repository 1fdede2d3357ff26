"""Similarity join on word n-grams with adaptive multi-match prefixes.

A document's set holds its distinct 5-word shingles (64-bit hashes of lower-cased words; the whole sequence as one shingle where
there are fewer words). Documents link when ``100 * intersection >= percent * union``.

Equal sets are one class, so copies never meet in pairs. A count-min sketch of all shingles (fixed size, one pass over all texts)
estimates how many documents hold a shingle; shingles are ordered rarest first. A set of size n that needs o = ceil(percent * n /
100) common shingles has the prefix ``n - o + lift``: two linked sets share at least ``min(lift, lift')`` shingles within their
prefixes. Each document picks the lift with the smallest estimated cost of scanning its prefix and verifying what that leaves;
documents whose prefix is shared by many get longer prefixes and must share more of them.

Links are only needed as far as they connect, so candidates come in two steps. First every document meets ``HUBS`` documents of
similar size for each of its prefix shingles, which joins near copies of one text without pairing them all. Then documents that
share prefix shingles across different components so far are paired, all of them: by a join where few are outside a shingle's largest
component, by matrix products over blocks of documents elsewhere, once for lists of nearly the same documents. Both steps count shared prefix shingles per pair, ask for as many as the lifts, the sizes and the ends
of the two prefixes imply, and verify on whole sets. The second step runs first with the best ``PARTNERS`` of each document only,
again while that links many, so that the pairs of one large group are few when all are asked for once. Pairs verified before are not
verified again. No link between different components is lost, so the components are exact, however many rounds were run.

Null, empty and blank texts have an empty set and link with nothing. Component ids are smallest ids, null only if all ids of the
component are null. Rows that repeat an id are documents of their own. An empty table gives an empty table.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import release, settle
from .common import map_rows, text_of
from .components import connected_components, joined_components

N = 5
PERCENT = 75
MAX_LIFT = 8
VERIFY_COST = 0.05
SKETCH_BITS = 19
BLOCK_BITS = 13
BROADCAST_IDS = 1_000_000
HUBS = 3
LIGHT = 32
BLOCK = 16_384
STRIP = 256
COLUMNS = 2048
CACHE_WORDS = 300_000
AGAIN = 0.5
PARTNERS = 16
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


class _WordHashes(dict):
    """64-bit hash of a word, emptied when full."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > CACHE_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _ODD[0]
    h = (h ^ (h >> np.uint64(29))) * _ODD[1]
    return h ^ (h >> np.uint64(32))


def shingle_set(text: bytes, hashes: dict, n: int = N) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes of a UTF-8 text."""
    words = text.lower().split()  # for bytes: A-Z only, and white space is exactly x20 and x09 to x0D
    if not words:
        return np.zeros(0, "uint64")
    ids = np.fromiter(map(hashes.__getitem__, words), "uint64", len(words))
    size = min(n, len(ids))
    h = np.full(len(ids) - size + 1, size, "uint64")
    for j in range(size):
        h = _mixed(h + ids[j : len(ids) - size + 1 + j] * _ODD[j % len(_ODD)])
    return np.unique(h)


def set_digest(tokens: np.ndarray) -> tuple[int, int]:
    import xxhash

    raw = xxhash.xxh3_128_digest(tokens.tobytes())
    return int.from_bytes(raw[:8], "little", signed=True), int.from_bytes(raw[8:], "little", signed=True)


def _cells(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    mask = np.uint64((1 << SKETCH_BITS) - 1)
    return (tokens & mask).astype("int64"), ((tokens >> np.uint64(32)) & mask).astype("int64")


class Frequencies:
    """Count-min sketch with two rows; ``documents`` estimates how many other documents hold each shingle."""

    def __init__(self, counts: np.ndarray):
        self.counts = counts
        self.noise = counts[0].sum() / counts.shape[1]

    def others(self, tokens: np.ndarray) -> np.ndarray:
        a, b = _cells(tokens)
        return np.maximum(0.0, np.minimum(self.counts[0][a], self.counts[1][b]) - 1 - self.noise)


def need(n: int, percent: int = PERCENT) -> int:
    """Smallest intersection a set of size n can link with."""
    return -(-percent * n // 100)


def prefix_of(tokens: np.ndarray, others: np.ndarray, percent: int = PERCENT, max_lift: int = MAX_LIFT) -> tuple[int, np.ndarray, tuple[float, int]]:
    """The lift with the smallest estimated cost, the prefix in the common order (rarest first, then by hash), and the place of
    its last shingle in that order."""
    order = np.lexsort((tokens, others))
    n, o = len(tokens), need(len(tokens), percent)
    scan = np.cumsum(others[order])
    lifts = np.arange(1, min(max_lift, o) + 1)
    shared = scan[n - o + lifts - 1]  # postings met by each prefix
    cost = shared * (1 + VERIFY_COST * n / lifts)
    lift = int(lifts[np.argmin(cost)])
    last = order[n - o + lift - 1]
    return lift, tokens[order[: n - o + lift]], (float(others[last]), int(tokens[last] >> np.uint64(1)))


def read_documents(docs: DataFrame, id_col: str, text_col: str, n: int) -> tuple[DataFrame, np.ndarray]:
    """One pass over all texts: ``id, t, n, d1, d2`` per row, written out, and the summed sketch."""
    kind = docs.select(F.col(id_col)).schema[0].dataType.simpleString()
    text = text_of(text_col)
    size = 1 << BLOCK_BITS

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        hashes, sketch = _WordHashes(), np.zeros((2, 1 << SKETCH_BITS), "int64")
        for key, t, data in rows:
            tokens = shingle_set(data, hashes, n)
            for row, cells in zip(sketch, _cells(tokens)):
                np.add.at(row, cells, 1)
            yield (key, t, len(tokens), *set_digest(tokens), None, None)
        for i, block in enumerate(sketch.reshape(-1, size)):
            if block.any():
                yield None, None, None, None, None, i, zlib.compress(block.astype("<i8").tobytes(), 1)

    schema = f"id {kind}, t bigint, n int, d1 bigint, d2 bigint, block int, counts binary"
    found = settle(map_rows(docs.select(F.col(id_col), F.xxhash64(text), text.cast("binary")), run, schema))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, raw in zip(batch.column("block").to_pylist(), batch.column("counts").to_pylist()):
                sums[i] = sums.get(i, 0) + np.frombuffer(zlib.decompress(raw), "<i8")
        if sums:
            yield pa.RecordBatch.from_pydict({"block": pa.array(list(sums), pa.int32()), "counts": [zlib.compress(x.tobytes(), 1) for x in sums.values()]})

    blocks = 2 << (SKETCH_BITS - BLOCK_BITS)
    parts = found.where(F.col("block").isNotNull()).select("block", "counts").repartition(blocks, "block")
    total = np.zeros((blocks, size), "int64")
    for row in parts.mapInArrow(add, "block int, counts binary").collect():  # the sketch: 8 MB, whatever the corpus
        total[row["block"]] += np.frombuffer(zlib.decompress(row["counts"]), "<i8")
    return found.where(F.col("block").isNull()).select("id", "t", "n", "d1", "d2"), total.reshape(2, -1)


def classes_of(docs: DataFrame, sketch: np.ndarray, id_col: str, text_col: str, n: int, percent: int, max_lift: int) -> DataFrame:
    """``v, d1, d2, first_id, first_t, n, lift, cut, prefix``: one row per distinct non-empty set, written out."""
    kind = docs.select(F.col(id_col)).schema[0].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(Frequencies(sketch.astype("float32")))

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        hashes, known = _WordHashes(), shared.value
        for key, t, data in rows:
            tokens = shingle_set(data, hashes, n)
            if len(tokens):
                lift, prefix, (f, h) = prefix_of(tokens, known.others(tokens), percent, max_lift)
                yield (key, t, *set_digest(tokens), len(tokens), lift, {"f": f, "h": h}, prefix.view("int64"))

    schema = f"id {kind}, t bigint, d1 bigint, d2 bigint, n int, lift int, cut struct<f: double, h: bigint>, prefix array<bigint>"
    rows = map_rows(docs.select(F.col(id_col), F.xxhash64(text_of(text_col)), text_of(text_col).cast("binary")), run, schema)
    head = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "t"))
    one = rows.groupBy("d1", "d2").agg(
        head["id"].alias("first_id"), head["t"].alias("first_t"), *[F.first(c).alias(c) for c in ("n", "lift", "cut", "prefix")]
    )
    return settle(one.withColumn("v", F.monotonically_increasing_id()))


def fits(a: Column, b: Column, percent: int) -> Column:
    """Two sets of these sizes can link at all."""
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def asked(nx, ny, lx, ly, x_first, y_first, percent, low, high, up, when):
    """How many prefix shingles two sets must share to be worth verifying.

    Common shingles up to the earlier of the two cuts are in both prefixes and counted; beyond it there are at most as many as the
    set with the earlier cut has left, its size less its prefix. What the pair needs less that rest is asked for, and the smaller
    lift in any case. The arithmetic is handed in, for columns and for arrays.
    """
    rest_x, rest_y = up(nx * percent / 100) - lx, up(ny * percent / 100) - ly
    beyond = when(x_first, rest_x, when(y_first, rest_y, low(rest_x, rest_y)))
    return high(low(lx, ly), up((nx + ny) * percent / (100 + percent)) - beyond)


def enough(pairs: DataFrame, facts: DataFrame, percent: int, besides: DataFrame | None = None) -> DataFrame:
    """``a, b, na, nb, c`` of the pairs ``v, v_`` (a row per shared shingle) that share enough; ``facts`` holds ``v, n, lift, cut``.

    ``besides`` (``v, h``) counts shingles not joined here; a pair may share the smaller of its two numbers of them too.
    """
    counted = pairs.groupBy(F.least("v", "v_").alias("a"), F.greatest("v", "v_").alias("b")).agg(F.count(F.lit(1)).alias("c"))
    for end, name in (("a", "x"), ("b", "y")):
        counted = counted.join(facts.select(F.col("v").alias(end), F.struct("n", "lift", "cut").alias(name)), end)
        if besides is not None:
            counted = counted.join(besides.select(F.col("v").alias(end), F.col("h").alias(f"h{end}")), end, "left")
    if besides is not None:
        counted = counted.withColumn("c", F.col("c") + F.least(F.coalesce("ha", F.lit(0)), F.coalesce("hb", F.lit(0))))
    least = asked(
        F.col("x.n"), F.col("y.n"), F.col("x.lift"), F.col("y.lift"), F.col("x.cut") < F.col("y.cut"), F.col("y.cut") < F.col("x.cut"),
        percent, F.least, F.greatest, F.ceil, lambda c, p, q: F.when(c, p).otherwise(q),
    )
    return counted.where(F.col("c") >= least).select("a", "b", F.col("x.n").alias("na"), F.col("y.n").alias("nb"), "c")


def hub_pairs(postings: DataFrame, percent: int, hubs: int = HUBS) -> DataFrame:
    """``v, v_``: each document with a few others of similar size for each of its prefix shingles, the same ones for all that hold
    it: those that come first in ``hubs`` different shuffles."""
    band = F.floor(F.log(F.col("n").cast("double")) / F.lit(math.log(100 / percent))).cast("int")
    banded = postings.withColumn("band", band)
    first = [F.min_by(F.struct("v", "n"), F.struct(F.xxhash64("v", F.lit(i)), "v")) for i in range(hubs)]
    chosen = banded.groupBy("t", "band").agg(F.array(*first).alias("ys"))
    met = banded.join(chosen, ["t", "band"]).select("v", "n", F.explode(F.array_distinct("ys")).alias("y"))
    met = met.where((F.col("v") != F.col("y.v")) & fits(F.col("n"), F.col("y.n"), percent))
    return met.select("v", F.col("y.v").alias("v_"))


def families(heavy: DataFrame) -> DataFrame:
    """``f, v, comp``: the lists ``t`` of ``heavy`` put together where they hold nearly the same documents, each document once.

    A list goes to the family of the longest list of most of its documents. Where comparing a family's documents with each other takes
    more than comparing those of its lists, the lists stay apart. Documents that share a list share a family in any case.
    """
    longest = F.max(F.struct("df", "t"))["t"].alias("f")
    votes = heavy.groupBy("v").agg(longest, F.collect_list("t").alias("ts")).select("f", F.explode("ts").alias("t"))
    votes = votes.groupBy("t", "f").agg(F.count(F.lit(1)).alias("c"))
    chosen = votes.groupBy("t").agg(F.max_by("f", F.struct("c", "f")).alias("f"))
    placed = heavy.select("t", "v", "comp", "df").join(chosen, "t")
    # a row for each document of a list: its length, summed over them, is its square
    costs = placed.groupBy("f").agg(F.count_distinct("v").alias("size"), F.sum("df").alias("apart"))
    costs = costs.select("f", (F.col("size") * F.col("size") > F.col("apart")).alias("split"))
    return placed.join(costs, "f").select(F.when(F.col("split"), F.col("t")).otherwise(F.col("f")).alias("f"), "v", "comp").distinct()


def cross_pairs(
    postings: DataFrame, prefixes: DataFrame, facts: DataFrame, comps: DataFrame, seen: DataFrame, percent: int, best: bool
) -> DataFrame:
    """``a, b, na, nb``: all pairs in different components so far, and not in ``seen``, that share enough prefix shingles; with
    ``best`` only the ``PARTNERS`` that share most with each document. Written out.

    For each shingle its largest component is met by the documents of all others; two documents of one component never meet. Where
    at most ``LIGHT`` documents are outside the largest component this is a join, with at most ``LIGHT`` rows per posting. Longer
    lists of documents that are alike but not linked are put together in families and compared in blocks by matrix products, which
    emit only pairs that share enough.
    """
    known = settle(postings.join(comps, "v", "left").select("t", "v", "n", F.coalesce("comp", "v").alias("comp")))
    per = known.groupBy("t", "comp").agg(F.count(F.lit(1)).alias("c"))
    lists = per.groupBy("t").agg(F.max_by("comp", F.struct("c", "comp")).alias("main"), F.max("c").alias("most"), F.sum("c").alias("df"))
    lists = lists.where(F.col("df") > F.col("most")).withColumn("light", F.col("df") - F.col("most") <= LIGHT)
    rows = settle(known.join(lists.select("t", "main", "df", "light"), "t").withColumn("out", F.col("comp") != F.col("main")).drop("main"))
    light = rows.where("light")
    other = light.where("out").select("t", *[F.col(c).alias(f"{c}_") for c in ("v", "n", "comp")])
    met = light.join(other, "t").where((F.col("comp") != F.col("comp_")) & (~F.col("out") | (F.col("v") < F.col("v_"))))
    met = met.where(fits(F.col("n"), F.col("n_"), percent)).select("v", "v_")
    # a light list gives each of its shared shingles; those of heavy lists are added to the count as if all were shared
    heavy = rows.where(~F.col("light"))
    extra = heavy.groupBy("v").agg(F.count(F.lit(1)).alias("h"))
    members = settle(families(heavy))
    pairs = enough(met, facts, percent, extra).unionByName(block_pairs(members, prefixes, facts, percent, best))
    pairs = pairs.join(seen, ["a", "b"], "left_anti")
    if best:
        ends = pairs.select(F.explode(F.array("a", "b")).alias("v"), "*")
        nearest = Window.partitionBy("v").orderBy(F.col("c").desc(), "a", "b")
        pairs = ends.withColumn("_n", F.row_number().over(nearest)).where(F.col("_n") <= PARTNERS).drop("v", "_n")
    out = settle(pairs.dropDuplicates(["a", "b"]))
    release(known, rows, members)
    return out


def block_pairs(members: DataFrame, prefixes: DataFrame, facts: DataFrame, percent: int, best: bool) -> DataFrame:
    """``a, b, na, nb, c`` of the pairs within the families of ``members`` that share enough of their prefix shingles ``p``.

    A family is cut into blocks of about ``BLOCK`` documents, so that it is moved once unless it is larger; a task holds two blocks and compares them in
    strips of ``STRIP`` documents.
    """
    per = members.groupBy("f", "comp").agg(F.count(F.lit(1)).alias("c"))
    sizes = per.groupBy("f").agg(F.max_by("comp", F.struct("c", "comp")).alias("main"), F.sum("c").alias("df"))
    sets = prefixes.join(members.groupBy("v").agg(F.collect_list("f").alias("q")), "v")
    sets = sets.join(facts.select("v", F.struct("n", "lift", "cut").alias("x")), "v")
    parts = F.ceil(F.col("df") / F.lit(BLOCK)).cast("int")
    cut = members.join(sizes, "f").select("f", "v", "comp", (F.col("comp") != F.col("main")).alias("out"), parts.alias("parts"))
    cut = cut.withColumn("own", F.pmod(F.xxhash64("v", "f"), F.col("parts")).cast("int"))
    spread = cut.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    spread = spread.select("f", F.least("own", "with").alias("i"), F.greatest("own", "with").alias("j"), "own", "v", "comp", "out").join(sets, "v")

    def lists(rows: pa.Table, name: str, below: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The values of the list column ``name`` (less than ``below``) that several rows have, numbered, with the row of each."""
        column = rows.column(name).combine_chunks()
        values, doc = column.flatten().to_numpy(), np.repeat(np.arange(rows.num_rows), np.diff(column.offsets.to_numpy()))
        if below is not None:
            values, doc = values[values < below], doc[values < below]
        _, number, count = np.unique(values, return_inverse=True, return_counts=True)
        several = count[number] > 1
        return number[several], doc[several]

    def common(values: np.ndarray, doc: np.ndarray, rows: int, strip: np.ndarray, right: np.ndarray) -> np.ndarray:
        """How many values the rows of a strip share with each row on the right: only the strip's values take up columns."""
        own = np.unique(values[np.isin(doc, strip)])
        place = np.full(int(values.max(initial=-1)) + 1, -1)
        place[own] = np.arange(len(own))
        column = place[values] if len(values) else values
        same = np.zeros((len(strip), len(right)), "float32")
        for start in range(0, len(own), COLUMNS):
            here = (column >= start) & (column < start + COLUMNS)
            whole = np.zeros((rows, COLUMNS), "float32")
            whole[doc[here], column[here] - start] = 1
            same += whole[strip] @ whole[right].T
        return same

    def compare(rows: pa.Table) -> pa.Table:
        f, i, j = (rows.column(k)[0].as_py() for k in ("f", "i", "j"))
        own, v, comp, out = (rows.column(k).to_numpy() for k in ("own", "v", "comp", "out"))
        x = rows.column("x").to_pylist()
        n, lift = (np.array([r[k] for r in x]) for k in ("n", "lift"))
        cuts = np.array([(r["cut"]["f"], r["cut"]["h"]) for r in x], dtype=[("f", "f8"), ("h", "i8")])
        place = np.unique(cuts, return_inverse=True)[1]
        left = np.flatnonzero((own == i) & (out if i == j else True))
        right = np.flatnonzero(own == j)
        prefixes, earlier = lists(rows, "p"), lists(rows, "q", f)
        ends_a, ends_b, counts = [], [], []
        for at in range(0, len(left), STRIP):
            strip = left[at : at + STRIP]
            same = common(*prefixes, rows.num_rows, strip, right)
            first = common(*earlier, rows.num_rows, strip, right) == 0  # a pair belongs to the first of the families that hold both
            nx, ny = n[strip][:, None], n[right][None, :]
            least = asked(
                nx, ny, lift[strip][:, None], lift[right][None, :], place[strip][:, None] < place[right][None, :],
                place[right][None, :] < place[strip][:, None], percent, np.minimum, np.maximum, np.ceil, np.where,
            )
            fit = 100 * np.minimum(nx, ny) >= percent * np.maximum(nx, ny)
            once = ~out[right][None, :] | (v[strip][:, None] < v[right][None, :]) if i == j else True
            r, c = np.nonzero((same >= least) & fit & first & once & (comp[strip][:, None] != comp[right][None, :]))
            if best and len(r):
                order = np.lexsort((-same[r, c], r))
                starts = np.flatnonzero(np.append(True, r[order][1:] != r[order][:-1]))
                near = np.arange(len(r)) - np.repeat(starts, np.diff(np.append(starts, len(r)))) < PARTNERS
                r, c = r[order][near], c[order][near]
            ends_a.append(strip[r])
            ends_b.append(right[c])
            counts.append(same[r, c].astype("int64"))
        a, b, shared = (np.concatenate(z) if z else np.zeros(0, "int64") for z in (ends_a, ends_b, counts))
        flip = v[a] > v[b]
        a, b = np.where(flip, b, a), np.where(flip, a, b)
        found = {"a": pa.array(v[a], pa.int64()), "b": pa.array(v[b], pa.int64()), "na": pa.array(n[a], pa.int32()), "nb": pa.array(n[b], pa.int32()), "c": pa.array(shared, pa.int64())}
        return pa.table(found)

    return spread.groupBy("f", "i", "j").applyInArrow(compare, "a bigint, b bigint, na int, nb int, c bigint")


def linked(pairs: DataFrame, docs: DataFrame, classes: DataFrame, id_col: str, text_col: str, n: int, percent: int) -> DataFrame:
    """``a, b, ok`` of the written ``pairs``: whether their whole sets link; written out. Only documents of candidate pairs are read
    for it."""
    nodes = pairs.select(F.col("a").alias("v")).unionByName(pairs.select(F.col("b").alias("v"))).distinct()
    wanted = settle(classes.select("v", "d1", "d2", "first_id").join(nodes, "v"))
    ids = wanted.select(F.col("first_id").alias("id")).distinct()
    if wanted.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).cast("binary").alias("text"))
    rows = rows.join(ids, rows["id"].eqNullSafe(ids["id"]), "left_semi").select("text")

    def run(batch: Iterator[tuple]) -> Iterator[tuple]:
        hashes = _WordHashes()
        for (data,) in batch:
            tokens = shingle_set(data, hashes, n)
            yield (*set_digest(tokens), tokens.view("int64"))

    sets = map_rows(rows, run, "d1 bigint, d2 bigint, tokens array<bigint>")
    sets = settle(sets.join(wanted.select("v", "d1", "d2"), ["d1", "d2"]).dropDuplicates(["v"]).select("v", "tokens"))
    both = pairs.join(sets.select(F.col("v").alias("b"), F.col("tokens").alias("tb")), "b")
    both = both.join(sets.select(F.col("v").alias("a"), F.col("tokens").alias("ta")), "a")
    same = F.size(F.array_intersect("ta", "tb"))
    out = settle(both.select("a", "b", (100 * same >= percent * (F.col("na") + F.col("nb") - same)).alias("ok")))
    release(pairs, wanted, sets)
    return out


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N, percent: int = PERCENT, max_lift: int = MAX_LIFT
) -> DataFrame:
    """One row per row of ``docs``: ``id_col, n_shingles, component_id``, a hash ``t`` of the text, and ``first``, which is true for
    the rows with the smallest id (of equal ids the smallest set digest, then the smallest text hash) of their component."""
    rows, sketch = read_documents(docs, id_col, text_col, n)
    classes = classes_of(docs, sketch, id_col, text_col, n, percent, max_lift)
    postings = classes.select("v", "n", F.explode("prefix").alias("t"))
    shared = postings.groupBy("t").agg(F.min("v").alias("a"), F.max("v").alias("b")).where(F.col("a") != F.col("b")).select("t")
    postings = settle(postings.join(shared, "t"))
    prefixes = settle(postings.groupBy("v").agg(F.collect_list("t").alias("p")))  # parts of them: what others have too
    facts = classes.select("v", "n", "lift", "cut")
    options = dict(docs=docs, classes=classes, id_col=id_col, text_col=text_col, n=n, percent=percent)
    seen = linked(settle(enough(hub_pairs(postings, percent), facts, percent)), **options)
    comps = settle(connected_components(seen.where("ok")))
    best, links = True, seen.where("ok").count()
    while True:
        more = linked(cross_pairs(postings, prefixes, facts, comps, seen.select("a", "b"), percent, best), **options)
        old, seen = seen, settle(seen.unionByName(more))
        gained = more.where("ok").count()
        if gained:
            before, comps = comps, settle(joined_components(comps, more.where("ok")))
            release(before)
        release(old, more)
        if not best:
            break
        links += gained
        best = gained > AGAIN * links

    named = classes.select("v", "d1", "d2", "first_id", "first_t").join(comps, "v", "left").withColumn("comp", F.coalesce("comp", "v"))
    named = settle(named)
    release(classes, postings, prefixes, seen, comps)
    place = F.struct(F.col("first_id").isNull().alias("none"), F.col("first_id").alias("id"), "d1", "d2", F.col("first_t").alias("t"))
    heads = named.groupBy("comp").agg(F.min(place).alias("head"))
    whole = named.join(heads, "comp").select("d1", "d2", "head")
    out = rows.join(whole, ["d1", "d2"], "left")
    alone = F.col("head").isNull()
    chosen = F.col("id").eqNullSafe(F.col("head.id")) & (F.col("d1") == F.col("head.d1")) & (F.col("d2") == F.col("head.d2"))
    chosen = chosen & (F.col("t") == F.col("head.t"))
    return out.select(
        F.col("id").alias(id_col),
        F.col("n").cast("bigint").alias("n_shingles"),
        F.when(alone, F.col("id")).otherwise(F.col("head.id")).alias("component_id"),
        "t",
        F.when(alone, F.lit(True)).otherwise(chosen).alias("first"),
    )


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row of every component, and every row without words, with all their columns: the row with the smallest id.

    The dropped rows are usually the smaller part, so they are what is joined; of rows that repeat id and text one stays.
    """
    marks = settle(near_duplicates(docs, id_col, text_col, **options))
    lost = marks.where(~F.col("first")).select(F.col(id_col).alias("_i"), F.col("t").alias("_t")).distinct()
    again = marks.where(F.col("first") & (F.col("n_shingles") > 0)).groupBy(F.col(id_col).alias("_i"), F.col("t").alias("_t")).count()
    again = again.where(F.col("count") > 1).select("_i", "_t", F.lit(True).alias("_again"))
    keyed = docs.select(F.struct("*").alias("_row"), F.col(id_col).alias("_id"), F.xxhash64(text_of(text_col)).alias("_h"))
    if marks.where(~F.col("first")).count() <= BROADCAST_IDS:
        lost = F.broadcast(lost)
    same = lambda other: keyed["_id"].eqNullSafe(other["_i"]) & (keyed["_h"] == other["_t"])
    left = keyed.join(lost, same(lost), "left_anti")
    if not again.isEmpty():
        marked = left.join(again, left["_id"].eqNullSafe(again["_i"]) & (left["_h"] == again["_t"]), "left")
        number = F.row_number().over(Window.partitionBy("_id", "_h").orderBy(F.lit(0)))
        left = marked.withColumn("_n", number).where(F.col("_again").isNull() | (F.col("_n") == 1))
    return left.select("_row.*")
