"""Mixing sources to target weights by weighted fair queueing.

Every source is a queue of its documents in shuffled order (by a hash of id and text), offered up to ``max_repeats`` times over.
A document's virtual finish time is the number of words its source has sent up to and including it, divided by the source's
target. The mix is the prefix, in order of finish time over all sources, that fits the total budget.

Targets: sources in code point order, null last, take the weights in turn and share the budget (all words); a target stops at
``max_repeats`` times the words of its source, and the excess is shared again by weight until none is above. That is the same as
``min(max_repeats * size, level * weight)`` with the one level that meets the budget, found from running sums.

Running sums along a source use two levels, so a source holding most rows is spread over many tasks: its hash range is cut into
pieces of about ``PIECE`` rows, sums of pieces are added up first, then each piece is ordered on its own. All documents that finish
by time 1 fit together (a source has sent at most its target by then); where the prefix ends beyond that is found from sums per
slice of the time line and one slice in order.

Empty or null texts have size 0 and take 0 words; sources without words have target 0. A null source is a source of its own. Rows that repeat id and text are
queued next to each other. Null ids hash as empty text. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..lookup import attach
from ..operators.ranks import dense_codes, prefix_sums
from ..session import settle
from .common import text_of, word_count

WEIGHTS = (1, 2, 3)
MAX_REPEATS = 3
SEED = "mix"
PIECE = 500
SLICE = 20_000
HASH_RANGE = 2**52


def shuffle_key(id_col: str, text_col: str, seed: str = SEED):
    """52 bits of md5 over seed, id and text: the order of a source's queue."""
    key = F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.md5(text_of(text_col))))
    return F.conv(F.substring(key, 1, 13), 16, 10).cast("bigint")


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """``(source, source_size, n_rows, target)`` from ``(source, source_size, n_rows)``, one row per source."""
    ranked = dense_codes(sizes.withColumn("_last", F.col("source").isNull()), ["_last", "source", "source_size", "n_rows"], "_rank")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod("_rank", F.lit(len(weights))).cast("int") + 1)
    ranked = settle(
        ranked.select("source", "source_size", "n_rows", weight.alias("weight"), (F.col("source_size") * max_repeats).alias("most"))
    )
    steps = ranked.groupBy((F.col("most") / F.col("weight")).alias("level")).agg(F.sum("most").alias("c"), F.sum("weight").alias("w"))
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    run = prefix_sums(steps, [], "level", ["c", "w"])
    level = (F.lit(float(total)) - F.col("cum_c") + F.col("c")) / (F.col("all_w") - F.col("cum_w") + F.col("w"))
    met = run.select("level", level.alias("l")).where(F.col("l") <= F.col("level") * (1 + 1e-12)).agg(F.min_by("l", "level")).first()[0]
    target = F.least(F.col("most").cast("double"), F.lit(float(met or 0.0)) * F.col("weight"))
    return ranked.select("source", "source_size", "n_rows", target.alias("target"))


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[float] = WEIGHTS,
    max_repeats: int = MAX_REPEATS,
    seed: str = SEED,
) -> DataFrame:
    """One row per row of ``docs``: ``id_col, source, size, source_size, target, repeats, taken`` and the shuffle key ``queue_key``."""
    items = settle(
        docs.select(
            F.col(id_col).alias("id"),
            F.col(source_col).alias("source"),
            word_count(text_of(text_col)).alias("size"),
            shuffle_key(id_col, text_col, seed).alias("h"),
        )
    )
    sizes = items.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_rows"))
    targets = source_targets(sizes, weights, max_repeats)
    known = targets.withColumn("source", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")))
    named = items.withColumn("s", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")))
    rows = attach(named, known.withColumnRenamed("source", "s"), ["s"])
    pieces = F.ceil(F.col("n_rows") / F.lit(PIECE))
    rows = rows.withColumn("piece", F.floor(F.col("h") / F.lit(float(HASH_RANGE)) * pieces).cast("bigint"))
    sums = rows.groupBy("s", "piece").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("s").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("s", "piece", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("s", "piece").orderBy("h", "id", "size").rowsBetween(Window.unboundedPreceding, 0)
    queued = settle(rows.join(offsets, ["s", "piece"]).withColumn("sent", F.sum("size").over(inside) + F.col("offset")))

    def sent(e):
        return F.col("sent") + F.col("source_size") * e

    epochs = [F.lit(e) for e in range(max_repeats)]
    on_time = sum(((sent(e) <= F.col("target")).cast("int") for e in epochs[1:]), (sent(epochs[0]) <= F.col("target")).cast("int"))
    late = queued.where(F.col("target") > 0).select(
        "size", "s", "h", "id", F.explode(F.array(*[sent(e).cast("double") / F.col("target") for e in epochs])).alias("finish")
    ).where(F.col("finish") > 1)
    cut = _cut(queued, late, on_time)
    rest = F.lit(0)
    if cut is not None:
        f, h, s, i = cut
        for e in epochs:
            finish = sent(e).cast("double") / F.col("target")
            place = F.struct(finish, F.col("h"), F.col("s"), F.col("id"))
            end = F.struct(F.lit(f), F.lit(h), F.lit(s), F.lit(i).cast(dict(queued.dtypes)["id"]))
            rest = rest + ((sent(e) > F.col("target")) & (F.col("target") > 0) & (place <= end)).cast("int")
    repeats = (on_time + rest).cast("int")
    return queued.select(
        F.col("id").alias(id_col),
        F.col("source").alias("source"),
        "size",
        "source_size",
        "target",
        repeats.alias("repeats"),
        (F.col("size") * repeats).cast("bigint").alias("taken"),
        F.col("h").alias("queue_key"),
    )


def _cut(queued: DataFrame, late: DataFrame, on_time) -> tuple | None:
    """Place of the last late item that still fits the budget: ``(finish, h, source, id)``."""
    totals = queued.agg(F.sum("size").alias("budget"), F.sum(F.col("size") * on_time).alias("sent"), F.count(F.lit(1)).alias("n")).first()
    if not totals["n"]:
        return None
    left = int(totals["budget"] - totals["sent"])
    grid = max(64, totals["n"] // SLICE)
    cell = F.least(F.floor((F.col("finish") - 1) * grid), F.lit(4 * grid)).cast("bigint")
    cells = late.withColumn("cell", cell)
    sums = cells.groupBy("cell").agg(F.sum("size").alias("words"))
    run = Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)
    ahead = sums.select("cell", (F.sum("words").over(run) - F.col("words")).alias("ahead"), F.sum("words").over(run).alias("upto"))
    first = ahead.where(F.col("upto") > left).orderBy("cell").first()
    place = F.struct("finish", "h", "s", "id")
    if first is None:
        end = cells.agg(F.max(place).alias("p")).first()["p"]
        return tuple(end) if end is not None else None
    order = Window.orderBy("finish", "h", "s", "id").rowsBetween(Window.unboundedPreceding, 0)
    one = cells.where(F.col("cell") == first["cell"]).withColumn("upto", F.sum("size").over(order) + F.lit(first["ahead"]))
    end = one.where(F.col("upto") <= left).agg(F.max(place).alias("p")).first()["p"]
    if end is None:
        end = cells.where(F.col("cell") < first["cell"]).agg(F.max(place).alias("p")).first()["p"]
    return tuple(end) if end is not None else None


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as it is taken, with all its columns.

    Rows are matched by shuffle key, id and source, which only rows that repeat id, text and source share; the k-th of such rows
    gets the k-th largest number of repeats. The joined rows are already together by that key, so numbering them moves nothing.
    """
    most = options.get("max_repeats", MAX_REPEATS)
    plan = mix(docs, id_col, text_col, source_col, **options).where(F.col("repeats") > 0)
    key = F.concat_ws("|", F.col("_h"), F.coalesce(F.concat(F.lit("s"), "_s"), F.lit("n")), F.coalesce(F.concat(F.lit("i"), "_i"), F.lit("n")))
    taken = plan.select(F.col("queue_key").alias("_h"), F.col(id_col).cast("string").alias("_i"), F.col("source").alias("_s"), "repeats")
    taken = taken.groupBy(key.alias("_q")).agg(*[F.sum((F.col("repeats") >= r).cast("int")).alias(f"_g{r}") for r in range(1, most + 1)])
    keyed = docs.select(
        F.struct("*").alias("_row"),
        shuffle_key(id_col, text_col, options.get("seed", SEED)).alias("_h"),
        F.col(id_col).cast("string").alias("_i"),
        F.col(source_col).alias("_s"),
    ).select("_row", key.alias("_q"))
    joined = keyed.join(taken, "_q").withColumn("_same", F.count(F.lit(1)).over(Window.partitionBy("_q")))
    # rows that share all of these may differ in other columns: the whole row decides, so reruns agree however rows are dealt
    order = F.when(F.col("_same") > 1, F.md5(F.to_json("_row")))
    joined = joined.withColumn("_n", F.row_number().over(Window.partitionBy("_q").orderBy(order)))
    times = sum(((F.col("_n") <= F.col(f"_g{r}")).cast("int") for r in range(2, most + 1)), (F.col("_n") <= F.col("_g1")).cast("int"))
    copies = joined.withColumn("_t", times).where(F.col("_t") > 0).select("_row", F.explode(F.sequence(F.lit(1), F.col("_t"))).alias("_copy"))
    return copies.select("_row.*")
