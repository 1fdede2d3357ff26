"""Scored frames derived from the given tables, each as a Spark plan and as the SQL of the same rows.

The raw labels of the tables carry no signal, so targets are built from columns and a hashed draw.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.hashing import unit
from ..functions.numeric import flag
from ..functions.vectors import softmax
from .registry import table

# Irrational factors, so that no derived mean lies halfway between two rounded values.
UNEVEN = 0.9549296585513721
SPREAD = 0.3183098861837907

SHIFT = {"BUILDING": 0.0, "AUTOMOBILE": 0.3, "FURNITURE": 0.6, "HOUSEHOLD": 0.9, "MACHINERY": 1.2}


def _shift():
    out = F.lit(None).cast("double")
    for name, value in SHIFT.items():
        out = F.when(F.col("c_mktsegment") == name, F.lit(value)).otherwise(out)
    return out


_SHIFT_SQL = "CASE c_mktsegment " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in SHIFT.items()) + " END"


def unit_sql(seed: str, *parts: str) -> str:
    """Uniform draw of :func:`functions.hashing.unit`."""
    return f"({int_sql(seed, *parts)} / 4294967296.0::DOUBLE)"


def int_sql(seed: str, *parts: str) -> str:
    return f"('0x' || substr({key_sql(seed, *parts)}, 1, 8))::BIGINT"


def key_sql(seed: str, *parts: str) -> str:
    return "md5('" + seed + "'" + "".join(f" || '|' || CAST({p} AS VARCHAR)" for p in parts) + ")"


def scored_orders(spark: SparkSession, sf: str) -> DataFrame:
    """Orders with their customer: two group types, a score, a decision and a label whose noise differs by segment."""
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    t = o.join(c, o.o_custkey == c.c_custkey)
    margin = F.col("o_totalprice") / 100000 - 2.5
    t = t.withColumns({"margin": margin, "u": unit("y", "o_orderkey"), "shift": _shift()})
    signal = F.col("margin") + F.col("c_acctbal") / 10000 - F.col("shift") + 2 * (F.col("u") - 0.5)
    return t.select(
        F.col("o_orderkey").alias("row_id"),
        F.col("c_mktsegment").alias("g"),
        F.col("o_orderstatus").alias("g2"),
        "margin",
        (1 / (1 + F.exp(-F.col("margin")))).alias("score"),
        flag(F.col("o_totalprice") > 250000).alias("pred"),
        flag(signal > 0).alias("y"),
        "o_totalprice",
        "c_acctbal",
        "shift",
    )


SCORED = f"""
scored_raw AS (
  SELECT o_orderkey AS row_id, c_mktsegment AS g, o_orderstatus AS g2, o_totalprice / 100000 - 2.5 AS margin,
    {unit_sql('y', 'o_orderkey')} AS u, {_SHIFT_SQL} AS shift, o_totalprice, c_acctbal
  FROM orders JOIN customer ON o_custkey = c_custkey),
scored AS (
  SELECT row_id, g, g2, margin, 1 / (1 + exp(-margin)) AS score, CAST(o_totalprice > 250000 AS INT) AS pred,
    CAST(margin + c_acctbal / 10000 - shift + 2 * (u - 0.5) > 0 AS INT) AS y, o_totalprice, c_acctbal, shift
  FROM scored_raw)"""


def regression_orders(spark: SparkSession, sf: str) -> DataFrame:
    """Same rows with a real-valued target and a prediction from the price alone."""
    t = scored_orders(spark, sf)
    y = F.col("o_totalprice") / 1000 + F.col("c_acctbal") / 100 + 200 * F.col("shift")
    return t.select("row_id", "g", "o_totalprice", "c_acctbal", y.alias("y"), (F.col("o_totalprice") / 1000 + 100).alias("yhat"))


REGRESSION = SCORED + """,
reg AS (SELECT row_id, g, o_totalprice, c_acctbal, o_totalprice / 1000 + c_acctbal / 100 + 200 * shift AS y,
  o_totalprice / 1000 + 100 AS yhat FROM scored)"""


def scored_docs(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled documents by language: small, unbalanced groups."""
    d = table(spark, sf, "documents").select("doc_id", "lang", "n_chars")
    t = table(spark, sf, "labels").join(d, "doc_id").withColumn("margin", F.log(F.col("n_chars").cast("double")) - 6)
    return t.select(
        F.col("doc_id").alias("row_id"),
        F.col("lang").alias("g"),
        F.col("quality").alias("y"),
        "margin",
        (1 / (1 + F.exp(-F.col("margin")))).alias("score"),
        flag(F.col("n_chars") > 403).alias("pred"),
    )


DOCS = """
docs AS (SELECT doc_id AS row_id, lang AS g, quality AS y, ln(n_chars) - 6 AS margin, 1 / (1 + exp(-(ln(n_chars) - 6))) AS score,
  CAST(n_chars > 403 AS INT) AS pred FROM labels JOIN documents USING (doc_id))"""


def multi(spark: SparkSession, sf: str) -> DataFrame:
    """Ten-class probability vectors from the embeddings."""
    e = table(spark, sf, "embeddings")
    z = F.transform(F.slice("embedding", 1, 10), lambda x: x.cast("double") * 4.0)
    t = e.select(F.col("vec_id").alias("row_id"), F.pmod("vec_id", F.lit(4)).cast("bigint").alias("g"), F.col("label").alias("y"), z.alias("logits"))
    return t.withColumn("p", softmax("logits"))


MULTI = """
logit AS (SELECT vec_id AS row_id, vec_id % 4 AS g, label AS y, list_transform(embedding[1:10], lambda x: x::DOUBLE * 4.0) AS logits FROM embeddings),
expo AS (SELECT row_id, g, y, logits, list_transform(logits, lambda x: exp(x - list_max(logits))) AS e FROM logit),
multi AS (SELECT row_id, g, y, logits, list_transform(e, lambda x: x / list_sum(e)) AS p FROM expo)"""


def scored_events(spark: SparkSession, sf: str) -> DataFrame:
    """Events with user buckets as groups; the label is a purchase."""
    e = table(spark, sf, "events")
    return e.select(
        F.col("event_id").alias("row_id"),
        "ts",
        F.pmod("user_id", F.lit(8)).cast("bigint").alias("g"),
        flag(F.col("event_type") == "purchase").alias("y"),
        (F.col("value") / (F.col("value") + 50)).alias("score"),
        flag(F.col("value") > 50).alias("pred"),
    )


EVENTS = """
ev AS (SELECT event_id AS row_id, ts, user_id % 8 AS g, CAST(event_type = 'purchase' AS INT) AS y, value / (value + 50) AS score,
  CAST(value > 50 AS INT) AS pred FROM events)"""


def history(spark: SparkSession, sf: str) -> DataFrame:
    """One round per day, one group per user bucket: mean error and size."""
    e = table(spark, sf, "events").select(
        (F.datediff("ts", F.lit("2024-01-01").cast("date")) + 1).cast("bigint").alias("round"),
        F.pmod("user_id", F.lit(8)).cast("bigint").alias("g"),
        "value",
    )
    return e.groupBy("round", "g").agg((F.avg("value") * (UNEVEN / 100)).alias("err"), F.count(F.lit(1)).alias("n"))


HISTORY = f"""
hist AS (SELECT CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) + 1 AS BIGINT) AS round, user_id % 8 AS g,
  avg(value) * {UNEVEN / 100}::DOUBLE AS err, count(*) AS n FROM events GROUP BY 1, 2)"""


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Weight state per day: ``(vid, g, mu, loss, w, lam, share, mean_err, risk, best, k, k_min)``."""
    h = history(spark, sf)
    day = Window.partitionBy("round")
    err = F.round("err", 6) * UNEVEN
    return h.select(
        F.col("round").alias("vid"),
        "g",
        (F.col("n") / F.sum("n").over(day) * UNEVEN).alias("mu"),
        err.alias("loss"),
        (F.col("n") / F.sum("n").over(day)).alias("w"),
        ((F.col("g") + 1) / 100.0).alias("lam"),
        (F.col("n") / F.sum("n").over(day)).alias("share"),
        (F.sum(err * F.col("n")).over(day) / F.sum("n").over(day)).alias("mean_err"),
        err.alias("risk"),
        F.when(F.col("round") % 3 == 0, F.lit(None).cast("double")).when(F.col("round") % 3 == 1, F.lit(0.6)).otherwise(F.lit(2.0)).alias("best"),
        (F.col("round") % 30 + 1).cast("bigint").alias("k"),
        F.lit(20).cast("bigint").alias("k_min"),
    )


VECTORS = HISTORY + f""",
vec AS (SELECT round AS vid, g, n / sum(n) OVER d * {UNEVEN}::DOUBLE AS mu, round(err, 6) * {UNEVEN}::DOUBLE AS loss, n / sum(n) OVER d AS w, (g + 1) / 100.0::DOUBLE AS lam,
  n / sum(n) OVER d AS share, sum(round(err, 6) * {UNEVEN}::DOUBLE * n) OVER d / sum(n) OVER d AS mean_err, round(err, 6) * {UNEVEN}::DOUBLE AS risk,
  CASE round % 3 WHEN 0 THEN NULL WHEN 1 THEN 0.6::DOUBLE ELSE 2.0::DOUBLE END AS best, CAST(round % 30 + 1 AS BIGINT) AS k,
  CAST(20 AS BIGINT) AS k_min
  FROM hist WINDOW d AS (PARTITION BY round))"""


def results(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(val, test, trials)`` of many models: parts stand for evaluations, brands for datasets."""
    p = table(spark, sf, "part")
    number = (F.col("p_partkey") % 200).cast("bigint")
    made = p.select(
        F.col("p_brand").alias("dataset"),
        F.when(F.col("p_type").isin("SMALL", "MEDIUM", "LARGE"), F.lit("plain")).otherwise(F.lit("fair")).alias("model_name"),
        number.alias("number"),
        "p_size",
        "p_retailprice",
    )
    keys = ["dataset", "model_name", "number"]
    rows = made.groupBy(*keys).agg(
        (F.round(F.avg("p_retailprice") / 2000, 6) * SPREAD).alias("perf"),
        (F.round(F.avg("p_size") / 50, 6) * SPREAD).alias("fair"),
        (F.round(F.max("p_retailprice") / 2000, 6) * SPREAD).alias("perf_t"),
        (F.round(F.min("p_size") / 50, 6) * SPREAD).alias("fair_t"),
        F.max("p_size").alias("size"),
    )
    text = F.concat(
        F.floor(F.col("size") / 24).cast("string"), F.lit(" days "), F.lpad((F.col("size") % 24).cast("string"), 2, "0"), F.lit(":00:0"),
        (F.col("size") % 10).cast("string"), F.lit(".5"),
    )
    rows = rows.withColumn("duration_text", text)
    val = rows.select(*keys, "perf", "fair")
    test = rows.select(*keys, F.col("perf_t").alias("perf"), F.col("fair_t").alias("fair"), "duration_text")
    trials = rows.select(*keys, (F.col("number") % 10 / 10.0).alias("fair_weight"), F.col("size").cast("double").alias("depth"))
    return val, test, trials


RESULTS = f"""
made AS (SELECT p_brand AS dataset, CASE WHEN p_type IN ('SMALL', 'MEDIUM', 'LARGE') THEN 'plain' ELSE 'fair' END AS model_name,
  p_partkey % 200 AS number, p_size, p_retailprice FROM part),
res AS (SELECT dataset, model_name, number, round(avg(p_retailprice) / 2000, 6) * {SPREAD} AS perf, round(avg(p_size) / 50, 6) * {SPREAD} AS fair,
  round(max(p_retailprice) / 2000, 6) * {SPREAD} AS perf_t, round(min(p_size) / 50, 6) * {SPREAD} AS fair_t, max(p_size) AS size FROM made GROUP BY 1, 2, 3),
val AS (SELECT dataset, model_name, number, perf, fair FROM res),
test AS (SELECT dataset, model_name, number, perf_t AS perf, fair_t AS fair,
  CAST(size // 24 AS VARCHAR) || ' days ' || lpad(CAST(size % 24 AS VARCHAR), 2, '0') || ':00:0' || CAST(size % 10 AS VARCHAR) || '.5' AS duration_text,
  (size // 24) * 86400.0::DOUBLE + (size % 24) * 3600.0::DOUBLE + (size % 10) + 0.5::DOUBLE AS duration FROM res),
trials AS (SELECT dataset, model_name, number, (number % 10) / 10.0::DOUBLE AS fair_weight, size::DOUBLE AS depth FROM res)"""
