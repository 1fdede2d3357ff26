"""Queries on feature transforms; fits use the train part of a hash split."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.hashing import unit
from ..functions.vectors import to_categorical
from ..operators import features as X
from .bindings import unit_sql
from .registry import big, query, r, r6, table

TRAIN = unit_sql("f", "o_orderkey") + " < 0.7"


def _orders(spark, sf):
    t = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus", "o_orderpriority")
    return t, t.where(unit("f", "o_orderkey") < 0.7)


@query(
    "feature_standardize",
    f"""WITH m AS (SELECT avg(o_totalprice) AS a, stddev_pop(o_totalprice) AS s, avg(o_custkey) AS b, stddev_pop(o_custkey) AS t FROM orders WHERE {TRAIN})
    SELECT o_orderkey, {r('(o_totalprice - a) / s', 'o_totalprice')}, {r('(o_custkey - b) / t', 'o_custkey')}, 0.0::DOUBLE AS flat FROM orders, m""",
)
def feature_standardize(spark, sf):
    t, train = (d.withColumn("flat", F.lit(3.0)) for d in _orders(spark, sf))
    out = X.Standardize(["o_totalprice", "o_custkey", "flat"]).fit(train).transform(t)
    return out.select("o_orderkey", r6("o_totalprice"), r6("o_custkey"), r6("flat"))


LEVELS = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")


def _hot_sql(column: str, values) -> str:
    return ", ".join(f"CAST({column} = '{v}' AS BIGINT) AS \"{column}_{v}\"" for v in values)


def _hot(spark, sf, drop, **more):
    t, train = _orders(spark, sf)
    t, train = (d.withColumn("late", F.when(F.col("o_orderstatus") == "F", "no").otherwise("yes")) for d in (t, train))
    hot = X.OneHot(["o_orderpriority", "late"], drop=drop, **more).fit(train)
    return hot.transform(t).select("o_orderkey", *[big(F.col(f"`{c}`"), c) for c in hot.names()])


LATE = "(SELECT *, CASE WHEN o_orderstatus = 'F' THEN 'no' ELSE 'yes' END AS late FROM orders)"


@query("feature_onehot_if_binary", f"SELECT o_orderkey, {_hot_sql('o_orderpriority', LEVELS)}, {_hot_sql('late', ['yes'])} FROM {LATE}")
def feature_onehot_if_binary(spark, sf):
    return _hot(spark, sf, "if_binary")


@query("feature_onehot_drop_last", f"SELECT o_orderkey, {_hot_sql('o_orderpriority', LEVELS[:-1])}, {_hot_sql('late', ['no'])} FROM {LATE}")
def feature_onehot_drop_last(spark, sf):
    return _hot(spark, sf, "last")


@query("feature_onehot_full", f"SELECT o_orderkey, {_hot_sql('o_orderpriority', LEVELS)}, {_hot_sql('late', ['no', 'yes'])} FROM {LATE}")
def feature_onehot_full(spark, sf):
    return _hot(spark, sf, None)


@query("feature_onehot_inferred", f"SELECT l_orderkey, l_quantity, {_hot_sql('l_returnflag', 'ANR')}, {_hot_sql('l_linestatus', 'O')} FROM lineitem")
def feature_onehot_inferred(spark, sf):
    t = table(spark, sf, "lineitem").select("l_orderkey", "l_quantity", "l_returnflag", "l_linestatus")
    hot = X.OneHot(infer=True).fit(t)
    return hot.transform(t).select("l_orderkey", "l_quantity", *[big(c) for c in hot.names()])


@query(
    "feature_minmax",
    f"""WITH m AS (SELECT min(o_totalprice) AS a, max(o_totalprice) AS b FROM orders WHERE {TRAIN})
    SELECT o_orderkey, {r('(o_totalprice - a) / (b - a)', 'o_totalprice')}, 0.0::DOUBLE AS flat FROM orders, m""",
)
def feature_minmax(spark, sf):
    t, train = (d.select("o_orderkey", "o_totalprice").withColumn("flat", F.lit(3.0)) for d in _orders(spark, sf))
    out = X.MinMax(exclude=["o_orderkey"]).fit(train).transform(t)
    return out.select("o_orderkey", r6("o_totalprice"), r6("flat"))


@query(
    "feature_magnitude_rescale",
    f"""WITH m AS (SELECT pow(10.0::DOUBLE, floor(log10(max(abs(c_acctbal))))) AS a, pow(10.0::DOUBLE, floor(log10(max(abs(c_nationkey))))) AS b FROM customer)
    SELECT c_custkey, {r('c_acctbal / a', 'c_acctbal')}, {r('c_nationkey / b', 'c_nationkey')} FROM customer, m""",
)
def feature_magnitude_rescale(spark, sf):
    t = X.magnitude_rescale(table(spark, sf, "customer"), ["c_acctbal", "c_nationkey"])
    return t.select("c_custkey", r6("c_acctbal"), r6("c_nationkey"))


@query(
    "feature_quantile_cut",
    """WITH q AS (SELECT quantile_cont(l_extendedprice, [0.0, 0.25, 0.5, 0.75, 1.0]) AS e FROM lineitem)
    SELECT l_orderkey, l_linenumber, l_extendedprice, CAST(CASE WHEN l_extendedprice <= e[1] THEN NULL WHEN l_extendedprice <= e[2] THEN 0 WHEN l_extendedprice <= e[3] THEN 1
      WHEN l_extendedprice <= e[4] THEN 2 ELSE 3 END AS BIGINT) AS bin FROM lineitem, q""",
)
def feature_quantile_cut(spark, sf):
    t = X.quantile_cut(table(spark, sf, "lineitem"), "l_extendedprice", 4, "bin")
    return t.select("l_orderkey", "l_linenumber", "l_extendedprice", big("bin"))


@query("feature_to_categorical", "SELECT vec_id, list_transform(range(0, 10), lambda k: CAST(k = label AS FLOAT)) AS onehot FROM embeddings")
def feature_to_categorical(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", to_categorical("label", 10).alias("onehot"))


@query("feature_priors", f"SELECT lang, {r('count(*) / (SELECT count(*) FROM documents)', 'prior')} FROM documents GROUP BY lang")
def feature_priors(spark, sf):
    return X.priors(table(spark, sf, "documents"), "lang").select("lang", r6("prior"))
