"""Queries on cleaning, recoding and row selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import recode as R
from ..operators import clean as C
from ..spec import TableSpec, usable_features
from .bindings import RESULTS, SCORED, key_sql, results, scored_orders
from .registry import big, query, r, r6, table

PRIORITY = {"1-URGENT": "urgent", "2-HIGH": "high", "3-MEDIUM": "medium"}


@query("recode_map", "SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'urgent' WHEN '2-HIGH' THEN 'high' WHEN '3-MEDIUM' THEN 'medium' END AS level FROM orders")
def recode_map(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", R.map_value("o_orderpriority", PRIORITY).alias("level"))


@query("recode_map_strict", "SELECT o_orderkey, CAST(CASE o_orderstatus WHEN 'F' THEN 2 WHEN 'O' THEN 1 ELSE 0 END AS BIGINT) AS code FROM orders")
def recode_map_strict(spark, sf):
    code = R.map_value("o_orderstatus", {"F": 2, "O": 1, "P": 0}, on_missing="error")
    return table(spark, sf, "orders").select("o_orderkey", big(code, "code"))


NAMES = ("first", "second", "third", "fourth")


@query("recode_index", f"SELECT l_orderkey, l_linenumber, count(*) AS n, [{', '.join(repr(n) for n in NAMES)}][l_linenumber] AS name FROM lineitem GROUP BY ALL")
def recode_index(spark, sf):
    t = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", R.map_index("l_linenumber", NAMES).alias("name"))
    return t.groupBy("l_orderkey", "l_linenumber", "name").agg(F.count(F.lit(1)).alias("n"))


@query("recode_binary_label", "SELECT o_orderkey, CAST(CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1 WHEN o_orderpriority IN ('4-NOT SPECIFIED', '5-LOW') THEN 0 END AS BIGINT) AS y FROM orders")
def recode_binary_label(spark, sf):
    y = R.binarize("o_orderpriority", ["1-URGENT", "2-HIGH"], ["4-NOT SPECIFIED", "5-LOW"])
    return table(spark, sf, "orders").select("o_orderkey", big(y, "y"))


@query("replace_everywhere", "SELECT l_orderkey, replace(replace(l_returnflag, 'F', 'closed'), 'N', 'none') AS l_returnflag, replace(l_linestatus, 'F', 'closed') AS l_linestatus FROM lineitem")
def replace_everywhere(spark, sf):
    t = table(spark, sf, "lineitem").select("l_orderkey", "l_returnflag", "l_linestatus")
    return C.replace_everywhere(t, {"F": "closed", "N": "none"})


@query("recode_invert_label", "SELECT doc_id, CAST(1 - quality AS BIGINT) AS y, CAST(toxic = 1 AS BIGINT) AS t FROM labels")
def recode_invert_label(spark, sf):
    t = table(spark, sf, "labels")
    return t.select("doc_id", big(R.invert_label("quality"), "y"), big(R.bool_to_int(F.col("toxic") == 1), "t"))


@query("recode_code_suffix", "SELECT c_custkey, CAST(right(c_name, 1) AS BIGINT) AS digit, CAST(right(c_name, 1) AS BIGINT) - 1 AS shifted FROM customer")
def recode_code_suffix(spark, sf):
    digit = R.code_suffix("c_name")
    return table(spark, sf, "customer").select("c_custkey", big(digit, "digit"), big(digit - 1, "shifted"))


@query("select_roles", "SELECT c_custkey AS row_id, c_mktsegment, c_acctbal AS balance, c_nationkey::DOUBLE AS c_nationkey FROM customer")
def select_roles(spark, sf):
    spec = TableSpec(cat=("c_mktsegment",), num="all", key="c_custkey")
    t = C.drop_positions(table(spark, sf, "customer"), [1]).withColumn("c_nationkey", F.col("c_nationkey").cast("double"))
    return C.select_roles(t, spec, {"c_custkey": "row_id", "c_acctbal": "balance"})


@query("usable_features", "SELECT o_custkey, o_totalprice FROM orders")
def usable_feature_query(spark, sf):
    spec = TableSpec(label="o_orderpriority", key="o_orderkey", groups=("o_orderstatus",))
    t = table(spark, sf, "orders").drop("o_orderdate")
    return t.select(*usable_features(spec, t.columns, usable=None, drop_groups=True))


HOLES = "CASE WHEN s_acctbal < 0 THEN NULL ELSE s_acctbal END"


@query("drop_missing", f"SELECT s_suppkey, {HOLES} AS bal, CASE WHEN s_nationkey = 7 THEN NULL ELSE s_name END AS s_name FROM supplier WHERE {HOLES} IS NOT NULL AND s_nationkey <> 7 AND s_nationkey <> 9")
def drop_missing(spark, sf):
    t = table(spark, sf, "supplier").select(
        "s_suppkey",
        F.when(F.col("s_acctbal") < 0, None).when(F.col("s_nationkey") == 9, float("nan")).otherwise(F.col("s_acctbal")).alias("bal"),
        F.when(F.col("s_nationkey") != 7, F.col("s_name")).alias("s_name"),
    )
    return C.drop_missing(t)


@query("keep_all_equal", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_discount = 0.0 AND l_tax = 0.0")
def keep_all_equal(spark, sf):
    return C.keep_all_equal(table(spark, sf, "lineitem"), ["l_discount", "l_tax"], 0.0).select("l_orderkey", "l_linenumber", "l_quantity")


@query("keep_values", "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority IN ('1-URGENT', '5-LOW')")
def keep_values(spark, sf):
    t = C.keep_values(table(spark, sf, "orders"), "o_orderstatus", ["F"])
    return C.keep_values(t, "o_orderpriority", ["1-URGENT", "5-LOW"]).select("o_orderkey", "o_orderpriority")


@query("drop_groups", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment <> 'MACHINERY' AND c_nationkey <> 3")
def drop_groups(spark, sf):
    return C.drop_groups(table(spark, sf, "customer"), ["c_mktsegment@MACHINERY", "c_nationkey@3"]).select("c_custkey", "c_mktsegment")


@query("argmax_columns", """SELECT l_orderkey, l_linenumber, l_quantity, l_discount, CASE WHEN l_quantity / 5 >= greatest(l_discount * 100, l_tax * 100) THEN 'quantity'
  WHEN l_discount * 100 >= l_tax * 100 THEN 'discount' ELSE 'tax' END AS plurality FROM lineitem""")
def argmax_columns(spark, sf):
    t = table(spark, sf, "lineitem").withColumns(
        {"a": F.col("l_quantity") / 5, "b": F.col("l_discount") * 100, "c": F.col("l_tax") * 100}
    )
    name = R.argmax_name(["a", "b", "c"], ["quantity", "discount", "tax"]).alias("plurality")
    return t.select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", name)


@query("recode_bands", "SELECT p_partkey, CAST(least(p_size // 10, 3) AS BIGINT) AS band FROM part")
def recode_bands(spark, sf):
    return table(spark, sf, "part").select("p_partkey", big(R.width_bin("p_size", 10, cap=3), "band"))


@query("recode_threshold", "SELECT p_partkey, CAST(p_retailprice >= 950 AS BIGINT) AS dear, CAST(p_size = 7 AS BIGINT) AS seven FROM part")
def recode_threshold(spark, sf):
    t = table(spark, sf, "part")
    return t.select("p_partkey", big(R.threshold("p_retailprice", 950), "dear"), big(R.threshold("p_size", 7, "=="), "seven"))


@query("recode_one_vs_rest", "SELECT event_id, CAST(event_type = 'purchase' AS BIGINT) AS purchase FROM events")
def recode_one_vs_rest(spark, sf):
    return table(spark, sf, "events").select("event_id", big(R.one_vs_rest("event_type", "purchase"), "purchase"))


@query(
    "category_codes",
    """WITH t AS (SELECT p_type, p_brand, dense_rank() OVER (ORDER BY p_brand, p_type) - 1 AS code FROM (SELECT DISTINCT p_brand, p_type FROM part))
    SELECT p_partkey, p_brand, p_type, CAST(code AS BIGINT) AS code FROM part JOIN t USING (p_brand, p_type)""",
)
def category_codes(spark, sf):
    t = C.category_codes(table(spark, sf, "part"), ["p_brand", "p_type"])
    return t.select("p_partkey", "p_brand", "p_type", big("code"))


@query("tagged_union", "SELECT c_custkey AS id, c_acctbal AS balance, 'customer' AS source FROM customer UNION ALL SELECT s_suppkey, s_acctbal, 'supplier' FROM supplier")
def tagged_union(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"))
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("balance"))
    return C.tagged_union({"customer": c, "supplier": s})


@query("sample_rows", f"SELECT o_orderkey, o_totalprice FROM orders ORDER BY {key_sql('sample', 'o_orderkey')} LIMIT 500")
def sample_rows(spark, sf):
    t = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return C.sample_n(t, 500, "o_orderkey", "sample")


@query("sample_rows_by_cut", f"SELECT o_orderkey, o_totalprice FROM orders ORDER BY {key_sql('sample', 'o_orderkey')} LIMIT 700")
def sample_rows_by_cut(spark, sf):
    """The large-sample path: the cut value instead of a top-n."""
    t = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return C.sample_n(t, 700, "o_orderkey", "sample", top_rows=0)


@query("duration_seconds", f"WITH {RESULTS} SELECT dataset, model_name, number, {r('duration', 'seconds')} FROM test")
def duration_seconds(spark, sf):
    _, test, _ = results(spark, sf)
    return test.select("dataset", "model_name", "number", r6(R.duration_seconds("duration_text"), "seconds"))


@query("normalize_binary_label", f"WITH {SCORED} SELECT row_id, CAST(y AS BIGINT) AS y FROM scored")
def normalize_binary_label(spark, sf):
    from ..spec import normalize_binary

    signed = scored_orders(spark, sf).withColumn("signed", 2 * F.col("y") - 1)
    return signed.select("row_id", big(normalize_binary("signed"), "y"))
