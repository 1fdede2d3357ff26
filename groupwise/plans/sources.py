"""Round trips through the readers and writers: a given table is written in a format and read back whole."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.groups import encode_groups
from ..session import checkpoint_root
from ..sources import readers as R
from ..sources import writers as W
from ..spec import TableSpec
from .bindings import RESULTS, SCORED, results, scored_orders
from .registry import query, table

ORDERS = "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders"
SPEC = TableSpec(
    cat=("o_orderstatus", "o_orderpriority"), num=("o_totalprice",), key="o_orderkey", extra={"o_custkey": T.LongType()}
)
COLUMNS = ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")


def fresh(spark, name: str) -> str:
    return f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}"


def _orders(spark, sf):
    return table(spark, sf, "orders").select(*COLUMNS)


@query("source_csv_with_header", ORDERS)
def source_csv_with_header(spark, sf):
    path = fresh(spark, "csv")
    W.write_table(_orders(spark, sf), path, "csv")
    return R.read_table(spark, path, SPEC)


@query("source_csv_named_columns", ORDERS)
def source_csv_named_columns(spark, sf):
    path = fresh(spark, "bare")
    _orders(spark, sf).write.csv(path)
    return R.read_table(spark, path, SPEC, names=COLUMNS)


@query("source_csv_sniffed_delimiter", ORDERS)
def source_csv_sniffed_delimiter(spark, sf):
    path = fresh(spark, "semicolon")
    _orders(spark, sf).write.option("header", True).option("sep", ";").csv(path)
    return R.read_table(spark, path, SPEC, sep=None)


# letters that the code page has besides ASCII; quotes and backslashes are left out as they are the file's own marks
CP860 = "ÇüéâãàçêÊèÍÔìÃÂÉÀÈôõòÚùÌÕÜáíóúñÑªº¿ß"
ENCODABLE = f"[^ !#-\\[\\]-~{CP860}]"


@query(
    "source_csv_encoded",
    f"SELECT doc_id, lang, source, n_chars, regexp_replace(coalesce(trim(regexp_replace(text, '{ENCODABLE}', '?', 'g')), '-'), '^$', '-') AS text FROM documents",
)
def source_csv_encoded(spark, sf):
    """Accented texts through a file of another code page; characters outside it become question marks before they are written."""
    path = fresh(spark, "encoded")
    text = F.regexp_replace(F.coalesce(F.trim(F.regexp_replace("text", ENCODABLE, "?")), F.lit("-")), "^$", "-")
    t = table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars", text.alias("text"))
    spec = TableSpec(cat=("lang", "source", "text"), key="doc_id", extra={"n_chars": T.LongType()})
    R.allow_charset(spark, "cp860")
    t.write.option("header", True).option("sep", ";").option("encoding", "IBM860").csv(path)
    return R.read_table(spark, path, spec, sep=";", encoding="cp860")


def _lines(df, columns):
    return df.select(F.to_csv(F.struct(*columns)).alias("value"))


@query("source_csv_junk_first_line", ORDERS)
def source_csv_junk_first_line(spark, sf):
    path = fresh(spark, "junk")
    head = ["X1,X2,X3,X4,X5", ",".join(COLUMNS)]

    def with_head(batches):
        import pandas as pd

        yield pd.DataFrame({"value": head})  # also by a task without rows, as an empty table has a header too
        yield from batches

    _lines(_orders(spark, sf), COLUMNS).mapInPandas(with_head, "value string").write.text(path)
    return R.read_table(spark, path, SPEC, skip_lines=1)


@query("source_whitespace_text", "SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_returnflag FROM lineitem")
def source_whitespace_text(spark, sf):
    path = fresh(spark, "spaces")
    names = ("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_returnflag")
    table(spark, sf, "lineitem").select(F.concat(F.lit("  "), F.concat_ws("   ", *names)).alias("value")).write.text(path)
    spec = TableSpec(cat=("l_returnflag",), num=("l_quantity", "l_extendedprice"), key="l_orderkey", extra={"l_linenumber": T.IntegerType()})
    return R.read_table(spark, path, spec, names=names, sep_regex=r"\s+")


@query(
    "source_split_files",
    """SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority,
    CASE o_orderstatus WHEN 'F' THEN 'train' WHEN 'O' THEN 'val' ELSE 'test' END AS split FROM orders""",
)
def source_split_files(spark, sf):
    root = fresh(spark, "splits")
    t = _orders(spark, sf).select(F.monotonically_increasing_id().alias("_c0"), *COLUMNS)
    for split, status in (("train", "F"), ("val", "O"), ("test", "P")):
        t.where(F.col("o_orderstatus") == status).write.option("header", True).csv(f"{root}/{split}_3.csv")
    return R.read_splits(spark, root, SPEC, number=3)


@query(
    "source_bundle",
    f"""WITH {SCORED}, a AS (SELECT g, dense_rank() OVER (ORDER BY g) - 1 AS i FROM (SELECT DISTINCT g FROM scored)),
    b AS (SELECT g2, dense_rank() OVER (ORDER BY g2) - 1 AS i FROM (SELECT DISTINCT g2 FROM scored))
    SELECT [o_totalprice, c_acctbal] AS features, y, CAST(a.i AS INT) AS g_0, CAST(b.i AS INT) AS g_1, true AS is_binary, a.g AS name_0
    FROM scored JOIN a USING (g) JOIN b USING (g2)""",
)
def source_bundle(spark, sf):
    path = fresh(spark, "bundle")
    rows, dims = encode_groups(scored_orders(spark, sf), ["g", "g2"])
    groups = {"g_0": dims["g"], "g_1": dims["g2"]}
    for _ in range(2):  # the second write finds the bundle and leaves it
        W.write_bundle(rows, path, ["o_totalprice", "c_acctbal"], "y", groups, True)
    back, names = R.read_bundle(spark, path)
    first = names.where(F.col("group_type") == "g_0").select(F.col("g").alias("g_0"), F.col("group_name").alias("name_0"))
    return back.join(first, "g_0")


@query("sink_parquet_table", ORDERS)
def sink_parquet_table(spark, sf):
    path = fresh(spark, "table")
    W.write_table(_orders(spark, sf), path)
    return spark.read.parquet(path)


@query("sink_result_tables", f"WITH {RESULTS} SELECT dataset, model_name, CAST('test' AS VARCHAR) AS split, number, perf, fair FROM test UNION ALL SELECT dataset, model_name, 'val', number, perf, fair FROM val")
def sink_result_tables(spark, sf):
    root = fresh(spark, "results")
    val, test, _ = results(spark, sf)
    both = test.select("dataset", "model_name", "number", "perf", "fair").withColumn("split", F.lit("test"))
    both = both.unionByName(val.withColumn("split", F.lit("val")))
    W.write_results(both, root)
    schema = "number bigint, perf double, fair double, dataset string, model_name string, split string"
    return spark.read.schema(schema).parquet(root)


@query("sink_trial_tables", f"WITH {RESULTS} SELECT dataset, model_name, number, duration_text, perf FROM test")
def sink_trial_tables(spark, sf):
    root = fresh(spark, "trials")
    _, test, _ = results(spark, sf)
    W.write_trials(test.select("dataset", "model_name", "number", "duration_text", "perf"), root)
    return spark.read.schema("number bigint, duration_text string, perf double, dataset string, model_name string").parquet(root)


@query("sink_run_bundle", f"WITH {SCORED}, s AS (SELECT g, count(*) AS n FROM scored GROUP BY g), p AS (SELECT row_id, g, pred FROM scored) SELECT row_id, g, pred, n FROM p JOIN s USING (g)")
def sink_run_bundle(spark, sf):
    root = fresh(spark, "run")
    t = scored_orders(spark, sf)
    W.write_run({"sizes": t.groupBy("g").agg(F.count(F.lit(1)).alias("n")), "predictions": t.select("row_id", "g", "pred")}, root)
    parts = W.read_run(spark, root, ["sizes", "predictions"])
    return parts["predictions"].join(parts["sizes"], "g")
