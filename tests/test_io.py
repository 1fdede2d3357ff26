"""Readers, writers and the stream monitor."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from groupwise.operators.metrics import group_stats, rates
from groupwise.plans import load
from groupwise.plans.bindings import scored_events
from groupwise.sources import readers as R
from groupwise.sources import writers as W
from groupwise.spec import TableSpec
from groupwise.streaming.monitor import monitor, monitor_rates

SF = "/root/testdata/sf0.001"
SPEC = TableSpec(cat=("c",), num=("v",), label="y", key="id", extra={"y": T.IntegerType()})


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_roles_decide_types(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,c,v,y\n1,7,2.5,0\n2, x ,,1\n")
    df = R.read_table(spark, str(tmp_path / "a.csv"), SPEC)
    assert df.dtypes == [("id", "bigint"), ("c", "string"), ("v", "double"), ("y", "int")]
    assert rows(df.na.fill(-1.0)) == [(1, "7", 2.5, 0), (2, "x", -1.0, 1)]


def test_delimiter_is_found_in_the_first_two_lines(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id;c;v;y\n1;a;2.5;0\n")
    (tmp_path / "b.csv").write_text("id,c,v,y\n1,a,2.5,0\n2,b;c,1.0,1\n")
    assert R.sniff_delimiter(spark, str(tmp_path / "a.csv")) == ";"
    assert R.sniff_delimiter(spark, str(tmp_path / "b.csv")) == ","
    assert rows(R.read_table(spark, str(tmp_path / "a.csv"), SPEC, sep=None)) == [(1, "a", 2.5, 0)]


def test_charset(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("id;c;v;y\n1;São João;2.5;0\n".encode("cp860"))
    assert rows(R.read_table(spark, str(tmp_path / "a.csv"), SPEC, sep=";", encoding="cp860")) == [(1, "São João", 2.5, 0)]


def test_junk_line_before_the_header(spark, tmp_path):
    (tmp_path / "a.csv").write_text(",X1,X2,Y\nid,c,v,y\n1,a,2.5,0\n2,b,1.5,1\n")
    assert rows(R.read_table(spark, str(tmp_path / "a.csv"), SPEC, skip_lines=1)) == [(1, "a", 2.5, 0), (2, "b", 1.5, 1)]


def test_rows_equal_to_the_junk_or_header_line_stay(spark, tmp_path):
    spec = TableSpec(cat=("c", "v"), label="y", key="id", extra={"y": T.StringType(), "id": T.StringType()})
    (tmp_path / "d").mkdir()
    lead = "j,j,j,j\nid,c,v,y\n"
    (tmp_path / "d" / "a.csv").write_text(lead + "1,a,b,0\nj,j,j,j\nid,c,v,y\n\n2,a,b,1\n")
    (tmp_path / "d" / "b.csv").write_text(lead + "j,j,j,j\n" + "3,x,y,z\n" * 50)
    (tmp_path / "d" / "c.csv").write_text(lead)
    expected = [("1", "a", "b", "0"), ("2", "a", "b", "1"), ("id", "c", "v", "y"), *[("j",) * 4] * 2, *[("3", "x", "y", "z")] * 50]
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for size in (kept, "30"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            assert rows(R.read_table(spark, str(tmp_path / "d"), spec, skip_lines=1)) == sorted(expected)
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", kept)


def test_the_header_is_in_the_first_file_that_is_not_empty(spark, tmp_path):
    d = tmp_path / "a b%20c"
    d.mkdir()
    for name, text in (("a", ""), ("b", ""), ("c", "j;j\n"), ("d e", "j;j\nid;c;v;y\n1;a;2.5;0\n"), ("f", ""), ("g", "j;j\nid;c;v;y\n2;b;1.5;1\n")):
        (d / f"{name}.csv").write_text(text)
    assert R.first_lines(spark, str(d), 2) == ["j;j"]
    assert R.sniff_delimiter(spark, str(d)) == ";"
    for sep in (";", None):
        assert rows(R.read_table(spark, str(d), SPEC, sep=sep, skip_lines=1)) == [(1, "a", 2.5, 0), (2, "b", 1.5, 1)]
    (tmp_path / "none").mkdir()
    (tmp_path / "none" / "a.csv").write_text("")
    assert R.first_lines(spark, str(tmp_path / "none"), 2) == []
    with pytest.raises(ValueError, match="no header after 1 lines"):
        R.read_table(spark, str(tmp_path / "none"), SPEC, skip_lines=1)


def test_a_junk_first_line_when_tasks_have_no_rows(spark, tmp_path):
    """A row group belongs to the split with its middle, so the first split of a table in one row group has no rows."""
    columns = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]
    orders = spark.range(5000).selectExpr(
        "id as o_orderkey", "if(id % 7 = 0, null, id * 31 % 997) as o_custkey", "substr('FOP', 1 + cast(id % 3 as int), 1) as o_orderstatus",
        "id / 4 as o_totalprice", "concat(id % 5, '-P, \"', id % 11, '\"') as o_orderpriority",
    )
    orders.coalesce(1).write.parquet(str(tmp_path / "some" / "orders.parquet"))
    orders.limit(0).coalesce(1).write.parquet(str(tmp_path / "none" / "orders.parquet"))
    size = max(f.stat().st_size for f in (tmp_path / "some" / "orders.parquet").glob("*.parquet"))
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size // 5))
    try:
        tasks = spark.read.parquet(str(tmp_path / "some" / "orders.parquet")).rdd.glom().map(len).collect()
        assert tasks[0] == 0 and sum(tasks) == 5000
        got = load()[0]["source_csv_junk_first_line"](spark, str(tmp_path / "some"))
        assert rows(got.select(*columns).na.fill(-1)) == rows(orders.na.fill(-1))
        got = load()[0]["source_csv_junk_first_line"](spark, str(tmp_path / "none"))
        assert got.columns == columns and rows(got) == []
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)


def test_whitespace(spark, tmp_path):
    (tmp_path / "a.txt").write_text("  1   a  2.5 0\n\n2 b 1.5   1  \n")
    got = R.read_table(spark, str(tmp_path / "a.txt"), SPEC, names=["id", "c", "v", "y"], sep_regex=r"\s+")
    assert rows(got) == [(1, "a", 2.5, 0), (2, "b", 1.5, 1)]


def test_split_files_lose_their_index(spark, tmp_path):
    for i, split in enumerate(("train", "val", "test")):
        (tmp_path / f"{split}_2.csv").write_text(f",id,c,v,y\n0,{i},a,2.5,0\n")
    got = R.read_splits(spark, str(tmp_path), SPEC, number=2)
    assert rows(got) == [(0, "a", 2.5, 0, "train"), (1, "a", 2.5, 0, "val"), (2, "a", 2.5, 0, "test")]


def test_existing_bundle_is_left_alone(spark, tmp_path):
    df = spark.createDataFrame([(1.0, 0, 0), (float("nan"), 1, 1)], "a double, y int, g_0 int")
    dim = spark.createDataFrame([("x", 0), ("z", 1)], "name string, g_0 int")
    path = str(tmp_path / "bundle")
    W.write_bundle(df, path, ["a"], "y", {"g_0": dim}, True)
    W.write_bundle(df.limit(1), path, ["a"], "y", {"g_0": dim.limit(1)}, False)
    back, names = R.read_bundle(spark, path)
    assert back.count() == 2 and names.count() == 2
    assert {r["y"]: r["features"] for r in back.collect()} == {0: [1.0], 1: [None]}
    assert back.where("is_binary").count() == 2


def test_result_partitions_are_pruned(spark, tmp_path):
    df = spark.createDataFrame([("d", "m", s, 1.0) for s in ("val", "test")], "dataset string, model_name string, split string, acc double")
    W.write_results(df, str(tmp_path / "r"))
    picked = spark.read.parquet(str(tmp_path / "r")).where("split = 'test'")
    assert picked.count() == 1 and "PartitionFilters: [isnotnull(split" in picked._jdf.queryExecution().toString()
    with pytest.raises(ValueError):
        W.write_table(df, str(tmp_path / "x"), "json")


def test_stream_needs_a_watermark(spark):
    stream = spark.readStream.format("rate").load().selectExpr("timestamp as ts", "value % 2 as g", "1 as y", "1 as pred", "0.5D as score")
    with pytest.raises(ValueError, match="watermark"):
        monitor(stream)


def test_stream_equals_batch_and_drops_late_rows(spark, tmp_path):
    batch = scored_events(spark, SF).withColumn("ts", F.col("ts").cast("timestamp"))
    order = batch.select("ts").orderBy("ts").collect()
    cut = order[len(order) // 2][0]
    source = str(tmp_path / "in")
    schema = batch.schema
    batch.where(F.col("ts") < F.lit(cut)).coalesce(1).write.parquet(source)
    stream = spark.readStream.schema(schema).parquet(source)
    out = monitor_rates(monitor(stream, window="1 day", watermark="1 hour"))
    q = out.writeStream.outputMode("append").format("memory").queryName("monitored").start()
    q.processAllAvailable()
    batch.where(F.col("ts") >= F.lit(cut)).coalesce(1).write.mode("append").parquet(source)
    q.processAllAvailable()
    # rows of the first day arrive again, far behind the watermark
    batch.where(F.col("ts") < "2024-01-02").coalesce(1).write.mode("append").parquet(source)
    q.processAllAvailable()
    q.stop()
    got = spark.table("monitored")
    want = monitor_rates(monitor(batch, window="1 day"))
    last = got.agg(F.max("window_end")).first()[0]
    key = ["window_start", "g", "n", "acc", "tpr"]
    assert rows(got.select(*key).na.fill(-1.0)) == rows(want.where(F.col("window_end") <= F.lit(last)).select(*key).na.fill(-1.0))
    assert got.count() > 100


def test_overall_monitor_agrees_with_metrics(spark):
    sf = scored_events(spark, SF)
    whole = monitor(sf, window="3650 days").groupBy("g").agg(F.sum("n").alias("n"), F.sum("tp").alias("tp"), F.sum("pos").alias("pos"))
    got = {r["g"]: r["tp"] / r["pos"] for r in whole.collect()}
    want = {r["g"]: r["tpr"] for r in rates(group_stats(sf), ["g"], ["tpr"]).collect()}
    assert got == pytest.approx(want)
