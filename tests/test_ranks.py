"""Order statistics, prefix sums and codes against numpy, with skewed keys and the large-table paths forced."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from groupwise import lookup
from groupwise.functions.hashing import hash_key
from groupwise.operators import ranks as R
from groupwise.operators.dual import dual_step, dual_update
from groupwise.operators.splits import assign_folds, split_by_group


def skewed(spark, n=3000):
    """A third of all rows in one group."""
    g = F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("g"), (F.col("id") % 40).cast("string")))
    return spark.range(n).select(F.col("id").alias("k"), g.alias("g"), (F.col("id") * 7919 % 1009 / 10).alias("v"), (F.col("id") % 2).alias("y"))


@pytest.mark.parametrize("sort_rows", [200_000, 1])
def test_rank_cuts(spark, sort_rows):
    df = skewed(spark).withColumn("h", hash_key("t", "k"))
    pdf = df.toPandas()
    groups = sorted(pdf["g"].unique())
    cuts = [(g, c, k) for g in groups for c, k in (("a", 1), ("b", 20), ("none", 0), ("all", 10_000))]
    table = spark.createDataFrame(cuts, "g string, cut string, k long")
    got = R.rank_cuts(df, ["g"], "h", lambda sizes: table, sort_rows).collect()
    assert len(got) == len(cuts)
    at = {(r["g"], r["cut"]): r["at"] for r in got}
    for g in groups:
        keys = sorted(pdf[pdf.g == g]["h"])
        assert at[g, "a"] == keys[0]
        assert at[g, "b"] == keys[19]
        assert at[g, "none"] == ""
        assert at[g, "all"] > keys[-1]


@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize("buckets", [1, 7, 64])
def test_prefix_sums(spark, descending, buckets):
    table = skewed(spark).groupBy("g", "v").agg(F.count("*").alias("c"))
    got = R.prefix_sums(table, ["g"], "v", ["c"], descending, buckets).toPandas()
    assert len(got) == table.count()
    for _, part in got.groupby("g"):
        part = part.sort_values("v", ascending=not descending)
        assert (part["cum_c"] == part["c"].cumsum()).all()
        assert (part["all_c"] == part["c"].sum()).all()


def test_exact_quantiles(spark):
    df = skewed(spark)
    probs = [0.0, 0.1, 0.25, 0.5, 0.77, 1.0]
    assert np.allclose(R.exact_quantiles(df, "v", probs), np.quantile(df.toPandas()["v"], probs))


def test_quantiles_cut_again_where_cells_are_long(spark, monkeypatch):
    """Cells above the bound are cut again over their own rows; a value that fills its cell needs no cut."""
    df = spark.range(20_000).selectExpr("case when id % 3 = 0 then 5.0 when id % 7 = 0 then null else sqrt(id * 7919 % 20011) end as v").repartition(5)
    probs = [0.0, 0.01, 0.2, 0.5, 0.9, 0.999, 1.0]
    want = np.quantile(df.toPandas()["v"].dropna(), probs)
    monkeypatch.setattr(R, "POINTS", 20)
    monkeypatch.setattr(R, "EVEN", 21)
    for rows in (200_000, 500):
        monkeypatch.setattr(R, "SORT_ROWS", rows)
        assert np.allclose(R.exact_quantiles(df, "v", probs), want)
    assert R.exact_quantiles(df.where("v is null"), "v", [0.5]) == []


def test_pooled_points_stand_for_even_shares(spark):
    df = spark.range(200_000).selectExpr("pow(id / 200000, 3) as v", "id % 4 as few", "cast(null as double) as none").repartition(9)
    points, n = R.pooled_points(df, ["v", "few", "none"])
    assert n == 200_000 and points["few"].tolist() == [0, 1, 2, 3] and len(points["none"]) == 0
    edges = np.array(R.cuts_of(points["v"], 10))
    assert np.allclose(np.cbrt(edges), np.arange(1, 10) / 10, atol=0.01)
    assert R.cuts_of(points["few"], 255) == [1, 2, 3] and R.cuts_of(np.zeros(0), 8) == []


def test_buckets_by_search(spark):
    edges = [0.5, 2.0, 3.0, 50.0]
    got = R.with_bucket(skewed(spark).select("v").union(spark.sql("select cast(null as double)")), "v", edges, "b").toPandas()
    known = got["v"].notna()
    assert (got["b"][known] == np.searchsorted(edges, got["v"][known], side="right")).all() and got["b"][~known].isna().all()


def brute_ks(y, s):
    best = (0, None)
    for t in sorted(set(s)):
        hit = s >= t
        d = (y[hit] == 1).sum() * (y == 0).sum() - (y[hit] == 0).sum() * (y == 1).sum()
        if d > 0 and (best[1] is None or d >= best[0]):
            best = (d, t)
    return best


@pytest.mark.parametrize("buckets", [1, 4, 64, 1024])
@pytest.mark.parametrize("values", [3, 40, 5000])
def test_ks_by_bounds_is_exact(spark, buckets, values):
    """Ties of scores and of differences, keys without a class, useless scores."""
    from groupwise.operators.metrics import ks_threshold

    rng = np.random.default_rng(values + buckets)
    s = rng.integers(0, values, 600) / values
    g = rng.integers(0, 4, 600)
    y = np.where(g == 0, 1, np.where(g == 1, (rng.random(600) < s).astype(int), rng.integers(0, 2, 600)))
    df = spark.createDataFrame([(int(a), int(b), float(c)) for a, b, c in zip(g, y, s)], "g int, y int, score double").repartition(3)
    got = {r["g"]: r for r in ks_threshold(df, ["g"], buckets=buckets).collect()}
    for k in range(4):
        d, t = brute_ks(y[g == k], s[g == k])
        pos, neg = (y[g == k] == 1).sum(), (y[g == k] == 0).sum()
        assert got[k]["threshold"] == (float("inf") if t is None else t)
        assert got[k]["ks"] == pytest.approx(d / (pos * neg) if t is not None else 0.0)
    whole = ks_threshold(df, buckets=buckets).first()
    assert whole["threshold"] == brute_ks(y, s)[1]


def test_running_mean_over_ranges(spark, monkeypatch):
    from groupwise.operators.metrics import running_mean

    monkeypatch.setattr(R, "BUCKET_ROWS", 10)
    rows = [(g, i, float(i * 37 % 11), i % 5 + 1) for g in range(2) for i in range(120)]
    df = spark.createDataFrame(rows, "g int, i int, v double, c int").repartition(4)
    got = running_mean(df, "i", "v", "c", ["g"]).toPandas().sort_values(["g", "i"])
    for _, part in got.groupby("g"):
        assert np.allclose(part["running_mean"], (part["v"] * part["c"]).cumsum() / part["c"].cumsum())
    text = running_mean(df.withColumn("i", F.lpad(F.col("i").cast("string"), 4, "0")), "i", "v", "c", ["g"]).toPandas().sort_values(["g", "i"])
    assert np.allclose(text["running_mean"], got["running_mean"])


def test_edge_bucket(spark):
    edges = [0.5, 2.0, 3.0, 50.0]
    df = skewed(spark).select("v", R.edge_bucket("v", edges).alias("b")).toPandas()
    assert (df["b"] == np.searchsorted(edges, df["v"], side="right")).all()


@pytest.mark.parametrize("bound", [100_000, 5])
def test_dense_codes_small_and_large(spark, monkeypatch, bound):
    monkeypatch.setattr(lookup, "LOOKUP_ROWS", bound)
    distinct = skewed(spark).select("g", "y").distinct()
    got = R.dense_codes(distinct, ["g", "y"], "code").toPandas().sort_values(["g", "y"])
    assert got["code"].tolist() == list(range(len(got)))


@pytest.mark.parametrize("bound", [100_000, 3])
@pytest.mark.parametrize("how", ["inner", "left"])
def test_attach_small_and_large(spark, monkeypatch, bound, how):
    monkeypatch.setattr(lookup, "LOOKUP_ROWS", bound)
    df = skewed(spark)
    dim = df.where("g != 'g7'").groupBy("g").agg(F.count("*").alias("n"))
    got = lookup.attach(df, dim, ["g"], how).toPandas()
    want = df.toPandas().merge(dim.toPandas(), on="g", how=how)
    assert len(got) == len(want)
    assert got["n"].fillna(0).sum() == want["n"].fillna(0).sum()


@pytest.mark.parametrize("bound", [100_000, 3])
def test_split_with_many_strata(spark, monkeypatch, bound):
    monkeypatch.setattr(lookup, "LOOKUP_ROWS", bound)
    df = skewed(spark)
    got = split_by_group(df, "k", 20).toPandas()
    assert len(got) == 3000
    for _, part in got.groupby("g"):
        sizes = part["split"].value_counts()
        assert sizes.get("test", 0) == sizes.get("val", 0) == int(len(part) * 0.2)
        rates = part.groupby("split")["y"].mean()
        assert abs(rates["test"] - part["y"].mean()) <= 1 / max(sizes["test"], 1)


def test_split_does_not_depend_on_partitioning(spark):
    df = skewed(spark)
    seen = {tuple(sorted(map(tuple, split_by_group(df.repartition(n), "k").select("k", "split").collect()))) for n in (1, 4, 17)}
    assert len(seen) == 1


def test_folds_cover_all_rows_once(spark):
    got = assign_folds(skewed(spark, 1003), "k", 4).toPandas()
    assert sorted(got["fold"].unique()) == [0, 1, 2, 3]
    assert got.groupby(["y", "fold"]).size().groupby("y").agg(lambda s: s.max() - s.min()).max() <= 1


@pytest.mark.parametrize("name", ["_m", "key", "c0", "v0", "_c", "cum__s"])
def test_cuts_of_a_column_of_any_name(spark, name):
    df = skewed(spark).withColumn("v", F.when(F.col("k") % 7 != 0, F.col("v")))
    points, n = R.pooled_points(df.withColumnRenamed("v", name), [name, "y"])
    want, _ = R.pooled_points(df, ["v", "y"])
    assert n == 3000
    assert points[name].tolist() == want["v"].tolist()
    assert points["y"].tolist() == [0.0, 1.0]


def test_projection_of_moved_weights(spark):
    """Many vectors of two to six entries with ties: the table form against the vector form."""
    state = spark.range(540).select(
        (F.col("id") % 90).alias("vid"), F.floor(F.col("id") / 90).alias("g"), (F.col("id") * 31 % 17 / 17).alias("mu"), (F.col("id") * 7 % 5 / 5).alias("loss")
    )
    state = state.where(F.col("g") <= F.col("vid") % 5 + 1)
    got = dual_step(state, "gradient_norm", lam=0.7, eta=0.5).toPandas()
    assert len(got) == state.count()
    for _, part in got.groupby("vid"):
        want = dual_update(part["mu"].to_numpy(), part["loss"].to_numpy(), 0.7, 0.5, "gradient_norm")
        assert np.allclose(part["mu_new"], want, atol=1e-12)
