"""Edge cases of metrics, losses, features and recoding."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from groupwise.functions import losses as L
from groupwise.functions import recode as R
from groupwise.functions.hashing import poisson
from groupwise.operators import calibration as C
from groupwise.operators import clean, dual, features, groups, metrics
from groupwise.operators.trials import t_factor, t_quantile
from groupwise.spec import TableSpec, is_binary, normalize_binary

SCHEMA = "row_id long, g string, y int, pred int, score double"


def frame(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], SCHEMA)


def one(df):
    return df.first().asDict()


def test_group_without_positives_is_skipped(spark):
    sf = frame(spark, [("a", 1, 1, 0.9), ("a", 1, 0, 0.4), ("a", 0, 0, 0.2), ("b", 0, 1, 0.8), ("b", 0, 0, 0.1)])
    stats = metrics.group_stats(sf)
    b = one(metrics.rates(stats).where("g = 'b'"))
    assert b["tpr"] is None and b["fnr"] is None and b["logloss_pos"] is None
    assert b["recall"] == 0.0 and b["bal_acc"] == 0.5
    assert one(metrics.max_rate(stats, "fnr"))["max_fnr"] == 0.5
    assert one(metrics.fairness_metrics(stats))["min_tpr"] == 0.5


def test_single_group_has_no_spread(spark):
    stats = metrics.group_stats(frame(spark, [("a", 1, 1, 0.9), ("a", 0, 1, 0.6)]))
    got = one(metrics.fairness_metrics(stats))
    assert got["eod"] == got["spd"] == got["eq_loss"] == 0.0


def test_tied_worst_groups_give_the_lowest_id(spark):
    sf = frame(spark, [(g, 1, p, 0.5) for g in ("c", "b", "a") for p in (1, 0)])
    assert one(metrics.worst_group(metrics.group_stats(sf), "acc")) == {"worst_acc": 0.5, "worst_g": "a"}


def test_nothing_predicted_positive(spark):
    got = one(metrics.performance(metrics.group_stats(frame(spark, [("a", 1, 0, 0.1), ("a", 0, 0, 0.2)]))))
    assert got["precision"] == 0.0 and got["recall"] == 0.0 and got["acc"] == 0.5


def test_equal_scores(spark):
    sf = frame(spark, [("a", y, 1, 0.3) for y in (0, 1, 1, 0, 0)])
    assert one(metrics.roc_auc(sf))["roc_auc"] == 0.5
    assert one(metrics.ks_threshold(sf))["threshold"] == math.inf


def test_auc_of_one_class_is_null(spark):
    assert one(metrics.roc_auc(frame(spark, [("a", 1, 1, 0.3), ("a", 1, 1, 0.4)])))["roc_auc"] is None


def test_ks_takes_the_highest_of_tied_thresholds(spark):
    sf = frame(spark, [("a", 1, 1, 0.9), ("a", 0, 1, 0.8), ("a", 1, 1, 0.7), ("a", 0, 1, 0.1)])
    assert one(metrics.ks_threshold(sf)) == {"threshold": 0.9, "ks": 0.5}


def test_two_group_difference_is_signed(spark):
    sf = frame(spark, [("0", 1, 1, 0.9), ("0", 1, 1, 0.9), ("1", 1, 1, 0.9), ("1", 1, 0, 0.2)])
    stats = metrics.group_stats(sf)
    assert one(metrics.difference(stats, "tpr", signed=("0", "1")))["tpr_diff"] == -0.5
    assert one(metrics.difference(stats, "tpr"))["tpr_range"] == 0.5


def test_certain_probabilities_stay_finite(spark):
    sf = frame(spark, [("a", 1, 1, 1.0), ("a", 1, 0, 0.0)])
    losses = [r[0] for r in sf.select(L.logloss("y", "score")).collect()]
    assert losses[0] == pytest.approx(0.0, abs=1e-12) and losses[1] == pytest.approx(-math.log(1e-15))


def test_masked_rows_are_null_in_the_loss_and_zero_in_the_gradient(spark):
    sf = frame(spark, [("a", 0, 0, 0.3), ("a", 1, 0, 0.3)])
    rows = sf.select(L.constraint_loss("y", "score", "true_positive_rate"), L.constraint_grad("y", "score", "true_positive_rate")).collect()
    assert rows[0][0] is None and rows[0][1] == 0.0 and rows[1][1] == pytest.approx(-0.7)
    with pytest.raises(ValueError):
        L.constraint_loss("y", "score", "other")


def test_confidence_on_bin_edges(spark):
    values = [0.0, 0.1, 0.3, 0.6, 0.7, 0.95, 1.0]
    df = spark.createDataFrame([(v,) for v in values], "c double")
    got = [r[0] for r in df.select(C.confidence_bin(F.col("c"))).collect()]
    edges = np.linspace(0, 1, 11)
    want = [min(int(np.sum(edges[1:] <= v)), 9) for v in values]
    assert got == want == [0, 1, 2, 5, 6, 9, 9]
    assert C.bin_edges(10) == edges.tolist()


def test_constant_feature(spark):
    df = spark.createDataFrame([(1.0, 4.0), (2.0, 4.0), (4.0, 4.0)], "a double, b double")
    std = features.Standardize(["a", "b"]).fit(df).transform(df).toPandas()
    assert std["a"].std(ddof=0) == pytest.approx(1.0) and (std["b"] == 0).all()
    assert (features.MinMax().fit(df).transform(df).toPandas()["b"] == 0).all()


def test_unseen_category_gives_zeros(spark):
    train = spark.createDataFrame([("x",), ("y",), ("z",)], "c string")
    test = spark.createDataFrame([("w",), ("y",), (None,)], "c string")
    got = [tuple(r) for r in features.OneHot(["c"]).fit(train).transform(test).collect()]
    assert got == [(0, 0, 0), (0, 1, 0), (0, 0, 0)]


def test_too_many_categories_are_refused(spark):
    df = spark.range(50).select(F.col("id").cast("string").alias("c"))
    with pytest.raises(ValueError):
        features.OneHot(["c"], max_categories=20).fit(df)


def test_codes_of_unseen_values_are_null(spark):
    train = spark.createDataFrame([("b",), ("a",)], "c string")
    test = spark.createDataFrame([("a",), ("q",)], "c string")
    got = {r["c"]: r["code"] for r in clean.category_codes(test, ["c"], fitted=train).collect()}
    assert got == {"a": 0, "q": None}


def test_strict_map_stops_on_unknown_codes(spark):
    df = spark.createDataFrame([("a",), (None,)], "c string")
    assert [r[0] for r in df.select(R.map_value("c", {"a": 1}, "error")).collect()] == [1, None]
    with pytest.raises(Exception, match="unmapped value"):
        df.select(R.map_value("c", {"b": 1}, "error")).collect()


def test_binary_labels(spark):
    signed = spark.createDataFrame([(-1,), (1,), (None,)], "y int")
    assert [r[0] for r in signed.select(normalize_binary("y")).collect()] == [0, 1, None]
    assert is_binary(signed, "y")
    with pytest.raises(Exception, match="not a binary label"):
        spark.createDataFrame([(2,)], "y int").select(normalize_binary("y")).collect()


def test_null_label_rows(spark):
    df = spark.createDataFrame([(1.0, "a"), (None, "b"), (float("nan"), "c")], "v double, k string")
    assert [r["k"] for r in clean.drop_missing(df).collect()] == ["a"]
    assert [r["k"] for r in clean.keep_all_equal(df, ["v"], 1.0).collect()] == ["a"]
    with pytest.raises(ValueError):
        clean.drop_groups(df, ["nothing"])


def test_durations(spark):
    texts = ["0 days 00:00:01.5", "1 day 01:00:00", "02:03:04", "3 days 00:00:00.000001", "soon", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(R.duration_seconds("t")).collect()]
    assert got == pytest.approx([1.5, 90000.0, 7384.0, 259200.000001, None, None])


def test_wildcard_roles():
    spec = TableSpec(cat=("c",), num="all", label="y", key="id")
    assert spec.roles(["id", "c", "a", "b", "y"]) == (["c"], ["a", "b"])
    assert TableSpec(cat="none", num=("a",)).roles(["a", "b"]) == ([], ["a"])
    with pytest.raises(ValueError):
        TableSpec(cat="all", num="all").roles(["a"])


def test_poisson_copies(spark):
    df = spark.range(20_000).select(F.col("id"), *[poisson(F.lit(r), "s", "id").alias(f"r{i}") for i, r in enumerate((0.3, 4.0, 50.0))])
    got = df.agg(*[f(c) for c in ("r0", "r1", "r2") for f in (F.avg, F.variance)]).first()
    for mean, var, rate in zip(got[::2], got[1::2], (0.3, 4.0, 50.0)):
        assert mean == pytest.approx(rate, rel=0.05) and var == pytest.approx(rate, rel=0.06)


def test_resample_balances_groups(spark):
    df = spark.range(6000).select(F.col("id").alias("k"), F.when(F.col("id") % 10 == 0, "small").otherwise("big").alias("g"))
    sizes = dict(groups.resample_balanced(groups.inverse_frequency_weight(df, "g"), "k", "weight").groupBy("g").count().collect())
    assert sizes["small"] == pytest.approx(3000, rel=0.1) and sizes["big"] == pytest.approx(3000, rel=0.1)


def test_simplex_projection():
    rng = np.random.default_rng(0)
    for _ in range(50):
        v, z = rng.normal(size=rng.integers(1, 9)), rng.uniform(0.1, 3)
        x = dual.simplex(v, z)
        assert x.sum() == pytest.approx(z) and (x >= 0).all()
        assert np.allclose(dual.simplex(x, z), x)
        low, high = v.min() - z, v.max()
        for _ in range(200):
            mid = (low + high) / 2
            low, high = (mid, high) if np.maximum(v - mid, 0).sum() > z else (low, mid)
        assert np.allclose(x, np.maximum(v - low, 0), atol=1e-9)


def test_dual_updates_keep_the_mass():
    mu, loss = np.array([0.1, 0.2, 0.2]), np.array([0.5, np.nan, 0.9])
    for mode in ("optim", "gradient_norm", "gradient_norm2"):
        assert dual.dual_update(mu, loss, 0.5, 0.3, mode).sum() == pytest.approx(0.5)
    assert dual.dual_update(mu, np.array([0.9, 0.9, 0.1]), 0.5, 0.3, "optim").tolist() == [0.5, 0.0, 0.0]
    for wrong in ("fixed", "zero"):
        with pytest.raises(ValueError):
            dual.dual_update(mu, loss, 0.5, 0.3, wrong)


def test_early_stop():
    stop = dual.EarlyStop(2)
    assert [stop.update(x) for x in (1.0, 0.9995, 0.9, 0.95, 0.95, 0.95)] == [
        (True, False), (False, False), (True, False), (False, False), (False, False), (False, True),
    ]


def test_t_quantiles(spark):
    # fixed values from the usual tables
    for df, want in ((1, 12.7062047), (2, 4.3026527), (9, 2.2621572), (99, 1.9842170), (999, 1.9623415)):
        assert t_quantile(df) == pytest.approx(want, abs=2e-6)
    got = spark.createDataFrame([(1000,), (250,), (2,), (1,)], "n long").select(t_factor(F.col("n"))).collect()
    assert [g[0] for g in got] == pytest.approx([t_quantile(999), t_quantile(249), t_quantile(1), None], abs=1e-7)


def test_stats_do_not_depend_on_partitioning(spark):
    rng = np.random.default_rng(1)
    rows = [("abc"[i % 3], int(rng.integers(2)), int(rng.integers(2)), float(rng.uniform())) for i in range(200)]
    sf = frame(spark, rows)
    seen = set()
    for n in (1, 4, 17):
        stats = metrics.rates(metrics.group_stats(sf.repartition(n)))
        seen.add(tuple(sorted((r["g"], *[round(x, 9) for x in r[1:]]) for r in stats.collect())))
    assert len(seen) == 1
