"""Rows without a group or label: they are split like any stratum, and training refuses them instead of dropping them."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from groupwise.learners.adaptive import LogisticRiskOracle
from groupwise.learners.boosting import BoostClassifier, MinMaxBoostClassifier
from groupwise.learners.game import MinimaxGame
from groupwise.operators import splits


def table(spark, n=400):
    """Every second row has no group, every tenth no label."""
    return spark.range(n).select(
        F.col("id").alias("row_id"),
        F.when(F.col("id") % 2 == 0, "a").alias("g"),
        F.when(F.col("id") % 10 != 0, (F.col("id") % 3 == 0).cast("int")).alias("y"),
        ((F.col("id") * 7) % 11).cast("double").alias("x"),
    )


def test_null_strata_are_split(spark):
    out = splits.split_by_group(table(spark), key="row_id", pct=20)
    got = {(r["g"], r["split"]): r["n"] for r in out.groupBy("g", "split").agg(F.count(F.lit(1)).alias("n")).collect()}
    for g in ("a", None):
        assert sum(n for (k, _), n in got.items() if k == g) == 200
        assert got[g, "train"] < 200 and got[g, "val"] > 0 and got[g, "test"] > 0


def test_training_refuses_rows_without_a_group(spark):
    df = table(spark).fillna({"y": 0})
    with pytest.raises(Exception, match="NULL"):
        MinMaxBoostClassifier(n_estimators=1).fit(df, features=["x"], y="y", g="g")
    with pytest.raises(ValueError, match="NULL"):
        MinimaxGame(rounds=1).fit(df, ["x"])
    with pytest.raises(ValueError, match="NULL"):
        LogisticRiskOracle(df, ["x"])


def test_validation_refuses_unseen_groups(spark):
    df = table(spark).fillna({"y": 0, "g": "b"})
    with pytest.raises(Exception, match="group without training rows: new"):
        MinMaxBoostClassifier(n_estimators=1).fit(df, features=["x"], y="y", g="g", valid=df.withColumn("g", F.lit("new")))


def test_plain_booster_reads_no_group(spark):
    df = table(spark).fillna({"y": 0})
    with_group = BoostClassifier(n_estimators=2, num_leaves=3).fit(df, features=["x"], y="y")
    without = BoostClassifier(n_estimators=2, num_leaves=3).fit(df.drop("g"), features=["x"], y="y", g=None)
    p = [m.transform(df).agg(F.sum("p")).first()[0] for m in (with_group, without)]
    assert p[0] == pytest.approx(p[1])
