"""Properties of physical plans: what is read, shuffled and broadcast."""

from __future__ import annotations

import pytest

from groupwise.operators import metrics as M
from groupwise.operators import splits as S
from groupwise.plans import load
from groupwise.plans.bindings import scored_orders
from groupwise.plans.registry import table

SF = "/root/testdata/sf0.001"


def plan(df, run=False):
    if run:
        df.collect()
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_losses_are_one_narrow_stage(spark):
    text = plan(load()[0]["loss_error_types"](spark, SF))
    assert "Exchange hashpartitioning" not in text and "Python" not in text


def test_group_metrics_shuffle_only_partial_sums(spark):
    text = plan(M.fairness_metrics(M.group_stats(scored_orders(spark, SF))))
    assert text.count("Exchange hashpartitioning") + text.count("Exchange\n") <= 4
    assert "partial_sum" in text or "HashAggregate" in text
    assert "Window" not in text and "Python" not in text


def test_bundle_reads_the_rows_once(spark):
    sf = scored_orders(spark, SF).selectExpr("*", "'m' as model", "'train' as split")
    text = plan(M.evaluate_models(sf, 0.5))
    assert text.count("Scan parquet") == 4  # two tables, each once in the tree and once in the details


def test_a_curve_shares_one_shuffle_of_the_scores(spark):
    assert "ReusedExchange" in plan(M.roc_auc(scored_orders(spark, SF), ["g"]), run=True)


def test_ks_groups_only_scores_of_open_buckets(spark, monkeypatch):
    """Of 20,000 distinct scores a small part can hold the maximum; nothing else is grouped by score."""
    rows = spark.range(20_000).selectExpr("id / 20000 as score", "cast(rand(3) < 0.2 + 0.6 * id / 20000 as int) as y").cache()
    joined, attach = [], M.attach
    monkeypatch.setattr(M, "attach", lambda *a, **k: joined.append(attach(*a, **k)) or joined[-1])
    M.ks_threshold(rows, buckets=256).collect()
    assert joined[-1].count() < 0.2 * 20_000
    rows.unpersist()


def test_columns_and_filters_reach_the_scan(spark):
    text = plan(table(spark, SF, "orders").where("o_totalprice > 1000").select("o_orderkey"))
    assert "PushedFilters: [IsNotNull(o_totalprice), GreaterThan(o_totalprice,1000.0)]" in text
    assert "ReadSchema: struct<o_orderkey:bigint,o_totalprice:double>" in text


def test_rows_are_not_shuffled_to_be_split(spark):
    out = S.split_by_group(scored_orders(spark, SF).select("row_id", "g", "y"), "row_id")
    text = plan(out)
    assert "Window" not in text and "hashpartitioning" not in text and "SinglePartition" not in text


def test_the_whole_bootstrap_by_brute_force(spark):
    """1000 repetitions of 100 draws for one dataset; all draws of one alpha are made anew."""
    from hashlib import md5

    from groupwise.plans import trials
    from groupwise.plans.bindings import results

    brand, a = "Brand#1", 7
    val, test, _ = (t.where(f"dataset = '{brand}'").toPandas() if i < 2 else None for i, t in enumerate(results(spark, SF)))
    got = trials.trial_select_models_full(spark, SF, brand).toPandas()
    mean = trials.trial_mean_ci_full(spark, SF, brand).toPandas().set_index(["model_name", "alpha"])
    assert len(got) == 21 * 1000 * val["model_name"].nunique() and set(mean["n"]) == {1000}
    for name, rows in val.sort_values("number").groupby("model_name"):
        score = [(0.35 * f + 0.65 * p, -n) for f, p, n in zip(rows["fair"], rows["perf"], rows["number"])]
        at = lambda rep, draw: int(md5(f"11|{brand}|{name}|{a}|{rep}|{draw}".encode()).hexdigest()[:8], 16) % len(score)
        want = [-max(score[at(rep, draw)] for draw in range(100))[1] for rep in range(1000)]
        mine = got[(got["model_name"] == name) & (got["alpha"] == 0.35)].sort_values("rep")
        assert mine["number"].tolist() == want
        held = test[test["model_name"] == name].set_index("number").loc[want]
        scores = 0.65 * held["perf"] + 0.35 * held["fair"]
        assert abs(mean.loc[(name, 0.35), "score_mean"] - scores.mean()) < 2e-6
        assert abs(mean.loc[(name, 0.35), "score_ci"] - 1.9623414611 * scores.std(ddof=1) / 1000**0.5) < 2e-6
