"""Boosting against a direct numpy fit on few rows, and identities of the fair objective."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from groupwise.functions.losses import logloss_grad, logloss_hess, sigmoid
from groupwise.learners import boosting as B
from groupwise.learners.experiments import convergence, run_trials
from groupwise.operators.dual import simplex
from groupwise.sources.writers import load_model, save_model

N = 200
SMALL = {"num_leaves": 5, "min_child_samples": 8, "learning_rate": 0.3}


def data():
    rng = np.random.default_rng(3)
    x = np.column_stack([rng.integers(0, 40, N), rng.integers(0, 9, N), np.full(N, 2)]).astype(float)
    g = rng.integers(0, 3, N)
    y = (x[:, 0] / 40 + 0.3 * (x[:, 1] > 4) - 0.2 * g + rng.normal(0, 0.3, N) > 0.4).astype(float)
    return x, g, y


@pytest.fixture(scope="module")
def frame(spark):
    x, g, y = data()
    rows = [(i, *map(float, x[i]), "abc"[g[i]], int(y[i]), "train" if i % 4 else "val") for i in range(N)]
    return spark.createDataFrame(rows, "row_id long, a double, b double, c double, g string, y int, split string").repartition(3).cache()


FEATURES = ["a", "b", "c"]


def grow(x, grad, hess, p):
    """Best-first growth by trying every split; returns leaf id and value per row."""
    leaf = np.zeros(len(x), int)
    done, count = set(), 1

    def best(rows):
        out = None
        for f in range(x.shape[1]):
            for t in np.unique(x[rows, f])[1:]:
                left = rows[x[rows, f] < t]
                right = rows[x[rows, f] >= t]
                if min(len(left), len(right)) < p["min_child_samples"]:
                    continue
                s = lambda r: grad[r].sum() ** 2 / hess[r].sum()
                gain = 0.5 * (s(left) + s(right) - s(rows))
                if gain > 1e-9 and (out is None or gain > out[0] + 1e-9):
                    out = (gain, left, right)
        return out

    while count < p["num_leaves"]:
        options = [(best(np.flatnonzero(leaf == i)), i) for i in range(count) if i not in done]
        options = [(o, i) for o, i in options if o is not None]
        if not options:
            break
        (gain, left, right), i = max(options, key=lambda o: o[0][0])
        leaf[right] = count
        count += 1
    value = np.zeros(len(x))
    for i in range(count):
        r = leaf == i
        value[r] = -grad[r].sum() / hess[r].sum() * p["learning_rate"]
    return value


def sig(m):
    return np.clip(1 / (1 + np.exp(-m)), 1e-7, 1 - 1e-7)


def reference(rounds, lam, mode, kind, eta=0.2):
    x, g, y = data()
    m, mu, sizes = np.zeros(N), np.full(3, lam / 3), np.bincount(g)
    mask = {"equalized_loss": np.ones(N, bool), "true_positive_rate": y == 1}[kind]
    history = []
    for _ in range(rounds):
        p = sig(m)
        loss = -(y * np.log(p) + (1 - y) * np.log(1 - p))
        group = np.array([loss[(g == k) & mask].mean() for k in range(3)])
        if mode == "optim":
            new = np.eye(3)[np.argmax(group > group.max() - 1e-9)] * lam
        else:
            new = simplex(mu + eta * lam * (group - group.max()), lam)
        scale = (N / sizes * mu)[g] * mask
        grad, hess = (1 - lam + scale) * (p - y), (1 - lam + scale) * p * (1 - p)
        history.append((group, new))
        m = m + grow(x, grad, hess, SMALL)
        mu = new
    return sig(m), history


def predictions(model, frame):
    return model.transform(frame).orderBy("row_id").toPandas()["p"].to_numpy()


@pytest.mark.parametrize("mode,kind", [("optim", "equalized_loss"), ("gradient_norm", "true_positive_rate")])
def test_matches_numpy(frame, mode, kind):
    est = B.MinMaxBoostClassifier(
        n_estimators=3, fair_weight=0.6, dual_learning=mode, fairness_constraint=kind, multiplier_learning_rate=0.2, min_child_weight=0.0, **SMALL
    )
    model = est.fit(frame, FEATURES)
    want, history = reference(3, 0.6, mode, kind)
    assert np.allclose(predictions(model, frame), want, atol=1e-8)
    for t, (loss, mu) in enumerate(history, 1):
        rows = model.info[model.info["round"] == t]
        assert np.allclose(rows["loss"], loss) and np.allclose(rows["mu"], mu)
        assert rows["mu"].sum() == pytest.approx(0.6)
        assert (rows["epsilon"] == rows["loss"].max()).all()


def test_without_fair_weight_it_is_the_plain_booster_from_zero(frame):
    plain = B.BoostClassifier(n_estimators=3, objective=lambda y, m, s: (logloss_grad(y, sigmoid(m)), logloss_hess(y, sigmoid(m))), **SMALL)
    fair = B.MinMaxBoostClassifier(n_estimators=3, fair_weight=0.0, **SMALL)
    a, b = plain.fit(frame, FEATURES), fair.fit(frame, FEATURES)
    assert a.init == b.init == 0.0
    assert np.allclose(predictions(a, frame), predictions(b, frame))


def test_executor_side_splits_agree(frame, monkeypatch):
    settings = dict(n_estimators=2, reg_alpha=0.5, reg_lambda=1.0, **SMALL)
    near = B.MinMaxBoostClassifier(**settings).fit(frame, FEATURES)
    monkeypatch.setattr(B, "HISTOGRAM_CELLS", 0)
    far = B.MinMaxBoostClassifier(**settings).fit(frame, FEATURES)
    assert near.trees and [t.feature for t in near.trees] == [t.feature for t in far.trees]
    assert [t.left for t in near.trees] == [t.left for t in far.trees]
    assert np.allclose(predictions(near, frame), predictions(far, frame))


def test_a_tree_takes_one_job_per_level(spark, frame, monkeypatch):
    """The group losses come with the root, so no level needs a second pass."""
    prepared = B.prepare(frame, FEATURES)
    levels, passes = [], []
    histograms = B.histograms
    monkeypatch.setattr(B, "histograms", lambda *a: passes.append(a) or histograms(*a))
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # each stage is a job of its own otherwise
    try:
        for rounds in (1, 3):
            spark.sparkContext.setJobGroup(f"trees{rounds}", "")
            est = B.MinMaxBoostClassifier(n_estimators=rounds, min_child_weight=0.0, **SMALL)
            passes.clear()
            est.fit(frame, FEATURES, binned=prepared)
            levels.append((len(passes), len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"trees{rounds}"))))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        prepared.unpersist()
    assert all(jobs == passes for passes, jobs in levels) and levels[0][0] < levels[1][0]


def test_boosters_grown_together_are_those_grown_alone(frame, monkeypatch):
    """Different sizes, objectives and feature draws; together they take the passes of the longest one."""
    prepared = B.prepare(frame, FEATURES)
    passes, histograms = [], B.histograms
    monkeypatch.setattr(B, "histograms", lambda *a: passes.append(a) or histograms(*a))
    make = lambda: [
        B.MinMaxBoostClassifier(n_estimators=2, fair_weight=0.7, **SMALL), B.MinMaxBoostClassifier(n_estimators=4, dual_learning="gradient_norm", **SMALL),
        B.BoostClassifier(n_estimators=3, colsample_bytree=0.5, num_leaves=3, min_child_samples=5), B.BoostClassifier(n_estimators=2, min_child_samples=150),
    ]
    alone, counts = [], []
    for est in make():
        passes.clear()
        alone.append(est.fit(frame, FEATURES, binned=prepared))
        counts.append(len(passes))
    passes.clear()
    together = B.boost_together(make(), prepared)
    assert [m.trees for m in together] == [m.trees for m in alone] or all(
        np.allclose(predictions(a, frame), predictions(b, frame)) for a, b in zip(alone, together)
    )
    assert len(passes) < sum(counts) and not together[3].trees
    for a, b in zip(alone[:2], together[:2]):
        assert np.allclose(a.info[["loss", "mu"]], b.info[["loss", "mu"]])
    prepared.unpersist()


def test_long_fit_cuts_lineage_and_stops(frame):
    """More rounds than two lineage cuts, ended by patience."""
    train, valid = frame.where("split = 'train'"), frame.where("split = 'val'")
    est = B.BoostClassifier(n_estimators=60, early_stopping_rounds=4, checkpoint_every=3, **SMALL)
    model = est.fit(train, FEATURES, valid=valid)
    whole = B.BoostClassifier(n_estimators=60, early_stopping_rounds=4, checkpoint_every=1000, **SMALL).fit(train, FEATURES, valid=valid)
    assert 1 <= len(model.trees) < 56 and np.allclose(predictions(model, frame), predictions(whole, frame))


def test_lineage_cuts_do_not_change_the_model(frame):
    a = B.BoostClassifier(n_estimators=3, **SMALL).fit(frame, FEATURES)
    b = B.BoostClassifier(n_estimators=3, checkpoint_every=1, **SMALL).fit(frame.repartition(11), FEATURES)
    assert np.allclose(predictions(a, frame), predictions(b, frame))


def test_training_loss_falls_and_stages_add_up(spark, frame, tmp_path):
    model = B.BoostClassifier(n_estimators=4, **SMALL).fit(frame, FEATURES)
    assert model.init == pytest.approx(np.log(data()[2].mean() / (1 - data()[2].mean())))
    table = convergence(model, frame, [1, 2, 3, 4]).toPandas()
    overall = table[table["g"].isna()].groupby("iter")["acc"].count()
    assert overall.tolist() == [2, 2, 2, 2]
    losses = table[table["g"].isna() & (table["split"] == "train")].sort_values("iter")["logloss"]
    assert (np.diff(losses) < 0).all()
    staged = model.staged(frame, [4, 2]).where("iter = 4").orderBy("row_id").toPandas()
    assert np.allclose(staged["p"], predictions(model, frame))
    late = model.transform(frame, start=2, num=2, p="q").select("row_id", "q")
    early = model.transform(frame, num=2).join(late, "row_id").orderBy("row_id").toPandas()
    logit = lambda p: np.log(p / (1 - p))
    assert np.allclose(logit(early["p"]) + logit(early["q"]), logit(predictions(model, frame)))
    save_model(model, str(tmp_path / "m"))
    back = load_model(spark, str(tmp_path / "m"))
    assert np.allclose(predictions(back, frame), predictions(model, frame))


def test_regressors(frame):
    t = frame.withColumn("y", F.col("a") * 2 + F.when(F.col("g") == "a", 30).otherwise(0))
    plain = B.BoostRegressor(n_estimators=5, **SMALL).fit(t, FEATURES)
    fair = B.MinMaxBoostRegressor(n_estimators=5, dual_learning="optim", fair_weight=0.5, **SMALL).fit(t, FEATURES)
    err = lambda m: m.transform(t).agg(F.avg((F.col("y") - F.col("p")) ** 2)).first()[0]
    spread = t.agg(F.var_pop("y")).first()[0]
    assert err(plain) < 0.5 * spread
    assert plain.init == pytest.approx(t.agg(F.avg("y")).first()[0]) and fair.init == 0.0
    assert fair.info.groupby("round")["mu"].sum().tolist() == pytest.approx([0.5] * 5)
    with pytest.raises(ValueError):
        B.MinMaxBoostRegressor(fairness_constraint="true_positive_rate").fit(t, FEATURES)


def test_early_stopping_keeps_the_best_round(frame):
    train, valid = frame.where("split = 'train'"), frame.where("split = 'val'")
    seen = iter([3.0, 2.0, 2.5, 2.5, 2.5, 2.5])
    est = B.BoostClassifier(n_estimators=6, early_stopping_rounds=2, metric=lambda f: next(seen), **SMALL)
    assert len(est.fit(train, FEATURES, valid=valid).trees) == 2


def test_limits(frame):
    model = B.BoostClassifier(n_estimators=1, num_leaves=31, max_depth=1, min_child_samples=1).fit(frame, FEATURES)
    assert sum(f < 0 for f in model.trees[0].feature) == 2
    model = B.BoostClassifier(n_estimators=2, colsample_bytree=0.5, num_leaves=4).fit(frame, FEATURES)
    assert all(len({f for f in t.feature if f >= 0}) == 1 for t in model.trees)
    assert not B.BoostClassifier(n_estimators=2, min_child_samples=150).fit(frame, FEATURES).trees
    for wrong in ({"dual_learning": "fixed"}, {"fairness_constraint": "none"}, {"fair_weight": 2.0}):
        with pytest.raises(ValueError):
            B.MinMaxBoostClassifier(**wrong).fit(frame, FEATURES)


def test_missing_values_go_right(spark, frame):
    t = frame.withColumn("a", F.when(F.col("row_id") % 5 == 0, None).otherwise(F.col("a")))
    model = B.BoostClassifier(n_estimators=2, **SMALL).fit(t, FEATURES)
    assert not np.isnan(predictions(model, t)).any()


def test_trials_share_one_table(frame):
    params = [{"n_estimators": 1}, {"n_estimators": 2}]
    results, trials, models = run_trials(lambda p: B.BoostClassifier(**p, **SMALL), params, frame, FEATURES, models_per_pass=1)
    together, _, _ = run_trials(lambda p: B.BoostClassifier(**p, **SMALL), params, frame, FEATURES)
    key = lambda d: sorted((r["model"], r["split"], round(r["logloss"], 9), round(r["eod"], 9)) for r in d.collect())
    assert key(results) == key(together)
    assert {(r["model"], r["split"]) for r in results.collect()} == {(m, s) for m in (0, 1) for s in ("train", "val")}
    assert results.where("duration is null").isEmpty() and trials.count() == 2
    assert [len(models[i].trees) for i in (0, 1)] == [1, 2]
