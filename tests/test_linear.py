"""Weighted learners, games and the weight search against numpy."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from groupwise.learners import adaptive as A
from groupwise.learners import game as G
from groupwise.learners.linear import LinearLearner, LogisticLearner, PairedLearner, learner
from groupwise.operators.history import trajectory
from groupwise.operators.metrics import group_logloss
from groupwise.sources.writers import load_model, save_model

N = 300
X = ["a", "b"]


def data():
    rng = np.random.default_rng(7)
    x = rng.normal(size=(N, 2))
    g, h = rng.integers(0, 3, N), rng.integers(0, 2, N)
    y = (x[:, 0] + 0.5 * x[:, 1] - 0.6 * g + rng.normal(0, 0.8, N) > -0.4).astype(int)
    return pd.DataFrame({"row_id": range(N), "a": x[:, 0], "b": x[:, 1], "g": g, "h": h, "y": y, "w": rng.uniform(0.2, 2, N), "z": 3 * x[:, 0] - x[:, 1] + 2 * g})


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame(data()).repartition(4).cache()


def newton(x, y, w, c):
    """Logistic regression with an unpenalised intercept: c * sum(w * loss) + |coef|^2 / 2."""
    d = np.column_stack([x, np.ones(len(x))])
    b, ridge = np.zeros(d.shape[1]), np.diag([1.0] * x.shape[1] + [0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-d @ b))
        grad = c * d.T @ (w * (p - y)) + ridge @ b
        hess = c * (d * (w * p * (1 - p))[:, None]).T @ d + ridge
        b = b - np.linalg.solve(hess, grad)
    return b


def ridge(x, y, w, alpha):
    d = np.column_stack([x, np.ones(len(x))])
    a = (d * w[:, None]).T @ d + np.diag([alpha] * x.shape[1] + [0.0])
    return np.linalg.solve(a, d.T @ (w * y))


@pytest.mark.parametrize("balanced", [False, True])
@pytest.mark.parametrize("c", [0.01, 10.0])
def test_logistic(frame, balanced, c):
    p = data()
    w = p["w"].to_numpy()
    if balanced:
        w = w * np.where(p["y"] == 1, N / (2 * p["y"].sum()), N / (2 * (1 - p["y"]).sum()))
    want = newton(p[X].to_numpy(), p["y"].to_numpy(), w, c)
    got = LogisticLearner(C=c, balanced=balanced, tol=1e-10).fit(frame, X, "y", "w")
    assert np.allclose([*got.coef, got.intercept], want, atol=1e-4)


@pytest.mark.parametrize("alpha", [0.0, 5.0, 200.0])
def test_linear(frame, alpha):
    p = data()
    want = ridge(p[X].to_numpy(), p["z"].to_numpy(), p["w"].to_numpy(), alpha)
    got = LinearLearner(alpha=alpha).fit(frame, X, "z", "w")
    assert np.allclose([*got.coef, got.intercept], want, atol=1e-6)


def test_paired(frame):
    p = data()
    x, y, w = p[X].to_numpy(), p["y"].to_numpy(), p["w"].to_numpy()
    one = np.ones(N)
    diff = ridge(x, y * w, one, 0.0) - ridge(x, (1 - y) * w, one, 0.0)
    model = PairedLearner().fit(frame, X, "y", "w")
    got = model.transform(frame).orderBy("row_id").toPandas()["pred"]
    assert (got == (np.column_stack([x, one]) @ diff > 0)).all()


def test_names():
    assert learner("ridge").alpha == 1.0 and learner("linear").alpha == 0.0
    assert isinstance(learner("logistic"), LogisticLearner) and isinstance(learner("paired"), PairedLearner)
    with pytest.raises(ValueError):
        learner("perceptron")


def play_linear(rounds, a, b):
    """Exponential weights over least-squares fits."""
    p = data()
    x, y, g = p[X].to_numpy(), p["z"].to_numpy(), p["g"].to_numpy()
    n = np.bincount(g)
    w, row, out = n / N, np.full(N, 1 / N), []
    for t in range(1, rounds + 1):
        coef = ridge(x, y, row, 0.0)
        err = (y - np.column_stack([x, np.ones(N)]) @ coef) ** 2
        group = np.array([err[g == k].mean() for k in range(3)])
        w = w * np.exp(a * t**-b * group)
        w = w / w.sum()
        row = (w / n)[g]
        out.append((group, w, err.mean()))
    return out


def test_minimax_game_on_regression(frame):
    result = G.MinimaxGame(LinearLearner(), rounds=5, a=0.3, b=0.5).fit(frame, X, "z")
    got = result.history.toPandas()
    assert result.rounds == 5
    for t, (group, w, pop) in enumerate(play_linear(5, 0.3, 0.5), 1):
        rows = got[got["round"] == t].sort_values("g")
        assert np.allclose(rows["err"], group, atol=1e-6) and np.allclose(rows["weight"], w, atol=1e-6)
        assert np.allclose(rows["pop_err"], pop, atol=1e-6)
    path = trajectory(result.errors()).orderBy("round").toPandas()
    errs = np.array([g for g, _, _ in play_linear(5, 0.3, 0.5)])
    mixed = errs.cumsum(axis=0) / np.arange(1, 6)[:, None]
    assert np.allclose(path["max_group_err"], mixed.max(axis=1), atol=1e-6)


def test_one_group_is_the_plain_learner(frame):
    t = frame.withColumn("g", F.lit(0))
    result = G.MinimaxGame(LinearLearner(), rounds=10).fit(t, X, "z")
    plain = LinearLearner().fit(t, X, "z")
    assert result.rounds == 3  # no weight moves, so the fourth round is not played
    assert all(np.allclose(m.coef, plain.coef) for m in result.model.members)


def test_relaxed_game_with_false_negatives(frame):
    game = G.MinimaxGame(LogisticLearner(), mode="relaxed", rounds=2, gamma=0.05, a=1.0, b=0.5, error_type="FN")
    result = game.fit(frame, X, "y", ["g", "h"], valid=frame.where("row_id < 100"))
    got = result.history.toPandas()
    p = data()
    first = LogisticLearner().fit(frame.withColumn("one", F.lit(1.0 / N)), X, "y", "one").transform(frame).orderBy("row_id").toPandas()
    fn = (first["y"] == 1) & (first["pred"] == 0)
    for column in ("g", "h"):
        rows = got[(got["round"] == 1) & (got["group_type"] == column) & (got["error_type"] == "FN")].sort_values("g")
        want = [fn[p[column] == k].sum() / p["y"][p[column] == k].sum() for k in sorted(p[column].unique())]
        assert np.allclose(rows["err"], want)
        assert np.allclose(rows["lam"], np.maximum(0, np.array(want) - 0.05))
        assert np.allclose(rows["pop_err"], (first["y"] != first["pred"]).mean())
    assert set(got["error_type"]) == {"FN", "0/1 Loss"}
    assert result.pop_error == "0/1 Loss" and not result.valid_history.isEmpty()


def test_equal_error_weights_stay_positive(frame):
    result = G.MinimaxGame(LogisticLearner(), mode="equal", rounds=3, a=5.0).fit(frame, X)
    got = result.history.toPandas()
    assert result.rounds == 3 and got["err"].between(0, 1).all()


def test_sweep_trades_errors(frame):
    sweep = G.gamma_sweep(G.MinimaxGame(LinearLearner(), rounds=6, a=0.3), frame, X, "z", n=3).toPandas().sort_values("gamma")
    assert len(sweep) == 4 and sweep["gamma"].is_monotonic_increasing  # three increments with both ends
    assert np.allclose(np.diff(sweep["gamma"]), np.diff(sweep["gamma"])[0])
    assert (sweep["pop_err"] <= sweep["max_group_err"] + 1e-9).all()
    capped = G.gamma_sweep(G.MinimaxGame(LinearLearner(), rounds=6, a=0.3), frame, X, "z", n=3, cap=sweep["gamma"].iloc[1] + 1e-9)
    assert capped.count() == 2


def test_sweep_ranges_by_error_kind(frame):
    """FN kinds start at 0 and end at the worst error of one round; an equal-error game gives one value; a validation part adds its curve."""
    game = G.MinimaxGame(LogisticLearner(), rounds=3, error_type="FN")
    low, high = G.gamma_range(game, frame, X, "y", ["g"])
    one = G.MinimaxGame(LogisticLearner(), rounds=1, error_type="FN").fit(frame, X).history.where("error_type = 'FN'").toPandas()
    assert low == 0 and high == pytest.approx(one["err"].max())
    sweep = G.gamma_sweep(game, frame.where("row_id < 200"), X, n=2, valid=frame.where("row_id >= 200")).toPandas()
    assert len(sweep) == 3 and sweep["valid_max_group_err"].between(0, 1).all() and sweep["gamma"].min() == 0
    equal = G.gamma_sweep(G.MinimaxGame(PairedLearner(), mode="equal", rounds=2, error_type="FP"), frame, X, n=5)
    assert equal.count() == 1


def test_a_sweep_reads_its_rows_no_oftener_than_one_game(frame, monkeypatch):
    from groupwise.learners import cells

    passes = []
    look, gram = cells.look, cells.gram
    monkeypatch.setattr(cells, "look", lambda c, asked, *a: passes.append(len(asked)) or look(c, asked, *a))
    monkeypatch.setattr(cells, "gram", lambda *a: passes.append(0) or gram(*a))
    G.gamma_sweep(G.MinimaxGame(LinearLearner(), rounds=6, a=0.3), frame, X, "z", n=5)
    assert passes == [0, 0]  # one for the range, one for all six games
    passes.clear()
    game = G.MinimaxGame(LogisticLearner(), mode="relaxed", rounds=3, error_type="Log-Loss")
    table = cells.cells_of(frame, X, "y", ["g"], True)
    alone = []
    for gamma in (0.3, 0.5):
        passes.clear()
        single = G.fit_games([G.replace(game, gamma=gamma)], frame, X, cells=table)[0]
        alone.append((len(passes), single.model))
    passes.clear()
    both = G.fit_games([G.replace(game, gamma=gamma) for gamma in (0.3, 0.5)], frame, X, cells=table)
    assert len(passes) == max(n for n, _ in alone) and passes[0] == 2
    for (_, want), got in zip(alone, both):
        assert all(np.allclose(a.coef, b.coef) for a, b in zip(want.members, got.model.members))
    table.unpersist()


class Slow:
    """A learner outside the package: every round is a weighted fit."""

    def __init__(self, inner):
        self.inner, self.regression, self.has_probability = inner, isinstance(inner, LinearLearner), isinstance(inner, LogisticLearner)

    def fit(self, *args):
        return self.inner.fit(*args)


@pytest.mark.parametrize("inner,kind,y,mode", [
    (LinearLearner(alpha=2.0), "MSE", "z", "relaxed"), (PairedLearner(), "0/1 Loss", "y", "minimax"), (PairedLearner(fit_intercept=False), "FP", "y", "relaxed"),
    (LogisticLearner(tol=1e-12, C=5.0), "Log-Loss", "y", "minimax"), (LogisticLearner(tol=1e-12, penalty="none", balanced=False), "FN-Log-Loss", "y", "relaxed"),
    (LinearLearner(fit_intercept=False), "MSE", "z", "minimax"),
])
def test_cells_agree_with_weighted_fits(frame, inner, kind, y, mode):
    """Sums per cell give the histories of a game that fits weighted rows, with several group types and a validation part."""
    settings = dict(mode=mode, rounds=3, error_type=kind, gamma=0.2, a=0.4)
    groups, valid = ["g", "h"], frame.where("row_id < 120")
    fast = G.MinimaxGame(inner, **settings).fit(frame, X, y, groups, valid)
    slow = G.MinimaxGame(Slow(inner), **settings).fit(frame, X, y, groups, valid)
    key = ["round", "group_type", "g", "error_type"]
    for a, b in ((fast.history, slow.history), (fast.valid_history, slow.valid_history)):
        p, q = (t.toPandas().sort_values(key).reset_index(drop=True) for t in (a, b))
        assert p[key].equals(q[key]) and (p["n"] == q["n"]).all()
        for c in ("err", "pop_err", "weight", "lam"):
            assert np.allclose(p[c].astype(float), q[c].astype(float), atol=2e-4), c


def test_guards(frame):
    for game in (
        G.MinimaxGame(PairedLearner(), error_type="Log-Loss"), G.MinimaxGame(PairedLearner(), extra_error_types=("FN-Log-Loss",)), G.MinimaxGame(LinearLearner(), mode="equal"),
        G.MinimaxGame(error_type="other"), G.MinimaxGame(PairedLearner(), penalize_errors=True),
    ):
        with pytest.raises(ValueError):
            game.fit(frame, X, "z" if game.regression else "y")
    with pytest.raises(ValueError):
        LogisticLearner(penalty="elastic")
    with pytest.raises(ValueError):
        G.fit_games([G.MinimaxGame(LogisticLearner()), G.MinimaxGame(LinearLearner())], frame, X)


def test_sparse_and_unpenalised_logistic(frame):
    """Optimality conditions of the l1 fit, by both solvers; zero gradient without a penalty."""
    p = data()
    x, y = np.column_stack([p[X].to_numpy(), np.ones(N)]), p["y"].to_numpy()

    def gradient(m):
        return x.T @ (1 / (1 + np.exp(-x @ np.append(m.coef, m.intercept))) - y)

    for c in (0.02, 0.5):
        plain = LogisticLearner(C=c, penalty="l1", balanced=False, tol=1e-12).fit(frame, X, "y")
        # the game's weights sum to one, so its penalty counts N times as much
        game = G.MinimaxGame(LogisticLearner(C=c * N, penalty="l1", balanced=False), rounds=1, error_type="Log-Loss").fit(frame, X).model.members[0]
        for m, atol in ((plain, 1e-2), (game, 1e-5)):
            g = gradient(m)
            assert abs(g[-1]) < atol * 10
            for j, w in enumerate(m.coef):
                assert abs(g[j] + np.sign(w) / c) < atol / c if abs(w) > 1e-9 else abs(g[j]) <= (1 + atol) / c
    assert all(w == 0 for w in G.MinimaxGame(LogisticLearner(C=1e-3, penalty="l1"), rounds=1).fit(frame, X).model.members[0].coef)
    free = LogisticLearner(penalty="none", balanced=False, tol=1e-12).fit(frame, X, "y")
    assert np.abs(gradient(free)).max() < 1e-2


def test_penalty_in_the_log_loss(frame):
    plain = G.MinimaxGame(LogisticLearner(C=2.0), rounds=1, error_type="Log-Loss").fit(frame, X)
    more = G.MinimaxGame(LogisticLearner(C=2.0), rounds=1, error_type="Log-Loss", penalize_errors=True).fit(frame, X)
    added = 0.5 * np.square(more.model.members[0].coef).sum() / 2.0
    a, b = (r.history.orderBy("g").toPandas() for r in (plain, more))
    assert np.allclose(b["err"] - a["err"], added) and np.allclose(b["pop_err"] - a["pop_err"], added)


def test_mixture_prediction(spark, frame, tmp_path):
    result = G.MixtureClassifier(n_estimators=3, gamma=0.5).fit(frame, X)
    model = result.model
    members = np.array([m.transform(frame).orderBy("row_id").toPandas()["p"].to_numpy() for m in model.members])
    mean = model.transform(frame).orderBy("row_id").toPandas()["p"].to_numpy()
    assert np.allclose(mean, members.mean(axis=0))
    drawn = model.transform(frame, "sample", "row_id", seed=3).orderBy("row_id").toPandas()["p"].to_numpy()
    assert np.isclose(members, drawn).any(axis=0).all() and len(np.unique(np.isclose(members, drawn).argmax(axis=0))) == 3
    with pytest.raises(ValueError):
        model.transform(frame, "sample")
    save_model(model, str(tmp_path / "mix"))
    assert load_model(spark, str(tmp_path / "mix")) == model
    single = model.members[0]
    save_model(single, str(tmp_path / "one"))
    assert load_model(spark, str(tmp_path / "one")) == single


def test_many_members_are_one_matrix(spark):
    """2,000 members of 100 features: the plan is made at once and holds no coefficient."""
    import time

    from groupwise.learners.linear import LinearModel
    from groupwise.learners.mixture import MixtureModel, score_linear

    rng = np.random.default_rng(2)
    names = tuple(f"f{i}" for i in range(100))
    members = tuple(LinearModel("logistic", names, tuple(w[1:].tolist()), float(w[0])) for w in rng.normal(size=(2000, 101)))
    x = rng.normal(size=(50, 100))
    df = spark.createDataFrame(pd.DataFrame(x, columns=list(names)).assign(row_id=range(50)))
    model = MixtureModel(members)
    MixtureModel(members[:2]).transform(df)._jdf.queryExecution().toString()  # start-up is not planning
    began = time.perf_counter()
    scored = model.transform(df)
    text = scored._jdf.queryExecution().toString()
    assert time.perf_counter() - began < 1.5 and len(text) < 100_000
    w = np.array([[m.intercept, *m.coef] for m in members])
    each = 1 / (1 + np.exp(-(x @ w[:, 1:].T + w[:, 0])))
    assert np.allclose(scored.orderBy("row_id").toPandas()["p"], each.mean(1))
    long = score_linear(df.select("row_id", *names), {3: model, 7: members[5]}).toPandas().sort_values(["model", "row_id"])
    assert np.allclose(long["score"], np.concatenate([each.mean(1), each[:, 5]]))
    gone = model.transform(df.withColumn("f3", F.lit(None).cast("double"))).first()
    assert gone["p"] is None and gone["pred"] is None


def test_trials_of_all_families(frame):
    from groupwise.learners.experiments import run_trials

    t = frame.withColumn("split", F.when(F.col("row_id") % 4 == 0, "test").otherwise("train"))
    makers = [lambda: LogisticLearner(), lambda: G.MinimaxGame(LogisticLearner(), rounds=2, error_type="Log-Loss"), lambda: G.MixtureClassifier(n_estimators=2), lambda: A.AdaptiveClassifier(n_iterations=1)]
    results, trials, models = run_trials(lambda p: makers[p["i"]](), [{"i": i} for i in range(4)], t, X)
    got = results.toPandas().set_index(["model", "split"])
    assert set(got.index) == {(m, s) for m in range(4) for s in ("train", "test")} and trials.count() == 4
    plain = LogisticLearner().fit(t.where("split = 'train'"), X, "y").transform(t.where("split = 'test'")).toPandas()
    assert got.loc[(0, "test"), "acc"] == pytest.approx((plain["y"] == plain["pred"]).mean())
    worst = plain.assign(hit=plain["y"] == plain["pred"]).groupby("g")["hit"].mean()
    assert got.loc[(0, "test"), "min_acc"] == pytest.approx(worst.min())
    makers = [lambda: LinearLearner(), lambda: G.MixtureRegressor(n_estimators=2)]
    results, _, models = run_trials(lambda p: makers[p["i"]](), [{"i": i} for i in range(2)], t.drop("y").withColumnRenamed("z", "y"), X)
    got = results.toPandas().set_index(["model", "split"])
    test = models[1].transform(t.where("split = 'test'")).toPandas()
    by = ((test["z"] - test["p"]) ** 2).groupby(test["g"]).mean()
    assert got.loc[(1, "test"), "max_mse"] == pytest.approx(by.max()) and got.loc[(1, "test"), "mse_g=2"] == pytest.approx(by[2])
    assert got.loc[(1, "test"), "ratio_g=2"] == pytest.approx(len(test) / (test["g"] == 2).sum())


def test_mixture_regressor(frame):
    result = G.MixtureRegressor(n_estimators=2, gamma=0.0, C=1.0).fit(frame, X, "z")
    assert result.main_error == "MSE" and len(result.model.members) == 2


def test_weight_search_on_known_risks():
    """Two groups with opposite optima: the risk is quadratic around the weighted centre."""
    centre, scale = np.array([0.0, 1.0]), np.array([1.0, 4.0])

    def oracle(mu):
        best = (mu * scale * centre).sum() / (mu * scale).sum()
        return scale * (best - centre) ** 2

    start = np.array([0.5, 0.5])
    found = A.adaptive_weights(oracle, start, niter=200, patience=50)
    # equal risks at best = 2/3
    assert found.risk.max() == pytest.approx(4 / 9, abs=5e-3)
    assert found.risk.max() <= oracle(start).max()
    assert found.mu.sum() == pytest.approx(1.0)
    assert (found.history["best_risk"].diff().dropna() <= 0).all()


def test_domination_flag():
    risks = iter([[1.0, 2.0], [0.9, 2.5], [1.0004, 2.6], [0.5, 0.5]])
    found = A.adaptive_weights(lambda mu: np.array(next(risks)), np.array([0.5, 0.5]), niter=3, risk_digits=3)
    assert found.history["dominated"].tolist() == [False, False, True, False]
    assert found.history["improved"].tolist() == [True, False, False, True]


def test_adaptive_classifier(frame):
    est = A.AdaptiveClassifier(n_iterations=4)
    model = est.fit(frame, X)
    naive, risk = A.fit_weighted(frame, X, "naive")
    assert est.info.risk.max() <= risk.max() + 1e-9
    worst = group_logloss(model.transform(frame), "equalized_loss", score="p").agg(F.max("loss")).first()[0]
    assert worst == pytest.approx(est.info.risk.max(), abs=1e-6)


def test_balanced_scheme():
    mu = A.scheme_weights(np.array([0.75, 0.25]), "balanced")
    assert mu == pytest.approx(np.array([1 / 0.751, 1 / 0.251]) / (1 / 0.751 + 1 / 0.251))
    with pytest.raises(ValueError):
        A.scheme_weights(np.array([1.0]), "other")


def test_the_stop_compares_row_weights_at_every_size(spark, monkeypatch):
    """Two group types: the threshold lies between the largest move of a row weight and that of a type's weights."""
    from groupwise import lookup

    rng = np.random.default_rng(4)
    t = pd.DataFrame({"x0": rng.normal(size=300), "g": rng.choice(list("abc"), 300), "h": rng.choice(list("uvw"), 300)})
    t["y"] = (t["x0"] + rng.normal(size=300) * t["g"].map({"a": 0.1, "b": 1.0, "c": 3.0}) > 0).astype(float)
    frame, groups = spark.createDataFrame(t), ["g", "h"]
    game = dict(rounds=5, a=0.5, error_type="Log-Loss")
    log = G.MinimaxGame(LogisticLearner(), **game).fit(frame, ["x0"], groups=groups).history.where("error_type = 'Log-Loss'").toPandas()
    log["row_weight"] = log["weight"] / log["n"]
    w = log.set_index(["group_type", "g", "round"])["row_weight"]
    moves = {c: {g: w[c, g, 3] - w[c, g, 2] for g in t[c].unique()} for c in groups}
    row = max(abs(moves["g"][a] + moves["h"][b]) / 2 for a, b in set(zip(t["g"], t["h"])))
    assert row < (most := max(abs(m) for c in groups for m in moves[c].values()))
    for bound in (lookup.LOOKUP_ROWS, 8):
        monkeypatch.setattr(lookup, "LOOKUP_ROWS", bound)
        assert G.MinimaxGame(LogisticLearner(), threshold=(row + most) / 2, **game).fit(frame, ["x0"], groups=groups).rounds == 3
