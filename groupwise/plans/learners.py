"""Queries that train on the given tables. Iterative fits have no SQL form; the tests check them against small references.

The steps inside a fit do have one: group losses, gradients and histograms of a boosting round.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.hashing import unit
from ..learners import adaptive as A
from ..learners import boosting as B
from ..learners import experiments as E
from ..learners import game as G
from ..learners.linear import LinearLearner, LogisticLearner, PairedLearner
from ..lookup import pin
from ..operators.history import trajectory
from ..sources.writers import load_model, save_model
from .bindings import REGRESSION, SCORED, regression_orders, scored_orders
from .registry import big, query, r, r6
from .sources import fresh

FEATURES = ["o_totalprice", "c_acctbal"]
LINEAR = ["price", "balance"]


def _frame(spark, sf):
    """Scored orders with features of order one for the linear learners and a hash split."""
    u = unit("s", "row_id")
    t = scored_orders(spark, sf).withColumns({"price": F.col("o_totalprice") / 100000, "balance": F.col("c_acctbal") / 10000})
    return t.withColumn("split", F.when(u < 0.6, F.lit("train")).when(u < 0.8, F.lit("val")).otherwise(F.lit("test")))


def _regression(spark, sf):
    t = regression_orders(spark, sf)
    return t.withColumns({"price": F.col("o_totalprice") / 100000, "balance": F.col("c_acctbal") / 10000, "y": F.col("y") / 100})


# ---- games unrolled in SQL: one group of statements per round, for all games (k) side by side ---------------------------------

_REG_ROWS = """rows_ AS MATERIALIZED (SELECT g, o_totalprice / 100000 AS x1, c_acctbal / 10000 AS x2, y / 100 AS y, count(*) OVER (PARTITION BY g) AS n,
  count(*) OVER () AS total FROM reg)"""


def _least_squares_rounds(tag: str, rounds: int, update, a: str, games: str = "SELECT 0 AS k, 0.0::DOUBLE AS gamma") -> list[str]:
    """Weighted least squares with two features and an intercept; ``update`` maps a step size to the next ``(w, lam)``."""
    w0 = "SELECT DISTINCT k, gamma, g, n / total::DOUBLE AS w, 0.0::DOUBLE AS lam, n, total FROM rows_ CROSS JOIN games"
    out = [f"{tag}w0 AS MATERIALIZED ({w0.replace('games', f'({games})')})"]
    for t in range(1, rounds + 1):
        eta = f"({a} * {t}::DOUBLE ** -0.5)"
        w, lam = update(eta)
        d = "(y - b0 - b1 * x1 - b2 * x2)"
        out += [
            f"{tag}a{t} AS MATERIALIZED (SELECT k, sum(q * x1) / sum(q) AS m1, sum(q * x2) / sum(q) AS m2, sum(q * y) / sum(q) AS my FROM"
            f" (SELECT k, w.w / r.n AS q, x1, x2, y FROM rows_ r JOIN {tag}w{t - 1} w USING (g)) GROUP BY k)",
            f"{tag}c{t} AS MATERIALIZED (SELECT k, m1, m2, my, sum(q * (x1 - m1) ** 2) AS s11, sum(q * (x2 - m2) ** 2) AS s22, sum(q * (x1 - m1) * (x2 - m2)) AS s12,"
            f" sum(q * (x1 - m1) * (y - my)) AS s1, sum(q * (x2 - m2) * (y - my)) AS s2 FROM"
            f" (SELECT k, w.w / r.n AS q, x1, x2, y FROM rows_ r JOIN {tag}w{t - 1} w USING (g)) JOIN {tag}a{t} USING (k) GROUP BY k, m1, m2, my)",
            f"{tag}b{t} AS MATERIALIZED (SELECT *, my - b1 * m1 - b2 * m2 AS b0 FROM (SELECT *, (s1 * s22 - s2 * s12) / (s11 * s22 - s12 ** 2) AS b1,"
            f" (s2 * s11 - s1 * s12) / (s11 * s22 - s12 ** 2) AS b2 FROM {tag}c{t}))",
            f"{tag}e{t} AS MATERIALIZED (SELECT k, g, avg({d} ** 2) AS err FROM rows_ CROSS JOIN {tag}b{t} GROUP BY k, g)",
            f"{tag}w{t} AS MATERIALIZED (SELECT k, gamma, g, {w} AS w, {lam} AS lam, n, total, e.err, sum(e.err * n) OVER (PARTITION BY k) / total AS pop"
            f" FROM {tag}w{t - 1} w JOIN {tag}e{t} e USING (k, g))",
        ]
    union = " UNION ALL ".join(f"SELECT {t} AS t, k, gamma, g, w, lam, n, err, pop FROM {tag}w{t}" for t in range(1, rounds + 1))
    return [*out, f"{tag}log AS MATERIALIZED ({union})"]


def _minimax(eta: str) -> tuple[str, str]:
    return f"w.w * exp({eta} * e.err) / sum(w.w * exp({eta} * e.err)) OVER (PARTITION BY k)", "w.lam"


def _relaxed(eta: str) -> tuple[str, str]:
    lam = f"greatest(0.0, w.lam + {eta} * (e.err - gamma))"
    return f"n / total::DOUBLE + {lam}", lam


def _mixture_path(tag: str) -> str:
    """``(k, t, mix_err, mix_pop)``: worst group and population error of the mixture after every round."""
    run = "ORDER BY t ROWS UNBOUNDED PRECEDING"
    return (
        f"{tag}path AS MATERIALIZED (SELECT k, gamma, t, max(m) AS mix_err, max(p) AS mix_pop FROM (SELECT k, gamma, t, avg(err) OVER (PARTITION BY k, g {run}) AS m,"
        f" avg(pop) OVER (PARTITION BY k, g {run}) AS p FROM {tag}log) GROUP BY k, gamma, t)"
    )


_TOP = "(1.0 / (SELECT max(abs(y)) FROM rows_) ** 2)"
GAME_LINEAR_SQL = "WITH " + REGRESSION + ",\n" + ",\n".join([_REG_ROWS, *_least_squares_rounds("g", 4, _minimax, _TOP)]) + f"""
SELECT CAST(t AS INT) AS round, 'g' AS group_type, g, 'MSE' AS error_type, {r('err', 'err')}, CAST(n AS BIGINT) AS n, {r('pop', 'pop_err')},
  {r('w', 'weight')}, {r('lam', 'lam')} FROM glog"""

SWEEP_STEPS, SWEEP_ROUNDS = 3, 3
GAME_SWEEP_SQL = "WITH " + REGRESSION + ",\n" + ",\n".join([
    _REG_ROWS,
    *_least_squares_rounds("m", SWEEP_ROUNDS, _minimax, "0.05"),
    _mixture_path("m"),
    f"range_ AS MATERIALIZED (SELECT (SELECT mix_err FROM mpath ORDER BY t DESC LIMIT 1) AS low, (SELECT mix_err FROM mpath ORDER BY mix_pop, mix_err LIMIT 1) AS high)",
    *_least_squares_rounds("s", SWEEP_ROUNDS, _relaxed, "0.05",
                           f"SELECT i AS k, low + (high - low) * i / {SWEEP_STEPS} AS gamma FROM range_ CROSS JOIN range({SWEEP_STEPS + 1}) q(i) WHERE i = 0 OR high > low"),
    _mixture_path("s"),
]) + f"""
SELECT {r('gamma', 'gamma')}, {r('mix_pop', 'pop_err')}, {r('mix_err', 'max_group_err')}, {SWEEP_ROUNDS} AS rounds FROM spath WHERE t = {SWEEP_ROUNDS}"""  # fmt: skip


def _logistic_rounds(rounds: int, steps: int, c: float, kind: str, penalty: str = "l2") -> list[str]:
    """Exponential weights over logistic fits with two features: ``steps`` Newton steps from zero in every round, each a 3 x 3 solve by determinants."""
    ridge = 1.0 / c if penalty == "l2" else 0.0
    out = ["w0 AS MATERIALIZED (SELECT DISTINCT g, n / total::DOUBLE AS w, n FROM rows_)", "z0 AS MATERIALIZED (SELECT 0.0::DOUBLE AS b0, 0.0::DOUBLE AS b1, 0.0::DOUBLE AS b2)"]
    for t in range(1, rounds + 1):
        before = "z0"
        out.append(f"q{t} AS MATERIALIZED (SELECT r.*, w.w / r.n * CASE WHEN y = 1 THEN up ELSE down END AS q FROM rows_ r JOIN w{t - 1} w USING (g))")
        for i in range(steps):
            here = f"b{t}_{i}"
            out += [
                f"h{t}_{i} AS MATERIALIZED (SELECT b0, b1, b2, sum(q * (p - y)) AS g0, sum(q * (p - y) * x1) + {ridge} * b1 AS g1, sum(q * (p - y) * x2) + {ridge} * b2 AS g2,"
                f" sum(v) AS a00, sum(v * x1) AS a01, sum(v * x2) AS a02, sum(v * x1 * x1) + {ridge} AS a11, sum(v * x1 * x2) AS a12, sum(v * x2 * x2) + {ridge} AS a22"
                f" FROM (SELECT *, q * p * (1 - p) AS v FROM (SELECT r.*, z.*, 1 / (1 + exp(-(b0 + b1 * x1 + b2 * x2))) AS p FROM q{t} r CROSS JOIN {before} z)) GROUP BY b0, b1, b2)",
                f"{here} AS MATERIALIZED (SELECT b0 - (g0 * (a11 * a22 - a12 * a12) - a01 * (g1 * a22 - a12 * g2) + a02 * (g1 * a12 - a11 * g2)) / det AS b0,"
                f" b1 - (a00 * (g1 * a22 - a12 * g2) - g0 * (a01 * a22 - a12 * a02) + a02 * (a01 * g2 - g1 * a02)) / det AS b1,"
                f" b2 - (a00 * (a11 * g2 - g1 * a12) - a01 * (a01 * g2 - g1 * a02) + g0 * (a01 * a12 - a11 * a02)) / det AS b2 FROM"
                f" (SELECT *, a00 * (a11 * a22 - a12 * a12) - a01 * (a01 * a22 - a12 * a02) + a02 * (a01 * a12 - a11 * a02) AS det FROM h{t}_{i}))",
            ]
            before = here
        p = "1 / (1 + exp(-(b0 + b1 * x1 + b2 * x2)))"
        loss = {"Log-Loss": f"-(y * ln({p}) + (1 - y) * ln(1 - {p}))", "0/1 Loss": f"CASE WHEN (b0 + b1 * x1 + b2 * x2 > 0) = (y = 1) THEN 0.0 ELSE 1.0 END"}[kind]
        eta = f"({t}::DOUBLE ** -0.5)"
        out += [
            f"e{t} AS MATERIALIZED (SELECT g, avg({loss}) AS err FROM rows_ CROSS JOIN {before} GROUP BY g)",
            f"w{t} AS MATERIALIZED (SELECT g, w.w * exp({eta} * e.err) / sum(w.w * exp({eta} * e.err)) OVER () AS w, n, e.err, sum(e.err * n) OVER () / sum(n) OVER () AS pop"
            f" FROM w{t - 1} w JOIN e{t} e USING (g))",
        ]
    union = " UNION ALL ".join(f"SELECT {t} AS t, 0 AS k, 0.0 AS gamma, g, w, n, err, pop FROM w{t}" for t in range(1, rounds + 1))
    return [*out, f"log AS MATERIALIZED ({union})"]


_LOGIT_ROWS = """rows_ AS MATERIALIZED (SELECT g, o_totalprice / 100000 AS x1, c_acctbal / 10000 AS x2, y, count(*) OVER (PARTITION BY g) AS n, count(*) OVER () AS total,
  count(*) OVER () / (2.0 * sum(y) OVER ()) AS up, count(*) OVER () / (2.0 * (count(*) OVER () - sum(y) OVER ())) AS down FROM scored)"""
LOGIT_STEPS = 8
GAME_LOGISTIC_SQL = "WITH " + SCORED + ",\n" + ",\n".join([_LOGIT_ROWS, *_logistic_rounds(4, LOGIT_STEPS, 10.0, "Log-Loss"), _mixture_path("")]) + """
SELECT CAST(t AS INT) AS round, round(mix_pop, 5) + 0.0 AS pop_err, round(mix_err, 5) + 0.0 AS max_group_err FROM path"""
GAME_UNPENALISED_SQL = "WITH " + SCORED + ",\n" + ",\n".join([_LOGIT_ROWS, *_logistic_rounds(3, LOGIT_STEPS, 1.0, "Log-Loss", "none")]) + """
SELECT CAST(t AS INT) AS round, g, round(err, 5) + 0.0 AS err, round(w, 5) + 0.0 AS weight FROM log"""


def _info(spark, model):
    return spark.createDataFrame(model.info, "round int, g string, loss double, mu double, epsilon double")


@query("boost_minmax_classifier")
def boost_minmax_classifier(spark, sf):
    """Group losses and weights per round."""
    t = _frame(spark, sf)
    est = B.MinMaxBoostClassifier(n_estimators=4, num_leaves=7, fair_weight=0.5, dual_learning="gradient_norm", fairness_constraint="true_positive_rate")
    return _info(spark, est.fit(t.where("split = 'train'"), FEATURES, valid=t.where("split = 'val'")))


@query("boost_minmax_regressor")
def boost_minmax_regressor(spark, sf):
    est = B.MinMaxBoostRegressor(n_estimators=3, num_leaves=7, dual_learning="optim", fair_weight=0.5)
    return _info(spark, est.fit(_regression(spark, sf), FEATURES))


@query("boost_plain_classifier")
def boost_plain_classifier(spark, sf):
    t = _frame(spark, sf)
    model = B.BoostClassifier(n_estimators=3, num_leaves=7).fit(t.where("split = 'train'"), FEATURES)
    return model.transform(t.select("row_id", *FEATURES)).select("row_id", "p", "pred")


@query("boost_plain_regressor")
def boost_plain_regressor(spark, sf):
    t = _regression(spark, sf)
    model = B.BoostRegressor(n_estimators=3, num_leaves=7, min_gain_to_split=0.1).fit(t, FEATURES)
    return model.transform(t).select("row_id", "y", "p")


@query("boost_staged_prediction")
def boost_staged_prediction(spark, sf):
    t = _frame(spark, sf)
    model = B.BoostClassifier(n_estimators=3, num_leaves=7).fit(t.where("split = 'train'"), FEATURES)
    return model.staged(t.select("row_id", "y", "g", "split", *FEATURES), [1, 2, 3]).select("row_id", "iter", "p", "pred")


@query("boost_convergence")
def boost_convergence(spark, sf):
    t = _frame(spark, sf)
    model = B.MinMaxBoostClassifier(n_estimators=3, num_leaves=7).fit(t.where("split = 'train'"), FEATURES)
    return E.convergence(model, t, [1, 2, 3])


@query(
    "boost_round_group_loss",
    f"""WITH {SCORED}, p AS (SELECT g, y, least(greatest(score, 1e-7::DOUBLE), 1 - 1e-7::DOUBLE) AS q FROM scored)
    SELECT g, count(*) AS n, {r('avg(CASE WHEN y = 1 THEN -ln(q) END)', 'loss')}, {r('count(*) / (SELECT count(*) FROM p)', 'share')} FROM p GROUP BY g""",
)
def boost_round_group_loss(spark, sf):
    """The aggregation at the start of a boosting round."""
    from ..functions.losses import constraint_loss, sigmoid

    t = scored_orders(spark, sf)
    loss = F.avg(constraint_loss("y", sigmoid("margin"), "true_positive_rate")).alias("loss")
    by_group = pin(t.groupBy("g").agg(F.count(F.lit(1)).alias("n"), loss)).frame.withColumn("_k", F.lit(1))
    total = by_group.groupBy("_k").agg(F.sum("n").alias("total"))
    return by_group.join(total, "_k").select("g", "n", r6("loss"), r6(F.col("n") / F.col("total"), "share"))


@query(
    "boost_histogram",
    f"""WITH {SCORED} SELECT CAST(CASE WHEN o_totalprice < 250000 THEN 0 ELSE 1 END AS BIGINT) AS node, CAST(floor(c_acctbal / 1000) + 1 AS BIGINT) AS bin,
    {r('sum(score - y)', 'grad')}, {r('sum(score * (1 - score))', 'hess')}, count(*) AS n FROM scored GROUP BY 1, 2""",
)
def boost_histogram(spark, sf):
    """One histogram pass: gradient and Hessian sums per (node, bin) of all rows."""
    t = scored_orders(spark, sf)
    node = F.when(F.col("o_totalprice") < 250000, 0).otherwise(1)
    rows = t.withColumn("_b0", (F.floor(F.col("c_acctbal") / 1000) + 1).cast("smallint"))
    hist = B.histograms(rows, [B.Request(node, F.col("score") - F.col("y"), F.col("score") * (1 - F.col("score")), ["_b0"], [0, 1], 16)])
    return hist.select(big("node"), big("bin"), r6("g", "grad"), r6("h", "hess"), "n")


@query("boost_trials")
def boost_trials(spark, sf):
    """Two parameter sets on one binned table, evaluated together."""
    params = [{"n_estimators": 2, "num_leaves": 4, "fair_weight": w} for w in (0.2, 0.8)]
    results, _, _ = E.run_trials(lambda p: B.MinMaxBoostClassifier(**p), params, _frame(spark, sf), FEATURES, thresh="ks")
    return results.drop("duration")


@query("trial_families")
def trial_families(spark, sf):
    """Boosters, games, mixtures and weighted fits evaluated side by side."""
    made = {
        "booster": lambda p: B.MinMaxBoostClassifier(n_estimators=3, num_leaves=5, fair_weight=p["fair"]),
        "plain": lambda p: B.BoostClassifier(n_estimators=3, num_leaves=5),
        "game": lambda p: G.MinimaxGame(LogisticLearner(), rounds=4, error_type="Log-Loss"),
        "mixture": lambda p: G.MixtureClassifier(n_estimators=3, gamma=p["fair"]),
        "adaptive": lambda p: A.AdaptiveClassifier(n_iterations=2),
        "logistic": lambda p: LogisticLearner(),
    }
    params = [{"family": f, "fair": w} for f in made for w in ((0.3, 0.9) if f in ("booster", "mixture") else (0.5,))]
    frame = _frame(spark, sf).withColumns({"o_totalprice": F.col("price"), "c_acctbal": F.col("balance")})
    results, _, _ = E.run_trials(lambda p: made[p["family"]](p), params, frame, FEATURES)
    return results.drop("duration")


@query("trial_regressions")
def trial_regressions(spark, sf):
    """Boosted, ridge and mixture regressors: errors overall and per group."""
    made = [lambda p: B.BoostRegressor(n_estimators=3, num_leaves=5), lambda p: B.MinMaxBoostRegressor(n_estimators=3, num_leaves=5), lambda p: LinearLearner(alpha=1.0), lambda p: G.MixtureRegressor(n_estimators=3, gamma=0.5)]
    frame = _regression(spark, sf).withColumn("split", F.when(F.col("row_id") % 4 == 0, "test").otherwise("train"))
    results, _, _ = E.run_trials(lambda p: made[p["i"]](p), [{"i": i} for i in range(len(made))], frame, LINEAR)
    return results.drop("duration")


@query("boost_long_run")
def boost_long_run(spark, sf):
    """A fit long enough for lineage cuts and for patience to end it; the tree count and the validation loss of its rounds."""
    t = _frame(spark, sf)
    est = B.MinMaxBoostClassifier(n_estimators=40, num_leaves=7, learning_rate=0.5, early_stopping_rounds=3, fair_weight=0.3)
    model = est.fit(t.where("split = 'train'"), FEATURES, valid=t.where("split = 'val'"))
    played = spark.createDataFrame([(len(model.trees), int(est.info["round"].max()))], "trees int, rounds int")
    return played


@query("boost_fair_weight_sweep")
def boost_fair_weight_sweep(spark, sf):
    base = spark.createDataFrame([(2, 4)], "n_estimators int, num_leaves int")
    results, _, _ = E.fair_weight_sweep(lambda p: B.MinMaxBoostClassifier(**p), base, [0.1, 0.9], _frame(spark, sf), FEATURES)
    return results.drop("duration")


@query("boost_saved_model")
def boost_saved_model(spark, sf):
    """Predictions of a model written as tables and read back."""
    t = _frame(spark, sf)
    path = fresh(spark, "model")
    save_model(B.BoostClassifier(n_estimators=2, num_leaves=5).fit(t, FEATURES), path)
    return load_model(spark, path).transform(t.select("row_id", *FEATURES)).select("row_id", "p")


def _rounded(df, digits, *columns):
    return df.withColumns({c: F.round(c, digits) + 0.0 for c in columns})


@query("game_minimax_logistic", GAME_LOGISTIC_SQL)
def game_minimax_logistic(spark, sf):
    t = _frame(spark, sf)
    game = G.MinimaxGame(LogisticLearner(C=10.0), rounds=4, error_type="Log-Loss")
    path = trajectory(game.fit(t, LINEAR).errors())
    return _rounded(path.select("round", "pop_err", "max_group_err"), 5, "pop_err", "max_group_err")


@query("game_logistic_no_penalty", GAME_UNPENALISED_SQL)
def game_logistic_no_penalty(spark, sf):
    """Members without regularisation."""
    game = G.MinimaxGame(LogisticLearner(penalty="none"), rounds=3, error_type="Log-Loss")
    history = game.fit(_frame(spark, sf), LINEAR).history
    return _rounded(history.select("round", "g", "err", "weight"), 5, "err", "weight")


@query("game_logistic_l1")
def game_logistic_l1(spark, sf):
    """Sparse members: their coefficients by round, with the largest violation of the optimality conditions of the last one."""
    result = G.MinimaxGame(LogisticLearner(C=2.0, penalty="l1"), rounds=3, error_type="Log-Loss").fit(_frame(spark, sf), LINEAR)
    rows = [(i + 1, f, float(w)) for i, m in enumerate(result.model.members) for f, w in zip((*m.features, "intercept"), (*m.coef, m.intercept))]
    return spark.createDataFrame(rows, "round int, feature string, value double")


@query("game_long_run")
def game_long_run(spark, sf):
    """A game long enough to stop by itself: the weights of equally served groups settle."""
    t = _frame(spark, sf).withColumn("half", F.pmod("row_id", F.lit(2)))
    game = G.MinimaxGame(LogisticLearner(), rounds=60, b=1.0, threshold=1e-9, error_type="Log-Loss")
    return trajectory(game.fit(t, LINEAR, groups=["half"]).errors())


@query("game_relaxed_false_negatives")
def game_relaxed_false_negatives(spark, sf):
    """Two group types and a validation part."""
    t = _frame(spark, sf)
    game = G.MinimaxGame(LogisticLearner(), mode="relaxed", rounds=3, gamma=0.1, error_type="FN-Log-Loss")
    return game.fit(t.where("split = 'train'"), LINEAR, groups=["g", "g2"], valid=t.where("split = 'val'")).valid_history


@query("game_equal_error_logistic")
def game_equal_error_logistic(spark, sf):
    return G.MinimaxGame(LogisticLearner(), mode="equal", rounds=3).fit(_frame(spark, sf), LINEAR).history


@query("game_linear_regression", GAME_LINEAR_SQL)
def game_linear_regression(spark, sf):
    history = G.MinimaxGame(LinearLearner(), rounds=4, scale_by_label=True).fit(_regression(spark, sf), LINEAR).history
    return _rounded(history, 6, "err", "pop_err", "weight", "lam")


@query("game_paired_classifier")
def game_paired_classifier(spark, sf):
    return G.MinimaxGame(PairedLearner(), rounds=3).fit(_frame(spark, sf), LINEAR).history


@query("game_gamma_sweep", GAME_SWEEP_SQL)
def game_gamma_sweep(spark, sf):
    game = G.MinimaxGame(LinearLearner(), rounds=SWEEP_ROUNDS, a=0.05)
    sweep = G.gamma_sweep(game, _regression(spark, sf), LINEAR, n=SWEEP_STEPS)
    return _rounded(sweep, 6, "gamma", "pop_err", "max_group_err")


@query("game_gamma_sweep_rates")
def game_gamma_sweep_rates(spark, sf):
    """False negatives: the range starts at 0 and ends at the error of one round; with a validation curve."""
    t = _frame(spark, sf)
    game = G.MinimaxGame(LogisticLearner(), rounds=3, error_type="FN")
    return G.gamma_sweep(game, t.where("split = 'train'"), LINEAR, n=3, valid=t.where("split = 'val'"))


@query("game_gamma_sweep_equal")
def game_gamma_sweep_equal(spark, sf):
    """Equal errors: one relaxed game at the error they reach."""
    game = G.MinimaxGame(PairedLearner(), mode="equal", rounds=3, error_type="FP")
    return G.gamma_sweep(game, _frame(spark, sf), LINEAR)


@query("learner_ridge")
def learner_ridge(spark, sf):
    t = _regression(spark, sf)
    return LinearLearner(alpha=5.0).fit(t, LINEAR, "y").transform(t).select("row_id", "p")


@query("mixture_classifier")
def mixture_classifier(spark, sf):
    t = _frame(spark, sf)
    result = G.MixtureClassifier(n_estimators=3, gamma=0.5).fit(t, LINEAR)
    return result.model.transform(t, "sample", "row_id", seed=1).select("row_id", "p", "pred")


@query("mixture_regressor")
def mixture_regressor(spark, sf):
    t = _regression(spark, sf)
    return G.MixtureRegressor(n_estimators=3, gamma=0.5).fit(t, LINEAR).model.transform(t).select("row_id", "p")


@query("adaptive_classifier")
def adaptive_classifier(spark, sf):
    t = _frame(spark, sf)
    est = A.AdaptiveClassifier(n_iterations=3)
    est.fit(t, LINEAR)
    return A.history_table(spark, est.info)


@query("adaptive_rounded_risks")
def adaptive_rounded_risks(spark, sf):
    """The search with risks rounded to three digits and the domination flag."""
    with A.LogisticRiskOracle(_frame(spark, sf), LINEAR, kind="true_positive_rate") as oracle:
        result = A.adaptive_weights(oracle, A.scheme_weights(oracle.prior, "naive"), niter=2, risk_digits=3)
    return A.history_table(spark, result)


@query("adaptive_fixed_schemes")
def adaptive_fixed_schemes(spark, sf):
    t = _frame(spark, sf).persist()
    rows = []
    for scheme in ("naive", "balanced"):
        model, risk = A.fit_weighted(t, LINEAR, scheme)
        rows.append((scheme, list(model.coef), model.intercept, risk.tolist()))
    t.unpersist()
    return spark.createDataFrame(rows, "scheme string, coef array<double>, intercept double, risk array<double>")


@query("stream_scoring")
def stream_scoring(spark, sf):
    """A fitted model applied to the orders as a stream."""
    t = scored_orders(spark, sf).withColumn("price", F.col("o_totalprice") / 100000)
    model = LogisticLearner().fit(t, ["price"], "y")
    schema = spark.read.parquet(f"{sf}/orders.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "orders.parquet").parquet(sf)
    scored = model.transform(stream.withColumn("price", F.col("o_totalprice") / 100000)).select("o_orderkey", "p", "pred")
    root = fresh(spark, "scoring")
    q = scored.writeStream.format("parquet").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start(f"{root}/out")
    q.awaitTermination()
    return spark.read.schema(scored.schema).parquet(f"{root}/out")
