"""Queries on parameter tables and on the results of many models."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions.recode import duration_seconds
from ..operators import trials as X
from ..operators.pareto import pareto_hull
from .bindings import RESULTS, int_sql, results, scored_orders, unit_sql
from .registry import big, query, r, r6, table


def draw_sql(p, u: str) -> str:
    """SQL of one parameter draw."""
    if isinstance(p, X.Choice):
        return f"{list(p.options)}[CAST(floor({u} * {len(p.options)}) AS INT) + 1]"
    if p.log:
        v = f"exp({math.log(p.low)!r}::DOUBLE + {u} * {math.log(p.high) - math.log(p.low)!r}::DOUBLE)"
    else:
        v = f"{float(p.low)!r}::DOUBLE + {u} * {float(p.high - p.low)!r}::DOUBLE"
    return f"CAST(floor({v}) AS BIGINT)" if p.integer else v


SAMPLE = dict(X.SPACES["minmax_boost"]) | {"booster": X.Choice(("plain", "fair", "both"))}
_DRAWS = ", ".join(
    (f"{draw_sql(p, unit_sql('7|' + n, 'p_partkey'))} AS {n}" if isinstance(p, X.Choice) or p.integer else r(draw_sql(p, unit_sql("7|" + n, "p_partkey")), n))
    for n, p in SAMPLE.items()
)


@query("trial_parameters", f"SELECT p_partkey, {_DRAWS} FROM part")
def trial_parameters(spark, sf):
    """One trial per part."""
    t = X.sample_params(table(spark, sf, "part").select("p_partkey"), SAMPLE, 7, "p_partkey")
    real = {n for n, p in SAMPLE.items() if isinstance(p, X.Uniform) and not p.integer}
    return t.select("p_partkey", *[r6(n) if n in real else F.col(n) for n in SAMPLE])


VARIANTS = {"boost": "boost", "minmax_boost_tpr": "minmax_boost", "game_tpr": "game", "adaptive_tpr": "adaptive"}
DATASETS = "ds AS (SELECT p_brand AS dataset, count(*) AS n_params, count(*) > 80 AS is_large FROM part GROUP BY p_brand)"


def _run_sql() -> str:
    parts = []
    for variant, family in VARIANTS.items():
        for large, spaces in ((False, X.SPACES), (True, X.LARGE_SPACES)):
            for name, p in spaces[family].items():
                u = unit_sql(f"3|{name}", "dataset", f"'{variant}'", "number")
                parts.append(
                    f"SELECT dataset, '{variant}' AS model_name, number, '{name}' AS param, {r('(' + draw_sql(p, u) + ')::DOUBLE', 'value')} FROM nu WHERE is_large = {large}"
                )
    return " UNION ALL ".join(parts)


@query("trial_run_table", f"WITH {DATASETS}, nu AS (SELECT *, unnest(range(0, n_params)) AS number FROM ds) {_run_sql()}")
def trial_run_table(spark, sf):
    """Every brand is a dataset with as many trials as parts."""
    ds = table(spark, sf, "part").groupBy(F.col("p_brand").alias("dataset")).agg(F.count(F.lit(1)).alias("n_params"))
    runs = X.run_table(ds.withColumn("is_large", F.col("n_params") > 80), VARIANTS, seed=3)
    return runs.select("dataset", "model_name", big("number"), F.explode("params").alias("param", "v")).select(
        "dataset", "model_name", "number", "param", r6("v", "value")
    )


@query(
    "trial_sweep_parameters",
    f"SELECT p_partkey, {r(draw_sql(SAMPLE['reg_lambda'], unit_sql('7|reg_lambda', 'p_partkey')), 'reg_lambda')}, unnest([0.1, 0.5, 0.9]::DOUBLE[]) AS fair_weight FROM part",
)
def trial_sweep_parameters(spark, sf):
    base = X.sample_params(table(spark, sf, "part").select("p_partkey"), {"reg_lambda": SAMPLE["reg_lambda"]}, 7, "p_partkey")
    return X.sweep_params(base, [0.1, 0.5, 0.9]).select("p_partkey", r6("reg_lambda"), "fair_weight")


@query(
    "trial_sweep_curve",
    f"""WITH {RESULTS} SELECT dataset, fair_weight, {r('avg(perf)', 'perf')}, {r('avg(fair)', 'fair')}, {r('avg(depth)', 'depth')}
    FROM val JOIN trials USING (dataset, model_name, number) GROUP BY dataset, fair_weight""",
)
def trial_sweep_curve(spark, sf):
    val, _, trials = results(spark, sf)
    t = X.sweep_curve(val, trials, ["dataset", "fair_weight"])
    return t.select("dataset", "fair_weight", r6("perf"), r6("fair"), r6("depth"))


ALPHAS = tuple(i / 20 for i in range(21))
REPS, DRAWS = 8, 20
FULL_REPS, FULL_DRAWS = 1000, 100
PICK = f"""
ix AS (SELECT *, row_number() OVER (PARTITION BY dataset, model_name ORDER BY number) - 1 AS i, count(*) OVER (PARTITION BY dataset, model_name) AS n FROM val),
ke AS (SELECT DISTINCT dataset, model_name, n FROM ix),
dr AS (SELECT dataset, model_name, n, a, a / 20.0::DOUBLE AS alpha, rep, draw FROM ke, range(0, 21) x(a), range(0, {REPS}) y(rep), range(0, {DRAWS}) z(draw)),
di AS (SELECT *, {int_sql('11', 'dataset', 'model_name', 'a', 'rep', 'draw')} % n AS i FROM dr),
sc AS (SELECT di.dataset, di.model_name, alpha, rep, ix.number, alpha * ix.fair + (1 - alpha) * ix.perf AS s FROM di JOIN ix USING (dataset, model_name, i)),
be AS (SELECT *, row_number() OVER (PARTITION BY dataset, model_name, alpha, rep ORDER BY s DESC, number) AS k FROM sc),
ch AS (SELECT be.dataset, be.model_name, alpha, rep, be.number, test.perf, test.fair, test.duration, (1 - alpha) * test.perf + alpha * test.fair AS score
  FROM be JOIN test ON be.dataset = test.dataset AND be.model_name = test.model_name AND be.number = test.number WHERE k = 1)"""


def _chosen(spark, sf, reps=REPS, n=DRAWS, dataset=None):
    val, test, _ = results(spark, sf)
    if dataset is not None:
        val, test = val.where(F.col("dataset") == dataset), test.where(F.col("dataset") == dataset)
    test = test.withColumn("duration", duration_seconds("duration_text"))
    return X.select_models(val, test, "perf", "fair", reps=reps, n=n, seed=11)


@query("trial_select_models", f"WITH {RESULTS}, {PICK} SELECT dataset, model_name, {r('alpha', 'alpha')}, CAST(rep AS BIGINT) AS rep, number, {r('perf', 'perf')}, {r('fair', 'fair')}, {r('score', 'score')}, {r('duration', 'duration')} FROM ch")
def trial_select_models(spark, sf):
    t = _chosen(spark, sf)
    return t.select("dataset", "model_name", r6("alpha"), big("rep"), "number", *[r6(c) for c in ("perf", "fair", "score", "duration")])


@query("trial_select_models_full")
def trial_select_models_full(spark, sf, dataset=None):
    """The whole bootstrap: 1000 repetitions of 100 draws per alpha, for all datasets or one."""
    t = _chosen(spark, sf, FULL_REPS, FULL_DRAWS, dataset)
    return t.select("dataset", "model_name", r6("alpha"), big("rep"), "number", *[r6(c) for c in ("perf", "fair", "score", "duration")])


@query("trial_mean_ci_full")
def trial_mean_ci_full(spark, sf, dataset=None):
    """Means and intervals over the 1000 values of the whole bootstrap."""
    t = X.mean_ci(_chosen(spark, sf, FULL_REPS, FULL_DRAWS, dataset), ["dataset", "model_name", "alpha"], ["score"])
    return t.select("dataset", "model_name", r6("alpha"), "n", r6("score_mean"), r6("score_std"), r6("score_ci"))


# Fixed value: 97.5 % quantile of Student's t with 7 degrees of freedom.
T7 = 2.364624251592784


@query(
    "trial_mean_ci",
    f"""WITH {RESULTS}, {PICK} SELECT dataset, model_name, {r('alpha', 'alpha')}, count(*) AS n, {r('avg(score)', 'score_mean')}, {r('stddev_samp(score)', 'score_std')},
    {r(f'{T7}::DOUBLE * stddev_samp(score) / sqrt(count(*))', 'score_ci')} FROM ch GROUP BY dataset, model_name, alpha""",
)
def trial_mean_ci(spark, sf):
    t = X.mean_ci(_chosen(spark, sf), ["dataset", "model_name", "alpha"], ["score"])
    return t.select("dataset", "model_name", r6("alpha"), "n", r6("score_mean"), r6("score_std"), r6("score_ci"))


@query(
    "trial_cost_ratio",
    f"""WITH {RESULTS}, m AS (SELECT dataset, model_name, avg(duration) AS d FROM test GROUP BY ALL)
    SELECT m.dataset, m.model_name, {r('m.d', 'mean_duration')}, {r('m.d / b.d', 'cost_ratio')} FROM m JOIN m b ON m.dataset = b.dataset AND b.model_name = 'plain'""",
)
def trial_cost_ratio(spark, sf):
    _, test, _ = results(spark, sf)
    t = X.cost_ratio(test.withColumn("duration", duration_seconds("duration_text")), "plain")
    return t.select("dataset", "model_name", r6("mean_duration"), r6("cost_ratio"))


@query("trial_concat_runs", f"WITH {RESULTS} SELECT 'first' AS run, * FROM val UNION ALL SELECT 'second', dataset, model_name, number, perf, fair FROM test")
def trial_concat_runs(spark, sf):
    val, test, _ = results(spark, sf)
    return X.concat_runs({"first": val, "second": test.select(*val.columns)})


@query("pareto_hull")
def pareto_hull_query(spark, sf):
    """Lower-left hull of customer balance against mean order value, per segment."""
    t = scored_orders(spark, sf)
    return pareto_hull(t, "o_totalprice", "c_acctbal", ["g"])


@query("pareto_hull_results")
def pareto_hull_results(spark, sf):
    val, _, _ = results(spark, sf)
    return pareto_hull(val, "perf", "fair", ["dataset"])
