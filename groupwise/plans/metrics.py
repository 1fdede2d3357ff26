"""Queries on performance and group-fairness metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.hashing import unit
from ..lookup import pin
from ..operators import metrics as M
from ..operators.groups import Keep, subgroup
from .bindings import DOCS, HISTORY, REGRESSION, SCORED, SHIFT, history, regression_orders, scored_docs, scored_events, scored_orders, unit_sql
from .losses import LL
from .registry import big, query, r, r6, table

BOUND = "least(greatest(score, 1e-15::DOUBLE), 1 - 1e-15::DOUBLE)"


def stats_sql(source: str, keys: str = "g", pred: str = "pred") -> str:
    """Sufficient statistics and the rates built on them, as two CTEs ``st`` and ``rt``."""
    head = f"{keys}, " if keys else ""
    group = f"GROUP BY {keys}" if keys else ""
    return f"""
st AS (SELECT {head}count(*) AS n, sum(y) AS pos, sum(CASE WHEN y = 1 AND {pred} = 1 THEN 1 ELSE 0 END) AS tp,
  sum(CASE WHEN y = 0 AND {pred} = 1 THEN 1 ELSE 0 END) AS fp, sum(CASE WHEN y = 0 AND {pred} = 0 THEN 1 ELSE 0 END) AS tn,
  sum(CASE WHEN y = 1 AND {pred} = 0 THEN 1 ELSE 0 END) AS fn, sum({LL}) AS sum_ll,
  sum(CASE WHEN y = 1 THEN {LL} END) AS sum_ll_pos FROM {source} {group}),
rt AS (SELECT {head}n, pos, tp, fp, tn, fn, sum_ll, sum_ll_pos, tp / nullif(pos, 0) AS tpr, fp / nullif(fp + tn, 0) AS fpr, fn / nullif(pos, 0) AS fnr,
  tn / nullif(fp + tn, 0) AS tnr, (tp + tn) / n AS acc, (tp + fp) / n AS pr,
  coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(pos, 0), 0) AS recall,
  CASE WHEN pos = 0 THEN tn / (fp + tn) WHEN pos = n THEN tp / pos ELSE (tp / pos + tn / (fp + tn)) / 2 END AS bal_acc,
  sum_ll / n AS logloss, sum_ll_pos / nullif(pos, 0) AS logloss_pos FROM st)"""


ALL_RATES = ("tpr", "fpr", "fnr", "tnr", "acc", "pr", "precision", "recall", "bal_acc", "logloss", "logloss_pos")
PERF = ("bal_acc", "precision", "acc", "recall", "logloss")
BUNDLE = {
    "min_acc": "min(acc)",
    "min_bal_acc": "min(bal_acc)",
    "min_tpr": "min(tpr)",
    "min_pr": "min(pr)",
    "max_logloss": "max(logloss)",
    "max_logloss_tpr": "max(logloss_pos)",
    "eod": "max(tpr) - min(tpr)",
    "spd": "max(pr) - min(pr)",
    "eq_loss": "max(logloss) - min(logloss)",
}
GR = stats_sql("scored")


@query(
    "metric_worst_segments",
    f"""WITH {SCORED}, {GR}, tot AS (SELECT (sum(tp) + sum(tn)) / sum(n) AS acc FROM st)
    SELECT g, CAST(n AS BIGINT) AS n, {r('rt.acc', 'acc')}, {r('tpr', 'tpr')}, {r('logloss', 'logloss')}, {r('rt.acc - tot.acc', 'acc_gap')},
    CAST(row_number() OVER (ORDER BY rt.acc, g) AS BIGINT) AS worst_rank FROM rt, tot""",
)
def metric_worst_segments(spark, sf):
    """Segments ordered by accuracy, with the gap to the overall accuracy."""
    from pyspark.sql import Window

    stats = M.collect_stats(scored_orders(spark, sf))
    overall = M.rates(M.merge_stats(stats), (), ["acc"]).select(F.col("acc").alias("all_acc"), F.lit(1).alias("_k"))
    t = M.rates(stats, ["g", "n"], ["acc", "tpr", "logloss"]).withColumn("_k", F.lit(1)).join(overall, "_k")
    # one row per segment is left here
    rank = F.row_number().over(Window.partitionBy("_k").orderBy("acc", "g"))
    return t.select("g", big("n"), r6("acc"), r6("tpr"), r6("logloss"), r6(F.col("acc") - F.col("all_acc"), "acc_gap"), big(rank, "worst_rank"))


@query("metric_rates", f"WITH {SCORED}, {GR} SELECT g, {', '.join(r(m, m) for m in ALL_RATES)} FROM rt")
def metric_rates(spark, sf):
    t = M.rates(M.group_stats(scored_orders(spark, sf)))
    return t.select("g", *[r6(m) for m in ALL_RATES])


@query("metric_rates_by_language", f"WITH {DOCS}, {stats_sql('docs')} SELECT g, CAST(n AS BIGINT) AS n, {', '.join(r(m, m) for m in ALL_RATES)} FROM rt")
def metric_rates_by_language(spark, sf):
    stats = M.group_stats(scored_docs(spark, sf))
    return M.rates(stats, ["g", "n"]).select("g", big("n"), *[r6(m) for m in ALL_RATES])


@query("metric_performance", f"WITH {SCORED}, {stats_sql('scored', '')} SELECT {', '.join(r(m, m) for m in PERF)} FROM rt")
def metric_performance(spark, sf):
    t = M.performance(M.group_stats(scored_orders(spark, sf)))
    return t.select(*[r6(m) for m in PERF])


AUC = """
sc AS (SELECT {k}{s} AS s, sum(y) AS p, count(*) - sum(y) AS q FROM {t} GROUP BY {k}{s}),
cu AS (SELECT *, sum(q) OVER ({w} ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - q AS below FROM sc),
auc AS (SELECT {k}sum(p::DOUBLE * (below + q / 2.0)) / nullif(sum(p)::DOUBLE * sum(q), 0) AS roc_auc FROM cu {g})"""


@query("metric_roc_auc", f"WITH {SCORED}, {AUC.format(k='g, ', s='score', t='scored', w='PARTITION BY g', g='GROUP BY g')} SELECT g, {r('roc_auc', 'roc_auc')} FROM auc")
def metric_roc_auc(spark, sf):
    return M.roc_auc(scored_orders(spark, sf), ["g"]).select("g", r6("roc_auc"))


@query(
    "metric_roc_auc_tied_scores",
    f"WITH {SCORED}, coarse AS (SELECT y, floor(score * 20) / 20 AS s FROM scored), {AUC.format(k='', s='s', t='coarse', w='', g='')} SELECT {r('roc_auc', 'roc_auc')} FROM auc",
)
def metric_roc_auc_tied_scores(spark, sf):
    t = scored_orders(spark, sf).withColumn("score", F.floor(F.col("score") * 20) / 20)
    return M.roc_auc(t).select(r6("roc_auc"))


def ks_sql(source: str, keys: str = "", y: str = "y") -> str:
    k = f"{keys}, " if keys else ""
    on = f"USING ({keys})" if keys else "ON true"
    return f"""
kt AS (SELECT {k}score, sum({y}) AS p, count(*) - sum({y}) AS q FROM {source} GROUP BY {k}score),
kc AS (SELECT *, sum(p) OVER w AS cp, sum(q) OVER w AS cq FROM kt WINDOW w AS ({'PARTITION BY ' + keys if keys else ''} ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
kn AS (SELECT {k}sum(p) AS tp, sum(q) AS tq FROM kt {'GROUP BY ' + keys if keys else ''}),
kd AS (SELECT kc.*, tp, tq, cp * tq - cq * tp AS d FROM kc JOIN kn {on}),
kr AS (SELECT *, row_number() OVER ({'PARTITION BY ' + keys if keys else ''} ORDER BY d DESC, score DESC) AS rn FROM kd),
ks AS (SELECT {k}CASE WHEN d > 0 THEN score ELSE 'inf'::DOUBLE END AS threshold, CASE WHEN d > 0 THEN d / (tp::DOUBLE * tq) ELSE 0 END AS ks FROM kr WHERE rn = 1)"""


EV = "ev AS (SELECT user_id % 8 AS g, CAST(event_type = 'purchase' AS INT) AS y, value / (value + 50) AS score FROM events)"


@query("metric_ks_threshold", f"WITH {EV}, {ks_sql('ev', 'g')} SELECT g, {r('threshold', 'threshold')}, {r('ks', 'ks')} FROM ks")
def metric_ks_threshold(spark, sf):
    return M.ks_threshold(scored_events(spark, sf), ["g"]).select("g", r6("threshold"), r6("ks"))


@query("metric_ks_threshold_overall", f"WITH {EV}, {ks_sql('ev')} SELECT {r('threshold', 'threshold')}, {r('ks', 'ks')} FROM ks")
def metric_ks_threshold_overall(spark, sf):
    return M.ks_threshold(scored_events(spark, sf)).select(r6("threshold"), r6("ks"))


def _two_groups(spark, sf):
    t = subgroup(scored_orders(spark, sf), [Keep("g", ("MACHINERY",), "OTHER")])
    return M.group_stats(t.drop("g").withColumnRenamed("group_name", "g"))


TWO = SCORED + ", two AS (SELECT * REPLACE (CASE WHEN g = 'MACHINERY' THEN g ELSE 'OTHER' END AS g) FROM scored), " + stats_sql("two")


def _difference(name: str, metric: str):
    signed = f"max(CASE WHEN g = 'OTHER' THEN {metric} END) - max(CASE WHEN g = 'MACHINERY' THEN {metric} END)"

    @query(
        f"metric_{name}",
        f"""WITH {SCORED}, {GR} SELECT {r(f'max({metric}) - min({metric})', 'spread')}, (WITH {TWO} SELECT {r(signed)} FROM rt) AS signed_diff FROM rt""",
    )
    def run(spark, sf):
        spread = M.difference(M.group_stats(scored_orders(spark, sf)), metric).withColumn("_k", F.lit(1))
        signed_diff = M.difference(_two_groups(spark, sf), metric, signed=("MACHINERY", "OTHER")).withColumn("_k", F.lit(1))
        return spread.join(signed_diff, "_k").select(r6(f"{metric}_range", "spread"), r6(f"{metric}_diff", "signed_diff"))

    return run


_difference("equal_opportunity", "tpr")
_difference("statistical_parity", "pr")
_difference("equalized_loss", "logloss")

WORST = ("tpr", "pr", "bal_acc", "acc")


@query(
    "metric_worst_group",
    f"WITH {SCORED}, {GR} " + " UNION ALL ".join(f"SELECT '{m}' AS metric, {r(f'1 - min({m})', 'worst')}, arg_min(g, {m}) AS worst_g FROM rt" for m in WORST),
)
def metric_worst_group(spark, sf):
    stats = M.collect_stats(scored_orders(spark, sf))
    out = None
    for m in WORST:
        part = M.worst_group(stats, m).select(F.lit(m).alias("metric"), r6(f"worst_{m}", "worst"), "worst_g")
        out = part if out is None else out.unionByName(part)
    return out


@query("metric_max_error_rates", f"WITH {SCORED}, {GR} SELECT {r('max(fnr)', 'max_fnr')}, {r('max(fpr)', 'max_fpr')} FROM rt")
def metric_max_error_rates(spark, sf):
    stats = M.collect_stats(scored_orders(spark, sf))
    a, b = (M.max_rate(stats, m).withColumn("_k", F.lit(1)) for m in ("fnr", "fpr"))
    return a.join(b, "_k").select(r6("max_fnr"), r6("max_fpr"))


STATUS = ("F", "O", "P")
WIDE = ("tpr", "pr", "bal_acc", "acc")


@query(
    "metric_group_level_wide",
    f"WITH {SCORED}, {stats_sql('scored', 'g2')} SELECT "
    + ", ".join(f"max(CASE WHEN g2 = '{k}' THEN {r(m)} END) AS \"{m}_g={k}\"" for m in WIDE for k in STATUS)
    + " FROM rt",
)
def metric_group_level_wide(spark, sf):
    t = scored_orders(spark, sf).drop("g").withColumnRenamed("g2", "g")
    wide = M.group_level(M.group_stats(t), WIDE, STATUS)
    return wide.select(*[r6(c) for c in wide.columns])


@query(
    "metric_group_logloss",
    f"""WITH {SCORED}, k AS (SELECT g, 'equalized_loss' AS kind, {LL} AS l FROM scored
      UNION ALL SELECT g, 'positive_rate', -ln({BOUND}) FROM scored
      UNION ALL SELECT g, 'true_positive_rate', -ln({BOUND}) FROM scored WHERE y = 1
      UNION ALL SELECT g, 'true_negative_rate', -ln(1 - {BOUND}) FROM scored WHERE y = 0),
    m AS (SELECT kind, g, avg(l) AS loss FROM k GROUP BY kind, g)
    SELECT kind, g, {r('loss', 'loss')}, {r('max(loss) OVER (PARTITION BY kind)', 'max_loss')} FROM m""",
)
def metric_group_logloss(spark, sf):
    out = pin(M.group_loglosses(scored_orders(spark, sf))).frame
    top = out.groupBy("kind").agg(F.max("loss").alias("max_loss"))
    return out.join(top, "kind").select("kind", "g", r6("loss"), r6("max_loss"))


@query("metric_max_group_logloss", f"WITH {SCORED}, {GR} SELECT {r('max(logloss_pos)', 'max_loss')} FROM rt")
def metric_max_group_logloss(spark, sf):
    return M.max_group_logloss(scored_orders(spark, sf), "true_positive_rate").select(r6("max_loss"))


@query("metric_fairness_bundle", f"WITH {SCORED}, {GR} SELECT {', '.join(r(e, k) for k, e in BUNDLE.items())} FROM rt")
def metric_fairness_bundle(spark, sf):
    t = M.fairness_metrics(M.group_stats(scored_orders(spark, sf)))
    return t.select(*[r6(k) for k in BUNDLE])


PAIRS = f"""
{AUC.format(k='', s='score', t='scored', w='', g='')},
pf AS (SELECT (sum(tp) + sum(tn)) / sum(n) AS acc, (sum(tp) / sum(pos) + sum(tn) / sum(fp + tn)) / 2 AS bal_acc FROM st),
ff AS (SELECT max(tpr) - min(tpr) AS eod, max(pr) - min(pr) AS spd, 1 - min(tpr) AS min_tpr, 1 - min(pr) AS min_pr, 1 - min(bal_acc) AS min_bal_acc,
  1 - min(acc) AS min_acc FROM rt),
perf AS (SELECT 'acc' AS perf_metric, acc AS perf FROM pf UNION ALL SELECT 'bal_acc', bal_acc FROM pf UNION ALL SELECT 'roc_auc', roc_auc FROM auc),
fair AS (UNPIVOT ff ON eod, spd, min_tpr, min_pr, min_bal_acc, min_acc INTO NAME fair_metric VALUE fair)"""


@query(
    "metric_combined_score",
    f"""WITH {SCORED}, {GR}, {PAIRS} SELECT perf_metric, fair_metric, {r('perf', 'perf')}, {r('fair', 'fair')},
    {r('0.3 * perf + 0.7 * (1 - abs(fair))', 'score')} FROM perf, fair""",
)
def metric_combined_score(spark, sf):
    t = M.combined_score(scored_orders(spark, sf), 0.3)
    return t.select("perf_metric", "fair_metric", r6("perf"), r6("fair"), r6("score"))


@query(
    "metric_goal_score",
    f"""WITH {SCORED}, {GR}, {PAIRS}, j AS (SELECT perf_metric, fair_metric, perf, 1 - abs(fair) AS fair FROM perf, fair
      WHERE fair_metric IN ('eod', 'spd'))
    SELECT perf_metric, fair_metric, {r('perf', 'perf')}, {r('fair', 'fair')},
      {r('CASE WHEN fair >= 0.9 THEN perf ELSE perf - 10 * abs(fair - 0.9) END', 'score')} FROM j""",
)
def metric_goal_score(spark, sf):
    t = M.goal_score(scored_orders(spark, sf), 0.9, 10, ("acc", "bal_acc", "roc_auc"), ("eod", "spd"))
    return t.select("perf_metric", "fair_metric", r6("perf"), r6("fair"), r6("score"))


@query(
    "metric_regression",
    f"""WITH {REGRESSION}, m AS (SELECT g, count(*) AS n, sum((y - yhat) * (y - yhat)) AS se FROM reg GROUP BY g)
    SELECT g, {r('se / n', 'mse')}, {r('(SELECT sum(n) FROM m) / n', 'ratio')}, {r('(SELECT sum(se) / sum(n) FROM m)', 'all_mse')},
    {r('(SELECT max(se / n) FROM m)', 'max_mse')} FROM m""",
)
def metric_regression(spark, sf):
    t = regression_orders(spark, sf)
    overall = M.regression_metrics(t).select(F.lit(1).alias("_k"), F.col("mse").alias("all_mse"), "max_mse")
    by_group = M.group_mse(t).withColumn("_k", F.lit(1))
    return by_group.join(overall, "_k").select("g", r6("mse"), r6("ratio"), r6("all_mse"), r6("max_mse"))


MODELS = 5
LONG = (
    ", sp AS (SELECT *, CASE WHEN "
    + unit_sql("s", "row_id")
    + " < 0.6 THEN 'train' WHEN "
    + unit_sql("s", "row_id")
    + " < 0.8 THEN 'val' ELSE 'test' END AS split FROM scored), long AS (SELECT row_id, y, g, split, m AS model, 1 / (1 + exp(-(margin * (1 + m / 4.0) + c_acctbal * m / 40000.0))) AS score FROM sp, range(0, "
    + str(MODELS)
    + ") t(m))"
)


def long_frame(spark, sf, models: int = MODELS):
    """Scores of several models on all splits, one row per (model, row)."""
    t = scored_orders(spark, sf)
    u = unit("s", "row_id")
    t = t.withColumn("split", F.when(u < 0.6, F.lit("train")).when(u < 0.8, F.lit("val")).otherwise(F.lit("test")))
    t = t.withColumn("model", F.explode(F.array(*[F.lit(i).cast("bigint") for i in range(models)])))
    m = F.col("margin") * (1 + F.col("model") / 4.0) + F.col("c_acctbal") * F.col("model") / 40000.0
    return t.select("row_id", "y", "g", "split", "model", (1 / (1 + F.exp(-m))).alias("score"))


def _eval_sql(pred_source: str) -> str:
    keys = "model, split"
    bundle = ", ".join(f"{r(e, k)}" for k, e in BUNDLE.items())
    perf = f"""sum(tp) AS tp, sum(tn) AS tn, sum(fp) AS fp, sum(fn) AS fn, sum(pos) AS pos, sum(n) AS n, sum(sum_ll) AS ll"""
    return f"""{stats_sql(pred_source, 'model, split, g, thresh')},
o AS (SELECT {keys}, thresh, {perf} FROM st GROUP BY {keys}, thresh),
f AS (SELECT {keys}, {bundle} FROM rt GROUP BY {keys})
SELECT o.model, o.split, {r('thresh', 'thresh')}, {r('(tp / pos + tn / (fp + tn)) / 2', 'bal_acc')}, {r('coalesce(tp / nullif(tp + fp, 0), 0)', 'precision')},
  {r('(tp + tn) / n', 'acc')}, {r('tp / pos', 'recall')}, {r('ll / n', 'logloss')}, {', '.join('f.' + k for k in BUNDLE)}
FROM o JOIN f ON o.model = f.model AND o.split = f.split"""


EVAL = ("thresh", *PERF, *BUNDLE)


_SEGMENTS = sorted(SHIFT)


@query(
    "metric_evaluate_regressions",
    f"""WITH {REGRESSION}, k AS (SELECT unnest(range(4))::INT AS model), long AS (SELECT model, CASE WHEN row_id % 4 = 0 THEN 'test' ELSE 'train' END AS split, g, y, yhat + 3 * model AS s FROM reg CROSS JOIN k),
    m AS (SELECT model, split, g, count(*) AS n, sum((y - s) ** 2) AS se FROM long GROUP BY ALL)
    SELECT model, split, {r('sum(se) / sum(n)', 'mse')}, {r('max(se / n)', 'max_mse')},
    {', '.join(r(f"sum(n) / max(n) FILTER (WHERE g = '{k}')", f'"ratio_g={k}"') + ', ' + r(f"max(se / n) FILTER (WHERE g = '{k}')", f'"mse_g={k}"') for k in _SEGMENTS)}
    FROM m GROUP BY model, split""",
)
def metric_evaluate_regressions(spark, sf):
    """Errors of several regressions on two splits, overall, at worst and per group."""
    t = regression_orders(spark, sf).withColumn("split", F.when(F.col("row_id") % 4 == 0, "test").otherwise("train"))
    long = t.withColumn("model", F.explode(F.array(*[F.lit(i) for i in range(4)]))).withColumn("score", F.col("yhat") + 3 * F.col("model"))
    out = M.evaluate_regressions(long)
    return out.select("model", "split", *[r6(F.col(f"`{c}`"), c) for c in out.columns[2:]])


@query(
    "metric_evaluate_models",
    f"WITH {SCORED}{LONG}, pr AS (SELECT *, 0.5::DOUBLE AS thresh, CAST(score > 0.5 AS INT) AS pred FROM long), {_eval_sql('pr')}",
)
def metric_evaluate_models(spark, sf):
    t = M.evaluate_models(long_frame(spark, sf), 0.5)
    return t.select("model", "split", *[r6(c) for c in EVAL])


@query(
    "metric_evaluate_models_ks",
    f"""WITH {SCORED}{LONG}, tr AS (SELECT * FROM long WHERE split = 'train'), {ks_sql('tr', 'model')},
    pr AS (SELECT long.*, threshold AS thresh, CAST(score > threshold AS INT) AS pred FROM long JOIN ks USING (model)), {_eval_sql('pr')}""",
)
def metric_evaluate_models_ks(spark, sf):
    t = M.evaluate_models(long_frame(spark, sf), "ks")
    return t.select("model", "split", *[r6(c) for c in EVAL])


@query(
    "metric_running_mean",
    f"""WITH {HISTORY} SELECT round, g, {r('sum(err * n) OVER w / sum(n) OVER w', 'running_mean')} FROM hist
    WINDOW w AS (PARTITION BY g ORDER BY round ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
)
def metric_running_mean(spark, sf):
    t = M.running_mean(history(spark, sf), "round", "err", "n", ["g"])
    return t.select("round", "g", r6("running_mean"))


@query(
    "metric_weighted_group_loss",
    f"""WITH {SCORED}, m AS (SELECT g, avg({LL}) AS mean_loss, avg(CAST(y = pred AS DOUBLE)) AS acc, count(*) / (SELECT count(*) FROM scored) AS mu FROM scored GROUP BY g)
    SELECT g, {r('mean_loss', 'mean_loss')}, {r('acc', 'acc')}, {r('mu', 'mu')}, {r('mu * mean_loss', 'part')}, {r('sum(mu * mean_loss) OVER ()', 'total')} FROM m""",
)
def metric_weighted_group_loss(spark, sf):
    from ..functions.losses import logloss
    from ..operators.features import priors

    t = scored_orders(spark, sf).withColumn("loss", logloss("y", "score")).withColumn("correct", F.col("y") == F.col("pred"))
    out = M.weighted_group_loss(t, priors(t, "g").withColumnRenamed("prior", "mu"))
    return out.select("g", r6("mean_loss"), r6("acc"), r6("mu"), r6("part"), r6("total"))


@query(
    "metric_summary",
    f"""SELECT p_brand, p_type, {r('avg(p_retailprice)', 'p_retailprice_mean')}, {r('stddev_samp(p_retailprice)', 'p_retailprice_std')},
    {r('avg(p_size)', 'p_size_mean')}, {r('stddev_samp(p_size)', 'p_size_std')} FROM part GROUP BY p_brand, p_type""",
)
def metric_summary(spark, sf):
    t = M.summarize(table(spark, sf, "part"), ["p_brand", "p_type"], ["p_retailprice", "p_size"])
    return t.select("p_brand", "p_type", *[r6(c) for c in t.columns[2:]])
