"""Queries on dual updates and on the history of a game, over daily weight vectors of user buckets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import dual as D
from ..operators import history as H
from ..operators.pareto import pareto_flags
from .bindings import HISTORY, VECTORS, history, vectors
from .registry import big, query, r, r6, table


def project_sql(src: str, mu: str, z: str, vid: str = "vid", g: str = "g") -> str:
    return f"""
so AS (SELECT {vid}, {g}, {mu} AS m, row_number() OVER (PARTITION BY {vid} ORDER BY {mu} DESC, {g}) AS j FROM {src}),
cs AS (SELECT *, sum(m) OVER (PARTITION BY {vid} ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS s FROM so),
th AS (SELECT {vid}, max((s - {z}) / j) AS t FROM cs GROUP BY {vid}),
pj AS (SELECT {vid}, {g}, greatest(m - t, 0) AS projected FROM so JOIN th USING ({vid}))"""


@query(
    "dual_project_simplex",
    f"WITH v AS (SELECT o_custkey AS vid, o_orderkey AS g, o_totalprice * 1.5915494309e-05 AS mu FROM orders), {project_sql('v', 'mu', '2.0::DOUBLE')} SELECT vid, g, {r('projected', 'projected')} FROM pj",
)
def dual_project_simplex(spark, sf):
    """One vector per customer, one entry per order."""
    v = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("vid"), F.col("o_orderkey").alias("g"), (F.col("o_totalprice") * 1.5915494309e-05).alias("mu")
    )
    return D.project_simplex(v, z=2.0).select("vid", "g", r6("projected"))


@query(
    "dual_project_one_vector",
    f"WITH v AS (SELECT 1 AS vid, event_id AS g, value / 10 AS mu FROM events), {project_sql('v', 'mu', '100.0::DOUBLE')} SELECT g, {r('projected', 'projected')} FROM pj",
)
def dual_project_one_vector(spark, sf):
    """A single vector as long as the table."""
    v = table(spark, sf, "events").select(F.lit(1).alias("vid"), F.col("event_id").alias("g"), (F.col("value") / 10).alias("mu"))
    return D.project_simplex(v, z=100.0).select("g", r6("projected"))


@query("dual_optim", f"WITH {VECTORS} SELECT vid, g, {r('CASE WHEN row_number() OVER (PARTITION BY vid ORDER BY loss DESC, g) = 1 THEN 0.7 ELSE 0 END::DOUBLE', 'mu_new')} FROM vec")
def dual_optim(spark, sf):
    return D.dual_step(vectors(spark, sf), "optim", lam=0.7).select("vid", "g", r6("mu_new"))


@query("dual_gradient", f"WITH {VECTORS} SELECT vid, g, {r('mu + 0.1 * 0.7 * loss', 'mu_new')} FROM vec")
def dual_gradient(spark, sf):
    return D.dual_step(vectors(spark, sf), "gradient", lam=0.7, eta=0.1).select("vid", "g", r6("mu_new"))


MOVED = "mv AS (SELECT vid, g, mu + {s} * (loss - max(loss) OVER (PARTITION BY vid)) AS m FROM vec)"


@query("dual_gradient_norm", f"WITH {VECTORS}, {MOVED.format(s='0.5 * 0.7::DOUBLE')}, {project_sql('mv', 'm', '0.7::DOUBLE')} SELECT vid, g, {r('projected', 'mu_new')} FROM pj")
def dual_gradient_norm(spark, sf):
    return D.dual_step(vectors(spark, sf), "gradient_norm", lam=0.7, eta=0.5).select("vid", "g", r6("mu_new"))


@query(
    "dual_gradient_norm2",
    f"""WITH {VECTORS}, {MOVED.format(s='0.5 * 0.7::DOUBLE')}, lo AS (SELECT *, m - least(min(m) OVER (PARTITION BY vid), 0) AS x FROM mv)
    SELECT vid, g, {r('x / sum(x) OVER (PARTITION BY vid) * 0.7', 'mu_new')} FROM lo""",
)
def dual_gradient_norm2(spark, sf):
    return D.dual_step(vectors(spark, sf), "gradient_norm2", lam=0.7, eta=0.5).select("vid", "g", r6("mu_new"))


@query(
    "dual_gradient_norm2_regression",
    f"WITH {VECTORS}, {MOVED.format(s='0.01::DOUBLE')} SELECT vid, g, {r('m / sum(m) OVER (PARTITION BY vid) * 0.7', 'mu_new')} FROM mv",
)
def dual_gradient_norm2_regression(spark, sf):
    t = D.dual_step(vectors(spark, sf), "gradient_norm2", lam=0.7, eta=0.01, scale_step_by_lambda=False)
    return t.select("vid", "g", r6("mu_new"))


@query("game_exponential_weights", f"WITH {VECTORS}, e AS (SELECT vid, g, lam, w * exp(0.5 * err) AS e FROM (SELECT *, loss AS err FROM vec)) SELECT vid, g, {r('e / sum(e) OVER (PARTITION BY vid)', 'w_new')}, {r('lam', 'lam_new')} FROM e")
def game_exponential_weights(spark, sf):
    t = D.game_step(vectors(spark, sf).withColumn("err", F.col("loss")), "minimax", 0.5)
    return t.select("vid", "g", r6("w_new"), r6("lam_new"))


@query("game_relaxed", f"WITH {VECTORS}, e AS (SELECT *, greatest(0, lam + 0.5 * (loss - 0.6)) AS l FROM vec) SELECT vid, g, {r('share + l', 'w_new')}, {r('l', 'lam_new')} FROM e")
def game_relaxed(spark, sf):
    t = D.game_step(vectors(spark, sf).withColumn("err", F.col("loss")), "relaxed", 0.5, gamma=0.6)
    return t.select("vid", "g", r6("w_new"), r6("lam_new"))


@query("game_equal_errors", f"WITH {VECTORS}, e AS (SELECT *, lam + 0.5 * (loss - mean_err) AS l FROM vec) SELECT vid, g, {r('share * (1 - sum(l) OVER (PARTITION BY vid)) + l', 'w_new')}, {r('l', 'lam_new')} FROM e")
def game_equal_errors(spark, sf):
    t = D.game_step(vectors(spark, sf).withColumn("err", F.col("loss")), "equal", 0.5)
    return t.select("vid", "g", r6("w_new"), r6("lam_new"))


@query(
    "adaptive_weight_step",
    f"""WITH {VECTORS}, a AS (SELECT *, max(risk) OVER (PARTITION BY vid) AS top FROM vec),
    b AS (SELECT *, best IS NULL OR best > top AS improved, CASE WHEN best IS NULL OR best > top THEN top ELSE best END AS best_new FROM a),
    c AS (SELECT *, CASE WHEN improved THEN least(k, k_min) ELSE k + 1 END AS k_new, CASE WHEN risk >= best_new THEN 1.0::DOUBLE ELSE 0.0 END AS hit FROM b),
    d AS (SELECT *, 0.5 * mu + coalesce(hit / nullif(sum(hit) OVER (PARTITION BY vid), 0), NULL) * 0.5 / k_new AS m FROM c)
    SELECT vid, g, {r('m / sum(m) OVER (PARTITION BY vid)', 'mu_new')}, {r('best_new', 'best_new')}, k_new, improved FROM d""",
)
def adaptive_weight_step(spark, sf):
    t = D.worst_weight_step(vectors(spark, sf), 0.5)
    return t.select("vid", "g", r6("mu_new"), r6("best_new"), big("k_new"), "improved")


MIX = "mx AS (SELECT *, avg(err) OVER (PARTITION BY g ORDER BY round ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS mix_err FROM hist)"
POP = """po AS (SELECT round, sum(err * n) / sum(n) AS pop_err FROM hist GROUP BY round),
mp AS (SELECT *, avg(pop_err) OVER (ORDER BY round ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS mix_pop_err FROM po),
tj AS (SELECT mp.round, mix_pop_err AS pop_err, max(mix_err) AS max_group_err FROM mp JOIN mx USING (round) GROUP BY ALL)"""


@query("history_group_errors", f"WITH {HISTORY}, {MIX} SELECT round, g, {r('err', 'err')}, {r('mix_err', 'mix_err')} FROM mx")
def history_group_errors(spark, sf):
    return H.group_errors(history(spark, sf)).select("round", "g", r6("err"), r6("mix_err"))


@query("history_population_error", f"WITH {HISTORY}, {MIX}, {POP} SELECT round, {r('pop_err', 'pop_err')}, {r('mix_pop_err', 'mix_pop_err')} FROM mp")
def history_population_error(spark, sf):
    return H.mixture_pop_error(history(spark, sf)).select("round", r6("pop_err"), r6("mix_pop_err"))


@query("history_trajectory", f"WITH {HISTORY}, {MIX}, {POP} SELECT round, {r('pop_err', 'pop_err')}, {r('max_group_err', 'max_group_err')} FROM tj")
def history_trajectory(spark, sf):
    return H.trajectory(history(spark, sf)).select("round", r6("pop_err"), r6("max_group_err"))


@query("history_highest_gamma", f"WITH {HISTORY}, {MIX}, {POP} SELECT {r('max_group_err', 'highest_gamma')} FROM tj ORDER BY pop_err, max_group_err LIMIT 1")
def history_highest_gamma(spark, sf):
    return H.highest_gamma(history(spark, sf)).select(r6("highest_gamma"))


ITEMS = """it AS (SELECT p_partkey AS id, p_retailprice AS a, p_size::DOUBLE AS b, d AS c FROM part JOIN
  (SELECT l_partkey, max(l_discount) AS d FROM lineitem GROUP BY l_partkey) ON l_partkey = p_partkey)"""


def _items(spark, sf):
    d = table(spark, sf, "lineitem").groupBy("l_partkey").agg(F.max("l_discount").alias("c"))
    p = table(spark, sf, "part")
    return p.join(d, p.p_partkey == d.l_partkey).select(
        F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("a"), F.col("p_size").cast("double").alias("b"), "c"
    )


@query("pareto_flags", f"WITH {ITEMS} SELECT id, CAST(NOT EXISTS (SELECT 1 FROM it o WHERE o.id <> it.id AND it.a - o.a >= 0 AND it.b - o.b >= 0 AND it.c - o.c >= 0) AS INT) AS kept FROM it")
def pareto_flag_query(spark, sf):
    return pareto_flags(_items(spark, sf), "id", ["a", "b", "c"]).select("id", "kept")


@query(
    "pareto_flags_with_margin",
    f"WITH {ITEMS} SELECT id, CAST(NOT EXISTS (SELECT 1 FROM it o WHERE o.id <> it.id AND it.a - o.a >= 0.015625 AND it.b - o.b >= 0.015625 AND it.c - o.c >= 0.015625) AS INT) AS kept FROM it",
)
def pareto_flags_with_margin(spark, sf):
    return pareto_flags(_items(spark, sf), "id", ["a", "b", "c"], eps=0.015625).select("id", "kept")
