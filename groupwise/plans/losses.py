"""Queries on row-level losses, errors and gradients."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import losses as L
from ..functions import vectors as V
from ..operators.dual import mixed_grad_hess
from ..operators.groups import group_ratio
from .bindings import MULTI, REGRESSION, SCORED, multi, regression_orders, scored_orders
from .registry import big, query, r, r6, table

Q = "least(greatest(score, 1e-15::DOUBLE), 1 - 1e-15::DOUBLE)"
LL = f"-(y * ln({Q}) + (1 - y) * ln(1 - {Q}))"


@query("loss_logloss", f"WITH {SCORED} SELECT row_id, {r(LL, 'loss')} FROM scored")
def loss_logloss(spark, sf):
    return scored_orders(spark, sf).select("row_id", r6(L.logloss("y", "score"), "loss"))


@query("loss_sigmoid", f"WITH {SCORED} SELECT row_id, {r('least(greatest(1 / (1 + exp(-margin * 10)), 1e-7::DOUBLE), 1 - 1e-7::DOUBLE)', 'p')} FROM scored")
def loss_sigmoid(spark, sf):
    return scored_orders(spark, sf).select("row_id", r6(L.sigmoid(F.col("margin") * 10), "p"))


@query("loss_gradient", f"WITH {SCORED} SELECT row_id, {r('score - y', 'grad')}, {r('score * (1 - score)', 'hess')} FROM scored")
def loss_gradient(spark, sf):
    return scored_orders(spark, sf).select("row_id", r6(L.logloss_grad("y", "score"), "grad"), r6(L.logloss_hess("y", "score"), "hess"))


SHORT = {"equalized_loss": "eq", "positive_rate": "pr", "true_positive_rate": "tpr", "true_negative_rate": "tnr"}
KIND_SQL = {
    "eq": LL,
    "pr": f"-ln({Q})",
    "tpr": f"CASE WHEN y = 1 THEN -ln({Q}) END",
    "tnr": f"CASE WHEN y = 0 THEN -ln(1 - {Q}) END",
}


@query("loss_constraint", f"WITH {SCORED} SELECT row_id, {', '.join(r(s, k) for k, s in KIND_SQL.items())} FROM scored")
def loss_constraint(spark, sf):
    return scored_orders(spark, sf).select("row_id", *[r6(L.constraint_loss("y", "score", k), s) for k, s in SHORT.items()])


H = "score * (1 - score)"
GRAD_SQL = {"eq": ("score - y", H), "pr": ("score - 1", H)} | {
    k: (f"CASE WHEN y = {v} THEN score - {v} ELSE 0 END", f"CASE WHEN y = {v} THEN {H} ELSE 0 END") for k, v in (("tpr", 1), ("tnr", 0))
}


@query(
    "loss_constraint_gradient",
    f"WITH {SCORED} SELECT row_id, "
    + ", ".join(f"{r(g, 'grad_' + k)}, {r(h, 'hess_' + k)}" for k, (g, h) in GRAD_SQL.items())
    + " FROM scored",
)
def loss_constraint_gradient(spark, sf):
    cols = []
    for kind, name in SHORT.items():
        cols += [r6(L.constraint_grad("y", "score", kind), f"grad_{name}"), r6(L.constraint_hess("y", "score", kind), f"hess_{name}")]
    return scored_orders(spark, sf).select("row_id", *cols)


@query(
    "loss_squared",
    f"WITH {REGRESSION} SELECT row_id, {r('(y - yhat) * (y - yhat)', 'loss')}, {r('2 * (yhat - y)', 'grad')}, 2.0::DOUBLE AS hess FROM reg",
)
def loss_squared(spark, sf):
    return regression_orders(spark, sf).select("row_id", r6(L.sq_loss("y", "yhat"), "loss"), r6(L.sq_grad("y", "yhat"), "grad"), L.sq_hess().alias("hess"))


ERR_SQL = {
    "mse": "(y - pred) * (y - pred)",
    "zero_one": "CAST(y <> pred AS INT)",
    "fp": "CAST(y < pred AS INT)",
    "fn": "CAST(y > pred AS INT)",
    "ll": LL,
    "fp_ll": f"CAST(y < pred AS INT) * ({LL})",
    "fn_ll": f"CAST(y = 1 AS INT) * ({LL})",
}


@query("loss_error_types", f"WITH {SCORED} SELECT row_id, {', '.join(r(f'({s})::DOUBLE', k) for k, s in ERR_SQL.items())} FROM scored")
def loss_error_types(spark, sf):
    made = [r6(L.sample_error("y", "pred", "score", kind).cast("double"), name) for kind, name in zip(L.ERROR_TYPES, ERR_SQL)]
    return scored_orders(spark, sf).select("row_id", *made)


@query("loss_hard_decision", f"WITH {SCORED} SELECT row_id, CAST(y <> CAST(score > 0.5 AS INT) AS BIGINT) AS missed FROM scored")
def loss_hard_decision(spark, sf):
    return scored_orders(spark, sf).select("row_id", big(L.zero_one("y", "score"), "missed"))


@query(
    "loss_penalty",
    f"""SELECT vec_id, {r("list_sum(list_transform(embedding, lambda x: abs(x::DOUBLE))) / 4.0", 'l1')},
    {r("list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)) / 8.0", 'l2')} FROM embeddings""",
)
def loss_penalty(spark, sf):
    coef = F.transform("embedding", lambda x: x.cast("double"))
    return table(spark, sf, "embeddings").select("vec_id", r6(L.penalty(coef, "l1", 4.0), "l1"), r6(L.penalty(coef, "l2", 4.0), "l2"))


VEC = """
oh AS (SELECT row_id, logits, p, list_transform(range(0, 10), lambda k: CAST(k = y AS DOUBLE)) AS t FROM multi),
z AS (SELECT *, list_max(logits) + ln(list_sum(list_transform(logits, lambda x: exp(x - list_max(logits))))) AS lse FROM oh)"""


@query(
    "loss_vector",
    f"""WITH {MULTI}, {VEC} SELECT row_id,
    {r("list_sum(list_transform(range(1, 11), lambda i: t[i] * (lse - logits[i]))) / 10", 'ce_mean')},
    {r("list_sum(list_transform(range(1, 11), lambda i: abs(p[i] - t[i])))", 'l1_sum')},
    {r("list_sum(list_transform(range(1, 11), lambda i: (p[i] - t[i]) * (p[i] - t[i]))) / 10", 'brier_mean')} FROM z""",
)
def loss_vector(spark, sf):
    t = multi(spark, sf).withColumn("t", V.to_categorical("y", 10))
    return t.select(
        "row_id",
        r6(V.vector_loss("t", "logits", "ce", "mean"), "ce_mean"),
        r6(V.vector_loss("t", "logits", "l1", "sum"), "l1_sum"),
        r6(V.vector_loss("t", "logits", "brier", "mean"), "brier_mean"),
    )


@query("loss_entropy", f"WITH {MULTI} SELECT row_id, {r('list_sum(list_transform(p, lambda x: -x * ln(x)))', 'entropy')} FROM multi")
def loss_entropy(spark, sf):
    return multi(spark, sf).select("row_id", r6(V.entropy("p"), "entropy"))


@query(
    "loss_mixed_gradient",
    f"""WITH {SCORED}, st AS (SELECT g, 0.5 * count(*) / (SELECT count(*) FROM scored) AS mu,
      (SELECT count(*) FROM scored)::DOUBLE / count(*) AS s FROM scored GROUP BY g)
    SELECT row_id, {r("0.5 * (score - y) + s * mu * CASE WHEN y = 1 THEN score - 1 ELSE 0 END", 'grad')},
      {r("0.5 * score * (1 - score) + s * mu * CASE WHEN y = 1 THEN score * (1 - score) ELSE 0 END", 'hess')}
    FROM scored JOIN st USING (g)""",
)
def loss_mixed_gradient(spark, sf):
    t = scored_orders(spark, sf)
    mu = group_ratio(t).select("g", (0.5 / F.col("ratio")).alias("mu"), F.col("ratio").alias("n_over_ng"))
    out = mixed_grad_hess(t, mu, 0.5, "true_positive_rate")
    return out.select("row_id", r6("grad"), r6("hess"))
