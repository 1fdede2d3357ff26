"""Queries on probability vectors and calibration."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import calibration as C
from .bindings import MULTI, SCORED, multi, scored_orders
from .registry import big, query, r, r6

# Floating-point edges of ten equal bins.
EDGES = "[0.0, 0.1, 0.2, 0.30000000000000004, 0.4, 0.5, 0.6000000000000001, 0.7000000000000001, 0.8, 0.9]"

VM = """
vm AS (SELECT row_id, g, y, p, list_max(p) AS conf, CAST(list_position(p, list_max(p)) - 1 = y AS DOUBLE) AS hit,
  list_sum(list_transform(range(1, len(p) + 1), lambda i: (p[i] - CAST(i - 1 = y AS DOUBLE)) * (p[i] - CAST(i - 1 = y AS DOUBLE)))) AS bs,
  -ln(greatest(p[y + 1], 1e-20::DOUBLE)) AS ce, list_sum(list_transform(p, lambda x: -x * ln(x))) AS ent FROM {src})"""
BIN = f"""
bn AS (SELECT *, len(list_filter({EDGES}::DOUBLE[], lambda e: e <= conf)) - 1 AS bin FROM vm),
rel AS (SELECT {{k}}bin, count(*) AS n, avg(conf) AS mean_conf, avg(hit) AS acc FROM bn GROUP BY {{k}}bin),
cal AS (SELECT {{k}}sum(abs(mean_conf - acc) * n) / sum(n) AS ece, max(abs(mean_conf - acc)) AS mce FROM rel {{g}})"""


@query(
    "calibration_vector_metrics",
    f"""WITH {MULTI}, {VM.format(src='multi')} SELECT g, count(*) AS n, {r('avg(bs)', 'brier')}, {r('avg(ce)', 'ce')}, {r('avg(hit)', 'acc')},
    {r('avg(conf)', 'confidence')}, {r('avg(ent)', 'entropy')} FROM vm GROUP BY g""",
)
def calibration_vector_metrics(spark, sf):
    t = C.vector_metrics(multi(spark, sf), ["g"])
    return t.select("g", big("n"), *[r6(c) for c in ("brier", "ce", "acc", "confidence", "entropy")])


def _binary(spark, sf):
    """Two-class vectors whose confidence covers the upper bins."""
    t = scored_orders(spark, sf)
    return t.select("row_id", "g", "y", F.array(1 - F.col("score"), F.col("score")).alias("p"))


PAIR = SCORED + ", pair AS (SELECT row_id, g, y, [1 - score, score] AS p FROM scored)"


@query(
    "calibration_reliability",
    f"WITH {PAIR}, {VM.format(src='pair')}, {BIN.format(k='g, ', g='GROUP BY g')} SELECT g, CAST(bin AS BIGINT) AS bin, n, {r('mean_conf', 'mean_conf')}, {r('acc', 'acc')} FROM rel",
)
def calibration_reliability(spark, sf):
    t = C.reliability(_binary(spark, sf), ["g"])
    return t.select("g", big("bin"), big("n"), r6("mean_conf"), r6("acc"))


@query(
    "calibration_errors",
    f"WITH {PAIR}, {VM.format(src='pair')}, {BIN.format(k='g, ', g='GROUP BY g')} SELECT g, {r('ece', 'ece')}, {r('mce', 'mce')} FROM cal",
)
def calibration_errors(spark, sf):
    return C.calibration_errors(_binary(spark, sf), ["g"]).select("g", r6("ece"), r6("mce"))


REPORT = ("ratio", "acc", "bs", "ce", "entropy", "ece", "mce", "acc_prior")


@query(
    "calibration_group_report",
    f"""WITH {MULTI}, {VM.format(src='multi')}, {BIN.format(k='g, ', g='GROUP BY g')},
    base AS (SELECT g, count(*) / (SELECT count(*) FROM vm) AS ratio, avg(hit) AS acc, avg(bs) AS bs, avg(ce) AS ce, avg(ent) AS entropy FROM vm GROUP BY g),
    cls AS (SELECT g, max(c) / sum(c) AS acc_prior FROM (SELECT g, y, count(*) AS c FROM vm GROUP BY g, y) GROUP BY g)
    SELECT g, {', '.join(r(c, c) for c in REPORT)} FROM base JOIN cal USING (g) JOIN cls USING (g)""",
)
def calibration_group_report(spark, sf):
    t = C.group_report(multi(spark, sf))
    return t.select("g", *[r6(c) for c in REPORT])
