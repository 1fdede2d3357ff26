"""Queries on subgroups, weights and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..lookup import pin
from ..operators import groups as G
from ..operators import splits as S
from .bindings import EVENTS, SCORED, key_sql, scored_events, scored_orders
from .registry import big, query, r, r6, table

BANDS = "CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'middle' ELSE 'large' END"


@query(
    "group_from_rules",
    f"""SELECT p_partkey, CASE WHEN p_type IN ('PROMO', 'ECONOMY') THEN p_type ELSE 'Other' END || '_' || {BANDS} || '_' ||
    CASE WHEN p_retailprice > 950 THEN 'Older' ELSE 'Under' END AS group_name FROM part""",
)
def group_from_rules(spark, sf):
    rules = [
        G.Keep("p_type", ("PROMO", "ECONOMY")),
        G.Bands("p_size", (10, 30), ("small", "middle", "large")),
        G.Above("p_retailprice", 950, "Older", "Under"),
    ]
    return G.subgroup(table(spark, sf, "part"), rules).select("p_partkey", "group_name")


@query("group_from_onehot", "SELECT c_custkey, 'nation ' || c_nationkey AS group_name FROM customer")
def group_from_onehot(spark, sf):
    from ..operators.features import OneHot

    t = table(spark, sf, "customer").select("c_custkey", F.concat(F.lit("nation "), "c_nationkey").alias("n"))
    hot = OneHot(["n"], drop=None).fit(t).transform(t)
    return G.subgroup_from_onehot(hot, "n_").select("c_custkey", "group_name")


RANKED = "{t} AS (SELECT {c}, dense_rank() OVER (ORDER BY {c}) - 1 AS id FROM (SELECT DISTINCT {c} FROM scored))"


@query("group_encode", f"WITH {SCORED}, {RANKED.format(t='a', c='g')} SELECT row_id, g, CAST(id AS BIGINT) AS gid FROM scored JOIN a USING (g)")
def group_encode(spark, sf):
    t, _ = G.encode_groups(scored_orders(spark, sf), "g", out="gid")
    return t.select("row_id", "g", big("gid"))


@query(
    "group_encode_several",
    f"WITH {SCORED}, {RANKED.format(t='a', c='g')}, {RANKED.format(t='b', c='g2')} SELECT row_id, CAST(a.id AS BIGINT) AS g_0, CAST(b.id AS BIGINT) AS g_1 FROM scored JOIN a USING (g) JOIN b USING (g2)",
)
def group_encode_several(spark, sf):
    t, _ = G.encode_groups(scored_orders(spark, sf), ["g", "g2"])
    return t.select("row_id", big("g_0"), big("g_1"))


@query(
    "group_profile",
    f"""WITH {SCORED}, s AS (SELECT g, count(*) AS n, sum(y) AS p FROM scored GROUP BY g)
    SELECT g, n, CAST(p AS BIGINT) AS n_pos, CAST(n - p AS BIGINT) AS n_neg, {r('n / sum(n) OVER ()', 'share')}, {r('p / sum(n) OVER ()', 'positive_rate')},
    {r('(n - p) / sum(n) OVER ()', 'negative_rate')} FROM s""",
)
def group_profile(spark, sf):
    t = G.group_profile(scored_orders(spark, sf))
    return t.select("g", "n", "n_pos", "n_neg", r6("share"), r6("positive_rate"), r6("negative_rate"))


@query("group_sizes", f"WITH {SCORED} SELECT g, g2, count(*) AS n, CAST(sum(y) AS BIGINT) AS n_pos, CAST(sum(1 - y) AS BIGINT) AS n_neg FROM scored GROUP BY g, g2")
def group_sizes(spark, sf):
    return G.group_sizes(scored_orders(spark, sf), ["g", "g2"])


@query("group_ratio", f"WITH {SCORED} SELECT g, {r('(SELECT count(*) FROM scored) / count(*)', 'ratio')} FROM scored GROUP BY g")
def group_ratio(spark, sf):
    return G.group_ratio(scored_orders(spark, sf)).select("g", r6("ratio"))


@query("group_inverse_frequency", f"SELECT doc_id, lang, {r('(SELECT count(*) FROM documents) / count(*) OVER (PARTITION BY lang)', 'weight')} FROM documents")
def group_inverse_frequency(spark, sf):
    t = table(spark, sf, "documents").select("doc_id", "lang")
    return G.inverse_frequency_weight(t, "lang").select("doc_id", "lang", r6("weight"))


@query("group_resample")
def group_resample(spark, sf):
    """Events resampled so that every user bucket has the same expected weight."""
    t = G.inverse_frequency_weight(scored_events(spark, sf), "g")
    return G.resample_balanced(t, "row_id", "weight", seed="epoch").select("row_id", "g", "copy")


@query("group_row_scale", f"WITH {SCORED} SELECT row_id, {r('(SELECT count(*) FROM scored) / count(*) OVER (PARTITION BY g)', 'n_over_ng')} FROM scored")
def group_row_scale(spark, sf):
    return G.group_scale(scored_orders(spark, sf)).select("row_id", r6("n_over_ng"))


def _state(t, g, scale):
    """Group sizes with illustrative weights and multipliers."""
    sizes = pin(G.group_sizes(t, [g])).frame
    total = sizes.agg(F.sum("n").alias("total")).withColumn("_k", F.lit(1))
    s = sizes.withColumn("_k", F.lit(1)).join(total, "_k").drop("_k")
    return s.withColumns({"w": F.col("n") / F.col("total") + scale, "lam": F.col("n_pos") / F.col("total") - 0.05})


STATE = """{t} AS (SELECT {g}, count(*) AS n, sum(y) AS np, count(*) - sum(y) AS nn, (SELECT count(*) FROM scored) AS total,
  count(*) / (SELECT count(*) FROM scored) + {s} AS w, sum(y) / (SELECT count(*) FROM scored) - 0.05::DOUBLE AS lam FROM scored GROUP BY {g})"""


@query(
    "group_row_weights",
    f"""WITH {SCORED}, {STATE.format(t='a', g='g', s=0)}, {STATE.format(t='b', g='g2', s=0.1)}
    SELECT row_id, {r('1000 * (a.w / a.n + b.w / b.n) / 2', 'total_weight')}, {r('1000 * ((1.0::DOUBLE / a.total + CASE WHEN y = 1 THEN a.lam / a.np ELSE 0 END) + (1.0::DOUBLE / b.total + CASE WHEN y = 1 THEN b.lam / b.np ELSE 0 END)) / 2', 'fn_weight')},
    {r('1000 * (1.0::DOUBLE / a.total + CASE WHEN y = 0 THEN a.lam / a.nn ELSE 0 END)', 'fp_weight')}
    FROM scored JOIN a USING (g) JOIN b USING (g2)""",
)
def group_row_weights(spark, sf):
    t = scored_orders(spark, sf)
    a, b = _state(t, "g", 0.0), _state(t, "g2", 0.1)
    plain = {"g": G.game_weight_table(a, group="g"), "g2": G.game_weight_table(b, group="g2")}
    fn = {"g": G.game_weight_table(a, "FN", True, "g"), "g2": G.game_weight_table(b, "FN", True, "g2")}
    out = G.row_weights(t, plain, out="total_weight")
    out = G.row_weights(out, fn, out="fn_weight")
    out = G.row_weights(out, {"g": G.game_weight_table(a, "FP", True, "g")}, out="fp_weight")
    scaled = [r6(F.col(c) * 1000, c) for c in ("total_weight", "fn_weight", "fp_weight")]
    return out.select("row_id", *scaled)


@query(
    "group_row_weights_shifted",
    f"""WITH {SCORED}, {STATE.format(t='a', g='g', s=-0.2)}, m AS (SELECT least(min(w / n), 0) AS low FROM a)
    SELECT row_id, {r('1000 * (w / n - low)', 'weight')} FROM scored JOIN a USING (g), m""",
)
def group_row_weights_shifted(spark, sf):
    t = scored_orders(spark, sf)
    out = G.row_weights(t, {"g": G.game_weight_table(_state(t, "g", -0.2), group="g")}, shift_negative=True)
    return out.select("row_id", r6(F.col("weight") * 1000, "weight"))


@query("group_row_weights_mu", f"WITH {EVENTS} SELECT row_id, {r('(g + 1) / 36.0', 'weight')} FROM ev")
def group_row_weights_mu(spark, sf):
    t = scored_events(spark, sf)
    mu = t.select("g").distinct().withColumn("mu", (F.col("g") + 1) / 36.0)
    return G.row_weights_mu(t, mu).select("row_id", r6("weight"))


def _allocate_sql(src: str, by: str, label: str, n: str, take: str, out: str) -> str:
    return f"""(SELECT * EXCLUDE (f, q), f + CASE WHEN row_number() OVER (PARTITION BY {by} ORDER BY round(q - f, 9) DESC, {label}) <= {take} - sum(f) OVER (PARTITION BY {by}) THEN 1 ELSE 0 END AS {out}
      FROM (SELECT *, coalesce({take} * {n} / nullif(sum({n}) OVER (PARTITION BY {by}), 0), 0) AS q, CAST(floor(coalesce({take} * {n} / nullif(sum({n}) OVER (PARTITION BY {by}), 0), 0)) AS BIGINT) AS f FROM {src}))"""


@query(
    "split_by_group",
    f"""WITH {SCORED}, c AS (SELECT g, y, count(*) AS n, CAST(floor(sum(count(*)) OVER (PARTITION BY g) * 20 / 100) AS BIGINT) AS take FROM scored GROUP BY g, y),
    t AS {_allocate_sql('c', 'g', 'y', 'n', 'take', 'n_test')},
    v AS (SELECT *, n - n_test AS rest FROM t), w AS {_allocate_sql('v', 'g', 'y', 'rest', 'take', 'n_val')},
    o AS (SELECT row_id, g, y, row_number() OVER (PARTITION BY g, y ORDER BY {key_sql('split', 'row_id')}) AS k FROM scored)
    SELECT row_id, CASE WHEN k <= n_test THEN 'test' WHEN k <= n_test + n_val THEN 'val' ELSE 'train' END AS split FROM o JOIN w USING (g, y)""",
)
def split_by_group(spark, sf):
    t = scored_orders(spark, sf).select("row_id", "g", "y")
    return S.split_by_group(t, "row_id", 20).select("row_id", "split")


@query(
    "split_by_group_unstratified",
    f"""WITH {SCORED}, o AS (SELECT row_id, row_number() OVER (PARTITION BY g ORDER BY {key_sql('split', 'row_id')}) AS k, floor(count(*) OVER (PARTITION BY g) * 10 / 100) AS t FROM scored)
    SELECT row_id, CASE WHEN k <= t THEN 'test' WHEN k <= 2 * t THEN 'val' ELSE 'train' END AS split FROM o""",
)
def split_by_group_unstratified(spark, sf):
    t = scored_orders(spark, sf).select("row_id", "g")
    return S.split_by_group(t, "row_id", 10, y=None).select("row_id", "split")


@query("split_folds", f"WITH {SCORED} SELECT row_id, CAST(ntile(5) OVER (PARTITION BY y ORDER BY {key_sql('fold', 'row_id')}) - 1 AS BIGINT) AS fold FROM scored")
def split_folds(spark, sf):
    return S.assign_folds(scored_orders(spark, sf).select("row_id", "y"), "row_id", 5).select("row_id", big("fold"))


def _val_sql(src: str, seed: str, num: int, den: int) -> str:
    return f"""gc AS (SELECT g, count(*) AS n, 0 AS one, CAST(ceil(sum(count(*)) OVER () * {num} / {den}) AS BIGINT) AS take FROM {src} GROUP BY g),
    ga AS {_allocate_sql('gc', 'one', 'g', 'n', 'take', 'n_val')},
    gv AS (SELECT row_id, CASE WHEN row_number() OVER (PARTITION BY g ORDER BY {key_sql(seed, 'row_id')}) <= n_val THEN 'val' ELSE 'train' END AS split FROM {src} JOIN ga USING (g))"""


@query(
    "split_kfold",
    f"""WITH {SCORED}, f AS (SELECT row_id, g, ntile(4) OVER (PARTITION BY y ORDER BY {key_sql('fold', 'row_id')}) - 1 AS fold FROM scored),
    rest AS (SELECT row_id, g FROM f WHERE fold <> 1), {_val_sql('rest', 'fold-val', 1, 3)}
    SELECT row_id, 'test' AS split FROM f WHERE fold = 1 UNION ALL SELECT row_id, split FROM gv""",
)
def split_kfold(spark, sf):
    t = scored_orders(spark, sf).select("row_id", "g", "y")
    return S.kfold(t, "row_id", 4, 1).select("row_id", "split")


@query(
    "split_holdout_kfold",
    f"""WITH {SCORED}, o AS (SELECT row_id, y, row_number() OVER (ORDER BY {key_sql('fold-test', 'row_id')}) AS k FROM scored),
    rest AS (SELECT row_id, ntile(4) OVER (PARTITION BY y ORDER BY {key_sql('fold', 'row_id')}) - 1 AS fold FROM o WHERE k > ceil((SELECT count(*) FROM scored) * 20 / 100))
    SELECT row_id, 'test' AS split FROM o WHERE k <= ceil((SELECT count(*) FROM scored) * 20 / 100)
    UNION ALL SELECT row_id, CASE WHEN fold = 2 THEN 'val' ELSE 'train' END FROM rest""",
)
def split_holdout_kfold(spark, sf):
    t = scored_orders(spark, sf).select("row_id", "y")
    return S.holdout_kfold(t, "row_id", 4, 2).select("row_id", "split")


@query(
    "split_validation",
    f"""WITH {SCORED} SELECT row_id, CASE WHEN row_number() OVER (PARTITION BY g ORDER BY {key_sql('val', 'row_id')}) <= ceil(count(*) OVER (PARTITION BY g) * 25 / 100) THEN 'val' ELSE 'train' END AS one_type,
    CASE WHEN row_number() OVER (ORDER BY {key_sql('val', 'row_id')}) <= ceil(count(*) OVER () * 25 / 100) THEN 'val' ELSE 'train' END AS several FROM scored""",
)
def split_validation(spark, sf):
    t = scored_orders(spark, sf).select("row_id", "g", "g2")
    one = S.validation_split(t, "row_id", 25, ["g"], out="one_type")
    return S.validation_split(one, "row_id", 25, ["g", "g2"], out="several").select("row_id", "one_type", "several")


@query(
    "split_ratio",
    f"""WITH o AS (SELECT event_id, row_number() OVER (ORDER BY {key_sql('ratio', 'event_id')}) AS k, count(*) OVER () AS n FROM events)
    SELECT event_id, CASE WHEN k <= floor(n * 60 / 100) THEN 'train' WHEN k <= floor(n * 80 / 100) THEN 'val' ELSE 'test' END AS split FROM o""",
)
def split_ratio(spark, sf):
    return S.ratio_split(table(spark, sf, "events").select("event_id"), "event_id").select("event_id", "split")
