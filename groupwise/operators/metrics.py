"""Performance and group-fairness metrics from one aggregation.

:func:`group_stats` reduces a scored frame ``(row_id, y, score, pred, g)`` once, with map-side partial sums, to one row of sufficient
statistics per group (and per model, split, window ... if asked). Every metric is then arithmetic on those few rows. A ratio with an
empty denominator is NULL, and NULL groups are skipped by minima, maxima and ranges.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.losses import CONSTRAINTS, EVAL_EPS, constraint_loss, logloss
from ..functions.numeric import flag, ratio
from ..lookup import attach, pin
from .ranks import prefix_sums, quantile_edges, with_bucket

COUNTS = ("n", "pos", "tp", "fp", "tn", "fn")
SUMS = ("sum_ll", "sum_ll_pos")
PERFORMANCE = ("acc", "bal_acc", "roc_auc")
FAIRNESS = ("eod", "spd", "min_tpr", "min_pr", "min_bal_acc", "min_acc")


def stat_exprs(y: str = "y", pred: str | None = "pred", score: str | None = "score") -> list[Column]:
    """Aggregate expressions of the sufficient statistics; usable in any ``groupBy`` (batch, window or stream)."""
    yc = F.col(y)
    decided = F.col(pred) if pred else flag(F.col(score) > 0.5)
    hit = lambda a, b: F.sum(flag((yc == a) & (decided == b)).cast("bigint"))
    out = [
        F.count(F.lit(1)).alias("n"),
        F.sum(flag(yc == 1).cast("bigint")).alias("pos"),
        hit(1, 1).alias("tp"),
        hit(0, 1).alias("fp"),
        hit(0, 0).alias("tn"),
        hit(1, 0).alias("fn"),
    ]
    if score:
        ll = logloss(yc, F.col(score))
        out += [F.sum(ll).alias("sum_ll"), F.sum(F.when(yc == 1, ll)).alias("sum_ll_pos")]
    return out


def group_stats(sf: DataFrame, by: Sequence[str] = ("g",), y: str = "y", pred: str | None = "pred", score: str | None = "score") -> DataFrame:
    """Sufficient statistics per key."""
    return sf.groupBy(*by).agg(*stat_exprs(y, pred, score))


def collect_stats(sf: DataFrame, by: Sequence[str] = ("g",), y: str = "y", pred: str | None = "pred", score: str | None = "score") -> DataFrame:
    """Sufficient statistics evaluated once, for several results derived from them: the rows are read a single time."""
    return pin(group_stats(sf, by, y, pred, score)).frame


def merge_stats(stats: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Statistics of coarser keys (overall with ``by=()``) from those of finer ones."""
    sums = [c for c in (*COUNTS, *SUMS) if c in stats.columns]
    return stats.groupBy(*by).agg(*[F.sum(c).alias(c) for c in sums])


def rate_exprs(stats: DataFrame) -> dict[str, Column]:
    """Metric columns computable from the statistics at hand."""
    tpr, tnr = ratio("tp", "pos"), ratio("tn", F.col("fp") + F.col("tn"))
    out = {
        "tpr": tpr,
        "fpr": ratio("fp", F.col("fp") + F.col("tn")),
        "fnr": ratio("fn", "pos"),
        "tnr": tnr,
        "acc": ratio(F.col("tp") + F.col("tn"), "n"),
        "pr": ratio(F.col("tp") + F.col("fp"), "n"),
        "precision": F.coalesce(ratio("tp", F.col("tp") + F.col("fp")), F.when(F.col("n") > 0, F.lit(0.0))),
        "recall": F.coalesce(tpr, F.when(F.col("n") > 0, F.lit(0.0))),
        "bal_acc": F.coalesce((tpr + tnr) / 2, tpr, tnr),
    }
    if "sum_ll" in stats.columns:
        out["logloss"] = ratio("sum_ll", "n")
        out["logloss_pos"] = ratio("sum_ll_pos", "pos")
    return out


def rates(stats: DataFrame, keys: Sequence[str] = ("g",), only: Sequence[str] | None = None) -> DataFrame:
    """Keys plus metric columns (TPR, FPR, FNR, TNR, accuracy, positive rate, precision, recall, balanced accuracy, log-losses)."""
    exprs = rate_exprs(stats)
    return stats.select(*keys, *[exprs[m].alias(m) for m in (only or exprs)])


def performance(stats: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Accuracy, precision (0 if nothing is predicted positive), recall, balanced accuracy over the classes present, log-loss."""
    only = [m for m in ("bal_acc", "precision", "acc", "recall", "logloss") if m != "logloss" or "sum_ll" in stats.columns]
    return rates(merge_stats(stats, by), by, only)


def group_range(stats: DataFrame, metric: str, by: Sequence[str] = ()) -> DataFrame:
    """Largest minus smallest group value."""
    return rates(stats, [*by, "g"], [metric]).groupBy(*by).agg((F.max(metric) - F.min(metric)).alias(f"{metric}_range"))


def signed_difference(stats: DataFrame, metric: str, low, high, by: Sequence[str] = ()) -> DataFrame:
    """Group ``high`` minus group ``low``, the two-group form of the range."""
    value = lambda k: F.max(F.when(F.col("g") == F.lit(k), F.col(metric)))
    return rates(stats, [*by, "g"], [metric]).groupBy(*by).agg((value(high) - value(low)).alias(f"{metric}_diff"))


def difference(stats: DataFrame, metric: str, by: Sequence[str] = (), signed: tuple | None = None) -> DataFrame:
    """Group difference of a metric (``tpr`` equal opportunity, ``pr`` statistical parity, ``logloss`` equalised loss).

    An unsigned range, or with ``signed=(low, high)`` the signed two-group difference.
    """
    return signed_difference(stats, metric, *signed, by=by) if signed else group_range(stats, metric, by)


def worst_group(stats: DataFrame, metric: str, by: Sequence[str] = ()) -> DataFrame:
    """``1 - min`` over groups, and the group attaining it (lowest id on ties)."""
    r = rates(stats, [*by, "g"], [metric]).where(F.col(metric).isNotNull())
    return r.groupBy(*by).agg(
        (1 - F.min(metric)).alias(f"worst_{metric}"), F.min(F.struct(metric, "g"))["g"].alias("worst_g")
    )


def max_rate(stats: DataFrame, metric: str, by: Sequence[str] = ()) -> DataFrame:
    """Largest group FNR or FPR; groups without positives (negatives) have no rate and are skipped."""
    return rates(stats, [*by, "g"], [metric]).groupBy(*by).agg(F.max(metric).alias(f"max_{metric}"))


def group_level(stats: DataFrame, metrics: Sequence[str], groups: Sequence | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Per-group metrics, long by default; with the list of ``groups`` one column ``<metric>_g=<group>`` per group."""
    r = rates(stats, [*by, "g"], list(metrics))
    if groups is None:
        return r
    cells = [F.max(F.when(F.col("g") == F.lit(k), F.col(m))).alias(f"{m}_g={k}") for m in metrics for k in groups]
    return r.groupBy(*by).agg(*cells)


def group_loglosses(
    sf: DataFrame, kinds: Sequence[str] = CONSTRAINTS, by: Sequence[str] = ("g",), y: str = "y", score: str = "score", eps: float = EVAL_EPS
) -> DataFrame:
    """Mean loss per group under several constraints, one row per ``(by, kind)``, from one aggregation.

    Each constraint averages the rows it looks at; a group without such rows gives NULL.
    """
    means = sf.groupBy(*by).agg(*[F.avg(constraint_loss(y, score, k, eps)).alias(k) for k in kinds])
    pairs = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("loss")) for k in kinds])
    return means.select(*by, F.inline(pairs))


def group_logloss(sf: DataFrame, kind: str, by: Sequence[str] = ("g",), y: str = "y", score: str = "score", eps: float = EVAL_EPS) -> DataFrame:
    """Mean constraint loss per group over the rows the constraint looks at."""
    return sf.groupBy(*by).agg(F.avg(constraint_loss(y, score, kind, eps)).alias("loss"))


def max_group_logloss(sf: DataFrame, kind: str, by: Sequence[str] = (), g: str = "g", **cols) -> DataFrame:
    return group_logloss(sf, kind, [*by, g], **cols).groupBy(*by).agg(F.max("loss").alias("max_loss"))


BUNDLE = ("min_acc", "min_bal_acc", "min_tpr", "min_pr", "max_logloss", "max_logloss_tpr", "eod", "spd", "eq_loss")


def _bundle_exprs() -> list[Column]:
    return [
        F.min("_acc").alias("min_acc"),
        F.min("_bal_acc").alias("min_bal_acc"),
        F.min("_tpr").alias("min_tpr"),
        F.min("_pr").alias("min_pr"),
        F.max("_logloss").alias("max_logloss"),
        F.max("_logloss_pos").alias("max_logloss_tpr"),
        (F.max("_tpr") - F.min("_tpr")).alias("eod"),
        (F.max("_pr") - F.min("_pr")).alias("spd"),
        (F.max("_logloss") - F.min("_logloss")).alias("eq_loss"),
    ]


def overview(stats: DataFrame, by: Sequence[str] = (), carry: Sequence[str] = ()) -> DataFrame:
    """Performance and fairness bundle side by side, from one second-level aggregation of the group statistics.

    ``carry`` names columns that are constant per key.
    """
    sums = [c for c in (*COUNTS, *SUMS) if c in stats.columns]
    exprs = rate_exprs(stats)
    grouped = stats.withColumns({f"_{m}": exprs[m] for m in ("acc", "bal_acc", "tpr", "pr", "logloss", "logloss_pos")})
    t = grouped.groupBy(*by).agg(*[F.sum(c).alias(c) for c in sums], *_bundle_exprs(), *[F.max(c).alias(c) for c in carry])
    whole = rate_exprs(t)
    return t.select(*by, *carry, *[whole[m].alias(m) for m in ("bal_acc", "precision", "acc", "recall", "logloss")], *BUNDLE)


def fairness_metrics(stats: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The fairness bundle of a classifier: raw group minima, largest log-losses and unsigned group ranges."""
    return overview(stats, by).select(*by, *BUNDLE)


def _score_table(sf: DataFrame, by: Sequence[str], y: str, score: str) -> DataFrame:
    """Positives and negatives per distinct score: repeated scores collapse before anything is sorted."""
    return sf.groupBy(*by, score).agg(
        F.sum(F.col(y).cast("bigint")).alias("p"), F.sum((1 - F.col(y)).cast("bigint")).alias("q")
    )


def _curve(sf: DataFrame, by: Sequence[str], y: str, score: str, descending: bool, buckets: int | None) -> DataFrame:
    edges = quantile_edges(sf, score, buckets)
    return prefix_sums(_score_table(sf, by, y, score), by, score, ["p", "q"], descending, edges=edges)


def roc_auc(sf: DataFrame, by: Sequence[str] = (), y: str = "y", score: str = "score", buckets: int | None = None) -> DataFrame:
    """Area under the ROC curve, ties counted half; NULL when a class is missing."""
    c = _curve(sf, by, y, score, False, buckets)
    won = F.sum(F.col("p").cast("double") * ((F.col("cum_q") - F.col("q")).cast("double") + F.col("q") / F.lit(2.0)))
    t = c.groupBy(*by).agg(won.alias("_w"), F.max("cum_p").alias("_p"), F.max("all_q").alias("_q"))
    return t.select(*by, ratio("_w", F.col("_p").cast("double") * F.col("_q")).alias("roc_auc"))


KS_BUCKETS = 1_024


def ks_threshold(sf: DataFrame, by: Sequence[str] = (), y: str = "y", score: str = "score", buckets: int = KS_BUCKETS) -> DataFrame:
    """Score that maximises ``tpr - fpr`` of the rule ``>= score``; the highest score on ties.

    When no score beats the empty rule the threshold is infinite. Apply it with a strict ``score > threshold``. The comparison uses
    integers (``tp * N - fp * P``), so ties are exact.

    Branch and bound: one aggregation counts both classes per score bucket, which gives the difference at every bucket's end and, as no rule inside a
    bucket can do better than to take its positives first, a bound inside it. Only rows of buckets whose bound reaches the best end are grouped by score.
    """
    by = list(by)
    rows = sf.select(*by, F.col(score).alias("_s"), F.col(y).cast("bigint").alias("_y"))
    edges = quantile_edges(rows, "_s", buckets)
    bucketed = with_bucket(rows, "_s", edges, "_b")
    counted = bucketed.groupBy(*by, "_b").agg(
        F.sum("_y").alias("p"), F.sum(1 - F.col("_y")).alias("q"), F.min("_s").alias("_low")
    )  # at most `buckets` rows per key
    table = pin(counted).frame
    down = Window.partitionBy(*by, F.lit(0)).orderBy(F.col("_b").desc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*by, F.lit(0))
    wide = lambda c: c.cast("decimal(19,0)")
    ends = table.select(
        *by, "_b", "p", "q", "_low", F.sum("p").over(down).alias("cum_p"), F.sum("q").over(down).alias("cum_q"),
        F.sum("p").over(whole).alias("_P"), F.sum("q").over(whole).alias("_N"),
    )
    ends = ends.withColumn("_d", wide(F.col("cum_p")) * wide(F.col("_N")) - wide(F.col("cum_q")) * wide(F.col("_P")))
    top = F.max(F.when(F.col("_b").isNotNull(), F.col("_d"))).over(whole)
    # at the start of the bucket plus all its positives; a bucket of one class has its best rule at an end
    bound = F.col("_d") + wide(F.col("q")) * wide(F.col("_P"))
    state = pin(ends.withColumn("_open", F.col("_b").isNotNull() & (F.col("p") > 0) & (bound >= F.greatest(top, F.lit(0))))).frame
    start = state.where("_open").select(*by, "_b", (F.col("cum_p") - F.col("p")).alias("_p0"), (F.col("cum_q") - F.col("q")).alias("_q0"), "_P", "_N")
    inside = attach(bucketed, start, [*by, "_b"], null_safe=True)
    scores = inside.groupBy(*by, "_b", "_s").agg(F.sum("_y").alias("p"), F.sum(1 - F.col("_y")).alias("q"), *[F.first(c).alias(c) for c in ("_p0", "_q0", "_P", "_N")])
    run = Window.partitionBy(*by, "_b").orderBy(F.col("_s").desc()).rowsBetween(Window.unboundedPreceding, 0)
    at = wide(F.col("_p0") + F.sum("p").over(run)) * wide(F.col("_N")) - wide(F.col("_q0") + F.sum("q").over(run)) * wide(F.col("_P"))
    options = scores.select(*by, at.alias("_d"), "_s", "_P", "_N").unionByName(state.select(*by, F.when(F.col("_b").isNotNull(), F.col("_d")).alias("_d"), F.col("_low").alias("_s"), "_P", "_N"))
    best = options.groupBy(*by).agg(F.max(F.when(F.col("_d").isNotNull(), F.struct("_d", "_s"))).alias("_b"), F.max("_P").alias("_P"), F.max("_N").alias("_N"))
    return best.select(
        *by,
        F.when(F.col("_b._d") > 0, F.col("_b._s")).otherwise(F.lit(float("inf"))).alias("threshold"),
        F.when(F.col("_b._d") > 0, ratio("_b._d", F.col("_P").cast("double") * F.col("_N"))).otherwise(F.lit(0.0)).alias("ks"),
    )


def _perf_and_fair(sf: DataFrame, by: Sequence[str], perf: Sequence[str], fair: Sequence[str], y, pred, score) -> DataFrame:
    """Every pair of metrics. Differences enter as ranges, group minima as ``1 - min``."""
    out = overview(group_stats(sf, [*by, "g"], y, pred, score), by)
    out = out.withColumns({m: 1 - F.col(m) for m in FAIRNESS if m.startswith("min_")})
    if "roc_auc" in perf:
        key = list(by) or ["_k"]
        auc = roc_auc(sf, by, y, score)
        out = out.join(auc, key) if by else out.withColumn("_k", F.lit(1)).join(auc.withColumn("_k", F.lit(1)), key)
    pairs = F.array(
        *[
            F.struct(F.lit(p).alias("perf_metric"), F.lit(f).alias("fair_metric"), F.col(p).alias("perf"), F.col(f).alias("fair"))
            for p in perf
            for f in fair
        ]
    )
    return out.select(*by, F.inline(pairs))


def combined_score(
    sf: DataFrame, alpha: float, perf: Sequence[str] = PERFORMANCE, fair: Sequence[str] = FAIRNESS, by: Sequence[str] = (), y="y", pred="pred", score="score"
) -> DataFrame:
    """``alpha * perf + (1 - alpha) * (1 - |fair|)`` for every pair of metrics asked for."""
    t = _perf_and_fair(sf, by, perf, fair, y, pred, score)
    return t.withColumn("score", alpha * F.col("perf") + (1 - alpha) * (1 - F.abs("fair")))


def goal_score(
    sf: DataFrame, goal: float, m: float = 10.0, perf: Sequence[str] = ("acc",), fair: Sequence[str] = ("eod",), by: Sequence[str] = (), y="y", pred="pred", score="score"
) -> DataFrame:
    """The performance where ``1 - |fair|`` reaches the goal, else the performance minus ``m`` times the gap."""
    t = _perf_and_fair(sf, by, perf, fair, y, pred, score).withColumn("fair", 1 - F.abs("fair"))
    missed = F.col("perf") - F.lit(float(m)) * F.abs(F.col("fair") - F.lit(goal))
    return t.withColumn("score", F.when(F.col("fair") >= F.lit(goal), F.col("perf")).otherwise(missed))


def regression_stats(sf: DataFrame, by: Sequence[str] = ("g",), y: str = "y", yhat: str = "yhat") -> DataFrame:
    d = F.col(y) - F.col(yhat)
    return sf.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum(d * d).alias("sum_se"))


def regression_metrics(sf: DataFrame, by: Sequence[str] = (), y: str = "y", yhat: str = "yhat") -> DataFrame:
    """Overall and worst-group mean squared error."""
    t = regression_stats(sf, [*by, "g"], y, yhat)
    return t.groupBy(*by).agg(
        ratio(F.sum("sum_se"), F.sum("n")).alias("mse"), F.max(ratio("sum_se", "n")).alias("max_mse")
    )


def group_mse(sf: DataFrame, by: Sequence[str] = (), y: str = "y", yhat: str = "yhat") -> DataFrame:
    """Mean squared error per group and the inverse share ``N / n_g``."""
    t = pin(regression_stats(sf, [*by, "g"], y, yhat)).frame
    key = list(by) or ["_k"]
    t = t if by else t.withColumn("_k", F.lit(1))
    total = t.groupBy(*key).agg(F.sum("n").alias("total"))
    return t.join(total, key).select(*by, "g", ratio("sum_se", "n").alias("mse"), ratio("total", "n").alias("ratio"))


def evaluate_regressions(
    long_sf: DataFrame, by: Sequence[str] = ("model", "split"), y: str = "y", yhat: str = "score", groups: Sequence | None = None, durations: DataFrame | None = None
) -> DataFrame:
    """Errors of all regressions on all splits in one aggregation: ``mse``, ``max_mse`` and per group ``ratio_g=<group>`` (``N / n_g``) and ``mse_g=<group>``.

    ``long_sf`` has one row per (model, split, row) with its group ``g``. ``groups`` become columns; without them all groups that occur do, within the lookup bound.
    """
    by = list(by)
    stats = pin(regression_stats(long_sf, [*by, "g"], y, yhat))
    if groups is None:
        names = pin(stats.frame.select("g").distinct())
        if not names.small:
            raise ValueError("more groups than a table has columns for; name those of interest")
        groups = sorted((r for r in names.rows["g"].to_pylist() if r is not None), key=str)
    total = F.sum("n").alias("n")
    cells = [F.max(F.when(F.col("g") == F.lit(k), F.col("n"))).alias(f"_n{i}") for i, k in enumerate(groups)]
    errors = [F.max(F.when(F.col("g") == F.lit(k), ratio("sum_se", "n"))).alias(f"mse_g={k}") for k in groups]
    t = stats.frame.groupBy(*by).agg(total, ratio(F.sum("sum_se"), F.sum("n")).alias("mse"), F.max(ratio("sum_se", "n")).alias("max_mse"), *cells, *errors)
    shares = [ratio("n", f"_n{i}").alias(f"ratio_g={k}") for i, k in enumerate(groups)]
    out = t.select(*by, "mse", "max_mse", *shares, *[F.col(f"`mse_g={k}`") for k in groups])
    return attach(out, durations, ["model"], how="left") if durations is not None else out


def evaluate_models(
    long_sf: DataFrame,
    thresholds: float | str = 0.5,
    by: Sequence[str] = ("model", "split"),
    train: str = "train",
    y: str = "y",
    score: str = "score",
    durations: DataFrame | None = None,
) -> DataFrame:
    """Performance and fairness bundle of all models on all splits in one aggregation.

    ``long_sf`` has one row per (model, split, row). ``thresholds`` is a number, or ``"ks"`` for each model's KS threshold on its train
    split. ``durations`` is an optional table ``(model, duration)``.
    """
    if thresholds == "ks":
        model = [c for c in by if c != "split"]
        cut = ks_threshold(long_sf.where(F.col("split") == train), model, y, score).select(*model, F.col("threshold").alias("thresh"))
        sf = attach(long_sf, cut, model)
    else:
        sf = long_sf.withColumn("thresh", F.lit(float(thresholds)))
    sf = sf.withColumn("_pred", flag(F.col(score) > F.col("thresh")))
    stats = sf.groupBy(*by, "g").agg(*stat_exprs(y, "_pred", score), F.max("thresh").alias("thresh"))
    out = overview(stats, by, carry=["thresh"])
    return attach(out, durations, ["model"], how="left") if durations is not None else out


def running_mean(df: DataFrame, order: str, value: str, count: str, by: Sequence[str] = (), out: str = "running_mean") -> DataFrame:
    """Count-weighted mean over all batches so far; ``df`` holds one row per (key, batch).

    Batches in numeric, date or time order are cut into ranges whose totals go ahead of them, so no task holds all batches of a key. Other orders (text) are
    sorted within their key.
    """
    kind = df.schema[order].dataType.simpleString()
    weighted = df.withColumns({"_vc": F.col(value).cast("double") * F.col(count), "_c": F.col(count).cast("double")})
    if kind == "string":
        w = Window.partitionBy(*by, F.lit(0)).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        return weighted.withColumn(out, ratio(F.sum("_vc").over(w), F.sum("_c").over(w))).drop("_vc", "_c")
    place = F.unix_date(order) if kind == "date" else F.col(order).cast("timestamp") if kind == "timestamp_ntz" else F.col(order)
    run = prefix_sums(weighted.withColumn("_o", place.cast("double")), by, "_o", ["_vc", "_c"])
    return run.withColumn(out, ratio("cum__vc", "cum__c")).select(*df.columns, out)


def weighted_group_loss(pred: DataFrame, mu: DataFrame, loss: str = "loss", correct: str = "correct", g: str = "g") -> DataFrame:
    """Per group: mean loss, accuracy, weight and the group's part ``mu * mean loss``; ``total`` is the weighted loss overall."""
    means = pred.groupBy(g).agg(F.avg(loss).alias("mean_loss"), F.avg(F.col(correct).cast("double")).alias("acc"))
    t = attach(pin(means).frame, mu.select(g, "mu"), [g])
    t = t.withColumn("part", F.col("mu") * F.col("mean_loss")).withColumn("_k", F.lit(1))
    return t.join(t.groupBy("_k").agg(F.sum("part").alias("total")), "_k").drop("_k")


def summarize(df: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Mean and sample standard deviation of result columns per key."""
    aggs = [f(c).alias(f"{c}_{n}") for c in cols for f, n in ((F.avg, "mean"), (F.stddev_samp, "std"))]
    return df.groupBy(*keys).agg(*aggs)
