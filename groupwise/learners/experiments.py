"""Experiments over many fitted models."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..lookup import pin
from ..operators.metrics import evaluate_models, evaluate_regressions, group_stats, merge_stats, rates
from ..operators.trials import sweep_params
from .boosting import BoostModel, boost_together, prepare, score_models
from .game import MinimaxGame
from .linear import LinearLearner, LogisticLearner, PairedLearner
from .mixture import score_linear


MODELS_PER_PASS = 50
TOGETHER = 16


def run_trials(
    make: Callable[[dict], object],
    params: Sequence[dict],
    df: DataFrame,
    features: Sequence[str],
    y: str = "y",
    g: str = "g",
    split: str = "split",
    thresh: float | str = 0.5,
    models_per_pass: int = MODELS_PER_PASS,
) -> tuple[DataFrame, DataFrame, dict]:
    """Fit one model per parameter set on the train split and evaluate all of them on all splits.

    ``make`` gives boosters, games, mixtures, adaptive classifiers or weighted linear learners, of one kind of answer. Boosters are grown ``TOGETHER`` on one binned table, level by
    level, so a pass over the rows serves them all; the time of such a batch is shared out by trees. Evaluation reads the table once per
    ``models_per_pass`` models and keeps a few rows per model: performance and fairness for classifiers, errors overall and per group for
    regressions. Returns ``(results, trials, models)``; models are keyed by trial number. The search is random, so trials do not depend on each other.
    """
    spark = df.sparkSession
    train = df.where(F.col(split) == "train")
    models, took = _fit_all([make(p) for p in params], train, features, y, g)
    trials = [(i, took[i], f"0 days {timedelta(seconds=round(took[i], 6))}", {k: str(v) for k, v in p.items()}) for i, p in enumerate(params)]
    table = spark.createDataFrame(trials, "model int, duration_s double, duration string, params map<string,string>")
    durations = table.select("model", F.col("duration_s").alias("duration"))
    rows = df.select(*features, F.col(y).alias("_y"), F.col(g).alias("_g"), F.col(split).alias("split"))
    regression = {m.kind in ("regressor", "linear") for m in models.values()}
    if len(regression) > 1:
        raise ValueError("trials are either all classifiers or all regressions")
    groups = sorted((r[0] for r in rows.select("_g").distinct().collect() if r[0] is not None), key=str) if regression == {True} else None
    results = None
    for score in (score_models, score_linear):
        mine = [i for i, m in models.items() if isinstance(m, BoostModel) == (score is score_models)]
        for low in range(0, len(mine), models_per_pass):
            batch = {i: models[i] for i in mine[low : low + models_per_pass]}
            long = score(rows, batch).select("model", "split", F.col("_y").alias("y"), F.col("_g").alias("g"), "score")
            if groups is not None:
                part = evaluate_regressions(long, groups=groups, durations=durations)
            else:
                part = evaluate_models(long, thresh, durations=durations)
            part = pin(part).frame
            results = part if results is None else results.unionByName(part)
    return results, table, models


def _fit_all(estimators: Sequence[object], train: DataFrame, features: Sequence[str], y: str, g: str) -> tuple[dict, dict]:
    """Models and seconds by number."""
    models: dict[int, object] = {}
    took: dict[int, float] = {}
    boosters = [i for i, e in enumerate(estimators) if hasattr(e, "p") and hasattr(e, "fair")]
    if boosters:
        binned = prepare(train, features, y, g)
        try:
            for low in range(0, len(boosters), TOGETHER):
                batch = boosters[low : low + TOGETHER]
                began = time.perf_counter()
                fitted = boost_together([estimators[i] for i in batch], binned)
                spent, trees = time.perf_counter() - began, sum(len(m.trees) + 1 for m in fitted)
                for i, m in zip(batch, fitted):
                    models[i], took[i] = m, spent * (len(m.trees) + 1) / trees
        finally:
            binned.unpersist()
    for i, e in enumerate(estimators):
        if i in models:
            continue
        began = time.perf_counter()
        if isinstance(e, MinimaxGame):
            fitted = e.fit(train, features, y, [g])
        elif isinstance(e, (LinearLearner, LogisticLearner, PairedLearner)):
            fitted = e.fit(train, features, y)
        else:
            fitted = e.fit(train, features, y, g)
        models[i], took[i] = getattr(fitted, "model", fitted), time.perf_counter() - began
    return models, took


def fair_weight_sweep(
    make: Callable[[dict], object], base: DataFrame, weights: Sequence[float], df: DataFrame, features: Sequence[str], **run
) -> tuple[DataFrame, DataFrame, dict]:
    """Every base parameter row with every fair weight; see :func:`run_trials`. ``base`` is a small table of parameters."""
    rows = [r.asDict() for r in sweep_params(base, weights).collect()]
    results, trials, models = run_trials(make, rows, df, features, **run)
    return results.withColumn("fair_weight", F.element_at(_weights(rows), F.col("model"))), trials, models


def _weights(rows: Sequence[dict]):
    return F.create_map(*[x for i, r in enumerate(rows) for x in (F.lit(i), F.lit(float(r["fair_weight"])))])


def convergence(model: BoostModel, df: DataFrame, iters: Sequence[int], y: str = "y", g: str = "g", split: str = "split") -> DataFrame:
    """Accuracy, TPR and log-losses per iteration and split, overall (``g`` NULL) and per group, from one aggregation."""
    staged = model.staged(df, iters, "score", "pred").select("iter", split, F.col(g).alias("g"), F.col(y).alias("y"), "score", "pred")
    by = ["iter", split]
    stats = group_stats(staged, [*by, "g"])
    cols = ["acc", "tpr", "logloss", "logloss_pos"]
    groups = rates(stats, [*by, "g"], cols)
    overall = rates(merge_stats(stats, by), by, cols).withColumn("g", F.lit(None).cast(groups.schema["g"].dataType))
    return groups.unionByName(overall)


__all__ = ["convergence", "fair_weight_sweep", "run_trials"]
