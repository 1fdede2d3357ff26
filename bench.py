"""Time the headline queries; prints one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py
"""

from __future__ import annotations

import json
import os
import re
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
ROUNDS = 3


def sink(df) -> None:
    """Run the whole plan without bringing rows to the driver."""
    df.write.format("noop").mode("overwrite").save()


def extra():
    """Work sizes beyond the registered queries: many models, many draws, longer training."""
    from pyspark.sql import functions as F

    from groupwise.functions.recode import duration_seconds
    from groupwise.learners.boosting import MinMaxBoostClassifier
    from groupwise.learners.game import MinimaxGame
    from groupwise.learners.linear import LogisticLearner
    from groupwise.operators import metrics as M
    from groupwise.operators import trials as X
    from groupwise.plans.bindings import results
    from groupwise.plans.learners import FEATURES, LINEAR, _frame
    from groupwise.plans.metrics import long_frame
    from groupwise.plans.registry import table

    def twenty_models(spark, sf):
        """600k rows x 20 models."""
        l = table(spark, sf, "lineitem")  # noqa: E741
        rows = l.select(
            F.col("l_returnflag").alias("g"),
            (F.col("l_quantity") > 25).cast("int").alias("y"),
            F.lit("test").alias("split"),
            F.explode(F.array(*[F.lit(i) for i in range(20)])).alias("model"),
            (F.col("l_extendedprice") / 100000).alias("x"),
        )
        return M.evaluate_models(rows.withColumn("score", 1 / (1 + F.exp(-(F.col("x") - 0.02 * F.col("model"))))), 0.5)

    def bootstrap(spark, sf):
        """21 alphas x 1000 repetitions x 100 draws for one dataset and two model families."""
        val, test, _ = results(spark, sf)
        one = F.col("dataset") == "Brand#1"
        test = test.where(one).withColumn("duration", duration_seconds("duration_text"))
        return X.mean_ci(X.select_models(val.where(one), test, "perf", "fair"), ["dataset", "model_name", "alpha"], ["score"])

    def boost_round(spark, sf):
        model = MinMaxBoostClassifier(n_estimators=1).fit(_frame(spark, sf), FEATURES)
        return spark.createDataFrame(model.info)

    def game_ten_rounds(spark, sf):
        return MinimaxGame(LogisticLearner(), rounds=10, error_type="Log-Loss").fit(_frame(spark, sf), LINEAR).history

    return {
        "evaluate_20_models_600k_rows": twenty_models,
        "evaluate_models_ks": lambda spark, sf: M.evaluate_models(long_frame(spark, sf), "ks"),
        "bootstrap_selection_full": bootstrap,
        "boost_one_round": boost_round,
        "game_10_rounds": game_ten_rounds,
    }


NAMES = (
    "metric_worst_segments",
    "metric_fairness_bundle",
    "metric_roc_auc",
    "metric_ks_threshold",
    "metric_combined_score",
    "calibration_group_report",
    "split_by_group",
    "split_folds",
    "feature_standardize",
    "feature_quantile_cut",
    "group_encode",
    "group_row_weights",
    "dual_project_simplex",
    "history_trajectory",
    "pareto_flags",
    "trial_run_table",
    "trial_select_models",
    "monitor_tumbling",
)


def main() -> None:
    from groupwise.plans import load
    from groupwise.session import local_session

    spark = local_session("groupwise-bench", CPUS)
    registered = load()[0]
    work = {n: registered[n] for n in NAMES} | extra()
    sink(registered["metric_rates"](spark, SF_DIR))  # start-up is not part of any query
    seconds = {}
    for name, fn in work.items():
        best = float("inf")
        for _ in range(1 if name.startswith(("boost", "game")) else ROUNDS):
            began = time.perf_counter()
            sink(fn(spark, SF_DIR))
            best = min(best, time.perf_counter() - began)
        seconds[name] = round(best, 3)
        print(f"{name}: {seconds[name]}", file=sys.stderr, flush=True)
    scale = re.search(r"sf([0-9.]+)", SF_DIR)
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "total_seconds", "value": total, "unit": "sec", "queries": seconds, "sf": float(scale.group(1)) if scale else None}))
    spark.stop()


if __name__ == "__main__":
    main()
