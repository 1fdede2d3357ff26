"""Queries on the event-time monitor: the batch form, and the same plan fed as a stream."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..session import checkpoint_root
from ..streaming.monitor import monitor, monitor_rates, worst_by_window
from .bindings import scored_events
from .registry import big, query, r, r6, table

RATES = ("acc", "tpr", "fpr", "pr", "bal_acc", "logloss")


def _window_sql(starts: str) -> str:
    from .bindings import EVENTS
    from .metrics import stats_sql

    return f"""WITH {EVENTS}, sl AS (SELECT *, unnest({starts}) AS window_start FROM ev), {stats_sql('sl', 'window_start, g')}"""


DAY = "[time_bucket(INTERVAL '1 day', ts)]"
SLIDING = "[time_bucket(INTERVAL '12 hours', ts), time_bucket(INTERVAL '12 hours', ts) - INTERVAL '12 hours']"


@query(
    "monitor_tumbling",
    _window_sql(DAY) + f" SELECT window_start, window_start + INTERVAL '1 day' AS window_end, g, n, {', '.join(r(m, m) for m in RATES)} FROM rt",
)
def monitor_tumbling(spark, sf):
    t = monitor_rates(monitor(scored_events(spark, sf), window="1 day"))
    return t.select("window_start", "window_end", "g", big("n"), *[r6(m) for m in RATES])


@query(
    "monitor_sliding",
    _window_sql(SLIDING)
    + f""" SELECT window_start, window_start + INTERVAL '1 day' AS window_end, {r('min(acc)', 'min_acc')}, {r('min(bal_acc)', 'min_bal_acc')}, {r('min(tpr)', 'min_tpr')},
    {r('min(pr)', 'min_pr')}, {r('max(logloss)', 'max_logloss')} FROM rt GROUP BY window_start""",
)
def monitor_sliding(spark, sf):
    t = worst_by_window(monitor_rates(monitor(scored_events(spark, sf), window="24 hours", slide="12 hours")))
    return t.select("window_start", "window_end", *[r6(c) for c in t.columns[2:]])


@query(
    "monitor_stream",
    _window_sql(DAY)
    + f""" SELECT window_start, window_start + INTERVAL '1 day' AS window_end, g, n, {', '.join(r(m, m) for m in RATES)} FROM rt
    WHERE window_start + INTERVAL '1 day' <= (SELECT max(ts) FROM events)""",
)
def monitor_stream(spark, sf):
    """The events as a file stream, with a watermark; windows the watermark has passed are written out."""
    schema = table(spark, sf, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    scored = stream.select(
        F.col("ts").cast("timestamp").alias("ts"),
        F.pmod("user_id", F.lit(8)).cast("bigint").alias("g"),
        (F.col("event_type") == "purchase").cast("int").alias("y"),
        (F.col("value") / (F.col("value") + 50)).alias("score"),
        (F.col("value") > 50).cast("int").alias("pred"),
    )
    rated = monitor_rates(monitor(scored, window="1 day", watermark="0 seconds"))
    root = f"{checkpoint_root(spark)}/monitor-{uuid.uuid4().hex}"
    q = (
        rated.writeStream.outputMode("append")
        .format("parquet")
        .option("checkpointLocation", f"{root}/state")
        .trigger(availableNow=True)
        .start(f"{root}/out")
    )
    q.awaitTermination()
    t = spark.read.schema(rated.schema).parquet(f"{root}/out")
    ntz = [F.col(c).cast("timestamp_ntz").alias(c) for c in ("window_start", "window_end")]
    return t.select(*ntz, "g", big("n"), *[r6(m) for m in RATES])
