"""Alert rules over scraped series ``(ts, metric, labels map<string,string>, value)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .operations import alert_hold, counter_rate, histogram_quantile

# Thresholds and holding times, in scrape intervals (minutes by default).
ERROR_SHARE, MIN_RATE, SLOW_SECONDS, BACKLOG, STOPPED_AFTER, FAILURES = 0.05, 0.05, 2.0, 50, 30, 3
HOLD = {"down": 2, "error_rate": 5, "slow": 10, "store_down": 2, "worker_stopped": 5, "backlog": 15, "task_failures": 0,
        "stuck_pending": 15, "needs_human": 60}


def alert_eval(series: DataFrame, unit: int = 60) -> DataFrame:
    """(alert, step, since) for every evaluation step at which an alert fires.

    Every rule is first reduced to one value per step, so holding times run
    over a time grid.  A step without samples ends a run.
    """
    step = (F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / unit) * unit).cast("bigint")
    flat = series.withColumn("series", F.concat_ws("|", F.array_sort(F.transform(F.map_entries("labels"), lambda e: F.concat_ws("=", e["key"], e["value"])))))

    def gauge(cond: Column, agg=F.sum) -> DataFrame:
        last = flat.where(cond).groupBy("series", step.alias("step")).agg(F.max_by("value", "ts").alias("v"))
        return last.groupBy("step").agg(agg("v").alias("v"))

    def increase(cond: Column, window: int) -> DataFrame:
        return counter_rate(flat.where(cond), ["series"], ["ts"], window * unit, unit)

    def total(cond: Column, window: int) -> DataFrame:
        return increase(cond, window).groupBy("step").agg(F.sum("increase").alias("v"))

    m = F.col("metric")
    requests = m == "http_requests_total"
    errors = total(requests & F.col("labels")["status"].startswith("5"), 5).withColumnRenamed("v", "bad")
    share = total(requests, 5).join(errors, "step", "left").select("step", (
        (F.coalesce("bad", F.lit(0.0)) / F.nullif(F.col("v"), F.lit(0.0)) > ERROR_SHARE) & (F.col("v") / (5 * 60) > MIN_RATE)).alias("c"))
    buckets = (
        increase(m == "http_request_duration_seconds_bucket", 10)
        .withColumn("le", F.regexp_replace(F.regexp_extract("series", r"(?:^|\|)le=([^|]*)", 1), r"^\+", "").cast("double"))
        .groupBy("step", "le").agg(F.sum("increase").alias("n"))
    )
    slow = histogram_quantile(buckets, ["step"], 0.95).select("step", (F.col("quantile") > SLOW_SECONDS).alias("c"))
    kind = F.col("labels")["kind"]
    is_ = lambda df, c: df.select("step", c.alias("c"))
    v = F.col("v")
    conds = {
        "down": is_(gauge(m == "up", F.min), v == 0),
        "error_rate": share,
        "slow": slow,
        "store_down": is_(gauge(m == "store_up", F.min), v == 0),
        "worker_stopped": is_(gauge(m == "last_task_finished_timestamp_seconds", F.max), (v > 0) & (F.col("step") - v > STOPPED_AFTER * unit)),
        "backlog": is_(gauge((m == "queue_depth")), v > BACKLOG),
        "task_failures": is_(total((m == "task_runs_total") & (F.col("labels")["state"] == "FAILURE"), 15), v > FAILURES),
        "stuck_pending": is_(gauge((m == "stuck_rows") & kind.endswith("_pending")), v > 0),
        "needs_human": is_(gauge((m == "stuck_rows") & kind.endswith("_failed")), v > 0),
    }
    grid = None
    for name, df in conds.items():
        one = df.select(F.lit(name).alias("alert"), F.lit(HOLD[name] * unit).alias("hold"), "step", F.timestamp_seconds("step").alias("ts"), "c")
        grid = one if grid is None else grid.unionByName(one)
    return alert_hold(grid, ["alert"], F.col("c"), F.col("hold"), ["ts"], max_gap=2 * unit).select(
        "alert", "step", F.unix_seconds("since").alias("since"))
