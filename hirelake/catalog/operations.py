"""Operational queries: counters, limits, alerts, call handling."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..operators import operations as ops
from .registry import query

NOW = dt.datetime(2024, 1, 20)
_NOW = "TIMESTAMP '2024-01-20 00:00:00'"
LATER = dt.datetime(1999, 1, 1)

_SUMMARY = """SELECT task, state, count(*) AS runs, count(seconds) AS timed, round(coalesce(sum(seconds), 0), 4) AS seconds, max(ts) AS last_finished FROM v_metrics GROUP BY 1, 2"""


@query("task_summary", _SUMMARY)
def _(s):
    return ops.task_summary(s.metrics).withColumn("seconds", F.round("seconds", 4))


_HIST = "SELECT m.method, m.route, b.le, count(*) FILTER (m.seconds <= b.le) AS n FROM v_metrics m, (VALUES " + ", ".join(
    f"({b}E0)" for b in ops.LATENCY_BOUNDS) + ", (CAST('Infinity' AS DOUBLE))) b(le) WHERE m.seconds IS NOT NULL GROUP BY 1, 2, 3"


@query("latency_histogram", _HIST)
def _(s):
    return ops.latency_histogram(s.metrics, ["method", "route"], "seconds")


@query("histogram_quantile", f"""WITH h AS ({_HIST}), w AS (SELECT *, coalesce(lag(le) OVER o, 0) AS ple, coalesce(lag(n) OVER o, 0) AS pn, max(n) OVER (PARTITION BY method, route) * 0.75E0 AS t
 FROM h WINDOW o AS (PARTITION BY method, route ORDER BY le)), f AS (SELECT *, row_number() OVER (PARTITION BY method, route ORDER BY le) AS rn FROM w WHERE n >= t AND t > 0)
SELECT method, route, round(CASE WHEN isinf(le) THEN ple ELSE ple + (le - ple) * (t - pn) / (n - pn) END, 6) AS quantile FROM f WHERE rn = 1""")
def _(s):
    h = ops.latency_histogram(s.metrics, ["method", "route"], "seconds")
    return ops.histogram_quantile(h, ["method", "route"], 0.75).withColumn("quantile", F.round("quantile", 6))


_OLD = "updated_at < TIMESTAMP '1999-01-01 00:00:00' - INTERVAL 30 MINUTE"
_STUCK = f"""SELECT 'resume_extraction_pending' AS kind, count(*) FILTER (extraction_status = 'pending' AND {_OLD}) AS n FROM v_resumes
UNION ALL SELECT 'resume_extraction_failed', count(*) FILTER (extraction_status = 'failed' AND retry_count >= 3) FROM v_resumes
UNION ALL SELECT 'jd_extraction_pending', count(*) FILTER (extraction_status = 'pending' AND {_OLD} AND jd_raw_text IS NOT NULL) FROM v_jobs
UNION ALL SELECT 'jd_extraction_failed', count(*) FILTER (extraction_status = 'failed' AND retry_count >= 3) FROM v_jobs
UNION ALL SELECT 'match_scoring_failed', count(*) FILTER (match_status = 'failed') FROM v_applications"""


@query("stuck_rows", _STUCK)
def _(s):
    return ops.stuck_rows(s.resumes, s.jobs, s.applications, LATER)


_USAGE = f"SELECT CAST(coalesce(sum(tokens), 0) AS BIGINT) AS tokens, count(*) AS requests FROM v_hits WHERE ts BETWEEN {_NOW} - INTERVAL 3600 SECOND AND {_NOW}"


@query("window_usage", _USAGE)
def _(s):
    return ops.window_usage(s.hits, NOW, 3600)


_DEPTH = "SELECT task AS queue, count(*) AS depth FROM v_metrics WHERE state = 'RETRY' GROUP BY ROLLUP(task)"


@query("queue_depth", _DEPTH)
def _(s):
    return ops.queue_depth(s.metrics.where("state = 'RETRY'").select(F.col("task").alias("queue")))


_PROBE = "SELECT task, event_id AS id, lower(state) AS state, ts FROM v_metrics"
_LAST = """SELECT task, id, state FROM (SELECT *, row_number() OVER (PARTITION BY task ORDER BY ts DESC, id DESC) AS rn FROM (
 SELECT task, event_id AS id, CASE state WHEN 'RETRY' THEN 'busy' ELSE lower(state) END AS state, ts FROM v_metrics) WHERE state <> 'busy') WHERE rn = 1"""


def probes(s):
    return s.metrics.select("task", F.col("event_id").alias("id"), F.when(F.col("state") == "RETRY", "busy").otherwise(F.lower("state")).alias("state"), "ts")


@query("latest_per_task", _LAST)
def _(s):
    return ops.latest_probe(probes(s)).select("task", "id", "state")


@query("metric_rows", f"""SELECT 'task_runs' AS metric, task || '/' || state AS label, CAST(runs AS DOUBLE) AS value FROM ({_SUMMARY})
UNION ALL SELECT 'stuck_rows', kind, CAST(n AS DOUBLE) FROM ({_STUCK}) UNION ALL SELECT 'queue_depth', coalesce(queue, ''), CAST(depth AS DOUBLE) FROM ({_DEPTH})""")
def _(s):
    rows = (ops.metric_rows("task_runs", ops.task_summary(s.metrics), ["task", "state"], "runs")
            .unionByName(ops.metric_rows("stuck_rows", ops.stuck_rows(s.resumes, s.jobs, s.applications, LATER), ["kind"], "n"))
            .unionByName(ops.metric_rows("queue_depth", ops.queue_depth(s.metrics.where("state = 'RETRY'").select(F.col("task").alias("queue"))), ["queue"], "depth")))
    return rows.select("metric", F.concat_ws("/", F.map_values("labels")).alias("label"), "value")


@query("stagger_batches", """SELECT user_id, CAST(floor((row_number() OVER (ORDER BY first_ts, user_id) - 1) / 50) * 5 AS BIGINT) AS countdown
FROM (SELECT user_id, min(ts) AS first_ts FROM events GROUP BY 1)""")
def _(s):
    return ops.stagger(s.table("events"), "user_id", ["ts"], 50, 5)


@query("rate_limit_fixed", """SELECT hit_id, CAST(86400 - CAST(floor(epoch(ts)) AS BIGINT) % 86400 AS BIGINT) AS retry_after,
 row_number() OVER (PARTITION BY key, floor(epoch(ts) / 86400) ORDER BY ts, hit_id) <= 3 AS allowed FROM v_hits""")
def _(s):
    return ops.fixed_window_limit(s.hits, 3, 86400).select("hit_id", "retry_after", "allowed")


@query("counter_rate", """WITH d AS (SELECT event_type, ts, value, lag(value) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS prev FROM events),
i AS (SELECT event_type, CAST(floor(epoch(ts) / 3600) * 3600 AS BIGINT) AS step, sum(CASE WHEN prev IS NULL THEN 0 WHEN value < prev THEN value ELSE value - prev END) AS inc FROM d GROUP BY 1, 2)
SELECT event_type, step, round(sum(inc) OVER (PARTITION BY event_type ORDER BY step RANGE BETWEEN 10800 PRECEDING AND CURRENT ROW), 4) AS increase FROM i""")
def _(s):
    return ops.counter_rate(s.table("events"), ["event_type"], ["ts", "event_id"], 14400, 3600).withColumn("increase", F.round("increase", 4))


@query("alert_hold", """WITH c AS (SELECT *, value > 10 AS c FROM events), l AS (SELECT *, CASE WHEN lag(c) OVER w = c THEN 0 ELSE 1 END AS new FROM c WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)),
r AS (SELECT *, sum(new) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS run FROM l), s AS (SELECT *, min(ts) OVER (PARTITION BY event_type, run) AS since FROM r)
SELECT event_id, event_type, since FROM s WHERE c AND ts - since >= INTERVAL 3 HOUR""")
def _(s):
    return ops.alert_hold(s.table("events"), ["event_type"], F.col("value") > 10, 3 * 3600, ["ts", "event_id"]).select("event_id", "event_type", "since")


@query("token_estimate", """SELECT doc_id, CAST(floor((400 + n_chars) / 4) + 1500 AS BIGINT) AS tokens, floor((400 + n_chars) / 4) + 1500 <= 7200 AS fits FROM documents""")
def _(s):
    est = ops.token_estimate(F.lit(400), F.col("n_chars"))
    return s.table("documents").select("doc_id", est.alias("tokens"), ops.fits_budget(est, 8000).alias("fits"))


@query("backoff_seconds", """SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN least(2 * pow(2, event_id % 6), 20) WHEN value <= 20 THEN value END AS wait, 30 * pow(2, event_id % 3) AS task_wait FROM events""")
def _(s):
    i = F.col("event_id")
    return s.table("events").select("event_id", ops.backoff_seconds(i % 6 + 1, F.when(i % 3 == 0, F.col("value"))).alias("wait"), ops.task_retry_seconds(i % 3).alias("task_wait"))


@query("classify_error", """SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'transient' WHEN 1 THEN 'bad_output' WHEN 2 THEN 'permanent' WHEN 3 THEN 'transient' WHEN 4 THEN 'transient' ELSE 'permanent' END AS kind FROM events""")
def _(s):
    i = F.col("event_id") % 6
    code = F.when(i == 0, None).when(i <= 2, 400).when(i == 3, 429).when(i == 4, 503).otherwise(401).cast("int")
    msg = F.when(i == 1, F.concat(F.lit("json_validate_failed "), F.col("event_type"))).otherwise(F.col("event_type"))
    return s.table("events").select("event_id", ops.classify_error(code, msg).alias("kind"))


@query("validate_json_lists", """SELECT event_id, event_id % 4 = 0 AS ok, CASE WHEN event_id % 4 = 0 THEN event_type || ',' || CAST(user_id AS STRING) END AS skills FROM events""")
def _(s):
    e = s.table("events").withColumn("answer", F.expr("""CASE event_id % 4 WHEN 0 THEN concat('{"skills": ["', event_type, '", "', user_id, '"], "tools": []}')
        WHEN 1 THEN concat('{"skills": [1, "', event_type, '"], "tools": []}') WHEN 2 THEN concat('{"skills": ["', event_type, '"]}') ELSE concat('["', event_type) END"""))
    got = ops.validate_json_lists(F.col("answer"), ("skills", "tools"))
    return e.select("event_id", got.isNotNull().alias("ok"), F.array_join(got["skills"], ",").alias("skills"))
