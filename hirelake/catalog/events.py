"""Stateful and streaming queries."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..operators import stateful as st
from ..operators.alerts import alert_eval
from ..operators.sessions import sessionize
from ..operators.skew import rank_rows
from ..streaming import streams
from .registry import query

_ORD = "o AS (SELECT *, epoch_us(ts) AS tm, row_number() OVER (PARTITION BY key ORDER BY ts, hit_id) AS rn FROM v_hits)"


def _walk(cols: str, first: str, nxt: str, lateral: str = "") -> str:
    """Row by row over each key in time order, carrying state columns."""
    return f"""WITH RECURSIVE {_ORD}, r AS (SELECT key, rn, hit_id, tm, {first} FROM o WHERE rn = 1
UNION ALL SELECT o.key, o.rn, o.hit_id, o.tm, {nxt} FROM r JOIN o ON o.key = r.key AND o.rn = r.rn + 1 {lateral}) SELECT {cols} FROM r"""


def hits(s):
    return s.hits.select("hit_id", "key", "ts", "tokens", "actual_tokens", "failed")


@query("sliding_log_limit", _walk("hit_id, allowed, retry_after", "true AS allowed, CAST(0 AS BIGINT) AS retry_after, [tm] AS log",
       """len(f.log) < 2, CASE WHEN len(f.log) < 2 THEN 0 ELSE (86400000000 - (o.tm - f.log[1])) // 1000000 + 1 END, CASE WHEN len(f.log) < 2 THEN list_append(f.log, o.tm) ELSE f.log END""",
       ", LATERAL (SELECT list_filter(r.log, lambda x: x > o.tm - 86400000000) AS log) f"))
def _(s):
    return st.replay_quiet(hits(s), "key", "ts", "hit_id", st.SlidingLog(2, 86400)).select("hit_id", "allowed", "retry_after")


_TOK = "list_sum(list_transform(f.log, lambda x: x.t))"
_ADM = f"len(f.log) < 5 * 0.9E0 AND coalesce({_TOK}, 0) + o.tokens <= 150 * 0.9E0"


@query("budget_admission", _walk("hit_id, verdict, round(wait, 4) AS wait",
       """CASE WHEN tokens > 135 THEN 'rejected' ELSE 'admitted' END AS verdict, CASE WHEN tokens > 135 THEN NULL ELSE 0.0E0 END AS wait,
       CASE WHEN tokens > 135 THEN [] ELSE [{'a': tm, 't': actual_tokens}] END AS log""",
       f"""CASE WHEN o.tokens > 135 THEN 'rejected' WHEN {_ADM} THEN 'admitted' ELSE 'wait' END,
       CASE WHEN o.tokens > 135 THEN NULL WHEN {_ADM} THEN 0.0E0 WHEN len(f.log) = 0 THEN 1.0E0 ELSE greatest((86400000000 - (o.tm - f.log[1].a)) / 1000000.0E0, 0.001E0) END,
       CASE WHEN o.tokens <= 135 AND {_ADM} THEN list_append(f.log, {{'a': o.tm, 't': o.actual_tokens}}) ELSE f.log END""",
       ", LATERAL (SELECT list_filter(r.log, lambda x: o.tm - x.a < 86400000000) AS log) f"))
def _(s):
    out = st.replay_quiet(hits(s), "key", "ts", "hit_id", st.RollingBudget(5, 150, 86400))
    return out.select("hit_id", "verdict", F.round("wait", 4).alias("wait"))


@query("dedupe_ttl", _walk("hit_id, first", "true AS first, tm + 7200000000 AS until", "o.tm >= r.until, CASE WHEN o.tm >= r.until THEN o.tm + 7200000000 ELSE r.until END"))
def _(s):
    return st.replay_quiet(hits(s), "key", "ts", "hit_id", st.FirstSeen(7200)).select("hit_id", "first")


_W = "172800000000"
_N = f"CASE WHEN r.last IS NULL OR o.tm - r.last >= {_W} THEN 1 ELSE r.n + 1 END"


@query("login_lockout", _walk("hit_id, locked, n AS failures", f"false AS locked, CAST(CASE WHEN failed THEN 1 ELSE 0 END AS BIGINT) AS n, CASE WHEN failed THEN tm END AS last, CAST(NULL AS BIGINT) AS until",
       f"""coalesce(o.tm < r.until, false), CASE WHEN coalesce(o.tm < r.until, false) THEN r.n WHEN NOT o.failed THEN 0 ELSE {_N} END,
       CASE WHEN coalesce(o.tm < r.until, false) THEN r.last WHEN NOT o.failed THEN NULL ELSE o.tm END,
       CASE WHEN coalesce(o.tm < r.until, false) THEN r.until WHEN NOT o.failed THEN NULL WHEN {_N} >= 2 THEN o.tm + {_W} END"""))
def _(s):
    return st.replay_quiet(hits(s), "key", "ts", "hit_id", st.Lockout(2, 172800)).select("hit_id", "locked", "failures")


@query("sessionize", _walk("hit_id, start AS session_start", "tm AS start", """CASE WHEN o.tm > r.tm + 28800000000 OR o.tm >= r.start + 86400000000 THEN o.tm ELSE r.start END"""))
def _(s):
    return sessionize(hits(s), "key", "ts", "hit_id", 28800, 86400).select("hit_id", "session_start")


@query("token_reuse", _walk("hit_id, verdict", """CASE WHEN tokens % 2 = 0 THEN 'ok' ELSE 'unknown' END AS verdict, CASE WHEN tokens % 2 = 0 THEN 1 ELSE 0 END AS cur, CASE WHEN tokens % 2 = 0 THEN tm END AS rot, false AS rev""",
       """CASE WHEN r.rev THEN 'revoked' WHEN v.v = r.cur THEN 'ok' WHEN r.rot IS NOT NULL AND v.v = r.cur - 1 THEN CASE WHEN o.tm - r.rot <= 36000000000 THEN 'grace' ELSE 'replay' END ELSE 'unknown' END,
       CASE WHEN NOT r.rev AND v.v = r.cur THEN r.cur + 1 ELSE r.cur END, CASE WHEN NOT r.rev AND v.v = r.cur THEN o.tm ELSE r.rot END,
       r.rev OR (r.rot IS NOT NULL AND v.v = r.cur - 1 AND o.tm - r.rot > 36000000000)""",
       ", LATERAL (SELECT CASE WHEN o.rn < 6 THEN o.rn - 1 - o.tokens % 2 ELSE o.tokens % 12 END AS v) v"))
def _(s):
    # presented version: mostly the next one, sometimes an old one
    d = rank_rows(s.hits, ["key"], F.struct("ts", "hit_id"), "rn").withColumn("at", F.unix_micros(F.col("ts").cast("timestamp"))).withColumn(
        "version", F.when(F.col("rn") < 6, F.col("rn") - 1 - F.col("tokens") % 2).otherwise(F.col("tokens") % 12)).drop("rn")
    return st.replay(d, ["key"], ["at", "hit_id"], st.Rotation(36000)).select("hit_id", "verdict")


# ---- streams over the event table -----------------------------------------------

@query("stream_task_metrics", """SELECT task, state, count(*) AS runs, count(seconds) AS timed, round(coalesce(sum(seconds), 0), 4) AS seconds, max(ts) AS last_finished FROM
 (SELECT event_type AS task, CASE event_id % 4 WHEN 0 THEN 'FAILURE' ELSE 'SUCCESS' END AS state, value AS seconds, ts FROM events) GROUP BY 1, 2""")
def _(s):
    e = streams.read_stream(s.spark, s.sf_dir, "events").select(
        F.col("event_type").alias("task"), F.when(F.col("event_id") % 4 == 0, "FAILURE").otherwise("SUCCESS").alias("state"), F.col("value").alias("seconds"), "ts")
    return streams.run_to_table(streams.stream_task_metrics(e), "complete").withColumn("seconds", F.round("seconds", 4))


@query("stream_tumbling_limit", """SELECT user_id AS key, CAST(date_trunc('day', ts) AS TIMESTAMP) AS bucket, count(*) AS hits, least(count(*), 3) AS allowed, greatest(count(*) - 3, 0) AS denied FROM events GROUP BY 1, 2""")
def _(s):
    e, end = streams.with_end(streams.read_stream(s.spark, s.sf_dir, "events"))
    e = streams.event_time(e).withColumnRenamed("user_id", "key")
    out = streams.run_to_table(streams.stream_tumbling_limit(e, 3, 86400), "append", end=end)
    return out.withColumn("bucket", F.col("bucket").cast("timestamp_ntz"))


@query("stream_changed_fields", """SELECT event_id AS id, CASE WHEN event_id % 3 <> 1 THEN '' WHEN event_id % 4 <> event_id % 5 THEN 'status' ELSE '' END AS fields FROM events""")
def _(s):
    js = lambda n: F.concat(F.lit('{"status": "'), F.col("event_id") % n, F.lit('", "updated_at": "'), F.lit(n), F.lit('"}'))
    e = streams.read_stream(s.spark, s.sf_dir, "events").select(
        F.col("event_id").alias("id"), F.when(F.col("event_id") % 3 != 0, js(4)).alias("before_json"), F.when(F.col("event_id") % 3 != 2, js(5)).alias("after_json"))
    out = streams.run_to_table(streams.stream_changes(e).select("id", F.array_join("changed_fields", ",").alias("fields")), "append")
    return out


@query("readiness_trigger", """SELECT a.application_id, greatest(r.created_at, j.created_at) AS due_at FROM v_applications a JOIN v_resumes r ON a.resume_id = r.resume_id
 JOIN v_jobs j ON j.job_id = a.job_id WHERE r.extraction_status = 'done' AND j.extraction_status = 'done'""")
def _(s):
    # finish moments arrive with the base rows; the views tell which are done and when
    r = streams.read_stream(s.spark, s.sf_dir, "orders").select(F.col("o_orderkey").alias("resume_id")).join(
        s.resumes.where("extraction_status = 'done'").select("resume_id", F.col("created_at").alias("ts")), "resume_id")
    j = streams.read_stream(s.spark, s.sf_dir, "part").select(F.col("p_partkey").alias("job_id")).join(
        s.jobs.where("extraction_status = 'done'").select("job_id", F.col("created_at").alias("ts")), "job_id")
    out = streams.run_to_table(streams.stream_readiness(r, j, s.applications), "update", key="application_id")
    return out.withColumn("due_at", F.col("due_at").cast("timestamp_ntz"))


_T = "TIMESTAMP '1999-01-01 00:00:00'"
_HIT = f"(retry_count < 3 AND (extraction_status = 'failed' OR (extraction_status = 'pending' AND updated_at < {_T} - INTERVAL 10 MINUTE)))"


@query("retry_step", f"""SELECT resume_id, CAST(CASE WHEN {_HIT} THEN retry_count + 1 ELSE retry_count END AS INT) AS retry_count,
 CASE WHEN {_HIT} THEN 'pending' ELSE extraction_status END AS extraction_status, {_HIT} AS swept FROM v_resumes""")
def _(s):
    return streams.retry_step(s.resumes, dt.datetime(1999, 1, 1)).select("resume_id", "retry_count", "extraction_status", "swept")


@query("alert_eval")
def _(s):
    """Hourly series made from the events: one gauge and counters per type, so one interval is an hour here."""
    e = s.table("events").withColumn("hour", F.date_trunc("hour", F.col("ts").cast("timestamp")))
    h = e.groupBy("hour", "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("v"), F.max("event_id").alias("last"))
    row = lambda df, metric, labels, value: df.select(F.col("hour").alias("ts"), F.lit(metric).alias("metric"), labels.alias("labels"), value.cast("double").alias("value"))
    none = F.create_map().cast("map<string,string>")
    lab = lambda k, c: F.create_map(F.lit(k), c)
    t = F.col("event_type")
    series = (
        row(h.where(t == "view"), "queue_depth", lab("queue", t), F.col("v") * 2)
        .union(row(h.where(t == "error"), "up", none, F.when(F.col("n") > 3, 0).otherwise(1)))
        .union(row(h, "http_requests_total", lab("status", F.when(t == "error", "500").otherwise("200")), F.col("last") * 100))
        .union(row(h.where(t == "click"), "task_runs_total", lab("state", F.lit("FAILURE")), F.col("last")))
        .union(row(h.where(t == "signup"), "stuck_rows", lab("kind", F.lit("jd_extraction_pending")), F.col("n") - 1))
    )
    return alert_eval(series, 3600)
