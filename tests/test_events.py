"""Stateful rules: plain loops, batch, and streams must agree."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from hirelake.operators import stateful as st
from hirelake.operators.alerts import alert_eval
from hirelake.operators.sessions import sessionize
from hirelake.streaming import streams

RULES = [st.SlidingLog(3, 60), st.RollingBudget(4, 100, 60), st.FirstSeen(30), st.Lockout(3, 60)]


@pytest.fixture(scope="module")
def hits(spark):
    rnd, rows, at = random.Random(7), [], 0
    for i in range(900):
        at += rnd.choice([1, 3, 10, 25, 70])
        rows.append((i, rnd.choice([1, 1, 1, 2, 3]), dt.datetime(2024, 1, 1) + dt.timedelta(seconds=at), rnd.randint(1, 120), rnd.randint(1, 60), rnd.random() < 0.7))
    return spark.createDataFrame(rows, "hit_id long, key long, ts timestamp, tokens long, actual_tokens long, failed boolean")


def brute(rows, rule):
    state, out = {}, {}
    for r in sorted(rows, key=lambda r: (r.ts, r.hit_id)):
        s = state.get(r.key, rule.start())
        micros = int(r.ts.replace(tzinfo=dt.timezone.utc).timestamp() * 1_000_000)
        state[r.key], out[r.hit_id] = rule.step(s, micros, *[r[c] for c in rule.inputs])
    return out


@pytest.mark.parametrize("rule", RULES, ids=lambda r: type(r).__name__)
def test_batch_and_stream_agree(spark, hits, rule, tmp_path):
    names = st.out_names(rule)
    want = brute(hits.collect(), rule)
    got = {r.hit_id: tuple(r[n] for n in names) for r in st.replay_quiet(hits, "key", "ts", "hit_id", rule).collect()}
    same = lambda a, b: all((x is None or x != x) and (y is None or y != y) or x == pytest.approx(y) if isinstance(y, float) or y is None else x == y for x, y in zip(a, b))
    assert got.keys() == want.keys() and all(same(got[k], want[k]) for k in want)

    # three files in time order, one micro-batch each
    src = str(tmp_path / "in")
    for i in range(3):
        hits.where(F.floor(F.col("hit_id") / 300) == i).coalesce(1).write.mode("append").parquet(src)
    stream = streams.event_time(spark.readStream.schema(hits.schema).option("maxFilesPerTrigger", 1).parquet(src)).withColumn("at", F.unix_micros("ts"))
    out = streams.run_to_table(streams.stream_rule(stream, "key", rule, "hit_id"), "append")
    live = {r.hit_id: tuple(r[n] for n in names) for r in out.collect()}
    assert live.keys() == want.keys() and all(same(live[k], want[k]) for k in want)


def brute_sessions(rows, idle, longest):
    out, state = {}, {}
    for i, key, at in sorted(rows, key=lambda r: (r[2], r[0])):
        start, last = state.get(key, (None, None))
        if start is None or at > last + idle or at >= start + longest:
            start = at
        state[key] = start, at
        out[i] = start
    return out


@pytest.mark.parametrize("pause", [(1, 3, 10, 25, 70), (1, 2, 3)], ids=["some pauses", "never quiet"])
def test_sessions(spark, pause, in_parts):
    """Keys with pauses, and a key that is never quiet and so has long chains of sessions."""
    rnd, rows, at = random.Random(3), [], 0
    for i in range(1500):
        at += rnd.choice(pause)
        rows.append((i, rnd.choice([1, 1, 1, 1, 2, None]), at if rnd.random() < 0.9 else max(0, at - 3)))
    df = spark.createDataFrame([(i, k, dt.datetime(1970, 1, 1) + dt.timedelta(seconds=a)) for i, k, a in rows], "hit_id long, key long, ts timestamp_ntz")
    out = sessionize(df, "key", "ts", "hit_id", 40, 100)
    assert {r.hit_id: r.session_start // st.SECOND for r in out.collect()} == brute_sessions(rows, 40, 100)
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()


def test_sessions_without_time_or_rows(spark):
    df = spark.createDataFrame([(1, 1, None)], "hit_id long, key long, ts timestamp_ntz")
    assert [tuple(r) for r in sessionize(df, "key", "ts", "hit_id", 40, 100).collect()] == [(1, 1, None, None)]
    assert sessionize(df.limit(0), "key", "ts", "hit_id", 40, 100).count() == 0


def test_rotation():
    rule, s, out = st.Rotation(10), [0, None, False], []
    for at, v in ((0, 0), (5, 0), (30, 1), (35, 3), (60, 1), (61, 2)):
        s, o = rule.step(s, at * st.SECOND, v)
        out.append(o[0])
    assert out == ["ok", "grace", "ok", "unknown", "replay", "revoked"]


def test_never_over_limit(spark, hits):
    rule = st.SlidingLog(3, 60)
    ok = sorted((r.key, r.ts) for r in st.replay_quiet(hits, "key", "ts", "hit_id", rule).where("allowed").collect())
    for i, (k, t) in enumerate(ok):
        assert sum(1 for k2, t2 in ok if k2 == k and t - dt.timedelta(seconds=60) < t2 <= t) <= 3


def test_session_window_stream(spark, hits, tmp_path):
    src = str(tmp_path / "in")
    hits.coalesce(1).write.parquet(src)
    stream = streams.event_time(spark.readStream.schema(hits.schema).parquet(src))
    live = streams.run_to_table(streams.stream_sessions(stream, "key", "40 seconds"), "complete")
    batch = streams.stream_sessions(hits, "key", "40 seconds")
    assert sorted(map(tuple, live.collect())) == sorted(map(tuple, batch.collect()))


def test_readiness_stream(spark, tmp_path):
    """Sides finish months apart and some twice; the last row of an application holds the latest moments."""
    t0 = dt.datetime(2024, 1, 1)
    S = spark.createDataFrame
    r = S([(i, t0 + dt.timedelta(hours=i)) for i in range(20)] + [(3, t0 + dt.timedelta(days=400))], "resume_id long, ts timestamp")
    j = S([(i, t0 + dt.timedelta(days=90 * i)) for i in range(5)], "job_id long, ts timestamp")
    apps = S([(i, i, i % 7) for i in range(20)], "application_id long, resume_id long, job_id long")
    for name, df in (("r", r), ("j", j)):
        for at in range(3):
            df.where(F.floor(F.unix_seconds("ts") / 86400) % 3 == at).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
    read = lambda n, df: spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / n))
    live = streams.run_to_table(streams.stream_readiness(read("r", r), read("j", j), apps), "update", key="application_id")
    latest = lambda df, k: {x[0]: max(y[1] for y in df.collect() if y[0] == x[0]) for x in df.collect()}
    rs, js = latest(r, "resume_id"), latest(j, "job_id")
    assert {x.application_id: x.due_at for x in live.collect()} == {i: max(rs[i], js[i % 7]) for i in range(20) if i in rs and i % 7 in js}


def test_tumbling_state_is_dropped_behind_the_watermark(spark, tmp_path):
    t0, src = dt.datetime(2024, 1, 1), str(tmp_path / "in")
    for day in range(12):
        rows = [(k, t0 + dt.timedelta(days=day, minutes=k)) for k in range(50)]
        spark.createDataFrame(rows, "key long, ts timestamp").coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema("key long, ts timestamp").option("maxFilesPerTrigger", 1).parquet(src)
    replay, end = streams.with_end(stream)
    out, path, held = streams.stream_tumbling_limit(streams.event_time(replay), 3, 86400), str(tmp_path / "out"), []
    for send in (lambda: None, end):
        send()
        q = out.writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).format("parquet").option("path", path).start()
        q.awaitTermination()
        held += [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    assert spark.read.parquet(path).count() == 600 and max(held) <= 200 and held[-1] <= 1


def test_alerts(spark):
    t0, rows = dt.datetime(2024, 1, 1), []
    for m in range(40):
        t = t0 + dt.timedelta(minutes=m)
        rows += [(t, "up", {}, 0.0 if 5 <= m <= 9 else 1.0), (t, "queue_depth", {"queue": "work"}, 60.0),
                 (t, "task_runs_total", {"state": "FAILURE"}, float(m if m < 20 else 20)),
                 (t, "http_requests_total", {"status": "200"}, 90.0 * m), (t, "http_requests_total", {"status": "500"}, 10.0 * m),
                 (t, "last_task_finished_timestamp_seconds", {}, 1.0)]
    got = alert_eval(spark.createDataFrame(rows, "ts timestamp, metric string, labels map<string,string>, value double"))
    first = {r.alert: (r.lo, r.hi) for r in got.withColumn("m", (F.col("step") - 1704067200) / 60).groupBy("alert").agg(F.min("m").alias("lo"), F.max("m").alias("hi")).collect()}
    assert first["down"] == (7, 9) and first["backlog"][0] == 15 and first["worker_stopped"][0] == 5
    assert first["task_failures"][0] == 4 and first["error_rate"][0] >= 5 and "needs_human" not in first
