"""Sinks, intake and invariants."""

import datetime as dt
import glob

from pyspark.sql import functions as F

from hirelake.operators import dashboards, listing
from hirelake.sources import intake, sinks


def test_export_csv(spark, tmp_path):
    df = spark.createDataFrame([(1, "=cmd", 'a "q", b'), (2, None, "x\ny")], "id int, a string, b string").coalesce(1)
    assert sinks.export_csv(df, str(tmp_path / "out"), ["id", "a", "b"])
    raw = open(glob.glob(str(tmp_path / "out" / "part-*"))[0], "rb").read()
    assert raw.startswith(b"\xef\xbb\xbfid,a,b\r\n") and b"1,'=cmd,\"a \"\"q\"\", b\"\r\n" in raw and b'2,,"x\ny"\r\n' in raw
    assert not sinks.export_csv(df.where("id > 9"), str(tmp_path / "none")) and not glob.glob(str(tmp_path / "none*"))


def test_append_audit_and_edits(spark, tmp_path):
    apps = spark.createDataFrame([(1, 50.0, 7.0), (2, None, 8.0)], "application_id int, manual_score double, match_score double")
    edits = spark.createDataFrame([(1, 50.0), (2, 60.0), (9, 1.0)], "application_id int, manual_score double")
    new, changes = sinks.apply_edits(apps, edits, "application_id", ["manual_score"])
    assert [tuple(r) for r in changes.collect()] == [(2, None, 60.0)]
    assert sorted(map(tuple, new.collect())) == [(1, 50.0, 7.0), (2, 60.0, 8.0)]
    rows = sinks.audit_rows(new, "application", "application_id", "update", 3, dt.datetime(2024, 1, 1))
    for _ in range(2):
        sinks.append_audit(rows, str(tmp_path / "audit"))
    back = spark.read.parquet(str(tmp_path / "audit"))
    assert back.count() == 4 and back.where("get_json_object(after_json, '$.manual_score') = '60.0'").count() == 2


def test_upsert_is_idempotent(spark):
    df = spark.createDataFrame([("a", 1), ("b", 1)], "k string, v int")
    up = spark.createDataFrame([("a", 2)], "k string, v int")
    once = sinks.upsert(df, up, ["k"], ["v"])
    assert sorted(map(tuple, sinks.upsert(once, up, ["k"], ["v"]).collect())) == [("a", 2), ("b", 1)]


def test_intake(spark):
    bad = bytearray("good text ".encode() * 6)
    bad[3:3] = b"\xff\xfe"
    df = spark.createDataFrame([("a.txt", bytes(bad)), ("b.exe", b"x" * 80), ("c.pdf", b"short"), ("d.txt", b"")], "file_name string, content binary")
    got = {r.file_name: r for r in intake.ingest_text(df.withColumn("text", intake.decode_bytes(F.col("content")))).collect()}
    assert got["a.txt"].reason is None and got["a.txt"].clean.startswith("good text good")
    assert [got[k].reason for k in ("b.exe", "c.pdf", "d.txt")] == ["unsupported type", "too little text", "empty"]


def test_pages_cover_everything(stage):
    df = stage.applications.where("status = 'hired'").select("application_id", "match_score", "applied_at", F.lit("x").alias("sort_name"))
    seen = []
    for off in range(0, 400, 100):
        seen += [r.application_id for r in listing.page(df, listing.score_order(), 100, off).collect()]
    assert sorted(seen) == sorted(r.application_id for r in df.collect())


def test_funnel_adds_up(stage):
    assert dashboards.funnel(stage.applications).agg(F.sum("n")).first()[0] == stage.applications.count()


def test_read_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"caf\xc3\xa9 \xff" + b"word " * 20)
    (tmp_path / "b.bin").write_bytes(b"x")
    got = {r.file_name: r for r in intake.ingest_text(intake.read_files(spark, str(tmp_path))).collect()}
    assert got["a.txt"].reason is None and got["a.txt"].clean.startswith("café word") and got["b.bin"].reason == "unsupported type"


def test_deep_page_equals_page(stage):
    df = stage.applications.select("application_id", "applied_at")
    a = listing.page(df, [F.asc("applied_at"), F.asc("application_id")], 100, 700).collect()
    b = listing.deep_page(df, F.struct("applied_at", "application_id"), 100, 700).collect()
    assert sorted(a) == sorted(b) and len(b) == 100


def test_scan_prunes_and_pushes_down(stage):
    from hirelake.sources.entities import lookup, read_entity
    df = lookup(read_entity(stage.spark, stage.sf_dir, "orders"), "o_orderkey", 5).select("o_custkey")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(o_orderkey), EqualTo(o_orderkey,5)]" in plan and "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint>" in plan


def test_no_cross_joins(spark):
    import __spark_entry__ as entry
    from .conftest import SF
    for name in ("score_applications", "scope_read_jobs", "tag_skills", "fuzzy_set_match", "quick_actions", "page_rows", "rank_applicants", "audit_labels"):
        plan = entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoop" not in plan, name


def test_export_parts_join_into_one_csv(spark, tmp_path, in_parts):
    import csv
    import io
    rows = [(i, f"=x{i}" if i % 7 == 0 else f"a,{i}\n\"b\"", None if i % 5 == 0 else i * 0.5) for i in range(3000)]
    df = spark.createDataFrame(rows, "id int, t string, v double").repartition(7)
    assert sinks.export_csv(df, str(tmp_path / "out"), ["id", "t", "v"], ["v", "id"])
    parts = sorted(glob.glob(str(tmp_path / "out" / "part-*")))
    assert len(parts) > 2
    raw = b"".join(open(p, "rb").read() for p in parts)
    got = list(csv.reader(io.StringIO(raw.decode("utf-8-sig"), newline="")))
    assert raw.startswith(b"\xef\xbb\xbf") and raw.count(b"\xef\xbb\xbf") == 1 and got[0] == ["id", "t", "v"]
    want = sorted(rows, key=lambda r: (r[2] is not None, r[2] or 0, r[0]))
    assert got[1:] == [[str(i), "'" + t if t.startswith("=") else t, "" if v is None else str(v)] for i, t, v in want]


def test_upsert_and_purge_rewrite_touched_partitions_only(spark):
    name = f"parts_{dt.datetime.now():%H%M%S%f}"
    rows = [(k, 1, k % 5, dt.date(2024, 1, 1 + k % 5)) for k in range(50)]
    sinks.create_table(spark.createDataFrame(rows, "k int, v int, p int, d date"), name, "p")
    files = lambda: {r[0].split("/p=")[1] for r in spark.read.table(name).select(F.input_file_name()).distinct().collect()}
    try:
        before = files()
        sinks.upsert_table(spark.createDataFrame([(3, 2, 3, dt.date(2024, 1, 4)), (53, 1, 3, dt.date(2024, 1, 4)), (8, 0, 3, dt.date(2024, 1, 4))], "k int, v int, p int, d date"), name, ["k"], ["v"], "p")
        spark.catalog.refreshTable(name)
        after = files()
        assert {f for f in before if not f.startswith("3/")} == {f for f in after if not f.startswith("3/")} and before != after
        got = {r.k: r.v for r in spark.table(name).collect()}
        assert len(got) == 51 and got[3] == 2 and got[8] == 1 and got[53] == 1
        removed = sinks.purge_table(spark, name, (F.col("p") == 1) | (F.col("k") == 2), "p")
        spark.catalog.refreshTable(name)
        last = files()
        assert removed == 11 and {f for f in last if f[0] in "034"} == {f for f in after if f[0] in "034"} and not any(f[0] == "1" for f in last)
        assert spark.table(name).count() == 40 and spark.table(name).where("k = 2").isEmpty()
        assert sinks.purge_table(spark, name, F.lit(False), "p") == 0 and files() == last
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
