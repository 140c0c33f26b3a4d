"""The piecewise helpers equal plain windows, with one group holding most rows."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from hirelake.operators import skew

pytestmark = pytest.mark.usefixtures("in_parts")


def hot(spark, n=3000):
    return spark.range(n).select(
        F.when(F.col("id") % 3 > 0, F.lit(1)).otherwise(F.col("id") % 7 + 2).alias("g"), (F.col("id") * 7919 % 101).alias("v"), "id",
        F.timestamp_seconds(1_700_000_000 + F.col("id") * 1000 + F.col("id") % 13).alias("ts"))


def test_rank_rows(spark):
    df = hot(spark)
    for group in (["g"], []):
        got = skew.rank_rows(df, group, F.struct("v", "id"), "rank")
        w = (Window.partitionBy(*group) if group else Window).orderBy("v", "id")
        assert got.where("rank is null").isEmpty() and got.count() == df.count()
        assert got.withColumn("want", F.row_number().over(w)).where("rank <> want").isEmpty()


def test_rank_rows_ties_and_nulls(spark):
    df = hot(spark).withColumn("v", F.when(F.col("id") % 2 == 0, F.lit(5)).when(F.col("id") % 5 == 0, None).otherwise(F.col("v")))
    got = skew.rank_rows(df, ["g"], F.struct(F.col("v").isNull().alias("a"), (-F.col("v")).alias("b"), F.col("id").alias("c")))
    w = Window.partitionBy("g").orderBy(F.desc_nulls_last("v"), "id")
    assert got.withColumn("want", F.row_number().over(w)).where("rank <> want").isEmpty()


def test_lag_and_running_sum(spark):
    df = hot(spark)
    w = Window.partitionBy("g").orderBy("ts", "id")
    got = skew.lag_rows(df, ["g"], ["ts", "id"], {"v": "p"})
    got = skew.running_sum(got, ["g"], ["ts", "id"], "v", "s")
    bad = got.withColumn("wp", F.lag("v").over(w)).withColumn("ws", F.sum("v").over(w)).where("not (p <=> wp) or s <> ws")
    assert bad.isEmpty() and got.count() == df.count()


def test_latest_and_earliest(spark):
    df = hot(spark)
    assert skew.latest(df, ["g"], ["v", "id"]).count() == 8
    a = skew.earliest(df, ["g"], ["v", "id"]).where("g = 1").first()
    b = df.where("g = 1").orderBy("v", "id").first()
    assert (a.v, a.id) == (b.v, b.id)


def one_hour(spark, n=3000):
    """Nearly all rows are of one key and in one hour."""
    return spark.range(n).select(F.when(F.col("id") % 50 > 0, F.lit(1)).otherwise(2).alias("g"), "id", (F.col("id") * 31 % 17).cast("double").alias("value"),
                                 F.timestamp_seconds(1_700_000_000 + F.floor(F.col("id") * 3599 / n) * (F.col("id") % 50 > 0).cast("int") + F.col("id") % 3).alias("ts"))


def test_one_hour_of_one_key_is_cut_into_pieces(spark):
    df = one_hour(spark)
    sizes = [r["count"] for r in skew.in_pieces(df, ["g"], ["ts", "id"]).groupBy("g", "_piece").count().collect()]
    assert len(sizes) > 4 and max(sizes) < 0.4 * 3000
    w = Window.partitionBy("g").orderBy("ts", "id")
    got = skew.lag_rows(df, ["g"], ["ts", "id"], {"value": "p"}).withColumn("want", F.lag("value").over(w))
    assert got.where("not (p <=> want)").isEmpty() and got.count() == 3000
    runs = skew.islands(df.withColumn("c", F.col("value") > 4), ["g"], ["ts", "id"], F.col("c") != F.col("pc"), {"c": "pc"})
    want = df.withColumn("c", F.col("value") > 4).withColumn("s", F.coalesce(F.col("c") != F.lag("c").over(w), F.lit(True)).cast("int"))
    want = want.withColumn("n", F.sum("s").over(w)).groupBy("g", "n").count()
    assert sorted((r.g, r["count"]) for r in runs.groupBy("g", "island").count().collect()) == sorted((r.g, r["count"]) for r in want.collect())


def test_next_of(spark):
    df = one_hour(spark).select("g", F.unix_seconds("ts").alias("at"))
    rows = [tuple(r) for r in df.collect()]
    got = skew.next_of(df, ["g"], "at", F.col("at") + 100, "nxt").distinct().collect()
    assert {(r.g, r["at"], r.nxt) for r in got} == {(g, a, min((b for h, b in rows if h == g and b >= a + 100), default=None)) for g, a in set(rows)}


def most_in_one_part(df):
    return df.groupBy(F.spark_partition_id().alias("p")).count().agg(F.max("count")).first()[0]


def test_owned_applications_are_not_dealt_to_one_task(spark):
    from hirelake.operators.scopes import can_withdraw
    apps = spark.range(0, 4000, 1, 8).select(F.col("id").alias("application_id"), (F.col("id") % 5).alias("job_id"), F.when(F.col("id") % 10 > 0, F.col("id")).alias("user_id"))
    jobs = spark.range(5).select(F.col("id").alias("job_id"), F.lit(1).alias("company"), F.lit(7).alias("created_by"))
    viewers = spark.createDataFrame([(1, "superuser", None), (7, "recruiter", 1), (8, "user", 1)], "user_id long, role string, company int")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = can_withdraw(apps, jobs, viewers)
        assert out.count() == 3600 + 2 * 400 and most_in_one_part(out) < 1000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_skill_views_group_a_bounded_number_of_rows_per_task(spark, stage, monkeypatch):
    from hirelake.sources import standins
    want = [sorted(map(tuple, df.collect())) for df in (stage.resume_skills, stage.jd_skills)]
    monkeypatch.setattr(standins, "ROWS", {"lineitem": 300, "part": 10})
    for df, rows in zip((stage.resume_skills, stage.jd_skills), want):
        assert sorted(map(tuple, df.collect())) == rows
        # more parts than the session's eight: the scan is dealt by rows
        assert df.select(F.spark_partition_id()).distinct().count() > 8 and most_in_one_part(df) < len(rows) / 4


def test_skill_views_broadcast_no_table_of_many_rows(spark, stage, monkeypatch):
    from hirelake.sources import standins
    views = "resume_skills", "jd_skills", "jobs", "skill_state"
    want = [sorted(map(str, getattr(stage, v).collect())) for v in views]
    monkeypatch.setattr(standins, "LOOKED_UP", 10)
    for view, rows in zip(views, want):
        df = getattr(stage, view)
        assert "SortMergeJoin" in df._jdf.queryExecution().executedPlan().toString() and sorted(map(str, df.collect())) == rows


def test_lists_per_application_are_grouped_in_parts_of_bounded_size(spark, stage, monkeypatch):
    from hirelake.catalog.relational import details
    from hirelake.sources import standins
    plain = lambda df: sorted((r.application_id, sorted(map(tuple, r.matched)), sorted(r.missing)) for r in df.collect())
    want = plain(details(stage))
    monkeypatch.setattr(standins, "ROWS", {**standins.ROWS, "orders": 50})
    df = details(stage)
    assert plain(df) == want and most_in_one_part(df) < 120 < len(want)


def test_blocks_hold_a_bounded_number_of_rows(spark, stage, monkeypatch):
    from hirelake.catalog.scoring import score_view, scored
    from hirelake.operators import similarity
    want = sorted(map(str, score_view(scored(stage)).collect()))
    monkeypatch.setattr(similarity, "ROWS", 50)
    df = scored(stage)
    assert most_in_one_part(df) < 120 < len(want) and sorted(map(str, score_view(df).collect())) == want
