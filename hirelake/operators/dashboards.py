"""Grouped counters for the role dashboards."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Application statuses, and the funnel bucket each one counts in.
STATUSES = ("applied", "under_review", "shortlisted", "interviewing", "hired", "rejected")
FUNNEL = (("applied", "applied"), ("reviewing", "under_review"), ("shortlisted", "shortlisted"),
          ("interview", "interviewing"), ("hired", "hired"), ("rejected", "rejected"))


def count_by(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def job_counters(apps: DataFrame) -> DataFrame:
    """Every per-job counter in one pass."""
    return apps.groupBy("job_id").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("status") == "applied").alias("new"),
        F.count_if(F.col("match_status") == "pending").alias("scoring"),
        F.count_if(F.col("status") == "shortlisted").alias("shortlisted"),
    )


def job_board(jobs: DataFrame, counters: DataFrame, n: int = 100) -> DataFrame:
    """Newest jobs with their counters; jobs without applications show zeros."""
    newest = jobs.orderBy(F.desc_nulls_last("created_at"), F.asc("job_id")).limit(n)
    return newest.join(counters, "job_id", "left").select(
        "job_id", "title", "status", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "new", "scoring", "shortlisted")])


def funnel(apps: DataFrame) -> DataFrame:
    """Six fixed buckets, zero where empty, as (bucket, n)."""
    row = apps.agg(*[F.count_if(F.col("status") == st).alias(b) for b, st in FUNNEL])
    return row.unpivot([], [b for b, _ in FUNNEL], "bucket", "n")


def stage_counts(apps: DataFrame) -> DataFrame:
    """Per job one column per status, and the total; one pass, no pivot discovery."""
    return apps.groupBy("job_id").agg(
        F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("status") == st).alias(st) for st in STATUSES])


def quick_actions(jobs: DataFrame, counters: DataFrame, upcoming: DataFrame) -> DataFrame:
    """Dashboard totals of the jobs given, in one row."""
    names = ("draft_jobs", "published_jobs", "new_applicants", "still_scoring", "shortlisted", "upcoming_interviews")

    def row(df: DataFrame, **given) -> DataFrame:
        return df.agg(*[given.get(n, F.lit(0)).cast("bigint").alias(n) for n in names])

    z = lambda c: F.coalesce(F.sum(c), F.lit(0))
    parts = (
        row(jobs, draft_jobs=F.count_if(F.col("status") == "draft"), published_jobs=F.count_if(F.col("status") == "published"))
        .unionByName(row(counters, new_applicants=z("new"), still_scoring=z("scoring"), shortlisted=z("shortlisted")))
        .unionByName(row(upcoming, upcoming_interviews=F.count(F.lit(1))))
    )
    return parts.agg(*[F.sum(n).alias(n) for n in names])


def attention(jobs: DataFrame, counters: DataFrame) -> DataFrame:
    """Jobs that need their owner, with the first rule that holds."""
    n = F.coalesce("new", F.lit(0))
    rule = (
        F.when((F.col("status") == "published") & (n > 0), "review")
        .when((F.col("status") == "published") & (F.coalesce("total", F.lit(0)) == 0), "published")
        .when((F.col("status") == "draft") & F.col("jd_raw_text").isNull(), "draft")
    )
    return (
        jobs.join(counters, "job_id", "left").withColumn("attention_type", rule).where("attention_type is not null")
        .select("job_id", "attention_type", n.alias("new_count"))
    )


def onboarding(users: DataFrame, resumes: DataFrame, apps: DataFrame) -> DataFrame:
    """Checklist per user: profile, document, first application."""
    r = resumes.where("owner_id is not null and not is_archived").select(F.col("owner_id").alias("user_id")).distinct()
    a = apps.where("user_id is not null").select("user_id").distinct()
    return (
        users.join(r.withColumn("_r", F.lit(True)), "user_id", "left")
        .join(a.withColumn("_a", F.lit(True)), "user_id", "left")
        .select("user_id", (F.col("full_name").isNotNull() & F.col("phone").isNotNull()).alias("profile_complete"),
                F.coalesce("_r", F.lit(False)).alias("has_resume"), F.coalesce("_a", F.lit(False)).alias("has_applied"))
    )


def owner_guard(users: DataFrame, jobs: DataFrame) -> DataFrame:
    """Jobs each account still owns; any blocks its removal."""
    n = jobs.groupBy(F.col("created_by").alias("user_id")).agg(F.count(F.lit(1)).alias("owned_jobs"))
    return users.select("user_id").join(n, "user_id", "left").select(
        "user_id", F.coalesce("owned_jobs", F.lit(0)).alias("owned_jobs")).withColumn("can_remove", F.col("owned_jobs") == 0)
