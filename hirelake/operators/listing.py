"""Ranking, paging and newest-N lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .skew import earliest, rank_rows


def with_people(apps: DataFrame, users: DataFrame, resumes: DataFrame) -> DataFrame:
    """Applications with their optional account, document and submitter; every application is kept."""
    u = users.select("user_id", F.col("full_name").alias("user_name"), F.col("email").alias("user_email"))
    by = users.select(F.col("user_id").alias("submitted_by_id"), F.col("email").alias("submitted_by_email"))
    r = resumes.select("resume_id", "candidate_name", "candidate_email", "original_filename", "experience_months")
    return apps.join(u, "user_id", "left").join(r, "resume_id", "left").join(by, "submitted_by_id", "left")


def display_identity(df: DataFrame) -> DataFrame:
    """Shown name and e-mail, and the (different) name used for sorting.  Takes :func:`with_people` rows."""
    account = F.col("user_id").isNotNull() & F.col("user_email").isNotNull()
    return df.withColumns({
        "applicant_name": F.when(account, F.col("user_name")).otherwise(F.coalesce("candidate_name", "original_filename")),
        "applicant_email": F.when(account, F.col("user_email")).otherwise(F.col("candidate_email")),
        "sort_name": F.lower(F.coalesce("user_name", "user_email", "candidate_name", "original_filename")),
    })


def score_order() -> list[Column]:
    """Best score first with unscored last, then earliest applied, name, id."""
    return [F.desc_nulls_last("match_score"), F.asc_nulls_last("applied_at"), F.asc_nulls_last("sort_name"), F.asc("application_id")]


def listing_order(sort: str) -> list[Column]:
    return score_order() if sort == "score" else [F.desc_nulls_last("applied_at"), F.asc("application_id")]


def rank_applicants(df: DataFrame, score: str = "match_score", **kw) -> DataFrame:
    """Rank per job in the order of :func:`score_order`, also for a job with very many applicants."""
    order = F.struct(
        F.col(score).isNull().alias("a"), (-F.col(score)).alias("b"), F.col("applied_at").isNull().alias("c"),
        F.col("applied_at").alias("d"), F.col("sort_name").isNull().alias("e"), F.col("sort_name").alias("f"),
        F.col("application_id").alias("g"),
    )
    return rank_rows(df, ["job_id"], order, "rank", **kw)


def page(df: DataFrame, order: list[Column], limit: int = 50, offset: int = 0) -> DataFrame:
    """One page; 1..200 rows.  Becomes one top-k operator over offset + limit rows; see :func:`deep_page` for large offsets."""
    if not 1 <= limit <= 200 or offset < 0:
        raise ValueError("limit must be 1..200 and offset not negative")
    return df.orderBy(*order).offset(offset).limit(limit)


def deep_page(df: DataFrame, order: Column, limit: int = 50, offset: int = 0) -> DataFrame:
    """The same page for a large offset: ``order`` is a struct; rows are placed in parallel, none pass through one task."""
    placed = rank_rows(df, [], order, "_place")
    return placed.where(F.col("_place").between(offset + 1, offset + limit)).drop("_place")


def page_with_total(df: DataFrame, order: list[Column], limit: int = 50, offset: int = 0) -> DataFrame:
    """The page with the size of the whole filtered set on each row."""
    total = df.agg(F.count(F.lit(1)).alias("total"))
    return page(df, order, limit, offset).withColumn("total", total.scalar())


def top(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """First ``n`` rows of an order."""
    return df.orderBy(*order).limit(n)


def dedupe_keep_first(df: DataFrame, keys: list[str], pos: list[str]) -> DataFrame:
    """First row per key by position; map-side combined, so a hot key stays cheap."""
    return earliest(df, keys, pos)


def merge_sources(skills: DataFrame, order: tuple[str, ...] = ("skills_section", "work_experience", "projects")) -> DataFrame:
    """One flat list per document: fixed source order, then list order, first spelling wins."""
    rank = F.array_position(F.array(*[F.lit(x) for x in order]), F.col("source"))
    from ..functions.skills import normalize_ws
    rows = skills.where(rank > 0).select("resume_id", normalize_ws(F.col("skill")).alias("norm"), "skill",
                                         F.struct(rank.alias("r"), F.col("pos").alias("p")).alias("place"))
    return earliest(rows, ["resume_id", "norm"], ["place", "skill"])
