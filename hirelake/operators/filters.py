"""Filter builders: each returns one Column, so count and page share it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Allowed status changes of a job.
TRANSITIONS = (("draft", "published"), ("draft", "closed"), ("published", "closed"), ("closed", "published"))


def all_of(conds: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conds, F.lit(True))


def any_of(conds: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conds, F.lit(False))


def contains(cols: list[str], q: str | None) -> Column:
    """Literal, case-insensitive contains over any of the columns; a blank query keeps all rows."""
    if not q or not q.strip():
        return F.lit(True)
    return any_of([F.contains(F.lower(c), F.lit(q.strip().lower())) for c in cols])


def contains_wild(col: str, q: str) -> Column:
    """Case-insensitive contains in which ``%`` and ``_`` stay wildcards."""
    return F.col(col).ilike(f"%{q}%")


def one_of(col: str, values: list | None) -> Column:
    return F.col(col).isin(*values) if values else F.lit(True)


def in_range(col: str, lo=None, hi=None) -> Column:
    """Inclusive bounds; a null value drops out once a bound is given."""
    conds = []
    if lo is not None:
        conds.append(F.col(col) >= lo)
    if hi is not None:
        conds.append(F.col(col) <= hi)
    return all_of(conds)


def years_range(col: str, lo: float | None = None, hi: float | None = None) -> Column:
    """Bounds in years against a column in months (half-even rounding)."""
    m = lambda y: None if y is None else round(y * 12)
    return in_range(col, m(lo), m(hi))


def equal_if_given(**opts) -> Column:
    """AND of the equality filters that are given."""
    return all_of([F.col(k) == v for k, v in opts.items() if v is not None])


def job_filter(role: str, q: str | None = None, location: str | None = None, **opts) -> Column:
    """Job list filter; plain users only see published jobs."""
    conds = [equal_if_given(**opts), contains(["title", "department", "location"], q)]
    if role == "user":
        conds.append(F.col("status") == "published")
    if location:
        conds.append(contains_wild("location", location))
    return all_of(conds)


def has_skill(matched: Column, missing: Column, skill: str, state: str) -> Column:
    """A skill is in the stored explanation as ``matched``, ``proven`` or ``missing``; case-sensitive."""
    if state == "missing":
        return F.array_contains(missing, skill)
    if state == "proven":
        return F.exists(matched, lambda x: (x["jd_skill"] == skill) & (x["status"] == "proven"))
    return F.exists(matched, lambda x: x["jd_skill"] == skill)


def skill_conditions(matched: Column, missing: Column, conds: list[tuple[str, str]], mode: str = "all") -> Column:
    """All or any of ``(skill, state)`` conditions; no condition keeps every row."""
    if not conds:
        return F.lit(True)
    built = [has_skill(matched, missing, skill, state) for skill, state in conds]
    return all_of(built) if mode == "all" else any_of(built)


def list_text(col: str) -> Column:
    """The JSON text of a string list, with the blank after each comma."""
    esc = F.transform(col, lambda x: F.replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')))
    return F.when(F.size(col) == 0, F.lit("[]")).otherwise(F.concat(F.lit('["'), F.array_join(esc, '", "'), F.lit('"]')))


def list_text_contains(col: str, q: str) -> Column:
    """Free-text search in the JSON text of a list, so punctuation can match."""
    return F.contains(F.lower(list_text(col)), F.lit(q.strip().lower()))


def stale(now, after_minutes: int, max_retry: int, col: str = "extraction_status") -> Column:
    """Pending, untouched for ``after_minutes`` and with retries left."""
    cutoff = F.lit(now) - F.make_dt_interval(mins=F.lit(after_minutes))
    return (F.col(col) == "pending") & (F.col("updated_at") < cutoff) & (F.col("retry_count") < max_retry)


def retryable(now, after_minutes: int = 10, max_retry: int = 3, col: str = "extraction_status") -> Column:
    """What the retry sweep picks up: stale pending rows and failed rows of any age."""
    failed = (F.col(col) == "failed") & (F.col("retry_count") < max_retry)
    return stale(now, after_minutes, max_retry, col) | failed


def between_days(col: str, first=None, last=None) -> Column:
    """Whole-day bounds, both inclusive, open where not given."""
    conds = []
    if first is not None:
        conds.append(F.col(col) >= F.lit(first).cast("date"))
    if last is not None:
        conds.append(F.col(col) < F.date_add(F.lit(last).cast("date"), 1))
    return all_of(conds)


def within_next(col: str, now, days: int) -> Column:
    """From now to ``days`` later, both ends inclusive."""
    return F.col(col).between(F.lit(now), F.lit(now) + F.make_dt_interval(days=F.lit(days)))


def first_reason(*rules: tuple[Column, str]) -> Column:
    """The label of the first rule that holds, else null."""
    return F.coalesce(*[F.when(c, F.lit(label)) for c, label in rules])


def transition_check(changes: DataFrame) -> DataFrame:
    """``allowed`` for each wanted status change, with the first rule that blocks it.

    Takes (status, new_status, title, description, jd_raw_text).
    """
    moved = F.col("new_status") != F.col("status")
    legal = F.concat_ws(">", "status", "new_status").isin(*[f"{a}>{b}" for a, b in TRANSITIONS])
    publish = moved & (F.col("new_status") == "published")
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    return changes.withColumn("reason", first_reason(
        (moved & ~legal, "not allowed"),
        (publish & (blank("title") | blank("description")), "title and description needed"),
        (publish & blank("jd_raw_text"), "job description file needed"),
    )).withColumn("allowed", F.col("reason").isNull())


def apply_status(apps: DataFrame, new_status: Column) -> DataFrame:
    """Change the status and set or clear the sub-states; an equal status changes nothing."""
    change = F.lit(True) & ~new_status.eqNullSafe(F.col("status"))
    return apps.withColumns({
        "shortlist_stage": F.when(~change, F.col("shortlist_stage")).when(new_status == "shortlisted", "shortlisted"),
        "interview_at": F.when(~change, F.col("interview_at")),
        "interview_stage": F.when(~change, F.col("interview_stage")).when(new_status == "interviewing", "scheduled"),
        "status": new_status,
    })


def usable_reason(resumes: DataFrame, apps: DataFrame, job_id: int, actor: int) -> DataFrame:
    """Why a document cannot be put forward for a job; null means it can."""
    taken = apps.where(F.col("job_id") == job_id).select("resume_id").distinct().withColumn("_t", F.lit(True))
    return resumes.join(taken, "resume_id", "left").select("resume_id", first_reason(
        (~F.col("uploaded_by").eqNullSafe(F.lit(actor)), "not found"),
        (F.col("owner_id").isNotNull(), "belongs to an account"),
        (F.col("is_archived"), "archived"),
        (F.col("extraction_status") == "failed", "unreadable"),
        (F.col("_t").isNotNull(), "already applied"),
    ).alias("reason"))


def grant_reason(users: DataFrame) -> DataFrame:
    """First reason that blocks a role request; null means it may be granted."""
    return users.select("user_id", first_reason(
        (F.col("requested_role").isNull(), "no request"),
        (F.col("company").isNull(), "no company"),
        (F.col("role") != "user", "not a plain user"),
    ).alias("reason"))


def live_tokens(tokens: DataFrame, revoked: DataFrame, users: DataFrame, now) -> DataFrame:
    """Tokens not revoked, whose session is live and whose account is active."""
    live = F.col("revoked_at").isNull() & (F.col("expires_at") > F.lit(now))
    return (
        tokens.where(live).join(revoked, "token", "left_anti")
        .join(users.where("is_active").select("user_id"), "user_id", "left_semi")
    )


def clamp(col: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(col, F.lit(lo)), F.lit(hi))


def active_filters(*conds: Column) -> Column:
    """How many of the filters are set."""
    return reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(False)).cast("int") for c in conds])
