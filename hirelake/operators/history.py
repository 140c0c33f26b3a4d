"""Change history: scopes, filters, labels and differences.

Takes ``audit(id, actor_id, actor_email, action, resource_type, resource_id,
before_json, after_json, created_at)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.snapshots import changed_fields, snap_field, strip_heavy
from .scopes import JOB_SCOPED_TYPES

# The snapshot field that names a row of each type.
LABEL_FIELDS = {"job": "title", "user": "email", "resume": "original_filename", "application": "job_id", "application_note": "job_id"}


def _snap(key: str) -> Column:
    return snap_field(F.col("before_json"), F.col("after_json"), key)


def job_ref() -> Column:
    """The job an audit row belongs to, as text."""
    return F.when(F.col("resource_type") == "job", F.col("resource_id").cast("string")).when(
        F.col("resource_type").isin(*JOB_SCOPED_TYPES), _snap("job_id"))


def _known_jobs(audit: DataFrame, live: DataFrame, key: str, value: str) -> DataFrame:
    """Keys of jobs that match now, and of those whose own history says they once did."""
    once = audit.where((F.col("resource_type") == "job") & (_snap(key) == value)).select(F.col("resource_id").cast("string").alias("ref"))
    return live.select(F.col("job_id").cast("string").alias("ref")).union(once).distinct()


def recruiter_scope(audit: DataFrame, jobs: DataFrame, viewer_id: int) -> DataFrame:
    """Rows about jobs the viewer owns or once owned, with their applications and notes."""
    mine = _known_jobs(audit, jobs.where(F.col("created_by") == viewer_id), "created_by_id", str(viewer_id))
    return audit.withColumn("ref", job_ref()).join(mine, "ref", "left_semi").drop("ref")


def admin_scope(audit: DataFrame, jobs: DataFrame, company: int | None) -> DataFrame:
    """Rows of one company: its jobs and users by snapshot, applications and notes by job; nothing without a company."""
    if company is None:
        return audit.where(F.lit(False))
    keys = _known_jobs(audit, jobs.where(F.col("company") == company), "company", str(company))
    children = audit.where(F.col("resource_type").isin(*JOB_SCOPED_TYPES)).withColumn("ref", _snap("job_id"))
    own = audit.where(F.col("resource_type").isin("job", "user") & (_snap("company") == str(company)))
    return own.unionByName(children.join(keys, "ref", "left_semi").drop("ref"))


def audit_filter(resource_type=None, resource_id=None, action=None, actor_id=None, job_id=None) -> Column:
    """AND of the given filters; ``job_id`` keeps the job itself and the rows that name it."""
    cond = F.lit(True)
    for col, value in (("resource_type", resource_type), ("resource_id", resource_id), ("action", action), ("actor_id", actor_id)):
        if value is not None:
            cond = cond & (F.col(col) == value)
    return cond if job_id is None else cond & (job_ref() == str(job_id))


def label_audit(audit: DataFrame, jobs: DataFrame, users: DataFrame, resumes: DataFrame) -> DataFrame:
    """Add ``label``: title, e-mail or file name of the row or its job, else what the snapshot holds."""
    child = F.col("resource_type").isin(*JOB_SCOPED_TYPES)
    snap = F.coalesce("before_json", "after_json")
    field = None
    for kind, key in LABEL_FIELDS.items():
        value = F.get_json_object(snap, f"$.{key}")
        field = F.when(F.col("resource_type") == kind, value) if field is None else field.when(F.col("resource_type") == kind, value)
    keyed = audit.withColumn("kind", F.when(child, "job").otherwise(F.col("resource_type"))).withColumn(
        "ref", F.when(child, _snap("job_id")).otherwise(F.col("resource_id").cast("string")))

    def named(kind: str, table: DataFrame, key: str, name: str) -> DataFrame:
        """Names of the rows that the history mentions; the keys are few, and typed like the table's."""
        asked = keyed.where(F.col("kind") == kind).select(F.col("ref").try_cast("bigint").alias(key)).distinct()
        return table.select(key, name).join(asked, key).select(F.lit(kind).alias("kind"), F.col(key).cast("string").alias("ref"), F.col(name).alias("name"))

    names = named("job", jobs, "job_id", "title").union(named("user", users, "user_id", "email")).union(named("resume", resumes, "resume_id", "original_filename"))
    return keyed.join(names, ["kind", "ref"], "left").withColumn("label", F.coalesce("name", field)).drop("kind", "ref", "name")


def with_changes(audit: DataFrame) -> DataFrame:
    """Add ``changed_fields`` and the display maps; stateless, so it runs on a stream as well."""
    return audit.withColumns({
        "changed_fields": changed_fields(F.col("before_json"), F.col("after_json")),
        "before": strip_heavy(F.col("before_json")), "after": strip_heavy(F.col("after_json")),
    })
