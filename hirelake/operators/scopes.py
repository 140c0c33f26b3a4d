"""Who may see or change which rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Audit rows of these types belong to a job named in their snapshot.
JOB_SCOPED_TYPES = ("application", "application_note")


def read_clause(role: str, company: int | None) -> Column:
    """Jobs one viewer may read, as a filter that reaches the scan."""
    if role == "superuser":
        return F.lit(True)
    if role in ("admin", "recruiter") and company is not None:
        return F.col("company") == F.lit(company)
    return F.lit(False)


def read_scope(jobs: DataFrame, users: DataFrame, viewer_id: int) -> DataFrame:
    """Jobs one account may read, with ``viewer_id`` and ``viewer_role``; its role and company are looked up as scalars."""
    me = users.where(F.col("user_id") == viewer_id)
    role, company = me.select("role").scalar(), me.select("company").scalar()
    seen = (role == "superuser") | (role.isin("admin", "recruiter") & (F.col("company") == company))
    return jobs.where(seen).withColumns({"viewer_id": F.lit(viewer_id).cast("bigint"), "viewer_role": role})


def write_scope(jobs: DataFrame, users: DataFrame, viewer_id: int) -> DataFrame:
    """Jobs one account may write: a recruiter only their own jobs in their company."""
    return read_scope(jobs, users, viewer_id).where((F.col("viewer_role") != "recruiter") | (F.col("created_by") == F.col("viewer_id")))


def resume_scope(resumes: DataFrame, apps: DataFrame, writable: DataFrame, viewer_id: int) -> DataFrame:
    """Documents a viewer may open: own, uploaded, or of an applicant to a job they may write."""
    reach = apps.join(writable.select("job_id"), "job_id", "left_semi").where("resume_id is not null").select("resume_id").distinct()
    return (
        resumes.join(reach.withColumn("_r", F.lit(True)), "resume_id", "left")
        .where(F.col("_r").isNotNull() | (F.col("owner_id") == viewer_id) | (F.col("uploaded_by") == viewer_id))
        .drop("_r")
    )


def can_withdraw(apps: DataFrame, jobs: DataFrame, viewers: DataFrame) -> DataFrame:
    """(application, viewer) pairs: the owner of an account row; of an unowned row those of the asking accounts that may write its job.

    ``viewers(user_id, role, company)``, any number of them.  A viewer and a job
    meet in one equi-join on the scope that gives the right: everything, a
    company, or a creator in a company.  Owned rows take no part in the join: with
    a null job they would all be dealt to one task.
    """
    part = lambda kind, *cols: F.concat_ws(":", F.lit(kind), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols])
    role, placed = F.col("role"), F.col("company").isNotNull()
    scope = (F.when(role == "superuser", F.lit("all")).when((role == "admin") & placed, part("company", "company"))
             .when((role == "recruiter") & placed, part("creator", "company", "user_id")))
    asking = viewers.select(F.col("user_id").alias("viewer_id"), scope.alias("scope")).where("scope IS NOT NULL")
    rights = F.array(F.lit("all"), part("company", "company"), part("creator", "company", "created_by"))
    open_jobs = jobs.select("job_id", F.explode(rights).alias("scope")).join(asking, "scope").select("job_id", "viewer_id")
    own = apps.select("application_id", "job_id", "user_id")
    unowned = own.where("user_id IS NULL").join(open_jobs, "job_id").select("application_id", "viewer_id")
    return own.where("user_id IS NOT NULL").select("application_id", F.col("user_id").alias("viewer_id")).unionByName(unowned.where("viewer_id IS NOT NULL"))


def library(resumes: DataFrame, viewer_id: int, role: str) -> DataFrame:
    """Active documents of one viewer: owned for plain users, uploaded for staff."""
    col = "owner_id" if role == "user" else "uploaded_by"
    return resumes.where((F.col(col) == viewer_id) & ~F.col("is_archived"))
