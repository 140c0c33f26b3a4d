"""Writers and table changes: CSV, audit append, upsert, purge, erase, backfill, edits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.snapshots import to_snapshot
from ..operators.listing import display_identity
from ..operators.skew import latest


def formula_guard(c: Column) -> Column:
    """Put a quote before text a spreadsheet would run as a formula; null becomes empty."""
    v = F.coalesce(c.cast("string"), F.lit(""))
    return F.when(v.rlike(r"^\s*[=+@]"), F.concat(F.lit("'"), v)).otherwise(v)


def csv_line(cols: list[Column]) -> Column:
    """One RFC 4180 line of guarded cells."""
    def cell(c: Column) -> Column:
        g = formula_guard(c)
        return F.when(g.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(g, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(g)

    return F.concat_ws(",", *[cell(c) for c in cols])


def export_csv(df: DataFrame, path: str, columns: list[str] | None = None, order: list[str] | None = None) -> bool:
    """Write one guarded CSV as ordered parts: joined by name they are a valid file (UTF-8 mark, one header, CRLF lines).

    The header is the least row of the order, so it leads the first part, and
    only there.  ``order`` is that of the rows, the exported columns by default.
    An empty input writes nothing.  Lines are built here because the CSV writer
    would also rewrite line breaks inside cells.
    """
    if df.isEmpty():
        return False
    names = columns or df.columns
    order = order or names
    quoted = ['"' + n.replace('"', '""') + '"' if set(n) & set(',"\r\n') else n for n in names]
    keys = [f"_k{i}" for i in range(len(order))]
    rows = df.select(F.lit(1).alias("_body"), *[F.col(c).alias(k) for c, k in zip(order, keys)], csv_line([F.col(c) for c in names]).alias("value"))
    head = df.sparkSession.range(1).select(F.lit(0).alias("_body"), *[F.lit(None).cast(rows.schema[k].dataType).alias(k) for k in keys], F.lit("\ufeff" + ",".join(quoted)).alias("value"))
    placed = head.unionByName(rows).repartitionByRange("_body", *keys).sortWithinPartitions("_body", *keys)
    placed.select("value").write.mode("overwrite").option("lineSep", "\r\n").text(path)
    return True


def applicant_export(people: DataFrame, jobs: DataFrame) -> DataFrame:
    """The ten export columns, null as empty text.  Takes rows of ``with_people``."""
    d = display_identity(people).join(jobs.select("job_id", F.col("title").alias("job_title")), "job_id", "left")
    names = {"applicant_name": "applicant_name", "applicant_email": "applicant_email", "job_title": "job_title", "application_status": "status",
             "shortlist_stage": "shortlist_stage", "applied_at": "applied_at", "interview_at": "interview_at", "match_score": "match_score",
             "manual_score": "manual_score", "resume_filename": "original_filename"}
    return d.select("application_id", *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(k) for k, c in names.items()])


def audit_rows(df: DataFrame, kind: str, key: str, action: str, actor_id: int | None, now) -> DataFrame:
    """Audit rows holding the full snapshot of each row: before for a delete, after otherwise."""
    snap = to_snapshot(df.columns, kind)
    none = F.lit(None).cast("string")
    return df.select(
        F.lit(actor_id).cast("bigint").alias("actor_id"), F.lit(action).alias("action"), F.lit(kind).alias("resource_type"),
        F.col(key).alias("resource_id"), (snap if action == "delete" else none).alias("before_json"),
        (none if action == "delete" else snap).alias("after_json"), F.lit(now).alias("created_at"))


def append_audit(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def upsert(df: DataFrame, updates: DataFrame, keys: list[str], version: list[str]) -> DataFrame:
    """Union keeping the newest row per key; writing the same key twice is one row."""
    return latest(df.unionByName(updates), keys, version)


def create_table(df: DataFrame, table: str, part: str) -> None:
    """A catalog table partitioned by ``part``, for the changes below."""
    df.write.partitionBy(part).format("parquet").saveAsTable(table)


def overwrite_parts(df: DataFrame, table: str) -> None:
    """Replace the partitions that ``df`` has rows of; the files of all others stay as they are."""
    conf, name = df.sparkSession.conf, "spark.sql.sources.partitionOverwriteMode"
    before = conf.get(name)
    conf.set(name, "dynamic")
    try:
        df.select(*df.sparkSession.table(table).columns).write.mode("overwrite").insertInto(table)
    finally:
        conf.set(name, before)


def upsert_table(updates: DataFrame, table: str, keys: list[str], version: list[str], part: str) -> None:
    """:func:`upsert` into a partitioned table; only partitions that updates fall into are read and rewritten.

    A key's partition must not change: ``part`` follows from the keys.
    """
    old = updates.sparkSession.table(table)
    touched = old.join(updates.select(part).distinct(), part, "left_semi").select(*old.columns)
    overwrite_parts(upsert(touched, updates.select(*old.columns), keys, version), table)


def purge_table(spark: SparkSession, table: str, gone: Column, part: str) -> int:
    """:func:`purge` on a partitioned table: partitions without such rows are not touched, those with nothing else are dropped; gives the count removed."""
    drop = F.coalesce(gone, F.lit(False))
    rows = spark.table(table)
    found = rows.groupBy(part).agg(F.count_if(drop).alias("removed"), F.count_if(~drop).alias("kept")).where("removed > 0").collect()  # a row per partition
    mixed = [r[0] for r in found if r.kept]
    if mixed:
        overwrite_parts(rows.where(F.col(part).isin(mixed) & ~drop), table)
    for r in found:
        if not r.kept:
            value = str(r[0]).replace("'", "\\'")
            spark.sql(f"ALTER TABLE {table} DROP PARTITION (`{part}` = '{value}')")
    return sum(r.removed for r in found)


def expired_sessions(now) -> Column:
    """Sessions that can never be used again: past their end, or revoked more than a day ago."""
    return (F.col("expires_at") < F.lit(now)) | F.coalesce(F.col("revoked_at") < F.lit(now) - F.make_dt_interval(days=F.lit(1)), F.lit(False))


def purge(df: DataFrame, gone: Column) -> tuple[DataFrame, DataFrame]:
    """(kept rows, one row with the count of removed ones)."""
    drop = F.coalesce(gone, F.lit(False))
    return df.where(~drop), df.agg(F.count_if(drop).alias("removed"))


def erase_owner(owners: DataFrame, resumes: DataFrame, apps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(resumes kept, applications kept) after erasing accounts.

    Gone are an account's own documents, its unowned uploads, its applications,
    and applications that point at a document that is gone.
    """
    who = owners.select("user_id").distinct()
    keyed = resumes.withColumn("_who", F.coalesce("owner_id", "uploaded_by"))
    gone = keyed.join(who.withColumnRenamed("user_id", "_who"), "_who", "left_semi").select("resume_id")
    kept = keyed.join(who.withColumnRenamed("user_id", "_who"), "_who", "left_anti").drop("_who").select(*resumes.columns)
    apps_kept = apps.join(who, "user_id", "left_anti").join(gone, "resume_id", "left_anti").select(*apps.columns)
    return kept, apps_kept


def backfill(child: DataFrame, parent: DataFrame, on: str, parent_key: str, col: str, default) -> DataFrame:
    """Fill null ``col`` from the parent row, then from the default."""
    p = parent.select(F.col(parent_key).alias(on), F.col(col).alias("_p"))
    return child.join(p, on, "left").withColumn(col, F.coalesce(F.col(col), F.col("_p"), F.lit(default))).drop("_p")


def backfill_when(df: DataFrame, cond: Column, col: str, value) -> DataFrame:
    return df.withColumn(col, F.when(cond, F.lit(value)).otherwise(F.col(col)))


def bulk_status(ids: DataFrame, apps: DataFrame, job_id: int, status: str) -> DataFrame:
    """Per distinct id of one job: changed, unchanged or not found."""
    mine = apps.where(F.col("job_id") == job_id).select("application_id", "status")
    return ids.select("application_id").distinct().join(mine, "application_id", "left").select(
        "application_id", F.when(F.col("status").isNull(), "not found").when(F.col("status") == status, "unchanged").otherwise("changed").alias("result"))


def archive_previous(resumes: DataFrame) -> DataFrame:
    """Only the newest document of each owner stays active; unowned ones are left alone.

    The newest is found by a map-side ``max``, not by ordering the owner's rows.
    """
    newest = resumes.where("owner_id is not null").groupBy("owner_id").agg(F.max(F.struct("created_at", "resume_id")).alias("_n"))
    return resumes.join(newest, "owner_id", "left").withColumn(
        "is_archived", F.when(F.col("_n").isNotNull(), F.col("_n.resume_id") != F.col("resume_id")).otherwise(F.col("is_archived"))).drop("_n")


def apply_edits(df: DataFrame, edits: DataFrame, key: str, cols: list[str]) -> tuple[DataFrame, DataFrame]:
    """(new table, real changes): an edit to the same value writes and logs nothing; other columns stay."""
    e = edits.select(key, *[F.col(c).alias(f"_new_{c}") for c in cols], F.lit(True).alias("_e"))
    j = df.join(e, key, "left")
    differs = F.col("_e").isNotNull() & reduce(lambda a, b: a | b, [~F.col(c).eqNullSafe(F.col(f"_new_{c}")) for c in cols])
    new = j.withColumns({c: F.when(F.col("_e").isNotNull(), F.col(f"_new_{c}")).otherwise(F.col(c)) for c in cols}).select(*df.columns)
    changes = j.where(differs).select(key, *[x for c in cols for x in (F.col(c).alias(f"old_{c}"), F.col(f"_new_{c}").alias(f"new_{c}"))])
    return new, changes
