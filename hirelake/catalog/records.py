"""History, quality, intake and table-change queries."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..functions import snapshots as snap
from ..operators import history as hist
from ..operators import listing, quality
from ..sources import intake, sinks
from .registry import query
from .relational import _PEOPLE, people

# ---- history --------------------------------------------------------------------

_REF = "coalesce(json_extract_string(after_json, '$.{0}'), json_extract_string(before_json, '$.{0}'))"
_JOBREF = f"CASE WHEN resource_type = 'job' THEN CAST(resource_id AS STRING) WHEN resource_type IN ('application', 'application_note') THEN {_REF.format('job_id')} END"


@query("json_parent_ref", f"SELECT id, {_JOBREF} AS ref FROM v_audit")
def _(s):
    return s.audit.select("id", hist.job_ref().alias("ref"))


_DIFF = """SELECT a.id, string_agg(k.k, ',' ORDER BY k.k) AS fields FROM v_audit a JOIN
 (SELECT DISTINCT id, unnest(list_concat(json_keys(before_json), json_keys(after_json))) AS k FROM v_audit WHERE before_json IS NOT NULL AND after_json IS NOT NULL) k ON k.id = a.id
 WHERE k.k <> 'updated_at' AND json_extract_string(a.before_json, '$.' || k.k) IS DISTINCT FROM json_extract_string(a.after_json, '$.' || k.k) GROUP BY 1"""


@query("changed_fields", f"SELECT a.id, coalesce(d.fields, '') AS fields FROM v_audit a LEFT JOIN ({_DIFF}) d ON d.id = a.id")
def _(s):
    return s.audit.select("id", F.array_join(snap.changed_fields(F.col("before_json"), F.col("after_json")), ",").alias("fields"))


@query("strip_heavy_keys", """SELECT id, array_to_string(list_sort(list_filter(json_keys(after_json), lambda k: k <> 'match_details')), ',') AS keys FROM v_audit WHERE after_json IS NOT NULL""")
def _(s):
    return s.audit.where("after_json is not null").select("id", F.array_join(F.sort_array(F.map_keys(snap.strip_heavy(F.col("after_json")))), ",").alias("keys"))


@query("audit_scope_recruiter", f"""SELECT id FROM v_audit WHERE {_JOBREF} IN (SELECT CAST(job_id AS STRING) FROM v_jobs WHERE created_by = 5
 UNION SELECT CAST(resource_id AS STRING) FROM v_audit WHERE resource_type = 'job' AND {_REF.format('created_by_id')} = '5')""")
def _(s):
    return hist.recruiter_scope(s.audit, s.jobs, 5).select("id")


@query("audit_scope_admin", f"""SELECT id FROM v_audit WHERE (resource_type IN ('job', 'user') AND {_REF.format('company')} = '1') OR (resource_type IN ('application', 'application_note') AND
 {_REF.format('job_id')} IN (SELECT CAST(job_id AS STRING) FROM v_jobs WHERE company = 1 UNION SELECT CAST(resource_id AS STRING) FROM v_audit WHERE resource_type = 'job' AND {_REF.format('company')} = '1'))""")
def _(s):
    return hist.admin_scope(s.audit, s.jobs, 1).select("id")


@query("audit_by_parent", f"SELECT id FROM v_audit WHERE {_JOBREF} = '31' AND action <> 'none'")
def _(s):
    return s.audit.where(hist.audit_filter(job_id=31)).select("id")


_LABEL = f"""SELECT a.*, coalesce(j.title, u.email, r.original_filename, json_extract_string(coalesce(before_json, after_json),
 CASE resource_type WHEN 'job' THEN '$.title' WHEN 'user' THEN '$.email' WHEN 'resume' THEN '$.original_filename' ELSE '$.job_id' END)) AS label FROM v_audit a
 LEFT JOIN v_jobs j ON CAST(j.job_id AS STRING) = {_JOBREF} LEFT JOIN v_users u ON a.resource_type = 'user' AND u.user_id = a.resource_id
 LEFT JOIN v_resumes r ON a.resource_type = 'resume' AND r.resume_id = a.resource_id"""


@query("audit_labels", f"SELECT id, label FROM ({_LABEL})")
def _(s):
    return hist.label_audit(s.audit, s.jobs, s.users, s.resumes).select("id", "label")


@query("audit_page", f"""SELECT p.id, p.label, coalesce(d.fields, '') AS fields FROM (SELECT * FROM ({_LABEL}) WHERE action = 'update' ORDER BY created_at DESC, id DESC LIMIT 50 OFFSET 50) p
 LEFT JOIN ({_DIFF}) d ON d.id = p.id""")
def _(s):
    from ..plans.composed import audit_page
    page = audit_page(s.audit.where(hist.audit_filter(action="update")), s.jobs, s.users, s.resumes, 50, 50)
    return page.select("id", "label", F.array_join("changed_fields", ",").alias("fields"))


@query("snapshot_columns", """SELECT user_id, CASE WHEN full_name IS NULL THEN 'null' ELSE full_name END || '|' || email || '|false' AS fields FROM v_users""")
def _(s):
    u = s.users.select("user_id", "full_name", "email", F.lit("secret").alias("hashed_password"))
    js = snap.to_snapshot(u.columns, "user")
    return u.select("user_id", F.concat_ws("|", F.coalesce(F.get_json_object(js, "$.full_name"), F.lit("null")), F.get_json_object(js, "$.email"),
                                           F.contains(js, F.lit("hashed")).cast("string")).alias("fields"))


@query("audit_snapshot", """SELECT application_id AS resource_id, 'delete' AS action, CAST(job_id AS STRING) || '/' || status AS held, after_json IS NULL AS empty_after
FROM (SELECT *, NULL AS after_json FROM v_applications)""")
def _(s):
    rows = sinks.audit_rows(s.applications, "application", "application_id", "delete", 5, dt.datetime(2024, 1, 1))
    return rows.select("resource_id", "action", F.concat_ws("/", F.get_json_object("before_json", "$.job_id"), F.get_json_object("before_json", "$.status")).alias("held"),
                       F.col("after_json").isNull().alias("empty_after"))


# ---- quality --------------------------------------------------------------------

_PAD = "SELECT file, ' ' || replace(lower(skill), '/', ' ') || ' ' AS skill FROM {}"
_CLOSE = "(contains(p.skill, g.skill) OR contains(g.skill, p.skill))"
_FUZZY = f"""g AS ({_PAD.format('v_gold')}), p AS ({_PAD.format('(SELECT file, replace(skill, chr(32) || chr(98) || chr(111) || chr(108) || chr(116), chr(47) || chr(98) || chr(111) || chr(108) || chr(116)) AS skill FROM v_pred)')}),
f AS (SELECT DISTINCT g.file FROM g JOIN p ON p.file = g.file),
miss AS (SELECT file, skill FROM g WHERE file IN (SELECT file FROM f) AND NOT EXISTS (SELECT 1 FROM p WHERE p.file = g.file AND {_CLOSE})),
ext AS (SELECT file, skill FROM p WHERE file IN (SELECT file FROM f) AND NOT EXISTS (SELECT 1 FROM g WHERE p.file = g.file AND {_CLOSE}))"""


def _pred(s):
    return s.pred.withColumn("skill", F.replace("skill", F.lit(" bolt"), F.lit("/bolt")))


@query("fuzzy_set_match", f"WITH {_FUZZY} SELECT file, 'missing' AS side, trim(skill) AS skill FROM miss UNION ALL SELECT file, 'extra', trim(skill) FROM ext")
def _(s):
    sets = quality.fuzzy_sets(_pred(s), s.gold)
    return (sets.select("file", F.lit("missing").alias("side"), F.explode("missing").alias("skill"))
            .union(sets.select("file", F.lit("extra"), F.explode("extra")))).withColumn("skill", F.trim("skill"))


@query("eval_prf", f"""WITH {_FUZZY}, t AS (SELECT (SELECT count(*) FROM g WHERE file IN (SELECT file FROM f)) AS want, (SELECT count(*) FROM miss) AS fn, (SELECT count(*) FROM ext) AS fp,
 (SELECT count(*) FROM f) AS checked, (SELECT count(*) FROM f WHERE file NOT IN (SELECT file FROM miss) AND file NOT IN (SELECT file FROM ext)) AS exact)
SELECT want - fn AS tp, fp, fn, checked, exact, round((want - fn) / CAST(want - fn + fp AS DOUBLE), 6) AS precision, round((want - fn) / CAST(want AS DOUBLE), 6) AS recall,
 round(2.0E0 * (want - fn) / CAST(2 * (want - fn) + fp + fn AS DOUBLE), 6) AS f1 FROM t""")
def _(s):
    return quality.eval_prf(_pred(s), s.gold).withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


_GSEC = """SELECT doc_id AS file, CASE WHEN doc_id % 7 <> 0 THEN 'Section ' || CAST(doc_id % 5 AS STRING) || ':' END AS gold_heading,
 CASE WHEN doc_id % 7 <> 0 THEN '- Last  ' || CAST(doc_id % 4 AS STRING) END AS gold_last_line FROM documents"""
_PSEC = """SELECT doc_id AS file, quality = 1 AS found, CASE WHEN quality = 1 THEN 'SECTION ' || CAST(doc_id % 3 AS STRING) END AS heading,
 CASE WHEN quality = 1 THEN 'x' || {nl} || 'last ' || CAST(doc_id % 2 AS STRING) || {nl} ELSE '' END AS section_text FROM labels"""


@query("eval_sections", f"""SELECT count(*) AS n, count(*) FILTER (p.found IS NOT NULL AND p.found = (g.gold_heading IS NOT NULL)) AS found_ok,
 count(*) FILTER (p.found IS NOT NULL AND CASE WHEN g.gold_heading IS NOT NULL THEN p.found AND g.file % 5 = g.file % 3 ELSE NOT p.found END) AS heading_ok,
 count(*) FILTER (p.found IS NOT NULL AND CASE WHEN g.gold_heading IS NOT NULL THEN p.found AND g.file % 4 = g.file % 2 ELSE NOT p.found END) AS boundary_ok
FROM ({_GSEC}) g LEFT JOIN ({_PSEC.format(nl='chr(10)')}) p ON p.file = g.file""")
def _(s):
    return quality.eval_sections(s.sql(_PSEC.format(nl="chr(10)")), s.sql(_GSEC))


_CALLS = "SELECT 'f' || CAST(conv_id AS STRING) AS file, CASE WHEN role = 'user' THEN length(text) END AS prompt_tokens, CASE WHEN role <> 'user' THEN length(text) END AS completion_tokens FROM conversations"


@query("token_rollup", f"""SELECT file, CAST(sum(coalesce(prompt_tokens, 0)) AS BIGINT) AS prompt_tokens, CAST(sum(coalesce(completion_tokens, 0)) AS BIGINT) AS completion_tokens
FROM ({_CALLS}) GROUP BY ROLLUP(file)""")
def _(s):
    return quality.token_rollup(s.sql(_CALLS))


@query("constraint_violations", """SELECT 'user applies once' AS rule, CAST(user_id AS STRING) || '/' || CAST(job_id AS STRING) AS key, count(*) AS n FROM v_applications WHERE user_id IS NOT NULL GROUP BY user_id, job_id HAVING count(*) > 1
UNION ALL SELECT 'document applies once', CAST(job_id AS STRING) || '/' || CAST(resume_id AS STRING), count(*) FROM v_applications WHERE user_id IS NULL AND resume_id IS NOT NULL GROUP BY job_id, resume_id HAVING count(*) > 1
UNION ALL SELECT 'one superuser', 'superuser', count(*) FROM v_users WHERE role = 'superuser' HAVING count(*) > 1
UNION ALL SELECT 'manual score range', CAST(application_id AS STRING), 1 FROM v_applications WHERE manual_score < 0 OR manual_score > 100""")
def _(s):
    return quality.constraint_violations(s.applications, s.users)


# ---- intake and exports -----------------------------------------------------------

_FILES = """SELECT doc_id, 'doc' || CAST(doc_id AS STRING) || CASE doc_id % 5 WHEN 0 THEN '.txt' WHEN 1 THEN '.PDF' WHEN 2 THEN '.docx' WHEN 3 THEN '.exe' ELSE '' END AS file_name,
 CASE WHEN doc_id % 17 = 0 THEN '' WHEN doc_id % 19 = 0 THEN substr(text, 1, 30) ELSE text END AS text FROM documents"""


def _clean_sql():
    from .texts import _CLEAN
    return _CLEAN


@query("ingest_documents", f"""SELECT doc_id, CASE WHEN raw_len = 0 THEN 'empty' WHEN doc_id % 5 > 2 THEN 'unsupported type' WHEN length(x) < 50 THEN 'too little text' END AS reason, CAST(length(x) AS INT) AS n
FROM (SELECT doc_id, length(text0) AS raw_len, {_clean_sql()} AS x FROM (SELECT doc_id, text AS text0, text FROM ({_FILES})))""")
def _(s):
    return intake.ingest_text(s.sql(_FILES)).select("doc_id", "reason", F.length("clean").alias("n"))


_TYPES = ("application/pdf", "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "image/png", "image/jpeg", "image/webp", "text/plain")


def _uploads(s):
    """Documents as byte content with a real leading mark, and a declared type that is right for half of them."""
    mark = F.expr("""CASE doc_id % 6 WHEN 0 THEN X'255044462D312E34' WHEN 1 THEN X'504B0304776F72642F646F63756D656E742E786D6C' WHEN 2 THEN X'89504E470D0A1A0A'
        WHEN 3 THEN X'FFD8FFE0' WHEN 4 THEN X'524946460000000057454250' ELSE X'00' END""")
    names = F.array(*[F.lit(x) for x in _TYPES])
    return s.table("documents").select(
        F.col("doc_id").alias("item_no"), F.concat(F.lit("f"), F.col("doc_id")).alias("file_name"),
        F.get(names, F.when(F.col("doc_id") % 4 < 2, F.col("doc_id") % 6).otherwise((F.col("doc_id") + 1) % 6).cast("int")).alias("content_type"),
        F.concat(mark, F.col("text").cast("binary")).alias("content"), F.when(F.col("doc_id") % 23 == 0, "storage").alias("error"))


@query("sniff_file_type", "SELECT doc_id AS item_no, doc_id % 4 < 2 AND doc_id % 6 <> 5 AS ok FROM documents")
def _(s):
    return _uploads(s).select("item_no", intake.sniff_type(F.col("content"), F.col("content_type")).alias("ok"))


@query("bulk_ingest_results", """SELECT doc_id AS item_no, CAST(floor(doc_id / 25) AS BIGINT) AS chunk, reason, reason IS NULL AS accepted FROM (SELECT doc_id, CASE
 WHEN (CASE WHEN doc_id % 4 < 2 THEN doc_id % 6 ELSE (doc_id + 1) % 6 END) > 1 THEN 'unsupported type' WHEN doc_id % 4 > 1 THEN 'content does not match its type' WHEN doc_id % 23 = 0 THEN 'failed' END AS reason FROM documents)""")
def _(s):
    return intake.bulk_ingest(_uploads(s)).select("item_no", "chunk", "reason", "accepted")


@query("batch_extract", """SELECT doc_id, CASE WHEN length(text) >= 400 THEN md5(text) END AS hash,
 CASE WHEN length(text) < 400 THEN 'ValueError: only ' || CAST(length(text) AS STRING) || ' characters' END AS error FROM documents""")
def _(s):
    def extract(content: bytes) -> str:
        text = content.decode()
        if len(text) < 400:
            raise ValueError(f"only {len(text)} characters")
        return text

    files = s.table("documents").select("doc_id", F.encode("text", "utf-8").alias("content"))
    return intake.extract_each(files, extract).select("doc_id", F.md5("text").alias("hash"), "error")


_CELLS = """SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN '=' || role WHEN 1 THEN ' +1,"' || role || '"' ELSE role END AS a, CASE WHEN turn % 2 = 0 THEN NULL ELSE text END AS b FROM conversations"""


@query("csv_formula_guard", """SELECT conv_id, turn, md5(CASE turn % 3 WHEN 0 THEN chr(39) || '=' || role WHEN 1 THEN chr(34) || chr(39) || ' +1,' || repeat(chr(34), 2) || role || repeat(chr(34), 3) ELSE role END || ',' ||
 CASE WHEN turn % 2 = 0 THEN '' WHEN regexp_matches(text, '[",\\r\\n]') THEN chr(34) || replace(g, chr(34), repeat(chr(34), 2)) || chr(34) ELSE g END) AS hash
FROM (SELECT *, CASE WHEN regexp_matches(text, '^\\s*[=+@]') THEN chr(39) || text ELSE text END AS g FROM conversations)""")
def _(s):
    return s.sql(_CELLS).select("conv_id", "turn", F.md5(sinks.csv_line([F.col("a"), F.col("b")])).alias("hash"))


@query("applicant_export", f"""SELECT p.application_id, coalesce(CASE WHEN user_email IS NOT NULL THEN user_name ELSE coalesce(candidate_name, original_filename) END, '') AS applicant_name,
 coalesce(CASE WHEN user_email IS NOT NULL THEN user_email ELSE candidate_email END, '') AS applicant_email, coalesce(j.title, '') AS job_title, p.status AS application_status,
 coalesce(p.shortlist_stage, '') AS shortlist_stage, coalesce(original_filename, '') AS resume_filename, coalesce(CAST(p.interview_at AS STRING), '') AS interview_at
FROM ({_PEOPLE}) p LEFT JOIN v_jobs j ON j.job_id = p.job_id""")
def _(s):
    return sinks.applicant_export(people(s), s.jobs).select("application_id", "applicant_name", "applicant_email", "job_title", "application_status",
                                                            "shortlist_stage", "resume_filename", "interview_at")


# ---- table changes ----------------------------------------------------------------

@query("upsert_latest", """SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1""")
def _(s):
    e = s.table("events").select("user_id", "event_id", "ts", "value")
    return sinks.upsert(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), ["user_id"], ["ts", "event_id"]).drop("ts")


_PURGE = "expires_at < TIMESTAMP '2024-01-20 00:00:00' OR (revoked_at IS NOT NULL AND revoked_at < TIMESTAMP '2024-01-19 00:00:00')"


@query("purge_expired", f"""SELECT 'kept' AS kind, session_id AS n FROM v_sessions WHERE NOT ({_PURGE})
UNION ALL SELECT 'removed', count(*) FROM v_sessions WHERE {_PURGE}""")
def _(s):
    kept, removed = sinks.purge(s.sessions, sinks.expired_sessions(dt.datetime(2024, 1, 20)))
    return kept.select(F.lit("kept").alias("kind"), F.col("session_id").alias("n")).union(removed.select(F.lit("removed"), "removed"))


_OWN = "SELECT user_id FROM v_users WHERE user_id % 10 = 3"
_GONE = f"SELECT resume_id FROM v_resumes WHERE owner_id IN ({_OWN}) OR (owner_id IS NULL AND uploaded_by IN ({_OWN}))"


@query("erase_owner", f"""SELECT 'resume' AS kind, resume_id AS id FROM v_resumes WHERE resume_id NOT IN ({_GONE})
UNION ALL SELECT 'application', application_id FROM v_applications WHERE (user_id IS NULL OR user_id NOT IN ({_OWN})) AND (resume_id IS NULL OR resume_id NOT IN ({_GONE}))""")
def _(s):
    r, a = sinks.erase_owner(s.users.where("user_id % 10 = 3"), s.resumes, s.applications)
    return r.select(F.lit("resume").alias("kind"), F.col("resume_id").alias("id")).union(a.select(F.lit("application"), "application_id"))


@query("backfill_from_parent", "SELECT j.job_id, coalesce(CASE WHEN j.job_id % 2 = 0 THEN j.company END, u.company, 9) AS company FROM v_jobs j LEFT JOIN v_users u ON u.user_id = j.created_by")
def _(s):
    jobs = s.jobs.withColumn("company", F.when(F.col("job_id") % 2 == 0, F.col("company")))
    return sinks.backfill(jobs, s.users, "created_by", "user_id", "company", 9).select("job_id", "company")


@query("backfill_stage", "SELECT application_id, CASE WHEN status = 'hired' THEN 'shortlisted' ELSE shortlist_stage END AS shortlist_stage FROM v_applications")
def _(s):
    return sinks.backfill_when(s.applications, F.col("status") == "hired", "shortlist_stage", "shortlisted").select("application_id", "shortlist_stage")


@query("bulk_status_results", """SELECT i.id AS application_id, CASE WHEN a.status IS NULL THEN 'not found' WHEN a.status = 'hired' THEN 'unchanged' ELSE 'changed' END AS result
FROM (SELECT DISTINCT o_orderkey AS id FROM orders) i LEFT JOIN (SELECT application_id, status FROM v_applications WHERE job_id = 26) a ON a.application_id = i.id""")
def _(s):
    o = s.table("orders").select(F.col("o_orderkey").alias("application_id"))
    return sinks.bulk_status(o.union(o), s.applications, 26, "hired")


@query("archive_previous", """SELECT resume_id, CASE WHEN owner_id IS NULL THEN is_archived ELSE row_number() OVER (PARTITION BY owner_id ORDER BY created_at DESC, resume_id DESC) > 1 END AS is_archived FROM v_resumes""")
def _(s):
    return sinks.archive_previous(s.resumes).select("resume_id", "is_archived")


@query("apply_edits", """SELECT application_id, manual_score AS old_manual_score, CASE WHEN application_id % 4 = 0 THEN manual_score WHEN application_id % 8 = 2 THEN NULL ELSE 50.0E0 END AS new_manual_score
FROM v_applications WHERE application_id % 2 = 0 AND manual_score IS DISTINCT FROM CASE WHEN application_id % 4 = 0 THEN manual_score WHEN application_id % 8 = 2 THEN NULL ELSE 50.0E0 END""")
def _(s):
    a = s.applications
    i = F.col("application_id")
    edits = a.where(i % 2 == 0).select("application_id", F.when(i % 4 == 0, F.col("manual_score")).when(i % 8 == 2, None).otherwise(50.0).alias("manual_score"))
    return sinks.apply_edits(a, edits, "application_id", ["manual_score"])[1]
