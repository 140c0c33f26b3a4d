"""Scopes, filters, joins, listings and dashboards."""

from __future__ import annotations

import datetime as dt
import functools

from pyspark.sql import functions as F

from ..operators import dashboards as dash
from ..operators import filters as flt
from ..operators import listing, scopes
from ..operators.skew import rank_rows, written
from ..sources import entities
from .registry import query

NOW = dt.datetime(1999, 1, 1)
_NOW = "TIMESTAMP '1999-01-01 00:00:00'"
_VIEWERS = "(SELECT user_id, role, company FROM v_users WHERE user_id IN (0, 1, 5))"


#: The accounts that ask: the superuser, an admin and a recruiter.
ASKING = [0, 1, 5]


def for_each_viewer(s, scope):
    """A one-account scope for each asking account."""
    return functools.reduce(lambda a, b: a.unionByName(b), [scope(s.jobs, s.users, v) for v in ASKING])


def recruiter(s):
    """One recruiter account of the data (key 5 is in the recruiter range)."""
    return 5


# ---- scans and lookups -------------------------------------------------------

@query("scan_entity", "SELECT job_id, title, status, company FROM v_jobs")
def _(s):
    return s.jobs.select("job_id", "title", "status", "company")


@query("lookup_by_key", """SELECT k.o_orderkey * 2 AS application_id, a.job_id, a.application_id IS NOT NULL AS found
FROM orders k LEFT JOIN v_applications a ON a.application_id = k.o_orderkey * 2""")
def _(s):
    keys = s.table("orders").select((F.col("o_orderkey") * 2).alias("application_id"))
    return entities.lookup_many(keys, s.applications.select("application_id", "job_id"), "application_id")


# ---- scopes -------------------------------------------------------------------

_READ = f"""SELECT j.*, v.user_id AS viewer_id, v.role AS viewer_role FROM v_jobs j JOIN {_VIEWERS} v
 ON v.role = 'superuser' OR (v.role IN ('admin', 'recruiter') AND v.company = j.company)"""
_WRITE = f"SELECT * FROM ({_READ}) WHERE viewer_role <> 'recruiter' OR created_by = viewer_id"


@query("scope_read_jobs", f"SELECT job_id, viewer_id FROM ({_READ})")
def _(s):
    return for_each_viewer(s, scopes.read_scope).select("job_id", "viewer_id")


@query("scope_write_jobs", f"SELECT job_id, viewer_id FROM ({_WRITE})")
def _(s):
    return for_each_viewer(s, scopes.write_scope).select("job_id", "viewer_id")


@query("scope_applicant_docs", f"""SELECT resume_id FROM v_resumes WHERE owner_id = 5 OR uploaded_by = 5 OR resume_id IN
 (SELECT resume_id FROM v_applications WHERE job_id IN (SELECT job_id FROM ({_WRITE}) WHERE viewer_id = 5))""")
def _(s):
    w = scopes.write_scope(s.jobs, s.users, recruiter(s))
    return scopes.resume_scope(s.resumes, s.applications, w, recruiter(s)).select("resume_id")


@query("can_withdraw", f"""SELECT application_id, user_id AS viewer_id FROM v_applications WHERE user_id IS NOT NULL
UNION ALL SELECT a.application_id, w.viewer_id FROM v_applications a JOIN ({_WRITE}) w ON a.job_id = w.job_id WHERE a.user_id IS NULL""")
def _(s):
    return scopes.can_withdraw(s.applications, s.jobs, s.users.where(F.col("user_id").isin(ASKING)).select("user_id", "role", "company"))


@query("library_scope", "SELECT resume_id FROM v_resumes WHERE uploaded_by = 5 AND NOT is_archived")
def _(s):
    return scopes.library(s.resumes, recruiter(s), "recruiter").select("resume_id")


# ---- filters ------------------------------------------------------------------

@query("filter_jobs", """SELECT job_id FROM v_jobs WHERE department = 'ECONOMY' AND status = 'published'
 AND location ILIKE '%brand#1%' AND (contains(lower(title), 'red') OR contains(lower(department), 'red') OR contains(lower(location), 'red'))""")
def _(s):
    return s.jobs.where(flt.job_filter("user", q="Red", location="brand#1", department="ECONOMY")).select("job_id")


@query("search_contains", r"""SELECT resume_id FROM v_resumes WHERE contains(lower(candidate_name), '7') OR contains(lower(candidate_email), '7')
 OR contains(lower(original_filename), '7')""")
def _(s):
    return s.resumes.where(flt.contains(["candidate_name", "candidate_email", "original_filename"], " 7 ")).select("resume_id")


@query("search_wildcard", "SELECT job_id FROM v_jobs WHERE location ILIKE '%d#_5%'")
def _(s):
    return s.jobs.where(flt.contains_wild("location", "D#_5")).select("job_id")


@query("filter_status_in", "SELECT application_id FROM v_applications WHERE status IN ('shortlisted', 'hired') AND shortlist_stage IN ('shortlisted')")
def _(s):
    return s.applications.where(flt.one_of("status", ["shortlisted", "hired"]) & flt.one_of("shortlist_stage", ["shortlisted"])).select("application_id")


@query("filter_score_years", """SELECT a.application_id FROM v_applications a JOIN v_resumes r ON a.resume_id = r.resume_id
 WHERE match_score >= 40 AND match_score <= 80 AND experience_months >= 30 AND experience_months <= 120""")
def _(s):
    return (s.applications.join(s.resumes.select("resume_id", "experience_months"), "resume_id")
            .where(flt.in_range("match_score", 40, 80) & flt.years_range("experience_months", 2.5, 10)).select("application_id"))


def details(s):
    """Stored explanations: per application the matched structs and the missing names."""
    # dealt before they are grouped: a map-side list per application saves nothing, and would sort all rows of a task
    st = s.skill_state.repartition(s.parts("orders"), "application_id")
    return st.groupBy("application_id").agg(
        F.collect_list(F.when(F.col("state") != "missing", F.struct("jd_skill", F.col("state").alias("status")))).alias("matched"),
        F.collect_list(F.when(F.col("state") == "missing", F.col("jd_skill"))).alias("missing"))


def _has(skill, states):
    return f"EXISTS (SELECT 1 FROM v_skill_state t WHERE t.application_id = a.application_id AND t.jd_skill = '{skill}' AND t.state IN ({states}))"


_IN = "a.application_id IN (SELECT application_id FROM v_skill_state)"


@query("filter_skill_state", f"""SELECT a.application_id, {_has('red widget', "'proven', 'mentioned'")} AS is_matched, {_has('red widget', "'proven'")} AS is_proven,
 {_has('red widget', "'missing'")} AS is_missing FROM v_applications a WHERE {_IN}""")
def _(s):
    m, x = F.col("matched"), F.col("missing")
    return details(s).select("application_id", *[flt.has_skill(m, x, "red widget", k).alias(f"is_{k}") for k in ("matched", "proven", "missing")])


@query("filter_skill_all_any", f"""SELECT a.application_id, {_has('red widget', "'proven'")} AND {_has('blue bolt', "'missing'")} AS in_all,
 {_has('red widget', "'proven'")} OR {_has('blue bolt', "'missing'")} AS in_any FROM v_applications a WHERE {_IN}""")
def _(s):
    conds = [("red widget", "proven"), ("blue bolt", "missing")]
    m, x = F.col("matched"), F.col("missing")
    return details(s).select("application_id", flt.skill_conditions(m, x, conds, "all").alias("in_all"),
                             flt.skill_conditions(m, x, conds, "any").alias("in_any"))


@query("search_skill_text", """SELECT resume_id FROM (SELECT resume_id, '["' || string_agg(skill, '", "' ORDER BY skill) || '"]' AS t
 FROM (SELECT DISTINCT resume_id, skill FROM v_resume_skills) GROUP BY 1) WHERE contains(lower(t), 'ring", "s')""")
def _(s):
    lists = s.resume_skills.groupBy("resume_id").agg(F.sort_array(F.collect_set("skill")).alias("skills"))
    return lists.where(flt.list_text_contains("skills", 'RING", "s')).select("resume_id")


@query("filter_pending", """SELECT 'request' AS kind, user_id AS id FROM v_users WHERE requested_role IS NOT NULL
UNION ALL SELECT 'unowned', resume_id FROM v_resumes WHERE owner_id IS NULL UNION ALL SELECT 'active', resume_id FROM v_resumes WHERE NOT is_archived""")
def _(s):
    row = lambda df, kind, id_: df.select(F.lit(kind).alias("kind"), F.col(id_).alias("id"))
    r = s.resumes
    return (row(s.users.where("requested_role is not null"), "request", "user_id")
            .union(row(r.where("owner_id is null"), "unowned", "resume_id")).union(row(r.where("not is_archived"), "active", "resume_id")))


_STALE = f"extraction_status = 'pending' AND updated_at < {_NOW} - INTERVAL 10 MINUTE AND retry_count < 3"


@query("sweep_stale", f"SELECT resume_id FROM v_resumes WHERE {_STALE}")
def _(s):
    return s.resumes.where(flt.stale(NOW, 10, 3)).select("resume_id")


@query("sweep_candidates", f"SELECT resume_id, extraction_status FROM v_resumes WHERE ({_STALE}) OR (extraction_status = 'failed' AND retry_count < 3)")
def _(s):
    return s.resumes.where(flt.retryable(NOW)).select("resume_id", "extraction_status")


@query("candidate_view", """SELECT a.application_id, a.status, CASE WHEN a.interview_stage = 'scheduled' THEN 'interview_scheduled' END AS shortlist_stage,
 CASE WHEN a.interview_stage = 'scheduled' THEN a.interview_at END AS interview_at, j.title AS job_title, j.status AS job_status, j.location, u.company
FROM v_applications a JOIN v_jobs j ON a.job_id = j.job_id JOIN v_users u ON u.user_id = j.created_by WHERE a.user_id IS NOT NULL""")
def _(s):
    sched = F.col("a.interview_stage") == "scheduled"
    return (s.applications.where("user_id is not null").alias("a").join(s.jobs.alias("j"), "job_id")
            .join(s.users.select(F.col("user_id").alias("created_by"), F.col("company").alias("owner_company")), "created_by")
            .select("application_id", "a.status", F.when(sched, "interview_scheduled").alias("shortlist_stage"),
                    F.when(sched, F.col("a.interview_at")).alias("interview_at"), F.col("title").alias("job_title"),
                    F.col("j.status").alias("job_status"), "location", F.col("owner_company").alias("company")))


_PEOPLE = """SELECT a.*, u.full_name AS user_name, u.email AS user_email, r.candidate_name, r.candidate_email, r.original_filename,
 r.experience_months, b.email AS submitted_by_email FROM v_applications a LEFT JOIN v_users u ON a.user_id = u.user_id
 LEFT JOIN v_resumes r ON a.resume_id = r.resume_id LEFT JOIN v_users b ON b.user_id = a.submitted_by_id"""
_IDENT = f"""SELECT *, CASE WHEN user_email IS NOT NULL THEN user_name ELSE coalesce(candidate_name, original_filename) END AS applicant_name,
 CASE WHEN user_email IS NOT NULL THEN user_email ELSE candidate_email END AS applicant_email,
 lower(coalesce(user_name, user_email, candidate_name, original_filename)) AS sort_name FROM ({_PEOPLE})"""


def people(s):
    return listing.display_identity(listing.with_people(s.applications, s.users, s.resumes))


@query("join_left_people", f"SELECT application_id, user_email, original_filename, submitted_by_email FROM ({_PEOPLE})")
def _(s):
    return listing.with_people(s.applications, s.users, s.resumes).select("application_id", "user_email", "original_filename", "submitted_by_email")


@query("display_identity", f"SELECT application_id, applicant_name, applicant_email, sort_name FROM ({_IDENT})")
def _(s):
    return people(s).select("application_id", "applicant_name", "applicant_email", "sort_name")


@query("transition_check", """SELECT job_id, new_status, reason, reason IS NULL AS allowed FROM (SELECT job_id, new_status, CASE
 WHEN new_status <> status AND status || '>' || new_status NOT IN ('draft>published', 'draft>closed', 'published>closed', 'closed>published') THEN 'not allowed'
 WHEN new_status <> status AND new_status = 'published' AND (title = '' OR description IS NULL) THEN 'title and description needed'
 WHEN new_status <> status AND new_status = 'published' AND jd_raw_text IS NULL THEN 'job description file needed' END AS reason
 FROM (SELECT *, CASE job_id % 3 WHEN 0 THEN 'draft' WHEN 1 THEN 'published' ELSE 'closed' END AS new_status,
       CASE WHEN job_id % 5 <> 0 THEN department END AS description FROM v_jobs))""")
def _(s):
    j = s.jobs.withColumn("new_status", F.expr("CASE job_id % 3 WHEN 0 THEN 'draft' WHEN 1 THEN 'published' ELSE 'closed' END")).withColumn(
        "description", F.when(F.col("job_id") % 5 != 0, F.col("department")))
    return flt.transition_check(j).select("job_id", "new_status", "reason", "allowed")


@query("apply_status", """SELECT application_id, new_status AS status,
 CASE WHEN new_status = status THEN shortlist_stage WHEN new_status = 'shortlisted' THEN 'shortlisted' END AS shortlist_stage,
 CASE WHEN new_status = status THEN interview_at END AS interview_at,
 CASE WHEN new_status = status THEN interview_stage WHEN new_status = 'interviewing' THEN 'scheduled' END AS interview_stage
FROM (SELECT *, CASE job_id % 3 WHEN 0 THEN 'shortlisted' WHEN 1 THEN 'interviewing' ELSE 'rejected' END AS new_status FROM v_applications)""")
def _(s):
    new = F.expr("CASE job_id % 3 WHEN 0 THEN 'shortlisted' WHEN 1 THEN 'interviewing' ELSE 'rejected' END")
    return flt.apply_status(s.applications, new).select("application_id", "status", "shortlist_stage", "interview_at", "interview_stage")


@query("usable_reason", """SELECT r.resume_id, CASE WHEN r.uploaded_by IS DISTINCT FROM 5 THEN 'not found' WHEN r.owner_id IS NOT NULL THEN 'belongs to an account'
 WHEN r.is_archived THEN 'archived' WHEN r.extraction_status = 'failed' THEN 'unreadable'
 WHEN r.resume_id IN (SELECT resume_id FROM v_applications WHERE job_id = 13 AND resume_id IS NOT NULL) THEN 'already applied' END AS reason FROM v_resumes r""")
def _(s):
    return flt.usable_reason(s.resumes, s.applications, 13, 5)


@query("grant_requests", """SELECT user_id, CASE WHEN requested_role IS NULL THEN 'no request' WHEN company IS NULL THEN 'no company'
 WHEN role <> 'user' THEN 'not a plain user' END AS reason FROM v_users""")
def _(s):
    return flt.grant_reason(s.users)


@query("unset_config", "SELECT task FROM v_configs WHERE provider = 'unset' OR model = 'unset'")
def _(s):
    return s.configs.where("provider = 'unset' OR model = 'unset'").select("task")


_TNOW = "TIMESTAMP '2024-01-15 00:00:00'"


@query("live_tokens", f"""SELECT t.token, t.user_id FROM v_sessions t JOIN v_users u ON u.user_id = t.user_id AND u.is_active
 WHERE t.revoked_at IS NULL AND t.expires_at > {_TNOW} AND t.token NOT IN (SELECT token FROM v_sessions WHERE session_id % 5 = 0)""")
def _(s):
    t = s.sessions
    return flt.live_tokens(t, t.where("session_id % 5 = 0").select("token"), s.users, dt.datetime(2024, 1, 15)).select("token", "user_id")


@query("filter_day_range", "SELECT id FROM v_audit WHERE created_at >= DATE '2024-01-05' AND created_at < DATE '2024-01-11'")
def _(s):
    return s.audit.where(flt.between_days("created_at", "2024-01-05", "2024-01-10")).select("id")


@query("clamp_filters", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, least(greatest(l_quantity * 3, 0), 100) AS clamped,
 CAST(l_discount > 0 AS INT) + CAST(l_tax > 0 AS INT) + CAST(l_returnflag = 'R' AS INT) AS n_active FROM lineitem""")
def _(s):
    return s.table("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", flt.clamp(F.col("l_quantity") * 3, 0.0, 100.0).alias("clamped"),
                                      flt.active_filters(F.col("l_discount") > 0, F.col("l_tax") > 0, F.col("l_returnflag") == "R").alias("n_active"))


# ---- joins --------------------------------------------------------------------

@query("join_apps_jobs", "SELECT a.application_id, j.title, a.status, j.status AS job_status FROM v_applications a JOIN v_jobs j ON a.job_id = j.job_id")
def _(s):
    return s.applications.alias("a").join(s.jobs.alias("j"), "job_id").select("application_id", "title", "a.status", F.col("j.status").alias("job_status"))


@query("sweep_unscored", f"""SELECT a.application_id FROM v_applications a JOIN v_resumes r ON a.resume_id = r.resume_id JOIN v_jobs j ON a.job_id = j.job_id
 WHERE a.match_status = 'pending' AND r.extraction_status = 'done' AND j.extraction_status = 'done' AND a.updated_at < {_NOW} - INTERVAL 10 MINUTE""")
def _(s):
    cut = F.lit(NOW) - F.make_dt_interval(mins=F.lit(10))
    done = lambda df, k: df.where("extraction_status = 'done'").select(k)
    return (s.applications.where((F.col("match_status") == "pending") & (F.col("updated_at") < cut))
            .join(done(s.resumes, "resume_id"), "resume_id").join(done(s.jobs, "job_id"), "job_id").select("application_id"))


@query("semi_owned_jobs", "SELECT application_id FROM v_applications WHERE job_id IN (SELECT job_id FROM v_jobs WHERE created_by = 5)")
def _(s):
    return s.applications.join(s.jobs.where("created_by = 5"), "job_id", "left_semi").select("application_id")


@query("exists_semi", "SELECT resume_id FROM v_resumes r WHERE EXISTS (SELECT 1 FROM v_applications a WHERE a.resume_id = r.resume_id AND a.status = 'hired')")
def _(s):
    return s.resumes.join(s.applications.where("status = 'hired'"), "resume_id", "left_semi").select("resume_id")


@query("anti_not_applied", "SELECT resume_id FROM v_resumes WHERE resume_id NOT IN (SELECT resume_id FROM v_applications WHERE job_id % 2 = 1 AND resume_id IS NOT NULL)")
def _(s):
    return s.resumes.join(s.applications.where("job_id % 2 = 1"), "resume_id", "left_anti").select("resume_id")


@query("rescore_fanout", """SELECT DISTINCT application_id FROM v_applications a WHERE a.resume_id IN (SELECT resume_id FROM v_resumes WHERE updated_at >= TIMESTAMP '2001-01-01 00:00:00')
 OR a.job_id IN (SELECT job_id FROM v_jobs WHERE min_experience_months = 24)""")
def _(s):
    a = s.applications
    by_resume = a.join(s.resumes.where(F.col("updated_at") >= F.lit(dt.datetime(2001, 1, 1))), "resume_id", "left_semi")
    by_job = a.join(s.jobs.where("min_experience_months = 24"), "job_id", "left_semi")
    return by_resume.select("application_id").union(by_job.select("application_id")).distinct()


# ---- dashboards ---------------------------------------------------------------

@query("count_by_status", "SELECT status, count(*) AS n FROM v_applications GROUP BY 1")
def _(s):
    return dash.count_by(s.applications, "status")


_CNT = """SELECT job_id, count(*) AS total, count(*) FILTER (status = 'applied') AS new, count(*) FILTER (match_status = 'pending') AS scoring,
 count(*) FILTER (status = 'shortlisted') AS shortlisted FROM v_applications GROUP BY 1"""


@query("job_counters", _CNT)
def _(s):
    return dash.job_counters(s.applications)


@query("job_board", f"""SELECT j.job_id, j.title, j.status, coalesce(total, 0) AS total, coalesce(new, 0) AS new, coalesce(scoring, 0) AS scoring,
 coalesce(shortlisted, 0) AS shortlisted FROM (SELECT * FROM v_jobs ORDER BY created_at DESC, job_id LIMIT 100) j LEFT JOIN ({_CNT}) c ON j.job_id = c.job_id""")
def _(s):
    return dash.job_board(s.jobs, dash.job_counters(s.applications))


@query("hiring_funnel", """SELECT b.bucket, count(a.status) AS n FROM (VALUES ('applied', 'applied'), ('reviewing', 'under_review'), ('shortlisted', 'shortlisted'),
 ('interview', 'interviewing'), ('hired', 'hired'), ('rejected', 'rejected')) b(bucket, st) LEFT JOIN v_applications a ON a.status = b.st GROUP BY 1""")
def _(s):
    return dash.funnel(s.applications)


@query("stage_counts", """SELECT job_id, count(*) AS total, count(*) FILTER (status = 'applied') AS applied, count(*) FILTER (status = 'under_review') AS under_review,
 count(*) FILTER (status = 'shortlisted') AS shortlisted, count(*) FILTER (status = 'interviewing') AS interviewing, count(*) FILTER (status = 'hired') AS hired,
 count(*) FILTER (status = 'rejected') AS rejected FROM v_applications WHERE job_id IN (SELECT job_id FROM v_jobs WHERE company = 1) GROUP BY 1""")
def _(s):
    mine = s.jobs.where(scopes.read_clause("admin", 1)).select("job_id")
    return dash.stage_counts(s.applications).join(mine, "job_id", "left_semi")  # count first: a hot job shrinks before the join


@query("page_total", "SELECT count(*) AS total FROM v_applications WHERE match_score >= 50 AND status IN ('applied', 'hired')")
def _(s):
    return s.applications.where(flt.in_range("match_score", 50) & flt.one_of("status", ["applied", "hired"])).agg(F.count(F.lit(1)).alias("total"))


@query("quick_actions", f"""SELECT (SELECT count(*) FROM v_jobs WHERE created_by = 5 AND status = 'draft') AS draft_jobs,
 (SELECT count(*) FROM v_jobs WHERE created_by = 5 AND status = 'published') AS published_jobs,
 CAST(coalesce(sum(new), 0) AS BIGINT) AS new_applicants, CAST(coalesce(sum(scoring), 0) AS BIGINT) AS still_scoring, CAST(coalesce(sum(shortlisted), 0) AS BIGINT) AS shortlisted,
 (SELECT count(*) FROM v_applications WHERE interview_stage = 'scheduled' AND interview_at >= {_NOW} AND job_id IN (SELECT job_id FROM v_jobs WHERE created_by = 5)) AS upcoming_interviews
FROM ({_CNT}) WHERE job_id IN (SELECT job_id FROM v_jobs WHERE created_by = 5)""")
def _(s):
    own = s.jobs.where("created_by = 5")
    apps = s.applications.join(own, "job_id", "left_semi")
    up = apps.where((F.col("interview_stage") == "scheduled") & (F.col("interview_at") >= F.lit(NOW)))
    return dash.quick_actions(own, dash.job_counters(s.applications).join(own, "job_id", "left_semi"), up)


_ATT = f"""SELECT j.job_id, CASE WHEN status = 'published' AND coalesce(new, 0) > 0 THEN 'review' WHEN status = 'published' AND coalesce(total, 0) = 0 THEN 'published'
 WHEN status = 'draft' AND jd_raw_text IS NULL THEN 'draft' END AS attention_type, coalesce(new, 0) AS new_count FROM v_jobs j LEFT JOIN ({_CNT}) c ON j.job_id = c.job_id"""


@query("attention_jobs", f"SELECT * FROM ({_ATT}) WHERE attention_type IS NOT NULL")
def _(s):
    return dash.attention(s.jobs, dash.job_counters(s.applications))


@query("onboarding", """SELECT user_id, full_name IS NOT NULL AND phone IS NOT NULL AS profile_complete,
 EXISTS (SELECT 1 FROM v_resumes r WHERE r.owner_id = u.user_id AND NOT is_archived) AS has_resume,
 EXISTS (SELECT 1 FROM v_applications a WHERE a.user_id = u.user_id) AS has_applied FROM v_users u""")
def _(s):
    return dash.onboarding(s.users, s.resumes, s.applications)


@query("owner_guard", """SELECT u.user_id, count(j.job_id) AS owned_jobs, count(j.job_id) = 0 AS can_remove FROM v_users u LEFT JOIN v_jobs j ON j.created_by = u.user_id GROUP BY 1""")
def _(s):
    return dash.owner_guard(s.users, s.jobs)


# ---- lists --------------------------------------------------------------------

_ORDER = "match_score DESC NULLS LAST, applied_at, sort_name NULLS LAST, application_id"


@query("rank_applicants", f"SELECT application_id, job_id, row_number() OVER (PARTITION BY job_id ORDER BY {_ORDER}) AS rank FROM ({_IDENT})")
def _(s):
    # the joined rows are read several times by the ranking, so they are written once
    rows = people(s).select("application_id", "job_id", "match_score", "applied_at", "sort_name")
    return listing.rank_applicants(written(rows, "applicants")).select("application_id", "job_id", "rank")


@query("dedupe_keep_first", """SELECT resume_id, skill, pos, part_id FROM (SELECT *, row_number() OVER (PARTITION BY resume_id, skill ORDER BY pos, part_id) AS rn FROM
 (SELECT resume_id, lower(trim(raw_skill)) AS skill, pos, part_id FROM v_raw_skills)) WHERE rn = 1""")
def _(s):
    rows = s.raw_skills.select("resume_id", F.lower(F.trim("raw_skill")).alias("skill"), "pos", "part_id")
    return listing.dedupe_keep_first(rows, ["resume_id", "skill"], ["pos", "part_id"])


@query("merge_sources", """SELECT resume_id, norm, skill FROM (SELECT resume_id, lower(skill) AS norm, skill, row_number() OVER (PARTITION BY resume_id, lower(skill)
 ORDER BY CASE source WHEN 'skills_section' THEN 1 WHEN 'work_experience' THEN 2 ELSE 3 END, pos) AS rn FROM v_resume_skills) WHERE rn = 1""")
def _(s):
    return listing.merge_sources(s.resume_skills).drop("place")


@query("page_rows", f"""SELECT application_id, match_score, (SELECT count(*) FROM v_applications WHERE status = 'applied') AS total
FROM ({_IDENT}) WHERE status = 'applied' ORDER BY {_ORDER} LIMIT 50 OFFSET 100""")
def _(s):
    df = people(s).where("status = 'applied'").select("application_id", "match_score", "applied_at", "sort_name")
    return listing.page_with_total(df, listing.score_order(), 50, 100).select("application_id", "match_score", "total")


@query("newest_n", "SELECT job_id, title, created_at FROM v_jobs WHERE status = 'published' ORDER BY created_at DESC, job_id LIMIT 5")
def _(s):
    return listing.top(s.jobs.where("status = 'published'").select("job_id", "title", "created_at"), [F.desc("created_at"), F.asc("job_id")], 5)


_UP = f"""SELECT a.application_id, a.job_id, j.title AS job_title, a.interview_at FROM v_applications a JOIN v_jobs j ON a.job_id = j.job_id
 WHERE a.interview_stage = 'scheduled' AND a.interview_at >= {_NOW}"""


def upcoming(s):
    return (s.applications.where((F.col("interview_stage") == "scheduled") & (F.col("interview_at") >= F.lit(NOW)))
            .join(s.jobs.select("job_id", F.col("title").alias("job_title")), "job_id")
            .select("application_id", "job_id", "job_title", "interview_at"))


@query("upcoming_interviews", f"SELECT * FROM ({_UP}) ORDER BY interview_at, application_id LIMIT 20")
def _(s):
    return listing.top(upcoming(s), [F.asc("interview_at"), F.asc("application_id")], 20)


@query("upcoming_week", f"SELECT * FROM ({_UP}) WHERE interview_at BETWEEN {_NOW} AND {_NOW} + INTERVAL 7 DAY")
def _(s):
    return upcoming(s).where(flt.within_next("interview_at", NOW, 7))


@query("oldest_pending", "SELECT user_id, email, created_at FROM v_users WHERE requested_role IS NOT NULL ORDER BY created_at, user_id LIMIT 5")
def _(s):
    return listing.top(s.users.where("requested_role is not null").select("user_id", "email", "created_at"), [F.asc("created_at"), F.asc("user_id")], 5)


@query("hiring_board_order", f"""SELECT job_id, row_number() OVER (ORDER BY CASE status WHEN 'published' THEN 0 WHEN 'draft' THEN 1 WHEN 'closed' THEN 2 ELSE 3 END,
 coalesce(new, 0) DESC, coalesce(total, 0) DESC, job_id) AS place FROM (SELECT j.job_id, j.status, c.new, c.total FROM v_jobs j LEFT JOIN ({_CNT}) c ON j.job_id = c.job_id)""")
def _(s):
    rank = F.expr("CASE status WHEN 'published' THEN 0 WHEN 'draft' THEN 1 WHEN 'closed' THEN 2 ELSE 3 END")
    df = s.jobs.select("job_id", "status").join(dash.job_counters(s.applications), "job_id", "left")
    order = F.struct(rank.alias("a"), (-F.coalesce("new", F.lit(0))).alias("b"), (-F.coalesce("total", F.lit(0))).alias("c"), F.col("job_id").alias("d"))
    return rank_rows(df, [], order, "place").select("job_id", "place")


@query("sort_switch", """SELECT application_id, 'applied_at' AS sort FROM (SELECT * FROM v_applications ORDER BY applied_at DESC, application_id LIMIT 25)
UNION ALL SELECT application_id, 'score' FROM (SELECT * FROM ({0}) ORDER BY {1} LIMIT 25)""".format(_IDENT, _ORDER))
def _(s):
    p = people(s).select("application_id", "match_score", "applied_at", "sort_name")
    return (listing.top(p, listing.listing_order("applied_at"), 25).select("application_id", F.lit("applied_at").alias("sort"))
            .union(listing.top(p, listing.listing_order("score"), 25).select("application_id", F.lit("score"))))


@query("notes_latest", "SELECT application_id, note_id, created_at FROM v_notes ORDER BY created_at DESC, note_id DESC LIMIT 50")
def _(s):
    return listing.top(s.notes.select("application_id", "note_id", "created_at"), [F.desc("created_at"), F.desc("note_id")], 50)
