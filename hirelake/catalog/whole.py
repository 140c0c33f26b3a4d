"""Whole computations."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import sections as sec
from ..plans import composed
from .operations import _DEPTH, _STUCK, probes
from .records import _REF
from .registry import query
from .relational import _CNT
from .texts import (_FORM2, _HS, _JOINED, _KIND, _LEX, _SECT, _TODAY, _TOK, CLEAN_BULLETS, CLEAN_TEXT, NL, STRIP_BULLETS, STRIP_DATES, TODAY,
                    _in, _q, expand_sql, labels_sql)

NOW = dt.datetime(1999, 1, 1)
_NOW = "TIMESTAMP '1999-01-01 00:00:00'"
ENOW = dt.datetime(2024, 1, 20)


def _split(src: str) -> str:
    """Lines of (doc_id, text)."""
    return f"(SELECT doc_id, unnest(range(len(string_split(text, {NL})))) AS line_no, unnest(string_split(text, {NL})) AS line FROM {src})"


def _tags_sql(src: str, out: str, key: str = "doc_id") -> str:
    """Lexicon terms of (key, text) at their first place that the text also holds as they are written; the result is ``out`` (key, skill, pos)."""
    return f"""{out}_k AS (SELECT {key}, {_TOK} AS tok, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS txt FROM {src}), {out}_g AS (SELECT *, unnest(range(1, len(tok) + 1)) AS i FROM {out}_k),
{out}_n AS (SELECT {key}, txt, array_to_string(tok[i:i + z - 1], ' ') AS skill, i * 4 + z AS p FROM {out}_g, (VALUES (1), (2), (3)) v(z) WHERE i + z - 1 <= len(tok)),
{out} AS (SELECT {key}, skill, min(p) AS pos, bool_and(contains(txt, skill)) AS held FROM {out}_n WHERE skill IN (SELECT alias FROM ({_LEX})) GROUP BY {key}, skill)"""


def _renamed(sql: str, tag: str) -> str:
    """CTEs over the cleaned lines instead of the resume view, with names of their own."""
    body = sql.strip().removeprefix("WITH ")
    for name in sorted(set(re.findall(r"(?:^|,)\s*([a-z]) AS \(", body))):
        body = re.sub(rf"\b{name}\b(?= AS \()|(?<=FROM ){name}\b", f"{tag}_{name}", body)
    return body.replace("v_resume_lines", "lines")


_MON = "CASE lower(left({0}, 3)) " + " ".join(f"WHEN '{m}' THEN {i}" for i, m in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split(), 1)) + " END"
_MAJOR = f"""(f IN {_in(sec.MAJOR_HEADINGS)} OR (NOT regexp_matches(u, {_q(t.LIST_BULLET)}) AND u = upper(u) AND u <> lower(u) AND length(u) < 40 AND len(regexp_extract_all(u, '[A-Za-z][A-Za-z&/''-]*')) >= 2))"""
_HELD = "regexp_matches(' ' || b.txt || ' ', '[^a-z0-9+#]' || regexp_replace(m.skill, '([\\\\.\\[\\]{}()*+?^$|#&-])', '\\\\\\1', 'g') || '[^a-z0-9+#]')"
_PLACE = "CASE {} WHEN 'skills_section' THEN 0 WHEN 'work_experience' THEN 1 ELSE 2 END"


@query("extract_resume_skills", f"""WITH RECURSIVE docs AS (SELECT doc_id, {CLEAN_TEXT} AS text FROM v_resume_docs), lines AS {_split('docs')},
{_renamed(_SECT, 'sct')},
under AS (SELECT doc_id, section, string_agg(line, {NL} ORDER BY line_no) FILTER (kind IS NULL) AS text FROM sct_s WHERE section IN ('experience', 'projects') GROUP BY 1, 2),
{_renamed(_HS, 'hd')},
top AS (SELECT doc_id, line_no FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, line_no) AS rn FROM hd_q) WHERE rn = 1 AND score >= 3),
after AS (SELECT l.doc_id, l.line_no, l.line, hd.f, regexp_replace(hd.s, ':+$', '') AS u FROM lines l JOIN top USING (doc_id) JOIN hd_p hd ON hd.doc_id = l.doc_id AND hd.line_no = l.line_no WHERE l.line_no > top.line_no),
stop AS (SELECT doc_id, min(line_no) FILTER ({_MAJOR}) AS halt FROM after GROUP BY 1),
found AS (SELECT doc_id, string_agg(line, {NL} ORDER BY line_no) AS text FROM after JOIN stop USING (doc_id) WHERE line_no < coalesce(halt, 1000000000) AND trim(line) <> '' GROUP BY 1),
undated AS (SELECT d.doc_id, {STRIP_DATES} AS text FROM (SELECT docs.doc_id, coalesce(found.text, '') AS text FROM docs LEFT JOIN found USING (doc_id)) d),
{expand_sql('undated', 'expanded')}, {labels_sql(_split('expanded'), 'listed')},
blocks AS (SELECT doc_id, 'skills_section' AS source, text FROM listed
 UNION ALL SELECT doc_id, k.source, {STRIP_BULLETS} FROM (SELECT docs.doc_id, n.source, coalesce(under.text, '') AS text FROM docs CROSS JOIN (VALUES ('work_experience', 'experience'), ('projects', 'projects')) n(source, section)
  LEFT JOIN under ON under.doc_id = docs.doc_id AND under.section = n.section) k),
norm AS (SELECT doc_id, source, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS txt FROM blocks),
{_tags_sql('blocks', 'tags', 'doc_id, source')},
routed AS (SELECT g.doc_id, g.skill, {_PLACE.format('g.source')} * 1000000 + pos AS ord,
 coalesce((SELECT arg_min(b.source, CASE WHEN b.source = g.source THEN -1 ELSE {_PLACE.format('b.source')} END) FROM norm b WHERE b.doc_id = g.doc_id AND contains(b.txt, g.skill)), g.source) AS source FROM tags g),
kept AS (SELECT r.doc_id, r.source, r.skill, min(ord) AS ord FROM routed r JOIN norm b ON b.doc_id = r.doc_id AND b.source = r.source AND contains(b.txt, r.skill) GROUP BY 1, 2, 3),
merged AS (SELECT doc_id, skill, min({_PLACE.format('source')} * 100000000 + ord) AS ord FROM kept GROUP BY 1, 2),
filled AS (SELECT doc_id, source, skill, ord FROM kept UNION ALL
 SELECT b.doc_id, b.source, m.skill, 10000000000 + m.ord FROM merged m JOIN norm b ON b.doc_id = m.doc_id WHERE {_HELD} AND NOT EXISTS (SELECT 1 FROM kept k WHERE k.doc_id = b.doc_id AND k.source = b.source AND k.skill = m.skill)),
al AS (SELECT doc_id, skill, min({_PLACE.format('source')} * 100000000000 + ord) AS ord FROM filled GROUP BY 1, 2),
sx AS (SELECT doc_id, line, last_value({_KIND.format(f=_FORM2)} IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no) AS section FROM lines),
span AS (SELECT doc_id, make_date(TRY_CAST(regexp_extract(line, '^[A-Z][a-z]{{2}} ([0-9]{{4}})', 1) AS INT), {_MON.format('line')}, 1) AS a, CASE WHEN regexp_matches(line, '- Present Engineer') THEN {_TODAY} ELSE
 make_date(TRY_CAST(regexp_extract(line, ' - [A-Z][a-z]{{2}} ([0-9]{{4}}) Engineer', 1) AS INT), {_MON.format("regexp_extract(line, ' - ([A-Z][a-z]{2}) [0-9]{4} Engineer', 1)")}, 1) END AS z
 FROM sx WHERE section = 'experience' AND regexp_matches(line, '^[A-Z][a-z]{{2}} [0-9]{{4}} - (?:Present|[A-Z][a-z]{{2}} [0-9]{{4}}) Engineer')),
usable AS (SELECT doc_id, year(a) * 12 + month(a) AS lo, year(least(z, {_TODAY})) * 12 + month(least(z, {_TODAY})) AS hi FROM span WHERE z >= a AND a <= {_TODAY}),
months AS (SELECT doc_id, count(DISTINCT m) AS n FROM (SELECT doc_id, unnest(CASE WHEN hi > lo THEN range(lo, hi) ELSE [NULL] END) AS m FROM usable) GROUP BY 1)
SELECT d.doc_id, coalesce((SELECT string_agg(skill, '|' ORDER BY ord) FROM al WHERE al.doc_id = d.doc_id), '') AS skills,
 coalesce((SELECT string_agg(skill, '|' ORDER BY ord) FROM filled f WHERE f.doc_id = d.doc_id AND f.source = 'work_experience'), '') AS work,
 CAST(m.n AS INT) AS experience_months, CASE WHEN m.n IS NOT NULL THEN 'experience_section' END AS experience_source FROM docs d LEFT JOIN months m ON m.doc_id = d.doc_id""")
def _(s):
    out = composed.extract_resume_skills(s.resume_docs, s.sql(_LEX), F.lit(TODAY))
    return out.select("doc_id", F.array_join("skills", "|").alias("skills"), F.array_join(F.col("skills_by_source")["work_experience"], "|").alias("work"),
                      "experience_months", "experience_source")


_ASKS = "CAST(max(CAST(regexp_extract(line, '^- At least ([0-9]+)\\+ years of experience', 1) AS INT)) * 12 AS INT) AS months FROM {} WHERE regexp_matches(line, '^- At least [0-9]+\\+ years of experience') GROUP BY 1"


@query("extract_job_requirements", "WITH RECURSIVE " + _JOINED + f""",
items AS (SELECT doc_id, string_agg(item, {NL} ORDER BY k) AS text FROM (SELECT doc_id, k, arg_max(item, i) AS item FROM r GROUP BY 1, 2) GROUP BY 1),
cleaned AS (SELECT doc_id, {CLEAN_BULLETS} AS text FROM (SELECT d.doc_id, coalesce(i.text, '') AS text FROM v_job_docs d LEFT JOIN items i ON i.doc_id = d.doc_id)),
{expand_sql('cleaned', 'expanded')}, {labels_sql(_split('expanded'), 'body')}, {_tags_sql('body', 'tags')},
part AS (SELECT doc_id, {_ASKS.format(_split('(SELECT doc_id, body AS text FROM x)'))}), whole AS (SELECT doc_id, {_ASKS.format('v_job_lines')})
SELECT d.doc_id, x.doc_id IS NOT NULL AS found, coalesce(part.months, whole.months) AS min_months,
 CASE WHEN part.months IS NOT NULL THEN 'requirements_section' WHEN whole.months IS NOT NULL THEN 'full_text' END AS min_source,
 coalesce((SELECT string_agg(skill, '|' ORDER BY pos) FROM tags WHERE tags.doc_id = d.doc_id AND held), '') AS skills
FROM v_job_docs d LEFT JOIN x ON x.doc_id = d.doc_id LEFT JOIN part ON part.doc_id = d.doc_id LEFT JOIN whole ON whole.doc_id = d.doc_id""")
def _(s):
    out = composed.extract_job_requirements(s.job_docs, s.sql(_LEX))
    return out.select("doc_id", "found", "min_months", "min_source", F.array_join("skills", "|").alias("skills"))


_T = "SELECT a.*, j.title FROM v_applications a JOIN v_jobs j ON j.job_id = a.job_id WHERE a.user_id = 77"


@query("dashboard_applicant", f"""SELECT 'documents' AS section, extraction_status AS key, CAST(count(*) AS STRING) AS value FROM v_resumes WHERE owner_id = 77 AND NOT is_archived GROUP BY 2
UNION ALL SELECT 'applications', status, CAST(count(*) AS STRING) FROM v_applications WHERE user_id = 77 GROUP BY 2
UNION ALL SELECT 'onboarding', k, CAST(v AS STRING) FROM (SELECT unnest(['profile_complete', 'has_resume', 'has_applied']) AS k, unnest([full_name IS NOT NULL AND phone IS NOT NULL,
 EXISTS (SELECT 1 FROM v_resumes WHERE owner_id = 77 AND NOT is_archived), EXISTS (SELECT 1 FROM v_applications WHERE user_id = 77)]) AS v FROM v_users WHERE user_id = 77)
UNION ALL SELECT * FROM (SELECT 'upcoming', CAST(application_id AS STRING), title FROM ({_T}) WHERE interview_stage = 'scheduled' AND interview_at >= {_NOW} ORDER BY interview_at, application_id LIMIT 10)
UNION ALL SELECT * FROM (SELECT 'recent', CAST(application_id AS STRING), title FROM ({_T}) ORDER BY applied_at DESC, application_id LIMIT 5)
UNION ALL SELECT * FROM (SELECT 'newest jobs', CAST(job_id AS STRING), title FROM v_jobs WHERE status = 'published' ORDER BY created_at DESC, job_id LIMIT 5)""")
def _(s):
    return composed.dashboard_applicant(77, s.users, s.resumes, s.applications, s.jobs, NOW)


_OWN = "(SELECT job_id FROM v_jobs WHERE created_by = 5)"
_UPQ = f"FROM v_applications WHERE job_id IN {_OWN} AND interview_stage = 'scheduled' AND interview_at >= {_NOW}"
_QUICK = [("draft_jobs", "SELECT count(*) FROM v_jobs WHERE created_by = 5 AND status = 'draft'"), ("published_jobs", "SELECT count(*) FROM v_jobs WHERE created_by = 5 AND status = 'published'"),
          ("new_applicants", f"SELECT count(*) FROM v_applications WHERE job_id IN {_OWN} AND status = 'applied'"), ("still_scoring", f"SELECT count(*) FROM v_applications WHERE job_id IN {_OWN} AND match_status = 'pending'"),
          ("shortlisted", f"SELECT count(*) FROM v_applications WHERE job_id IN {_OWN} AND status = 'shortlisted'"), ("upcoming_interviews", f"SELECT count(*) {_UPQ}")]


@query("dashboard_recruiter", f"""SELECT 'job' AS section, CAST(j.job_id AS STRING) AS key, concat_ws('/', coalesce(total, 0), coalesce(new, 0), coalesce(scoring, 0), coalesce(shortlisted, 0)) AS value
 FROM (SELECT * FROM v_jobs WHERE created_by = 5 ORDER BY created_at DESC, job_id LIMIT 100) j LEFT JOIN ({_CNT}) c ON c.job_id = j.job_id
UNION ALL SELECT 'funnel', b.k, CAST(count(a.status) AS STRING) FROM (VALUES ('applied', 'applied'), ('reviewing', 'under_review'), ('shortlisted', 'shortlisted'), ('interview', 'interviewing'),
 ('hired', 'hired'), ('rejected', 'rejected')) b(k, st) LEFT JOIN (SELECT * FROM v_applications WHERE job_id IN {_OWN}) a ON a.status = b.st GROUP BY 2
UNION ALL SELECT * FROM (SELECT 'upcoming', CAST(application_id AS STRING), CAST(job_id AS STRING) {_UPQ} ORDER BY interview_at, application_id LIMIT 20)
""" + "".join(f"UNION ALL SELECT 'quick', '{k}', CAST(({q}) AS STRING)\n" for k, q in _QUICK))
def _(s):
    return composed.dashboard_recruiter(5, s.applications, s.jobs, NOW)


_FEED = f"""SELECT * FROM v_audit WHERE (resource_type IN ('job', 'user') AND {_REF.format('company')} = '1') OR (resource_type IN ('application', 'application_note') AND
 {_REF.format('job_id')} IN (SELECT CAST(job_id AS STRING) FROM v_jobs WHERE company = 1 UNION SELECT CAST(resource_id AS STRING) FROM v_audit WHERE resource_type = 'job' AND {_REF.format('company')} = '1'))"""
_USE = "FROM v_hits WHERE ts BETWEEN TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 60 SECOND AND TIMESTAMP '2024-01-20 00:00:00'"


@query("dashboard_admin", f"""SELECT 'requests' AS section, 'count' AS key, CAST(count(*) AS STRING) AS value FROM v_users WHERE requested_role IS NOT NULL AND company = 1
UNION ALL SELECT * FROM (SELECT 'oldest request', CAST(user_id AS STRING), email FROM v_users WHERE requested_role IS NOT NULL AND company = 1 ORDER BY created_at, user_id LIMIT 5)
UNION ALL SELECT 'unset', task, 'unset' FROM v_configs WHERE provider = 'unset' OR model = 'unset'
UNION ALL SELECT 'queue', 'total', CAST(count(*) AS STRING) FROM v_metrics WHERE state = 'RETRY'
UNION ALL SELECT 'quota', 'tokens', CAST(CAST(coalesce(sum(tokens), 0) AS BIGINT) AS STRING) {_USE} UNION ALL SELECT 'quota', 'requests', CAST(count(*) AS STRING) {_USE}
UNION ALL SELECT * FROM (SELECT 'activity', CAST(id AS STRING), action FROM ({_FEED}) ORDER BY created_at DESC, id DESC LIMIT 10)""")
def _(s):
    return composed.dashboard_admin(1, s.users, s.configs, s.metrics.where("state = 'RETRY'"), s.hits, s.audit, s.jobs, ENOW)


@query("system_snapshot", f"""SELECT 'stuck' AS section, kind AS key, CAST(n AS STRING) AS value FROM ({_STUCK})
UNION ALL SELECT 'running', 'resume_extractions', CAST(count(*) FILTER (extraction_status = 'processing') AS STRING) FROM v_resumes
UNION ALL SELECT 'running', 'job_extractions', CAST(count(*) FILTER (extraction_status = 'processing') AS STRING) FROM v_jobs
UNION ALL SELECT 'queue', coalesce(queue, 'total'), CAST(depth AS STRING) FROM ({_DEPTH})
UNION ALL SELECT 'quota', 'tokens', CAST(CAST(coalesce(sum(tokens), 0) AS BIGINT) AS STRING) {_USE} UNION ALL SELECT 'quota', 'requests', CAST(count(*) AS STRING) {_USE}
UNION ALL SELECT 'task', c.task, CASE WHEN provider <> 'unset' AND model <> 'unset' THEN 'true' ELSE 'false' END || '/none' FROM v_configs c""")
def _(s):
    return composed.system_snapshot(s.resumes, s.jobs, s.applications, s.metrics.where("state = 'RETRY'").select(F.col("task").alias("queue")), s.hits,
                                    s.configs, probes(s), NOW, ENOW)
