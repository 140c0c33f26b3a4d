"""Recruiting entities derived from the given tables.

Each view is one SELECT over the base tables and other views, in a dialect
both Spark SQL and the checking database read.  Where the two differ, a small
helper writes the right text.  All rules are integer arithmetic on keys, so
every view grows with its base table.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from .entities import SCHEMAS, parts, read_entity, spread

SPARK, DUCK = "spark", "duck"


def ts(d: str, text: str) -> str:
    return f"TIMESTAMP_NTZ '{text}'" if d == SPARK else f"TIMESTAMP '{text}'"


def add(d: str, base: str, n: str, unit: str) -> str:
    """``base`` plus ``n`` units (second, minute, hour, day, month)."""
    if d == SPARK:
        return f"timestampadd({unit.upper()}, CAST({n} AS INT), {base})"
    return f"({base} + to_{unit}s(CAST({n} AS INT)))"


def lines_map(d: str, text: str, body: str) -> str:
    """Rewrite each line ``x`` of ``text`` at 0-based index ``i`` by the CASE ``body``."""
    if d == SPARK:
        return f"array_join(transform(split({text}, '\\n'), (x, i) -> {body}), '\\n')"
    duck_body = re.sub(r"\bi\b", "(i - 1)", body)
    return f"array_to_string(list_transform(string_split({text}, chr(10)), lambda x, i: {duck_body}), chr(10))"


def explode_seq(d: str, lo: str, hi: str, name: str) -> str:
    """A lateral 0..n sequence, to be used in a SELECT list."""
    if d == SPARK:
        return f"explode(sequence({lo}, {hi})) AS {name}"
    return f"unnest(range({lo}, {hi} + 1)) AS {name}"


def dealt(d: str, table: str, cols: str, joined: str, name: str = "") -> str:
    """A join with ``part`` whose rows Spark deals by key before they are grouped; :class:`Stage` puts the hints where the mark stands."""
    return f"(SELECT {_mark(table)} {cols} FROM {joined}) {name}".rstrip() if d == SPARK else joined


def _mark(table: str) -> str:
    return f"/* hints: {table} */"


_MONTHS = "Jan,Feb,Mar,Apr,May,Jun,Jul,Aug,Sep,Oct,Nov,Dec".split(",")


def _month_case(expr: str) -> str:
    whens = " ".join(f"WHEN {i} THEN '{m}'" for i, m in enumerate(_MONTHS))
    return f"(CASE CAST({expr} AS INT) {whens} END)"


def _views(d: str) -> dict[str, str]:
    t0 = ts(d, "2020-01-01 00:00:00")
    month0 = "CAST(date_trunc('month', o_orderdate) AS DATE)"
    end = (f"CAST(add_months({month0}, CAST(o_orderkey % 30 AS INT)) AS DATE)" if d == SPARK
           else f"CAST({month0} + to_months(CAST(o_orderkey % 30 AS INT)) AS DATE)")
    snap = lambda v, st, owner: (
        "concat('{\"title\": \"T', CAST(event_id % 17 AS STRING), '\", \"status\": \"s', CAST(" + st + " AS STRING), "
        "'\", \"job_id\": \"', CAST(event_id % 700 AS STRING), '\", \"created_by_id\": \"', CAST(" + owner + " AS STRING), "
        "'\", \"company\": \"', CAST(event_id % 3 AS STRING), '\", \"email\": \"u', CAST(event_id % 40 AS STRING), '@x.test', "
        "'\", \"original_filename\": \"f', CAST(event_id % 90 AS STRING), '.pdf', "
        "'\", \"updated_at\": \"', CAST(event_id AS STRING), '" + v + "', "
        "'\", \"match_details\": \"', CAST(event_id % 5 AS STRING), '\"', "
        "CASE WHEN event_id % 6 = 0 THEN ', \"note\": null' ELSE '' END, '}')"
    )
    return {
        "v_users": f"""
SELECT c_custkey AS user_id,
       CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_name END AS full_name,
       lower(c_name) || '@x.test' AS email,
       CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE '555-' || CAST(c_custkey AS STRING) END AS phone,
       CASE WHEN c_custkey % 41 = 40 THEN NULL ELSE c_nationkey % 3 END AS company,
       CASE WHEN c_custkey = 0 THEN 'superuser' WHEN c_custkey % 50 IN (1, 2) THEN 'admin'
            WHEN c_custkey % 50 BETWEEN 3 AND 9 THEN 'recruiter' ELSE 'user' END AS role,
       CASE WHEN c_custkey % 13 = 0 THEN 'recruiter' END AS requested_role,
       CASE WHEN c_custkey % 26 = 0 THEN c_nationkey % 3 END AS requested_company,
       c_custkey % 19 <> 0 AS is_active,
       {add(d, t0, 'c_custkey % 20000', 'hour')} AS created_at
FROM customer""",
        "v_jobs": f"""
SELECT {_mark('customer') if d == SPARK else ''}p_partkey AS job_id, p_name AS title, p_type AS department, p_brand AS location,
       CASE p_size % 3 WHEN 0 THEN 'draft' WHEN 1 THEN 'published' ELSE 'closed' END AS status,
       c_custkey AS created_by,
       CASE WHEN p_partkey % 37 = 0 THEN (c_nationkey + 1) % 3 ELSE c_nationkey % 3 END AS company,
       CASE WHEN p_partkey % 6 = 0 THEN NULL ELSE (p_partkey % 9) * 12 END AS min_experience_months,
       CASE p_partkey % 10 WHEN 0 THEN 'failed' WHEN 1 THEN 'pending' ELSE 'done' END AS extraction_status,
       CAST(p_partkey % 5 AS INT) AS retry_count,
       CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE p_type || ' ' || p_brand END AS jd_raw_text,
       {add(d, t0, 'p_partkey % 20000', 'hour')} AS created_at,
       {add(d, t0, 'p_partkey % 30000 + 10', 'hour')} AS updated_at
FROM (SELECT *, (p_partkey % CAST(floor((SELECT count(*) FROM customer) / 50) AS BIGINT)) * 50 + 3 + p_partkey % 7 AS creator
      FROM part) p
JOIN customer ON c_custkey = creator""",
        "v_resumes": f"""
SELECT o_orderkey AS resume_id,
       CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_custkey END AS owner_id,
       (o_orderkey % CAST(floor((SELECT count(*) FROM customer) / 50) AS BIGINT)) * 50 + 3 + o_orderkey % 7 AS uploaded_by,
       CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE 'Cand ' || CAST(o_orderkey % 1000 AS STRING) END AS candidate_name,
       CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE 'cand' || CAST(o_orderkey AS STRING) || '@y.test' END AS candidate_email,
       'cv_' || CAST(o_orderkey AS STRING) || CASE WHEN o_orderkey % 3 = 0 THEN ' (2)' ELSE '' END
             || CASE o_orderkey % 4 WHEN 0 THEN '.docx' WHEN 1 THEN '.TXT' ELSE '.pdf' END AS original_filename,
       CASE o_orderkey % 10 WHEN 0 THEN 'failed' WHEN 1 THEN 'pending' WHEN 2 THEN 'processing' ELSE 'done' END AS extraction_status,
       CAST(o_orderkey % 5 AS INT) AS retry_count,
       o_orderkey % 8 = 0 AS is_archived,
       CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE o_orderkey % 240 END AS experience_months,
       o_orderdate AS created_at,
       {add(d, 'o_orderdate', 'o_orderkey % 120', 'minute')} AS updated_at
FROM orders""",
        "v_applications": f"""
SELECT o_orderkey AS application_id,
       CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_custkey END AS user_id,
       CASE WHEN o_orderkey % 11 = 0 THEN (o_orderkey % CAST(floor((SELECT count(*) FROM customer) / 50) AS BIGINT)) * 50 + 3 END AS submitted_by_id,
       (o_orderkey * 13) % (SELECT count(*) FROM part) AS job_id,
       CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE o_orderkey END AS resume_id,
       CASE o_orderkey % 6 WHEN 0 THEN 'applied' WHEN 1 THEN 'under_review' WHEN 2 THEN 'shortlisted'
            WHEN 3 THEN 'interviewing' WHEN 4 THEN 'hired' ELSE 'rejected' END AS status,
       CASE WHEN o_orderkey % 6 = 2 THEN 'shortlisted' END AS shortlist_stage,
       CASE WHEN o_orderkey % 6 = 3 THEN 'scheduled' WHEN o_orderkey % 12 = 4 THEN 'hired' END AS interview_stage,
       CASE WHEN o_orderkey % 6 = 3 THEN {add(d, 'o_orderdate', 'o_orderkey % 60', 'day')} END AS interview_at,
       CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE ((o_orderkey * 37) % 1001) / 10.0E0 END AS match_score,
       CASE o_orderkey % 5 WHEN 0 THEN 'pending' WHEN 1 THEN 'failed' ELSE 'done' END AS match_status,
       CASE WHEN o_orderkey % 14 = 0 THEN CAST(o_orderkey % 107 AS DOUBLE) END AS manual_score,
       o_orderdate AS applied_at,
       {add(d, 'o_orderdate', 'o_orderkey % 90', 'minute')} AS updated_at
FROM orders""",
        "v_resume_skills": f"""
SELECT l_orderkey AS resume_id,
       CASE l_linenumber % 3 WHEN 0 THEN 'skills_section' WHEN 1 THEN 'work_experience' ELSE 'projects' END AS source,
       p_name AS skill, min(l_partkey) AS pos
FROM {dealt(d, 'lineitem', 'l_orderkey, l_linenumber, l_partkey, p_name', 'lineitem JOIN part ON l_partkey = p_partkey')}
GROUP BY 1, 2, 3""",
        "v_jd_skills": f"""
SELECT t.job_id AS job_id, p_name AS skill, min(t.k) AS pos
FROM {dealt(d, 'part', 't.job_id, t.k, p_name', f"""(SELECT job_id, k, (job_id + k * 97) % (SELECT count(*) FROM part) AS target
      FROM (SELECT p_partkey AS job_id, {explode_seq(d, '0', '4', 'k')} FROM part)) t
JOIN part ON p_partkey = t.target""", 't')}
GROUP BY 1, 2""",
        "v_vectors": """
SELECT s.skill AS skill, e.embedding AS embedding
FROM (SELECT p_name AS skill, min(p_partkey) % (SELECT count(*) FROM embeddings) AS vec_id FROM part GROUP BY p_name) s
JOIN embeddings e ON e.vec_id = s.vec_id""",
        "v_alias": """
SELECT DISTINCT replace(p_name, ' ', '-') AS alias, p_name AS canonical FROM part""",
        "v_raw_skills": """
SELECT l_orderkey AS resume_id, l_linenumber AS pos,
       CASE l_partkey % 3 WHEN 0 THEN upper(p_name) WHEN 1 THEN '  ' || replace(p_name, ' ', '-') || ' ' ELSE p_name END AS raw_skill,
       l_partkey AS part_id, l_shipdate AS seen_at
FROM lineitem JOIN part ON l_partkey = p_partkey""",
        "v_skill_state": """
SELECT a.application_id AS application_id, j.skill AS jd_skill,
       CASE (a.application_id + j.pos) % 3 WHEN 0 THEN 'missing' WHEN 1 THEN 'proven' ELSE 'mentioned' END AS state
FROM v_applications a JOIN v_jd_skills j ON a.job_id = j.job_id""",
        "v_ranges": f"""
SELECT o_custkey AS person_id, {month0} AS start_date,
       CASE WHEN o_orderkey % 23 = 0 THEN NULL ELSE {end} END AS end_date
FROM orders""",
        "v_audit": f"""
SELECT event_id AS id, CASE WHEN event_id % 29 = 0 THEN NULL ELSE user_id END AS actor_id,
       'user' || CAST(user_id AS STRING) || '@x.test' AS actor_email,
       CASE event_id % 3 WHEN 0 THEN 'create' WHEN 1 THEN 'update' ELSE 'delete' END AS action,
       CASE event_type WHEN 'view' THEN 'job' WHEN 'click' THEN 'application' WHEN 'signup' THEN 'user'
            WHEN 'purchase' THEN 'resume' ELSE 'application_note' END AS resource_type,
       CASE WHEN event_type = 'view' THEN event_id % 700 ELSE event_id % 2500 END AS resource_id,
       CASE WHEN event_id % 3 = 0 THEN NULL ELSE {snap('b', 'event_id % 4', 'event_id % 160')} END AS before_json,
       CASE WHEN event_id % 3 = 2 THEN NULL ELSE {snap('a', 'event_id % 3', 'event_id % 160')} END AS after_json,
       ts AS created_at
FROM events""",
        "v_metrics": """
SELECT event_id, event_type AS task,
       CASE event_id % 4 WHEN 0 THEN 'FAILURE' WHEN 3 THEN 'RETRY' ELSE 'SUCCESS' END AS state,
       CASE WHEN event_id % 10 = 7 THEN NULL ELSE value END AS seconds, ts AS ts,
       CASE event_id % 2 WHEN 0 THEN 'GET' ELSE 'POST' END AS method, event_type AS route
FROM events""",
        "v_hits": """
SELECT event_id AS hit_id, user_id AS key, ts AS ts, CAST(floor(value) AS BIGINT) AS tokens,
       CAST(floor(value * 0.8E0) AS BIGINT) AS actual_tokens, event_type = 'error' AS failed
FROM events""",
        "v_sessions": f"""
SELECT event_id AS session_id, user_id, ts AS created_at,
       {add(d, 'ts', 'floor(value)', 'minute')} AS last_used_at, {add(d, 'ts', '12', 'hour')} AS expires_at,
       CASE WHEN event_id % 7 = 0 THEN {add(d, 'ts', 'event_id % 2000', 'minute')} END AS revoked_at,
       'tok' || CAST(event_id AS STRING) AS token
FROM events""",
        "v_notes": f"""
SELECT conv_id AS application_id, conv_id * 100 + turn AS note_id, turn, text AS body, role,
       {add(d, t0, 'floor(turn / 2)', 'minute')} AS created_at
FROM conversations""",
        "v_configs": """
SELECT s_name AS task, CASE WHEN s_suppkey % 3 = 0 THEN 'unset' ELSE 'prov' || CAST(s_nationkey AS STRING) END AS provider,
       CASE WHEN s_suppkey % 5 = 0 THEN 'unset' ELSE 'model' || CAST(s_suppkey % 4 AS STRING) END AS model
FROM supplier""",
        # resume-like documents: headings, date ranges and skill lines set into the prose by line number
        "v_resume_docs": f"""
SELECT doc_id, lang, source, {lines_map(d, 'text', f'''CASE
   WHEN i % 14 = 1 THEN 'Work Experience' WHEN i % 14 = 5 THEN 'Education:' WHEN i % 14 = 8 THEN 'PROJECTS'
   WHEN i % 14 = 11 THEN 'Technical Skills'
   WHEN i % 14 = 2 THEN {_month_case('(doc_id + i) % 12')} || ' ' || CAST(2003 + (doc_id * 7 + i) % 14 AS STRING) || ' - ' || CASE WHEN (doc_id + i) % 5 = 0 THEN 'Present' ELSE {_month_case('(doc_id + 3 * i) % 12')} || ' ' || CAST(2004 + (doc_id * 5 + i) % 18 AS STRING) END || ' Engineer, red widget team'
   WHEN i % 14 = 6 THEN CAST(1999 + (doc_id + i) % 9 AS STRING) || ' to ' || CAST(2003 + (doc_id + i) % 9 AS STRING) || ' University'
   WHEN i % 14 = 9 THEN '- Built a blue bolt for ' || source
   WHEN i % 14 = 12 THEN 'languages: Red Widget, small ring (steel, brass), c++, gold-plate'
   ELSE x END''')} AS text
FROM documents""",
        # job-description-like documents
        "v_job_docs": f"""
SELECT doc_id, lang, source, {lines_map(d, 'text', '''CASE
   WHEN i % 13 = 1 THEN 'About the Company' WHEN i % 13 = 3 AND doc_id % 4 <> 0 THEN 'Required Skills:'
   WHEN i % 13 = 3 THEN 'Key Technical Requirements'
   WHEN i % 13 = 4 THEN '- At least ' || CAST(1 + doc_id % 9 AS STRING) || '+ years of experience with red widget'
   WHEN i % 13 = 5 THEN '* blue bolt, small ring and' WHEN i % 13 = 6 THEN 'large gear tooling'
   WHEN i % 13 = 7 AND doc_id % 3 = 0 THEN 'own the deploy line Our Office'
   WHEN i % 13 = 8 AND doc_id % 5 <> 0 THEN 'Optional Skills' WHEN i % 13 = 9 THEN 'Ideally ' || CAST(12 + doc_id % 6 AS STRING) || ' years background'
   WHEN i % 13 = 11 THEN 'Rewards' ELSE x END''')} AS text
FROM documents""",
        # page-structured documents: ten lines a page, a running header on every page
        "v_doc_lines": (f"""
SELECT doc_id, CAST(pos AS BIGINT) AS line_no, CAST(floor(pos / 10) AS BIGINT) AS page,
       CASE WHEN pos % 10 = 0 THEN 'Header ' || CAST(doc_id AS STRING) ELSE trim(line) END AS line
FROM (SELECT doc_id, posexplode(split(text, '\\n')) AS (pos, line) FROM documents)""" if d == SPARK else """
SELECT doc_id, CAST(pos AS BIGINT) AS line_no, CAST(floor(pos / 10) AS BIGINT) AS page,
       CASE WHEN pos % 10 = 0 THEN 'Header ' || CAST(doc_id AS STRING) ELSE trim(line) END AS line
FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
             unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents)"""),
        # lines of the resume-like and job-like documents
        **{f"v_{kind}_lines": (f"""
SELECT doc_id, CAST(pos AS BIGINT) AS line_no, line FROM (SELECT doc_id, posexplode(split(text, '\\n')) AS (pos, line) FROM v_{kind}_docs)"""
            if d == SPARK else f"""
SELECT doc_id, CAST(pos AS BIGINT) AS line_no, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
  unnest(range(len(string_split(text, chr(10))))) AS pos FROM v_{kind}_docs)""") for kind in ("resume", "job")},
        # three text blocks per document, and skills listed under a block that may not hold them
        "v_blocks": ("""
SELECT doc_id, source, """ + ("array_join(transform(sort_array(collect_list(struct(line_no, line))), x -> x.line), '\\n')" if d == SPARK
                                else "string_agg(line, chr(10) ORDER BY line_no)") + """ AS text
FROM (SELECT *, CASE line_no % 3 WHEN 0 THEN 'skills_section' WHEN 1 THEN 'work_experience' ELSE 'projects' END AS source FROM v_resume_lines)
GROUP BY doc_id, source"""),
        "v_block_skills": """
SELECT doc_id, CASE (line_no + line_no % 2) % 3 WHEN 0 THEN 'skills_section' WHEN 1 THEN 'work_experience' ELSE 'projects' END AS source,
       CASE line_no % 4 WHEN 0 THEN split_part(line, ' ', 1) WHEN 1 THEN split_part(line, ' ', 2) WHEN 2 THEN replace(split_part(line, ' ', 1), 'e', 'E')
            ELSE 'zz' || CAST(line_no % 8 AS STRING) END AS skill, line_no AS pos
FROM v_resume_lines WHERE line <> '' AND split_part(line, ' ', 2) <> ''""",
        "v_gold": "SELECT DISTINCT resume_id AS file, skill FROM v_resume_skills WHERE source IN ('skills_section', 'work_experience')",
        "v_pred": "SELECT DISTINCT resume_id AS file, skill FROM v_resume_skills WHERE source IN ('work_experience', 'projects')",
    }


VIEWS = {SPARK: _views(SPARK), DUCK: _views(DUCK)}
#: Views that group a join by nearly unique keys: its rows are dealt by the key first, so later groupings by it need no shuffle, and a task groups
#: the rows that come from so many rows of the table, whatever the session's number of partitions.
DEALT = {"lineitem": "l_orderkey", "part": "t.job_id"}
ROWS = {"lineitem": 1 << 18, "part": 1 << 16, "orders": 1 << 17}
#: Rows of a table up to which Spark may broadcast it to a join.  Spark goes by the size of the file, where dictionary-coded columns take a small part of the memory they need in a task.
LOOKED_UP = 1 << 18


def _needed(sql: str, d: str, seen: list[str]) -> list[str]:
    """View names used by ``sql``, dependencies first."""
    for name in sorted(set(re.findall(r"\bv_[a-z_]+\b", sql))):
        if name in VIEWS[d] and name not in seen:
            _needed(VIEWS[d][name], d, seen)
            seen.append(name)
    return seen


def with_views(sql: str, d: str = DUCK) -> str:
    """Put the WITH clause of every view that ``sql`` mentions in front of it."""
    names = _needed(sql, d, [])
    if not names:
        return sql
    ctes = ",\n".join(f"{n} AS ({VIEWS[d][n]})" for n in names)
    body = sql.strip()
    if body[:15].upper() == "WITH RECURSIVE ":
        return f"WITH RECURSIVE {ctes},\n{body[15:]}"
    if body[:5].upper() == "WITH ":
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"


class Stage:
    """The views of one data folder, as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return read_entity(self.spark, self.sf_dir, name)

    def sql(self, text: str) -> DataFrame:
        full = with_views(text, SPARK)
        for name in ("lineitem", "part", "customer"):
            if _mark(name) in full:
                full = full.replace(_mark(name), f"/*+ {self._hints(name, full)} */".replace("/*+  */", ""))
        for name in SCHEMAS:
            if re.search(rf"\b{name}\b", full):
                table = self.table(name)
                (spread(table) if name == "documents" else table).createOrReplaceTempView(name)
        return self.spark.sql(full)

    def _hints(self, name: str, full: str) -> str:
        looked_up = "customer" if name == "customer" else "part"
        hints = [f"MERGE({looked_up})"] if self.table(looked_up).count() > LOOKED_UP else []
        if name in DEALT:
            # for v_skill_state the lists of jobs meet the applications in a shuffle of its own, where AQE splits a job with very many
            key = DEALT[name] + (", p_name" if name == "part" and "v_skill_state" in full else "")
            hints.append(f"REPARTITION({self.parts(name)}, {key})")
        return ", ".join(hints)

    def parts(self, name: str) -> int:
        """Into how many parts rows that come from a table are dealt."""
        return parts(self.table(name), ROWS[name])

    def __getattr__(self, name: str) -> DataFrame:
        if f"v_{name}" in VIEWS[SPARK]:
            return self.sql(f"SELECT * FROM v_{name}")
        raise AttributeError(name)
