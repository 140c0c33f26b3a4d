"""Text, section, extraction and experience queries."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..functions import dates as d
from ..functions import text as t
from ..functions.skills import normalize_ws
from ..operators import experience as xp
from ..operators import extraction as ex
from ..operators import sections as sec
from ..sources.entities import spread
from .registry import query

TODAY = dt.date(2020, 6, 15)
_TODAY = "DATE '2020-06-15'"
NL = "chr(10)"


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _in(values) -> str:
    return "(" + ", ".join(_q(v) for v in values) + ")"


def _trim(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def _squeeze(x: str) -> str:
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


def _form(x: str) -> str:
    return f"lower({_squeeze(f'''regexp_replace({_trim(x)}, ':+$', '')''')})"


# ---- experience ----------------------------------------------------------------

_USABLE = f"""u AS (SELECT DISTINCT person_id, start_date, least(coalesce(end_date, {_TODAY}), {_TODAY}) AS end_date FROM v_ranges
 WHERE coalesce(end_date, {_TODAY}) >= start_date AND start_date <= {_TODAY})"""
_ISLANDS = f"""WITH {_USABLE},
f AS (SELECT *, CASE WHEN start_date <= max(end_date) OVER (PARTITION BY person_id ORDER BY start_date, end_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM u),
g AS (SELECT *, sum(new) OVER (PARTITION BY person_id ORDER BY start_date, end_date) AS island FROM f),
i AS (SELECT person_id, island, min(start_date) AS start_date, max(end_date) AS end_date FROM g GROUP BY 1, 2),
m AS (SELECT *, CAST((year(end_date) - year(start_date)) * 12 + month(end_date) - month(start_date) AS INT) AS months FROM i)
"""


@query("merge_ranges", _ISLANDS + "SELECT person_id, start_date, end_date, months FROM m")
def _(s):
    return xp.merge_ranges(spread(s.ranges), "person_id", F.lit(TODAY))


_MONTHS_OF = "SELECT r.person_id AS person_id, CAST(sum(m.months) AS BIGINT) AS months FROM (SELECT DISTINCT person_id FROM v_ranges) r LEFT JOIN m ON m.person_id = r.person_id GROUP BY 1"


@query("experience_months", _ISLANDS + _MONTHS_OF)
def _(s):
    return xp.experience_months(spread(s.ranges), "person_id", F.lit(TODAY))


@query("experience_years", _ISLANDS + f"SELECT person_id, CAST(round_even(months / 12.0E0, 0) AS INT) AS years FROM ({_MONTHS_OF})")
def _(s):
    return xp.experience_months(spread(s.ranges), "person_id", F.lit(TODAY)).select("person_id", d.whole_years(F.col("months")).alias("years"))


_MTEXT = """SELECT o_orderkey, CASE o_orderkey % 8 WHEN 0 THEN 'Jun ' || y WHEN 1 THEN y || '-06' WHEN 2 THEN '06/' || y WHEN 3 THEN y WHEN 4 THEN 'June, ' || y
 WHEN 5 THEN 'Present' WHEN 6 THEN 'Jun ''20' ELSE ' till date ' END AS txt, y FROM (SELECT o_orderkey, CAST(1960 + o_orderkey % 60 AS STRING) AS y FROM orders)"""


@query("parse_month", f"""SELECT o_orderkey, CASE WHEN o_orderkey % 8 IN (5, 7) THEN {_TODAY} WHEN o_orderkey % 8 = 6 OR CAST(y AS INT) < 1970 THEN NULL
 ELSE make_date(CAST(y AS INT), CASE WHEN o_orderkey % 8 = 3 THEN 1 ELSE 6 END, 1) END AS month_end FROM ({_MTEXT})""")
def _(s):
    return s.sql(_MTEXT).select("o_orderkey", d.parse_month(F.col("txt"), True, F.lit(TODAY)).alias("month_end"))


_KIND = f"""CASE WHEN length({{f}}) > 40 THEN NULL WHEN {{f}} IN {_in(xp.EXPERIENCE_HEADINGS)} THEN 'experience' WHEN {{f}} IN {_in(xp.OTHER_HEADINGS)} THEN 'other' END"""
_FORM2 = _form("line")
_SPLIT = f"""WITH k AS (SELECT doc_id, line_no, line, {_KIND.format(f=_FORM2)} AS kind FROM v_resume_lines),
s AS (SELECT *, last_value(kind IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no) AS section FROM k)
"""


@query("split_experience", _SPLIT + f"""SELECT doc_id, md5(coalesce(string_agg(line, {NL} ORDER BY line_no) FILTER (section = 'experience'), '')) AS experience_text,
 md5(coalesce(string_agg(line, {NL} ORDER BY line_no) FILTER (section IS NULL OR section <> 'other'), '')) AS usable_text
FROM (SELECT d.doc_id, s.line_no, CASE WHEN s.kind IS NULL THEN s.line END AS line, s.section FROM v_resume_docs d LEFT JOIN s ON s.doc_id = d.doc_id) GROUP BY 1""")
def _(s):
    return xp.split_experience(s.resume_docs).select("doc_id", F.md5("experience_text").alias("experience_text"), F.md5("usable_text").alias("usable_text"))


_MON = "jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec"
_RNG = f"""r AS (SELECT doc_id, line_no, regexp_extract(line, '^([A-Z][a-z][a-z] [0-9]{{4}}|[0-9]{{4}}) (?:-|to) (Present|[A-Z][a-z][a-z] [0-9]{{4}}|[0-9]{{4}}) (?:Engineer|University)', ['a', 'b']) AS g
 FROM v_resume_lines WHERE regexp_matches(line, '^([A-Z][a-z][a-z] [0-9]{{4}}|[0-9]{{4}}) (?:-|to) (Present|[A-Z][a-z][a-z] [0-9]{{4}}|[0-9]{{4}}) (?:Engineer|University)'))"""


@query("extract_ranges", f"WITH {_RNG} SELECT doc_id, g.a AS range_start, g.b AS range_end FROM r")
def _(s):
    return s.resume_docs.select("doc_id", F.inline_outer(d.find_ranges(F.col("text")))).where("start is not null").select("doc_id", F.col("start").alias("range_start"), F.col("end").alias("range_end"))


# every injected job text line that states a duration, with the context that makes it a preference
_MEN = """SELECT doc_id, line_no, CAST(regexp_extract(line, '([0-9]+)\\+? years', 1) AS INT) * 12 AS min_months,
 starts_with(line, 'Ideally') OR (length(prev) <= 40 AND regexp_matches(lower(prev), 'nice to have|bonus|preferred|advantage')) AS preferred
FROM (SELECT *, trim(coalesce(lag(line) OVER (PARTITION BY doc_id ORDER BY line_no), '')) AS prev FROM v_job_lines)
WHERE regexp_matches(line, '^- At least [0-9]+\\+ years of experience|^Ideally [0-9]+ years background')"""


@query("extract_mentions", f"SELECT doc_id, min_months, preferred FROM ({_MEN})")
def _(s):
    return s.job_docs.select("doc_id", F.inline_outer(d.find_mentions(F.col("text")))).where("min_months is not null").select("doc_id", "min_months", "preferred")


@query("preferred_context", f"SELECT doc_id, min_months FROM ({_MEN}) WHERE preferred")
def _(s):
    return s.job_docs.select("doc_id", F.inline_outer(d.find_mentions(F.col("text")))).where("preferred").select("doc_id", "min_months")


@query("min_experience", f"""SELECT d.doc_id, CAST(max(m.min_months) FILTER (NOT preferred) AS INT) AS min_months,
 CASE WHEN max(m.min_months) FILTER (NOT preferred) IS NOT NULL THEN 'full_text' END AS min_source FROM v_job_docs d LEFT JOIN ({_MEN}) m ON m.doc_id = d.doc_id GROUP BY 1""")
def _(s):
    docs = s.job_docs.withColumn("section", F.lit(None).cast("string"))
    return xp.min_experience(docs, "section", "text").select("doc_id", "min_months", "min_source")


@query("quantity_months", """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CAST(round_even(l_quantity * 0.5E0 * CASE l_linenumber % 2 WHEN 0 THEN 12 ELSE 1 END, 0) AS INT) AS months FROM lineitem""")
def _(s):
    unit = F.when(F.col("l_linenumber") % 2 == 0, "Years").otherwise("mos")
    return s.table("lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", d.quantity_months(
        d.quantity((F.col("l_quantity") * 0.5).cast("string")), unit).alias("months"))


@query("format_months", """SELECT resume_id, CASE WHEN m IS NULL THEN NULL WHEN m = 0 THEN '0 mos' ELSE trim(
 CASE WHEN m >= 12 THEN CAST(m // 12 AS STRING) || CASE WHEN m // 12 = 1 THEN ' yr' ELSE ' yrs' END ELSE '' END || ' ' ||
 CASE WHEN m % 12 > 0 THEN CAST(m % 12 AS STRING) || CASE WHEN m % 12 = 1 THEN ' mo' ELSE ' mos' END ELSE '' END) END AS label FROM (SELECT resume_id, experience_months AS m FROM v_resumes)""")
def _(s):
    return s.resumes.select("resume_id", d.format_months(F.col("experience_months")).alias("label"))


@query("meets_requirement", """SELECT a.application_id, r.experience_months >= j.min_experience_months AS meets FROM v_applications a
 LEFT JOIN v_resumes r ON a.resume_id = r.resume_id LEFT JOIN v_jobs j ON a.job_id = j.job_id""")
def _(s):
    return (s.applications.join(s.resumes.select("resume_id", "experience_months"), "resume_id", "left").join(s.jobs.select("job_id", "min_experience_months"), "job_id", "left")
            .select("application_id", xp.meets_requirement(F.col("experience_months"), F.col("min_experience_months")).alias("meets")))


# ---- hygiene -------------------------------------------------------------------

def _hashed(df, col):
    return df.select("doc_id", F.md5(col).alias("hash"), F.length(col).alias("n"))


def _hash_sql(expr, view):
    return f"SELECT doc_id, md5(x) AS hash, CAST(length(x) AS INT) AS n FROM (SELECT doc_id, {expr} AS x FROM {view})"


def _lines_sql(body, keep, text="text"):
    return f"array_to_string(list_filter(list_transform(string_split({text}, {NL}), lambda x: {body}), lambda x: {keep}), {NL})"


@query("normalize_ws", _hash_sql("lower(trim(regexp_replace(text, '\\s+', ' ', 'g')))", "documents"))
def _(s):
    return _hashed(s.table("documents"), normalize_ws(F.col("text")))


_CLEAN = "text"
for _o, _n in t.ARTEFACTS:
    _CLEAN = f"replace({_CLEAN}, {_q(_o)}, {_q(_n)})"
_CLEAN = _trim(f"regexp_replace(regexp_replace({_CLEAN}, '[ \\t]+', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g')")


CLEAN_TEXT = _CLEAN


@query("clean_text", _hash_sql(CLEAN_TEXT, "documents"))
def _(s):
    return _hashed(s.table("documents"), t.clean_text(F.col("text")))


STRIP_DATES = _lines_sql(_trim(f"regexp_replace(x, {_q(t.LEADING_DATE)}, '')"), "x <> ''")


@query("strip_dates", _hash_sql(STRIP_DATES, "v_resume_docs"))
def _(s):
    return _hashed(s.resume_docs, t.strip_dates(F.col("text")))


STRIP_BULLETS = f"array_to_string(list_transform(list_filter(string_split(text, {NL}), lambda x: {_trim('x')} <> ''), lambda x: " + _trim(f"regexp_replace(x, {_q(t.PROSE_BULLET)}, '')") + f"), {NL})"


@query("strip_bullets", _hash_sql(STRIP_BULLETS, "v_job_docs"))
def _(s):
    return _hashed(s.job_docs, t.strip_bullets(F.col("text")))


_CB1 = _squeeze("regexp_replace(replace(x, chr(160), ' '), '[\\x{200b}\\x{200c}\\x{200d}\\x{feff}]', '', 'g')")
_CBR = _trim(f"regexp_replace(x, {_q(t.ITEM_BULLET)}, '')")
_CB2 = f"CASE WHEN NOT regexp_matches(x, {_q(t.ITEM_BULLET)}) THEN x WHEN {_CBR} = '' THEN '' WHEN regexp_matches(x, '^[0-9]') THEN x ELSE '- ' || {_CBR} END"


CLEAN_BULLETS = _trim(f"array_to_string(list_filter(list_transform(list_transform(string_split(text, {NL}), lambda x: {_CB1}), lambda x: {_CB2}), lambda x: x <> '' AND NOT regexp_matches(x, {_q(t.PAGE_NUMBER)})), {NL})")


@query("clean_bullets", _hash_sql(CLEAN_BULLETS, "v_job_docs"))
def _(s):
    return _hashed(s.job_docs, t.clean_bullets(F.col("text")))


def expand_sql(src: str, out: str) -> str:
    """CTEs that expand the parentheses of ``src`` (doc_id, text) round by round until nothing changes; the result is ``out`` (doc_id, text)."""
    group = "'([^()\\n,:|]+?)\\s*\\(([^()]*)\\)'"
    plain = "translate(lower(text), chr(1) || chr(2), '  ')"
    parts = f"""list_transform(regexp_extract_all(t, {group}), lambda x: {{'x': x, 'raw': regexp_extract(x, '^([^()\\n,:|]+?)\\s*\\(', 1), 'inner': regexp_extract(x, '\\(([^()]*)\\)$', 1)}})"""
    read = f"""list_transform({parts}, lambda q: {{'x': q.x, 'lead': regexp_extract(q.raw, '^\\s*', 0), 'base': {_trim('q.raw')},
 'w': list_filter(string_split({_squeeze('q.raw')}, ' '), lambda v: v <> ''), 'items': list_filter(list_transform(regexp_split_to_array(q.inner, '[,;|]'), lambda v: {_trim('v')}), lambda v: v <> '')}})"""
    named = f"""list_transform({read}, lambda q: {{'x': q.x, 'lead': q.lead, 'items': q.items, 'keep': len(q.w) = 0 OR len(q.w) > {t.MAX_BASE_WORDS} OR regexp_matches(q.base, '[.!?]\\s') OR len(q.items) = 0,
 'base': CASE WHEN len(q.w) > 1 AND q.w[1] IN {_in(t.STRUCTURAL_LEADERS)} AND q.w[2] NOT IN {_in(t.GENERIC_HEADS)} THEN array_to_string(q.w[2:], ' ') ELSE q.base END}})"""
    done = f"list_transform({named}, lambda q: CASE WHEN q.keep THEN q.x ELSE q.lead || array_to_string(list_concat([q.base], list_transform(q.items, lambda v: q.base || ' ' || v)), ', ') END)"
    return f"""{out}_r AS (SELECT doc_id, 0 AS k, replace(regexp_replace({plain}, '\\(\\s*cid:127\\s*\\)', ', ', 'g'), chr(8226), ', ') AS t FROM {src}
 UNION ALL SELECT doc_id, k + 1, n FROM (SELECT doc_id, k, t, array_to_string(list_transform(range(1, len(gaps) + 1), lambda i: gaps[i] || coalesce(new[i], '')), '') AS n
  FROM (SELECT doc_id, k, t, regexp_split_to_array(t, {group}) AS gaps, {done} AS new FROM {out}_r WHERE contains(t, '('))) WHERE n <> t),
{out} AS (SELECT doc_id, arg_max(t, k) AS text FROM {out}_r GROUP BY 1)"""


@query("expand_parens", "WITH RECURSIVE " + expand_sql("v_resume_docs", "expanded") + " SELECT doc_id, md5(text) AS hash, CAST(length(text) AS INT) AS n FROM expanded")
def _(s):
    return _hashed(s.resume_docs, t.expand_parens(F.col("text")))


_HW = _in(t.HEADER_WORDS)
_BARE = f"NOT regexp_matches(x, '[,|/:]') AND len(w) <= 4 AND len(list_filter(w, lambda v: lower(v) NOT IN {_HW})) = 0 AND nxt <> '' AND (regexp_matches(nxt, '[,|]') OR regexp_matches(nxt, '\\S\\s+\\S'))"
_REST = _trim("regexp_replace(x, '^[^:]*:', '')")


def labels_sql(lines: str, out: str) -> str:
    """CTEs that drop category labels from ``lines`` (doc_id, line_no, line); the result is ``out`` (doc_id, text)."""
    return f"""{out}_l AS (SELECT doc_id, line_no, {_trim('line')} AS x FROM {lines}),
{out}_n AS (SELECT *, coalesce(lead(x) OVER (PARTITION BY doc_id ORDER BY line_no), '') AS nxt, regexp_split_to_array(x, '\\s*&\\s*|\\s+') AS w FROM {out}_l),
{out}_o AS (SELECT doc_id, line_no, CASE WHEN {_BARE} THEN '' WHEN contains(x, ':') THEN CASE WHEN {_REST} = '' THEN '' WHEN {_trim("regexp_extract(x, '^([^:]*):', 1)")} <> '' THEN {_REST} ELSE x END ELSE x END AS y FROM {out}_n),
{out} AS (SELECT doc_id, coalesce(string_agg(y, {NL} ORDER BY line_no) FILTER (y <> ''), '') AS text FROM {out}_o GROUP BY 1)"""


@query("strip_labels", "WITH " + labels_sql("v_resume_lines", "labelled") + " SELECT doc_id, md5(text) AS hash, CAST(length(text) AS INT) AS n FROM labelled")
def _(s):
    return _hashed(s.resume_docs, t.strip_labels(F.col("text")))


@query("strip_boilerplate", f"""WITH l AS (SELECT doc_id, page, line_no, {_trim('line')} AS line FROM v_doc_lines),
p AS (SELECT doc_id, count(DISTINCT page) AS pages FROM l GROUP BY 1),
r AS (SELECT doc_id, line, count(DISTINCT page) AS n FROM l WHERE line <> '' AND length(line) <= 60 GROUP BY 1, 2)
SELECT doc_id, line_no, md5(line) AS hash FROM l WHERE line <> '' AND NOT EXISTS (SELECT 1 FROM r JOIN p ON r.doc_id = p.doc_id WHERE r.doc_id = l.doc_id AND r.line = l.line
 AND r.n >= greatest(2, round_even(p.pages * 0.5E0, 0)))""")
def _(s):
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.struct(
        F.floor(i / 10).alias("page"), i.cast("bigint").alias("line_no"), F.when(i % 10 == 0, F.concat(F.lit("Header "), F.col("doc_id").cast("string"))).otherwise(F.trim(x)).alias("line")))
    df = spread(s.table("documents")).withColumn("lines", lines).withColumn("kept", sec.strip_boilerplate(F.col("lines")))
    return df.select("doc_id", F.explode_outer("kept").alias("k")).where("k is not null").select("doc_id", "k.line_no", F.md5("k.line").alias("hash"))


# ---- headings and sections ------------------------------------------------------

_NH = ("lower(trim(regexp_replace(" + _squeeze("regexp_replace(replace(replace(replace(line, chr(8217), chr(39)), chr(8216), chr(39)), chr(160), ' '), '\\s*&\\s*', ' & ', 'g')")
       + ", ':+$', '')))")


@query("normalize_heading", f"SELECT doc_id, line_no, md5({_NH}) AS norm, md5(regexp_replace({_NH}, '[^a-z0-9]', '', 'g')) AS compact FROM v_job_lines")
def _(s):
    return s.job_lines.select("doc_id", "line_no", F.md5(t.normalize_heading(F.col("line"))).alias("norm"), F.md5(t.compact_heading(F.col("line"))).alias("compact"))


_RS = f"""CASE WHEN {_trim('line')} = '' OR length({_trim('line')}) > 60 OR regexp_matches({_trim('line')}, {_q(t.LIST_BULLET)}) OR regexp_matches({_trim('line')}, '[.;,]$') THEN 0
 WHEN {_FORM2} IN {_in(sec.STRONG_JOB_HEADINGS)} OR ({_NH} IN {_in(sec.STRONG_JOB_HEADINGS)} AND NOT regexp_matches({_trim('line')}, '[!?]$') AND NOT regexp_matches(regexp_extract(line, '(\\pL)', 1), '^\\p{{Ll}}$')) THEN 2
 WHEN regexp_matches({_FORM2}, {_q(sec.FUZZY_JOB_HEADING)}) THEN 1 ELSE 0 END"""


# every line that the tables of boundaries know is one of three set in by rule
_SET_IN = "('About the Company', 'Optional Skills', 'Rewards')"
_HEAD = f"regexp_replace({_trim('line')}, ':+$', '')"
_HEAD = _trim(_HEAD)
_NWORDS = f"len(regexp_extract_all({_HEAD}, '\\S+'))"
_CONTENT = f"list_filter(regexp_extract_all({_HEAD}, '[A-Za-z][A-Za-z'']*'), lambda w: lower(w) NOT IN {_in(sec.SMALL_WORDS)})"


@query("classify_headings", f"""SELECT doc_id, line_no, CAST({_RS} AS INT) AS requirement, {_trim('line')} IN {_SET_IN} AS boundary,
 regexp_matches({_trim('line')}, '[.;!?,]$') OR regexp_matches(regexp_extract({_trim('line')}, '(\\pL)', 1), '^\\p{{Ll}}$') AS fragment,
 {_HEAD} <> '' AND NOT regexp_matches({_HEAD}, {_q(t.ITEM_BULLET)}) AND {_HEAD} = upper({_HEAD}) AND {_HEAD} <> lower({_HEAD}) AND {_NWORDS} BETWEEN 2 AND 5 AND length({_HEAD}) < 40 AND NOT regexp_matches({_HEAD}, '[0-9,.;]') AS caps,
 {_NWORDS} BETWEEN 1 AND 7 AND NOT regexp_matches({_HEAD}, {_q(t.ITEM_BULLET)}) AND NOT regexp_matches({_HEAD}, '[.;!?,0-9]') AND regexp_matches({_HEAD}, {_q(sec.FUZZY_KEYWORD)}) AND regexp_matches({_HEAD}, '^\\p{{Lu}}')
  AND len({_CONTENT}) > 0 AND len(list_filter({_CONTENT}, lambda w: NOT regexp_matches(w, '^[A-Z]'))) = 0 AND {_HEAD} NOT IN {_SET_IN} AS fuzzy,
 CASE WHEN {_trim('line')} IN {_SET_IN} THEN lower({_trim('line')}) END AS leading,
 CASE WHEN {_NH} IN {_in(sec.PRIORITY_JOB_HEADINGS)} THEN 1 ELSE 0 END AS priority FROM v_job_lines""")
def _(s):
    c = F.col("line")
    return s.job_lines.select("doc_id", "line_no", sec.requirement_score(c).alias("requirement"), sec.is_job_boundary(c).alias("boundary"), sec.sentence_fragment(c).alias("fragment"),
                              sec.caps_heading(c).alias("caps"), sec.fuzzy_heading(c).alias("fuzzy"), sec.leading_boundary(c).alias("leading"), sec.heading_priority(c).alias("priority"))


@query("split_inline_label", f"""SELECT doc_id, line_no, CASE WHEN line_no % 2 = 0 THEN 'Required Skills' ELSE 'must  have' END AS heading, {_trim('line')} AS rest FROM v_job_lines WHERE {_trim('line')} <> ''""")
def _(s):
    lines = s.job_lines.withColumn("line", F.concat(F.when(F.col("line_no") % 2 == 0, "Required Skills").otherwise("must  have"), F.lit(" : "), "line"))
    got = sec.split_inline_label(F.col("line"))
    return lines.select("doc_id", "line_no", got["heading"].alias("heading"), got["rest"].alias("rest")).where("rest is not null")


@query("split_embedded", "SELECT doc_id, line_no, CASE WHEN line = 'own the deploy line Our Office' THEN 'own the deploy line' END AS head, CASE WHEN line = 'own the deploy line Our Office' THEN 'Our Office' END AS tail FROM v_job_lines")
def _(s):
    lines = s.job_lines
    got = sec.split_embedded(F.col("line"))
    return lines.select("doc_id", "line_no", F.when(got["tail"].isNotNull(), got["head"]).alias("head"), got["tail"].alias("tail"))


_RKIND = "CASE " + " ".join(f"WHEN f IN {_in([h for h, k in sec.RESUME_HEADINGS.items() if k == kind])} THEN '{kind}'" for kind in ("experience", "projects", "other")) + " END"
_SECT = f"""WITH l AS (SELECT doc_id, line_no, {_trim('line')} AS line FROM v_resume_lines),
h AS (SELECT doc_id, line_no, line, {_form('line')} AS f FROM l WHERE line <> ''),
k AS (SELECT *, CASE WHEN length(line) <= 60 THEN {_RKIND} END AS kind FROM h),
s AS (SELECT *, last_value(kind IGNORE NULLS) OVER w AS section, last_value(CASE WHEN kind IS NOT NULL THEN line END IGNORE NULLS) OVER w AS heading,
        count(kind) OVER w AS ordinal FROM k WINDOW w AS (PARTITION BY doc_id ORDER BY line_no))
"""


@query("partition_sections", _SECT + f"""SELECT doc_id, CAST(ordinal - 1 AS INT) AS pos, section AS kind, heading, CAST(count(*) FILTER (kind IS NULL) AS INT) AS n_lines,
 md5(coalesce(string_agg(line, {NL} ORDER BY line_no) FILTER (kind IS NULL), '')) AS hash FROM s WHERE ordinal > 0 GROUP BY 1, 2, 3, 4""")
def _(s):
    df = sec.partition_sections(s.resume_docs).select("doc_id", F.posexplode_outer(F.transform("sections", lambda x: F.struct(x["kind"].alias("kind"), x["heading"].alias("heading"), F.size(x["lines"]).alias("n_lines"), F.md5(F.array_join(x["lines"], "\n")).alias("hash")))).alias("pos", "x")).where("pos is not null")
    return df.select("doc_id", "pos", F.struct("x.*").alias("x")).select("doc_id", "pos", "x.*")


@query("collect_sections", _SECT + f"""SELECT d.doc_id, k.kind, count(s.doc_id) > 0 AS found, arg_min(s.heading, s.line_no) AS heading,
 md5(coalesce(string_agg(s.line, {NL} ORDER BY s.line_no) FILTER (s.kind IS NULL), '')) AS hash
FROM v_resume_docs d CROSS JOIN (VALUES ('experience'), ('projects')) k(kind) LEFT JOIN s ON s.doc_id = d.doc_id AND s.section = k.kind GROUP BY 1, 2""")
def _(s):
    df = sec.partition_sections(s.resume_docs)
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), sec.collect_section("sections", k).alias("x")) for k in ("experience", "projects")])
    return df.select("doc_id", F.inline_outer(kinds)).select("doc_id", "kind", "x.found", "x.heading", F.md5("x.section_text").alias("hash"))


_TRIML = _trim("line")
_HS = f"""WITH l AS (SELECT doc_id, line_no, line, {_TRIML} AS s, {_form('line')} AS f,
  concat_ws(' ', lead(line, 1) OVER w, lead(line, 2) OVER w, lead(line, 3) OVER w) AS nxt FROM v_resume_lines WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)),
p AS (SELECT *, f IN {_in(sec.SKILLS_HEADINGS)} AS known, regexp_matches(s, {_q(sec.HEADING_KEYWORDS)}) AS kw FROM l),
r AS (SELECT *, (CASE WHEN known THEN 8 ELSE 0 END + CASE WHEN length(s) < 60 THEN 1 ELSE 0 END
  + CASE WHEN (s = upper(s) AND s <> lower(s)) OR regexp_matches(s, '^\\PL*(?:\\p{{Lu}}\\p{{Ll}}*\\PL+)*\\p{{Lu}}\\p{{Ll}}*\\PL*$') THEN 1 ELSE 0 END + CASE WHEN s LIKE '%:' THEN 1 ELSE 0 END
  + CASE WHEN kw THEN 2 ELSE 0 END - CASE WHEN regexp_matches(s, {_q(sec.ROLE_TERMS)}) THEN 6 ELSE 0 END
  + CASE WHEN kw AND length(nxt) > 0 AND (length(nxt) - length(replace(nxt, ',', ''))) / CAST(greatest(length(nxt), 1) AS DOUBLE) > 0.01 THEN 1.5 ELSE 0 END) AS raw FROM p),
q AS (SELECT *, CAST(CASE WHEN s = '' OR f IN {_in(sec.MAJOR_HEADINGS)} THEN 0 WHEN known THEN greatest(raw, 9) ELSE raw END AS DOUBLE) AS score FROM r)
"""


@query("best_heading", _HS + """SELECT doc_id, score, CASE WHEN score >= 3 THEN s END AS heading, score >= 3 AS found FROM
 (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, line_no) AS rn FROM q) WHERE rn = 1""")
def _(s):
    return sec.best_skills_heading(s.resume_docs).select("doc_id", "skills.score", "skills.heading", "skills.found")


# the only boundary headings in the job texts are the ones set in by rule, and one glued heading
_GLUED = "own the deploy line Our Office"
_JL = f"""l AS (SELECT doc_id, line_no, line, {_trim('line')} AS t, {_RS} AS score FROM v_job_lines),
bound AS (SELECT *, t IN ('About the Company', 'Optional Skills', 'Rewards') AS stop, line = '{_GLUED}' AS glued FROM l)"""


def _read_sql(start: str, skip: str, lower: bool) -> str:
    """Lines after the start line up to the next boundary, with the head of a glued one."""
    body = f"CASE WHEN b.glued THEN 'own the deploy line' ELSE b.line END"
    text = f"coalesce(string_agg({body}, {NL} ORDER BY b.line_no) FILTER (b.line_no < e.at OR (b.line_no = e.at AND b.glued)), '')"
    return f"""{start},
e AS (SELECT s.doc_id, s.line_no, s.heading, coalesce(min(b.line_no) FILTER (b.stop OR b.glued), 1000000000) AS at FROM s LEFT JOIN bound b ON b.doc_id = s.doc_id AND b.line_no > s.line_no GROUP BY 1, 2, 3),
x AS (SELECT e.doc_id, e.line_no, e.heading, {text if not lower else f"lower({text})"} AS body FROM e LEFT JOIN bound b ON b.doc_id = e.doc_id AND b.line_no > e.line_no AND b.t <> '' AND NOT ({skip}) GROUP BY 1, 2, 3)"""


_BEST = "s AS (SELECT doc_id, line_no, t AS heading FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, line_no) AS rn FROM l) WHERE rn = 1 AND score > 0)"


@query("requirements_section", "WITH " + _JL + ", " + _read_sql(_BEST, "b.score > 0", False) + """ SELECT d.doc_id, x.doc_id IS NOT NULL AS found, x.heading, md5(coalesce(x.body, '')) AS hash FROM v_job_docs d LEFT JOIN x ON x.doc_id = d.doc_id""")
def _(s):
    return sec.requirements_section(s.job_docs).select("doc_id", "requirements.found", "requirements.heading", F.md5("requirements.section_text").alias("hash"))


_WORDS = r"len(regexp_extract_all({}, '\S+'))"
_CW = f"list_filter(regexp_extract_all(b.t, '[A-Za-z][A-Za-z'']*'), lambda w: lower(w) NOT IN {_in(sec.SMALL_WORDS)})"
_CONT = rf"""CASE WHEN regexp_matches(b.t, '^(?:\p{{Ll}}|[)\],;])') THEN true WHEN regexp_matches(r.item, {_q(sec.CONTINUES_AFTER)}) THEN true
 WHEN r.item LIKE '%:' AND {_WORDS.format('r.item')} <= 4 THEN true
 WHEN {_WORDS.format('b.t')} BETWEEN 2 AND 6 AND regexp_matches(b.t, {_q(sec.SUBHEADING_TAIL)}) AND len({_CW}) > 0 AND len(list_filter({_CW}, lambda w: NOT regexp_matches(w, '^[A-Z]'))) = 0 THEN false
 ELSE hb.has AND NOT regexp_matches(r.item, '[.!?;:]$') END"""


_JOINED = _JL + ", " + _read_sql(_BEST, "b.score > 0", False) + rf""",
b0 AS (SELECT doc_id, unnest(string_split(body, {NL})) AS raw, unnest(range(len(string_split(body, {NL})))) AS p FROM x),
b AS (SELECT doc_id, t, regexp_matches(t, {_q(t.ITEM_BULLET)}) AS bul, row_number() OVER (PARTITION BY doc_id ORDER BY p) AS i FROM (SELECT doc_id, p, {_trim('raw')} AS t FROM b0) WHERE t <> ''),
hb AS (SELECT doc_id, bool_or(bul) AS has FROM b GROUP BY 1),
r AS (SELECT doc_id, i, t AS item, 0 AS k FROM b WHERE i = 1 UNION ALL
 SELECT b.doc_id, b.i, CASE WHEN n.fresh THEN b.t ELSE r.item || CASE WHEN regexp_matches(r.item, '\pL-$') AND regexp_matches(b.t, '^\p{{Ll}}') THEN '' ELSE ' ' END || b.t END, r.k + CAST(n.fresh AS INT)
 FROM r JOIN b ON b.doc_id = r.doc_id AND b.i = r.i + 1 JOIN hb ON hb.doc_id = b.doc_id, LATERAL (SELECT b.bul OR NOT ({_CONT}) AS fresh) n)"""


@query("join_wrapped", "WITH RECURSIVE " + _JOINED + " SELECT doc_id, k AS pos, arg_max(item, i) AS item FROM r GROUP BY 1, 2")
def _(s):
    df = sec.requirements_section(s.job_docs)
    return df.select("doc_id", F.posexplode_outer(sec.join_wrapped(F.split("requirements.section_text", "\n"))).alias("pos", "item")).where("pos is not null")


_CAND = """SELECT doc_id, line_no, length(line) % 2 AS priority, (length(line) * 7) % 11 AS confidence, CAST(floor(line_no / 10) AS BIGINT) AS page, line_no % 3 AS detector_rank FROM v_job_lines WHERE line <> ''"""


@query("rank_heading_candidates", f"SELECT doc_id, line_no, priority, confidence FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY priority DESC, confidence DESC, page, detector_rank, line_no) AS rn FROM ({_CAND})) WHERE rn = 1")
def _(s):
    return sec.rank_heading_candidates(s.sql(_CAND)).select("doc_id", "line_no", "priority", "confidence")


@query("collect_until_boundary", "WITH " + _JL + ", " + _read_sql("s AS (SELECT doc_id, min(line_no) AS line_no, '' AS heading FROM l WHERE t = 'Required Skills:' GROUP BY 1)",
       "b.t = 'Required Skills:'", True) + " SELECT doc_id, CAST(line_no AS INT) AS chosen, md5(body) AS hash FROM x")
def _(s):
    lines = s.job_docs.withColumn("lines", t.lines_of(F.col("text")))
    best = F.array_max(F.transform("lines", lambda x, i: F.struct(sec.heading_priority(x).alias("p"), F.when(sec.is_strong_heading(x), 1).otherwise(0).alias("s"), (-i).alias("neg"))))
    df = lines.withColumn("b", best).where("b.s = 1").withColumn("chosen", -F.col("b.neg")).withColumn("priority", F.col("b.p"))
    return sec.collect_until_boundary(df, "lines", "chosen", "priority").select("doc_id", "chosen", F.md5("section_text").alias("hash"))


# ---- extraction -----------------------------------------------------------------

_LEX = "SELECT alias, canonical FROM v_alias UNION ALL SELECT DISTINCT canonical, canonical FROM v_alias"
_TOK = "regexp_extract_all(lower(text), '([\\pL\\pN+#]+(?:[.-][\\pL\\pN+#]+)*)', 1)"


@query("tag_skills", f"""WITH k AS (SELECT doc_id, {_TOK} AS tok FROM v_resume_docs), g AS (SELECT doc_id, tok, unnest(range(1, len(tok) + 1)) AS i FROM k),
n AS (SELECT doc_id, array_to_string(tok[i:least(i + z - 1, len(tok))], ' ') AS alias FROM g, (VALUES (1), (2), (3)) v(z) WHERE i + z - 1 <= len(tok))
SELECT DISTINCT n.doc_id, l.canonical AS skill FROM n JOIN ({_LEX}) l ON l.alias = n.alias""")
def _(s):
    return ex.tag_skills(s.resume_docs, ["doc_id"], "text", s.sql(_LEX)).select("doc_id", "skill")


def blocks(s):
    """Per document: skills by source and text by source, as maps."""
    skills = s.block_skills.groupBy("doc_id", "source").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "skill"))), lambda x: x["skill"]).alias("l"))
    skills = skills.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("source", "l"))).alias("skills"))
    text = s.blocks.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("source", "text"))).alias("blocks"))
    return skills.join(text, "doc_id")


_NTXT = "SELECT doc_id, source, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS txt FROM v_blocks"
_NSK = "SELECT *, lower(trim(regexp_replace(skill, '\\s+', ' ', 'g'))) AS norm FROM v_block_skills"


@query("ground_skills", f"""SELECT k.doc_id, k.source, k.skill FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, source, norm ORDER BY pos) AS rn FROM ({_NSK})) k
JOIN ({_NTXT}) b ON b.doc_id = k.doc_id AND b.source = k.source WHERE rn = 1 AND contains(b.txt, k.norm)""")
def _(s):
    df = blocks(s).select("doc_id", "blocks", F.explode_outer("skills").alias("source", "l"))
    return df.select("doc_id", "source", F.explode_outer(ex.ground(F.col("l"), F.try_element_at("blocks", "source"))["kept"]).alias("skill")).where("skill is not null")


_WORD = "regexp_matches(' ' || b.txt || ' ', '[^a-z0-9+#]' || regexp_replace(k.norm, '([\\\\.\\[\\]{}()*+?^$|#&-])', '\\\\\\1', 'g') || '[^a-z0-9+#]')"


@query("whole_word_skills", f"SELECT DISTINCT k.doc_id, k.norm AS skill, b.source FROM ({_NSK}) k JOIN ({_NTXT}) b ON b.doc_id = k.doc_id WHERE {_WORD}")
def _(s):
    norms = F.array_distinct(F.transform(ex.merge(F.col("skills")), normalize_ws))
    df = blocks(s).withColumn("norms", norms).select("doc_id", "norms", F.explode_outer("blocks").alias("source", "text"))
    df = df.withColumn("held", ex.held_words(ex.block_text(F.col("text")), ex.skill_parts(F.col("norms")))).select("doc_id", "source", F.arrays_zip("norms", "held").alias("k"))
    return df.select("doc_id", "source", F.explode_outer("k").alias("k")).where("k.held").select("doc_id", F.col("k.norms").alias("skill"), "source")


_SRCRANK = "CASE {} WHEN 'skills_section' THEN 0 WHEN 'work_experience' THEN 1 ELSE 2 END"
_ROUTED = f"""SELECT k.doc_id, k.pos, k.skill, k.norm, k.source AS old, coalesce((SELECT arg_min(b.source, CASE WHEN b.source = k.source THEN -1 ELSE {_SRCRANK.format('b.source')} END) FROM ({_NTXT}) b
 WHERE b.doc_id = k.doc_id AND contains(b.txt, k.norm)), k.source) AS source FROM ({_NSK}) k"""


@query("reroute_skills", f"SELECT doc_id, source, skill FROM ({_ROUTED})")
def _(s):
    return blocks(s).select("doc_id", F.inline_outer(ex.reroute(F.col("skills"), F.col("blocks")))).where("skill is not null")


@query("fill_occurrences", f"""SELECT doc_id, source, norm FROM (SELECT doc_id, source, norm FROM ({_NSK}) UNION SELECT k.doc_id, b.source, k.norm FROM ({_NSK}) k JOIN ({_NTXT}) b ON b.doc_id = k.doc_id WHERE {_WORD})""")
def _(s):
    df = blocks(s).select("doc_id", F.explode_outer(ex.fill_occurrences(F.col("skills"), F.col("blocks"))).alias("source", "l"))
    return df.select("doc_id", "source", F.explode_outer(F.array_distinct(F.transform("l", normalize_ws))).alias("norm")).where("norm is not null")


@query("clean_skill_list", """WITH l AS (SELECT resume_id, lower(trim(raw_skill)) AS n FROM v_raw_skills GROUP BY 1, 2)
SELECT resume_id, CASE WHEN count(*) > 4 THEN 'too many skills' END AS reason, CAST(count(*) AS INT) AS n FROM l GROUP BY 1""")
def _(s):
    # one row per spelling first, so the list of a resume is bounded by its distinct spellings
    rows = s.raw_skills.groupBy("resume_id", "raw_skill").agg(F.min("pos").alias("pos"), F.min("part_id").alias("part_id"))
    lists = rows.groupBy("resume_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "part_id", "raw_skill"))), lambda x: x["raw_skill"]).alias("l"))
    got = ex.clean_skill_list(F.col("l"), max_items=4)
    return lists.select("resume_id", got["reason"].alias("reason"), F.size(got["skills"]).alias("n"))


# ---- small functions --------------------------------------------------------------

@query("file_stem", "SELECT resume_id, 'cv_' || CAST(resume_id AS STRING) AS stem FROM v_resumes")
def _(s):
    return s.resumes.select("resume_id", t.file_stem(F.col("original_filename")).alias("stem"))


_EVN = r"regexp_replace(translate(line, '’‘“”–—', chr(39) || chr(39) || repeat(chr(34), 2) || '--'), '^\s*(?:\(cid:\d+\)|[-*•●>]|\d{1,2}[.)]\s)\s*', '')"


@query("eval_normalize", f"SELECT doc_id, line_no, md5(trim(regexp_replace(lower({_squeeze(_EVN)}), ':+$', ''))) AS hash FROM v_job_lines")
def _(s):
    return s.job_lines.select("doc_id", "line_no", F.md5(t.eval_normalize(F.col("line"))).alias("hash"))


@query("format_label", "SELECT DISTINCT upper(substr(status, 1, 1)) || replace(substr(status, 2), '_', ' ') AS label FROM v_applications")
def _(s):
    return s.applications.select(t.format_label(F.col("status")).alias("label")).distinct()


@query("safe_file_name", """SELECT resume_id, regexp_replace(original_filename, '[^A-Za-z0-9._-]', '_', 'g') AS safe_name,
 CASE WHEN resume_id % 2 = 0 THEN '.png' WHEN resume_id % 4 = 1 THEN '' ELSE '.pdf' END AS ext FROM v_resumes""")
def _(s):
    ct = F.when(F.col("resume_id") % 2 == 0, "image/png").otherwise("text/plain")
    return s.resumes.select("resume_id", t.safe_file_name(F.col("original_filename")).alias("safe_name"), t.safe_extension(F.col("original_filename"), ct).alias("ext"))


@query("token_hash", "SELECT session_id, sha256(token) AS hash FROM v_sessions")
def _(s):
    return s.sessions.select("session_id", F.sha2("token", 256).alias("hash"))
