"""The registered queries of this package and their checking SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, dialogue, exact_dedup, fingerprints, licence_texts, licences, mixing, near_dups, ngram_lm, pii, toxicity, url_reputation, variants, warc
from .shared import LOWER, UPPER, read_entity, remainder, whole

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_WORDS = r"length(regexp_replace(regexp_replace(coalesce(text, ''), '[^\x20\x09-\x0D]+', 'w', 'g'), '[\x20\x09-\x0D]+', '', 'g'))"


def register(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return keep


@register("op1_mix_sources")
def _(spark, sf_dir):
    plan = mixing.plan_mix(read_entity(spark, sf_dir, "documents"))
    return plan.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


#: Rules of the query: block net/, allow example.net/en/, block example.com/de/, allow org/fr/.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))


def _reputation_sql() -> str:
    """The three levels and their priors once more, for DuckDB."""
    u = url_reputation
    host = f"translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), '{UPPER}', '{LOWER}')"
    ruled = [(f"(host = '{r.split('/')[0]}' OR host LIKE '%.{r.split('/')[0]}') AND starts_with(path, '/{r.split('/', 1)[1]}')", r, v)
             for r, v in sorted(RULES, key=lambda x: -len(x[0]))]
    rule, verdict = ("CASE " + " ".join(f"WHEN {fits} THEN '{out[k]}'" for fits, *out in ruled) for k in (0, 1))
    two = f"regexp_extract(host, '[^.]*([.][^.]*)?$') IN ({', '.join(repr(x) for x in u.SUFFIXES)})"
    low, high = u.STRENGTH

    def strength(level: str) -> str:
        return f"""(SELECT coalesce(CASE WHEN b <= 0 THEN {high} ELSE greatest({low}, least({high}, spread / b - 1)) END, {high}) FROM
 (SELECT (sum(n * (bad / n - up) ** 2) - sum(up * (1 - up))) / greatest(sum(n) - sum(n * n) / sum(n), 1e-9) AS b, avg(up * (1 - up)) AS spread FROM {level} WHERE n > 0))"""

    rate = "(bad + m * up) / (n + m)"
    return f"""WITH p AS (SELECT page_id, {host} AS host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path,
  TRY_CAST(regexp_extract(url, '://[^/?#]*/[a-z]{{2}}/([0-9]{{1,18}})', 1) AS BIGINT) AS doc_id FROM pages),
o AS (SELECT host, NULL AS bad FROM p UNION ALL SELECT host, quality = 0 OR toxic = 1 FROM p JOIN labels USING (doc_id)),
h AS (SELECT host, count(bad)::DOUBLE AS n, (count(*) FILTER (bad))::DOUBLE AS bad, regexp_extract(host, CASE WHEN {two} THEN '[^.]*([.][^.]*)?$' ELSE '[^.]*$' END) AS suffix,
  regexp_extract(host, CASE WHEN {two} THEN '[^.]*([.][^.]*){{0,2}}$' ELSE '[^.]*([.][^.]*)?$' END) AS domain FROM o GROUP BY host),
s0 AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad, (SELECT (sum(bad) + 1) / (sum(n) + 2) FROM h) AS up FROM h GROUP BY 1),
s1 AS (SELECT suffix, {rate} AS rate FROM (SELECT *, {strength('s0')} AS m FROM s0)),
d0 AS (SELECT domain, d.n, d.bad, s1.rate AS up FROM (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM h GROUP BY 1, 2) d JOIN s1 USING (suffix)),
d1 AS (SELECT domain, {rate} AS rate FROM (SELECT *, {strength('d0')} AS m FROM d0)),
h0 AS (SELECT host, n, bad, d1.rate AS up FROM h JOIN d1 USING (domain)),
h1 AS (SELECT host, bad + m * up AS a, n - bad + m * (1 - up) AS b FROM (SELECT *, {strength('h0')} AS m FROM h0))
SELECT page_id, host, path, {rule} END AS rule, {verdict} WHEN a / (a + b) - {u.Z} * sqrt(a * b / ((a + b) ** 2 * (a + b + 1))) > {u.BLOCK_ABOVE} THEN 'block' ELSE 'allow' END AS verdict
FROM p LEFT JOIN h1 USING (host)"""


@register("op2_url_reputation", _reputation_sql())
def _(spark, sf_dir):
    """A page is made from the document whose id is the number in its path; a label of that document is the page's outcome."""
    pages = read_entity(spark, sf_dir, "pages")
    number = F.regexp_extract(F.coalesce("url", F.lit("")), r"://[^/?#]*/[a-z]{2}/([0-9]{1,18})", 1)
    numbered = pages.select(url_reputation.host_of(F.col("url")).alias("host"), F.when(number != "", number.cast("bigint")).alias("doc_id"))
    labels = read_entity(spark, sf_dir, "labels").select("doc_id", ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    outcomes = numbered.where("doc_id IS NOT NULL").join(labels, "doc_id").select("host", "bad")
    return url_reputation.judge(pages, outcomes, RULES).select("page_id", "host", "path", "rule", "verdict")


@register("op6_exact_dedup", r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS t FROM documents),
g AS (SELECT t, first(doc_id ORDER BY n DESC, doc_id NULLS LAST) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.t) AS text_sha256 FROM d JOIN g ON d.t = g.t""")
def _(spark, sf_dir):
    return exact_dedup.find_copies(read_entity(spark, sf_dir, "documents"))


@register("op10_simhash_near_dups")
def _(spark, sf_dir):
    return near_dups.find_groups(read_entity(spark, sf_dir, "documents"))


VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@register("op8_byte_bpe")
def _(spark, sf_dir):
    docs = read_entity(spark, sf_dir, "documents")
    return docs.select("doc_id", byte_bpe.round_trip(whole("text"), byte_bpe.read_ranks(VOCABULARY)).alias("r")).select("doc_id", "r.*")


@register("op9_warc", """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, octet_length(encode(h)) AS payload_bytes, sha1(h) AS payload_digest, h FROM p),
m AS (SELECT h, max(page_id) AS top FROM d WHERE payload_bytes >= 1000 GROUP BY h)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN top <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
 CASE WHEN top <> page_id THEN top END AS refers_to FROM d LEFT JOIN m ON d.h = m.h AND d.payload_bytes >= 1000""")
def _(spark, sf_dir):
    files, folder = warc.store_pages(read_entity(spark, sf_dir, "pages"))
    back = warc.read_stored(files, folder)
    return back.select(warc.id_of(F.col("id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type", warc.id_of(F.col("refers_to")).alias("refers_to"))


@register("op4_simhash_fingerprints")
def _(spark, sf_dir):
    return fingerprints.edit_and_compare(read_entity(spark, sf_dir, "documents"))


def learnable(spark, sf_dir):
    """Labels of the rows that may be learnt from: crc32 of the id modulo 4 is not 2."""
    return read_entity(spark, sf_dir, "labels").where(remainder(F.col("doc_id"), 4) != 2).select("doc_id", "toxic")


@register("op5_toxicity")
def _(spark, sf_dir):
    docs = read_entity(spark, sf_dir, "documents")
    model = toxicity.train(docs, learnable(spark, sf_dir))
    scored = docs.select("doc_id", (remainder(F.col("doc_id"), 4) == 2).alias("held_out"), toxicity.score(whole("text"), model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= toxicity.THRESHOLD).cast("int"))


def _licence_sql() -> str:
    """The canonical form once more, for DuckDB."""
    def canonical(text: str) -> str:
        t = f"trim(regexp_replace(regexp_replace(lower({text}), '{licences.COPYRIGHT_LINE}', ' ', 'g'), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"
        t = f"(' ' || {t} || ' ')"
        for spelling, usual in licences.EQUIVALENT:
            t = f"replace({t}, ' {spelling} ', ' {usual} ')"
        return f"trim({t})"

    known = ", ".join("('{}', '{}')".format(*(x.replace("'", "''") for x in row)) for row in licence_texts.KNOWN)
    return f"""WITH k AS (SELECT sha256(c) AS digest, min(licence) AS licence FROM (SELECT licence, {canonical('text')} AS c FROM (VALUES {known}) v(licence, text)) GROUP BY 1),
w AS (SELECT doc_id, {canonical("coalesce(text, '')")} AS c FROM documents),
l AS (SELECT doc_id, {canonical('line')} AS c FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents)),
n AS (SELECT doc_id, string_agg(DISTINCT licence, '|' ORDER BY licence) AS notices FROM l JOIN k ON sha256(l.c) = k.digest WHERE l.c <> '' GROUP BY 1)
SELECT w.doc_id, CASE WHEN w.c <> '' THEN sha256(w.c) END AS digest, CASE WHEN w.c <> '' THEN k.licence END AS licence, coalesce(n.notices, '') AS notices
FROM w LEFT JOIN k ON sha256(w.c) = k.digest LEFT JOIN n ON n.doc_id = w.doc_id"""


@register("op7_licence_scan", _licence_sql())
def _(spark, sf_dir):
    found = licences.scan_documents(read_entity(spark, sf_dir, "documents"), licence_texts.known_texts(spark))
    return found.withColumn("notices", F.array_join("notices", "|"))


@register("op3_ngram_lm")
def _(spark, sf_dir):
    docs = read_entity(spark, sf_dir, "documents")
    model = ngram_lm.train(docs.where(~ngram_lm.is_held_out(docs)))
    out = ngram_lm.score(docs, model)
    return out.select("doc_id", ngram_lm.is_held_out(out).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")


#: crc32 of a string as DuckDB expressions: its bytes, and a table of 256 entries made by the rule.
_CRC_TABLE = "list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END))"


def _crc32_sql(text: str, table: str) -> str:
    raw = f"list_transform(range(1, octet_length(encode({text})) + 1), lambda i: ('0x' || substr(hex(encode({text})), 2 * i - 1, 2))::BIGINT)"
    return f"xor(4294967295, list_reduce(list_prepend(4294967295, {raw}), lambda c, b: xor(c >> 8, {table}[(xor(c, b) & 255) + 1])))"


def _dialogue_sql() -> str:
    """Forward search over four states (nothing, system, user, assistant last) that keeps the cheapest, least audit and its text of each."""
    def step(frm: str, letter: str, cost: str, line: str = "''") -> str:
        return f"{{'c': {frm}.c + {cost}, 'a': {frm}.a || '{letter}', 't': {frm}.t || {line}}}"

    def kept(frm: str, role: str) -> str:
        own = step(frm, "K", "late", "chr(10) || role || ':' || text") if role == "system" else f"CASE WHEN ini = '{role[0]}' THEN {step(frm, 'K', 'late', 'chr(10) || role || chr(58) || text')} END"
        return own if role == "system" else f"{own}, {step(frm, 'R', '3 + late', f'chr(10) || {chr(39)}{role}:{chr(39)} || text')}"

    filled = f"""list_min([x.u, {step('x.n', 'I', '3', "chr(10) || 'user:'")}, {step('x.s', 'I', '3', "chr(10) || 'user:'")}, {step('x.v', 'I', '3', "chr(10) || 'user:'")}])"""
    both = f"""list_min([x.v, {step('y', 'I', '3', "chr(10) || 'assistant:'")}])"""

    def keeps(options: str) -> str:
        return f"CASE WHEN NOT must_go THEN list_min(list_filter([{options}], lambda o: o IS NOT NULL)) END"

    def least(stay: str, kept_options: str) -> str:
        return f"list_min(list_filter([{step(stay, 'D', '4')}, {keeps(kept_options)}], lambda o: o IS NOT NULL))"

    never = "{'c': 1000000000::BIGINT, 'a': '', 't': ''}"
    return f"""WITH RECURSIVE k AS (SELECT {_CRC_TABLE} AS tab),
d AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
h AS (SELECT d.*, {_crc32_sql('key', 'k.tab')} % 20 AS fault FROM d, k),
r AS (SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
  CASE WHEN fault = 1 THEN '' WHEN fault = 2 THEN translate(text, '.!?', '') ELSE text END AS text FROM h, range(CASE WHEN fault = 3 THEN 2 ELSE 1 END) WHERE fault <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i,
  left(role, 1) AS ini, regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS fin FROM r),
f AS (SELECT *, CASE WHEN fin = '' THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd' WHEN fin NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault,
  ini || lead(ini) OVER (PARTITION BY conv_id ORDER BY i) AS pair FROM o),
g AS (SELECT conv_id, i, role, text, ini, fault IN ('b', 'd') AS must_go, CASE WHEN fault = 't' THEN 3 ELSE 0 END AS late FROM f),
v AS (SELECT DISTINCT conv_id, 0::BIGINT AS i, {{'n': {{'c': 0::BIGINT, 'a': '', 't': ''}}, 's': {never}, 'u': {never}, 'v': {never}}} AS x FROM f
 UNION ALL
 SELECT conv_id, i, {{'n': {step('x.n', 'D', '4')}, 's': list_min(list_filter([{step('x.s', 'D', '4')}, CASE WHEN ini = 's' AND NOT must_go THEN {kept('x.n', 'system')} END], lambda o: o IS NOT NULL)),
  'u': {least('y', ', '.join(kept(q, 'user') for q in ('x.n', 'x.s', 'z')))}, 'v': {least('z', kept('y', 'assistant'))}}}
 FROM (SELECT *, {both} AS z FROM (SELECT v.conv_id, g.i, role, text, ini, must_go, late, x, {filled} AS y FROM v JOIN g ON v.conv_id IS NOT DISTINCT FROM g.conv_id AND g.i = v.i + 1))),
e AS (SELECT conv_id, list_min([x.n, {both}]) AS best FROM (SELECT conv_id, x, {filled} AS y FROM v
  WHERE i = (SELECT max(i) FROM f WHERE f.conv_id IS NOT DISTINCT FROM v.conv_id))),
s AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
  count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
 coalesce(best.c, 0) AS cost, coalesce(best.a, '') AS audit, sha256(coalesce(substr(best.t, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN s ON c.conv_id IS NOT DISTINCT FROM s.conv_id LEFT JOIN e ON c.conv_id IS NOT DISTINCT FROM e.conv_id"""


@register("op11_conversation_repair", _dialogue_sql())
def _(spark, sf_dir):
    """Conversations with planted faults, repaired."""
    rows = read_entity(spark, sf_dir, "conversations")
    return dialogue.repair_report(dialogue.damage_rows(rows), rows)


def _variants_sql() -> str:
    """Words one edit apart by their deletions: one is the other without a character, or both lose one at the same place."""
    v = variants
    runs = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{v.RUN}')"
    return f"""WITH RECURSIVE k AS (SELECT {_CRC_TABLE} AS tab),
t AS (SELECT doc_id, run, count(*) AS c FROM (SELECT doc_id, unnest({runs}) AS run FROM documents) WHERE length(run) >= {v.LEAST_LENGTH} GROUP BY 1, 2),
h AS (SELECT run, c, {_crc32_sql("(coalesce(doc_id::VARCHAR, '') || ':' || run)", 'k.tab')} AS h FROM t, k),
w AS (SELECT word, sum(c)::BIGINT AS n FROM (SELECT CASE WHEN h % 199 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, c FROM h)
 WHERE length(word) >= {v.LEAST_LENGTH} GROUP BY 1 HAVING sum(c) >= {v.LEAST_COUNT}),
x AS (SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS short FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w)),
e AS (SELECT a.word, b.word AS other, b.n AS other_n FROM x a JOIN x b ON a.short = b.short AND a.i = b.i AND a.word <> b.word
 UNION SELECT x.word, w.word, w.n FROM x JOIN w ON x.short = w.word UNION SELECT w.word, x.word, x.n FROM x JOIN w ON x.short = w.word),
b AS (SELECT word, count(*) AS n_near, first(other ORDER BY other_n DESC, other) AS top, max(other_n) AS top_n FROM e GROUP BY 1),
f AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN top_n >= {v.RATIO} * n THEN top END AS form, CASE WHEN top_n >= {v.RATIO} * n THEN top_n END AS form_n FROM w LEFT JOIN b USING (word)),
r AS (SELECT word, word AS root FROM f WHERE form IS NULL UNION ALL SELECT f.word, r.root FROM r JOIN f ON f.form = r.word)
SELECT word, form, root, n, n_near, form_n FROM f JOIN r USING (word)"""


@register("op13_spelling_variants", _variants_sql())
def _(spark, sf_dir):
    return variants.group_variants(variants.count_words(read_entity(spark, sf_dir, "documents")))


@register("op12_personal_data")
def _(spark, sf_dir):
    found = pii.find_spans(read_entity(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["base"])
    names = F.transform(base, lambda s: s["kind"])
    counts = [F.size(F.filter(names, lambda s: s == F.lit(k))).cast("bigint").alias(f"n_{k}") for k in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(pii.joined(base), 256).alias("base_sha256"), pii.joined(F.col("spans")).alias("spans"))
