"""Skill tagging and the checks after it.

Skills and text blocks of a document are maps in one row (source -> list,
source -> text), so every check below is a column function without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.skills import normalize_ws
from ..functions.text import let
from .skew import written

# The source keys in their order.
SOURCE_KEYS = ("skills_section", "work_experience", "projects")


def tag_skills(docs: DataFrame, key: list[str], text: str, lexicon: DataFrame) -> DataFrame:
    """(key, skill, pos): lexicon terms found in the text as word runs, at their first place.

    A word of the text goes on only where a term begins with it, and then only
    runs of the lengths of such terms are made and matched by equality.  While
    Spark broadcasts the first words and the terms, only matches are shuffled.
    ``lexicon(alias, canonical)`` is written once, so Spark goes by its own size
    and not by that of the tables it comes from.
    """
    lexicon = written(lexicon.select("alias", "canonical"), "lexicon")
    # possessive: a plain repeated group takes stack for each part of a dotted word
    tokens = F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}+#]++(?:[.-][\p{L}\p{N}+#]++)*+)"), F.lit(1))
    words = F.split("alias", " ")
    longest = lexicon.agg(F.coalesce(F.max(F.size(words)), F.lit(1))).scalar()
    firsts = lexicon.groupBy(F.get(words, F.lit(0)).alias("_first")).agg(F.collect_set(F.size(words)).alias("_sizes"))
    windows = let(tokens, lambda tok: F.transform(tok, lambda _, i: F.slice(tok, i + 1, F.col("_longest"))))
    rows = docs.withColumn("_longest", longest).select(*key, "_longest", F.posexplode_outer(windows).alias("_at", "_window"))
    runs = rows.join(firsts, F.get("_window", F.lit(0)) == F.col("_first")).select(
        *key, "_at", "_longest", "_window", F.explode(F.filter("_sizes", lambda n: n <= F.size("_window"))).alias("_n"))
    runs = runs.select(*key, F.array_join(F.slice("_window", F.lit(1), F.col("_n")), " ").alias("alias"),
                       (F.col("_at").cast("bigint") * (F.col("_longest") + 1) + F.col("_n")).alias("pos"))
    return (
        runs.join(lexicon, "alias")
        .groupBy(*key, F.col("canonical").alias("skill")).agg(F.min("pos").alias("pos"))
    )


def block_text(text: Column) -> Column:
    return normalize_ws(F.coalesce(text, F.lit("")))


def ground(skills: Column, text: Column) -> Column:
    """struct<kept, dropped>: first sightings found as plain substring of the text, and those that are not."""

    def marks(seen: Column) -> Column:
        norms = F.transform(seen, normalize_ws)
        return let(F.struct(norms.alias("n"), block_text(text).alias("t")), lambda v: F.transform(seen, lambda s, i: F.struct(
            s.alias("s"), (F.array_position(v["n"], F.get(v["n"], i)) == i + 1).alias("first"),
            F.contains(v["t"], F.get(v["n"], i)).alias("held"))))

    return let(let(skills, marks), lambda m: F.struct(
        F.transform(F.filter(m, lambda x: x["first"] & x["held"]), lambda x: x["s"]).alias("kept"),
        F.transform(F.filter(m, lambda x: ~x["held"]), lambda x: x["s"]).alias("dropped")))


#: Characters of a word; one skill stands in a text where no such character touches it.
ATOM = "[a-z0-9+#]+"


def skill_parts(norms: Column) -> Column:
    """Normalised skills as structs: ``n``, its ``core`` from the first to the last atom, what stands before (``lead``) and after (``tail``), ``size`` in atoms, ``first`` atom."""

    def parts(n: Column) -> Column:
        atom = n.rlike(f"^{ATOM}$")
        lead, tail = F.regexp_extract(n, "^[^a-z0-9+#]*", 0), F.regexp_extract(n, "[^a-z0-9+#]*$", 0)
        core = F.substring(n, F.length(lead) + 1, F.greatest(F.lit(0), F.length(n) - F.length(lead) - F.length(tail)))
        atoms = F.regexp_extract_all(n, F.lit(f"({ATOM})"), F.lit(1))
        return F.struct(n.alias("n"), F.when(atom, n).otherwise(core).alias("core"), F.when(atom, "").otherwise(lead).alias("lead"), F.when(atom, "").otherwise(tail).alias("tail"),
                        F.when(atom, 1).otherwise(F.size(atoms)).alias("size"), F.when(atom, n).otherwise(F.coalesce(F.get(atoms, F.lit(0)), F.lit(""))).alias("first"))

    return F.transform(norms, parts)


def held_words(text_norm: Column, skills: Column) -> Column:
    """For each of the skills (:func:`skill_parts`) whether the text holds it as a whole word; keeps ``c++``, ``c#`` and ``node.js`` apart.

    The text is cut once into atoms and the gaps between them.  Skills of one
    atom are found among the atoms; for others runs of atoms, gaps included, are
    made where some skill's first atom stands and in the lengths that skills
    have, and compared by equality.  What a skill has before or after its atoms
    is compared with the gaps around the run, less the character that touches
    the next atom.
    """
    empty = F.array().cast("array<struct<raw:string,i:int,j:int>>")

    def runs_of(v: Column) -> Column:
        n = F.size(v["atoms"])
        asked = F.filter(v["skills"], lambda s: (s["size"] > 1) | ((s["size"] == 1) & ((s["lead"] != "") | (s["tail"] != ""))))
        wanted = F.struct(F.array_distinct(F.transform(asked, lambda s: s["size"])).alias("sizes"),
                          F.array_intersect(F.transform(asked, lambda s: s["first"]), v["atoms"]).alias("firsts"))

        def raw(i: Column, k: Column) -> Column:
            inner = F.zip_with(F.slice(v["atoms"], i + 1, k - 1), F.slice(v["gaps"], i + 2, k - 1), lambda a, g: F.concat(a, g))
            return F.concat(F.array_join(inner, ""), F.get(v["atoms"], i + k - 1))

        def made(w: Column) -> Column:
            starts = F.filter(F.transform(v["atoms"], lambda a, i: F.when(F.array_contains(w["firsts"], a), i)), lambda i: i.isNotNull())
            runs = F.flatten(F.transform(starts, lambda i: F.transform(F.filter(w["sizes"], lambda k: i + k <= n), lambda k: F.struct(
                raw(i, k).alias("raw"), i.alias("i"), (i + k).alias("j")))))
            return F.when(F.size(w["firsts"]) > 0, runs).otherwise(empty)

        return let(wanted, made)

    def judged(v: Column, runs: Column) -> Column:
        last = F.size(v["atoms"])
        cores = F.transform(v["skills"], lambda s: s["core"])
        plain = F.concat(F.array_intersect(cores, v["atoms"]), F.array_intersect(cores, F.transform(runs, lambda r: r["raw"])))

        def before(i: Column) -> Column:
            return let(F.get(v["gaps"], i), lambda gap: F.when(i > 0, F.substring(gap, 2, F.length(gap))).otherwise(gap))

        def after(j: Column, gap: Column) -> Column:
            return F.when(j < last, F.left(gap, F.greatest(F.lit(0), F.length(gap) - 1))).otherwise(gap)

        def one(found: Column, s: Column) -> Column:
            around = F.exists(runs, lambda r: (r["raw"] == s["core"]) & F.endswith(before(r["i"]), s["lead"]) & F.startswith(after(r["j"], F.get(v["gaps"], r["j"])), s["tail"]))
            between = F.exists(F.sequence(F.lit(0), last), lambda i: F.contains(after(i, before(i)), s["n"]))
            return F.when(s["n"] == "", False).when(s["size"] == 0, between).when(~F.array_contains(found, s["core"]), False).when(
                (s["lead"] == "") & (s["tail"] == ""), True).otherwise(around)

        return let(plain, lambda found: F.transform(v["skills"], lambda s: one(found, s)))

    index = F.struct(F.regexp_extract_all(text_norm, F.lit(f"({ATOM})"), F.lit(1)).alias("atoms"), F.split(text_norm, ATOM).alias("gaps"), skills.alias("skills"))
    return let(index, lambda v: let(runs_of(v), lambda runs: judged(v, runs)))


def contains_word(text_norm: Column, skill_norm: Column) -> Column:
    """Whole-word containment of one skill; see :func:`held_words` for a list."""
    return F.get(held_words(text_norm, skill_parts(F.array(skill_norm))), F.lit(0))


def reroute(skills: Column, blocks: Column, keys: tuple[str, ...] = SOURCE_KEYS) -> Column:
    """array<struct<source, skill>>: a skill missing from its own block moves to the first other block that holds it."""
    empty = F.array().cast("array<string>")

    def route(k: str, s: Column, norm: Column) -> Column:
        def target(n: Column) -> Column:
            t = F.when(F.contains(norm[k], n), k)
            for other in keys:
                if other != k:
                    t = t.when(F.contains(norm[other], n), other)
            return t.otherwise(k)

        return F.struct(let(normalize_ws(s), target).alias("source"), s.alias("skill"))

    def every(norm: Column) -> Column:
        per_key = lambda k: F.transform(F.coalesce(F.try_element_at(skills, F.lit(k)), empty), lambda s: route(k, s, norm))
        return F.concat(*[per_key(k) for k in keys])

    return let(F.struct(*[block_text(F.try_element_at(blocks, F.lit(k))).alias(k) for k in keys]), every)


def by_source(pairs: Column, keys: tuple[str, ...] = SOURCE_KEYS) -> Column:
    """array<struct<source, skill>> -> map<source, skills>."""
    of = lambda k: F.transform(F.filter(pairs, lambda p: p["source"] == k), lambda p: p["skill"])
    return F.map_from_arrays(F.array(*[F.lit(k) for k in keys]), F.array(*[of(k) for k in keys]))


def fill_occurrences(skills: Column, blocks: Column, keys: tuple[str, ...] = SOURCE_KEYS) -> Column:
    """map<source, skills>: add to every source the listed skills its text holds as whole words."""
    get = lambda k: F.coalesce(F.try_element_at(skills, F.lit(k)), F.array().cast("array<string>"))

    def full(k: str, v: Column) -> Column:
        known = F.struct(F.transform(get(k), normalize_ws).alias("have"), held_words(block_text(F.try_element_at(blocks, F.lit(k))), v["parts"]).alias("held"))
        extra = let(known, lambda w: F.filter(v["all"], lambda s, i: F.get(w["held"], i) & ~F.array_contains(w["have"], F.get(v["parts"], i)["n"])))
        return F.concat(get(k), extra)

    listed = let(merge(skills, keys), lambda a: F.struct(a.alias("all"), skill_parts(F.transform(a, normalize_ws)).alias("parts")))
    return let(listed, lambda v: F.map_from_arrays(F.array(*[F.lit(k) for k in keys]), F.array(*[full(k, v) for k in keys])))


def merge(skills: Column, keys: tuple[str, ...] = SOURCE_KEYS) -> Column:
    """One flat list: source order, first spelling wins."""
    empty = F.array().cast("array<string>")
    flat = F.concat(*[F.coalesce(F.try_element_at(skills, F.lit(k)), empty) for k in keys])

    def firsts(v: Column) -> Column:
        marked = F.transform(v["flat"], lambda s, i: F.struct((F.array_position(v["n"], F.get(v["n"], i)) == i + 1).alias("first"), s.alias("s")))
        return F.transform(F.filter(marked, lambda x: x["first"]), lambda x: x["s"])

    return let(F.struct(flat.alias("flat"), F.transform(flat, normalize_ws).alias("n")), firsts)


def clean_skill_list(skills: Column, max_len: int = 100, max_items: int = 100) -> Column:
    """struct<skills, reason>: collapse blanks, drop blank ones, fold case duplicates; reason tells why a list is refused."""
    flat = F.filter(F.transform(skills, lambda s: F.trim(F.regexp_replace(s, r"\s+", " "))), lambda s: s != "")
    kept = merge(F.create_map(F.lit("skills_section"), flat))
    reason = (F.when(F.exists(flat, lambda s: F.length(s) > max_len), "skill too long")
              .when(F.size(kept) == 0, "no skills").when(F.size(kept) > max_items, "too many skills"))
    return F.struct(kept.alias("skills"), reason.alias("reason"))
