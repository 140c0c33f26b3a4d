"""Licence scans by canonical digest: whole texts joined to the digests of known licences. DataFrame functions only.

A text is brought to a canonical form: lower case, lines that state a copyright
or reserve all rights dropped, equivalent spellings made one (those that licence
matching guidelines list), comment marks and punctuation dropped, blanks
collapsed.  Its SHA-256 is joined to the digests of the known texts.

``scan_texts`` looks up whole texts.  ``scan_documents`` looks up each document
as a whole, and each of its lines as a text of its own, so a licence notice
inside a document is found.  A line is brought to its form only if its first
letters begin a known text, which equal forms share; only lines with a digest
of a known text pass the join, and they are collected per document, at most
once per licence, before the join with all documents.
The table of known texts is an argument; Spark broadcasts it while it is below
the session's threshold and shuffles digests beyond.

Defined cases: null is empty; an empty canonical form matches nothing; known
texts with one canonical form are one entry, its smallest name; repeated rows
are rows of their own; empty tables give empty results (no known text: no
match); other columns are ignored.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import column, whole

# Equivalent spellings of the public licence matching guidelines, as whole words.
EQUIVALENT = (
    ("acknowledgement", "acknowledgment"), ("analogue", "analog"), ("analyse", "analyze"), ("artefact", "artifact"), ("authorisation", "authorization"),
    ("authorised", "authorized"), ("calibre", "caliber"), ("cancelled", "canceled"), ("capitalisations", "capitalizations"), ("catalogue", "catalog"),
    ("categorise", "categorize"), ("centre", "center"), ("emphasised", "emphasized"), ("favour", "favor"), ("favourite", "favorite"), ("fulfil", "fulfill"),
    ("fulfilment", "fulfillment"), ("initialise", "initialize"), ("judgement", "judgment"), ("labelling", "labeling"), ("labour", "labor"),
    ("licence", "license"), ("maximise", "maximize"), ("modelled", "modeled"), ("modelling", "modeling"), ("offence", "offense"), ("optimise", "optimize"),
    ("organisation", "organization"), ("organise", "organize"), ("practise", "practice"), ("programme", "program"), ("realise", "realize"),
    ("recognise", "recognize"), ("signalling", "signaling"), ("sub license", "sublicense"), ("utilisation", "utilization"), ("whilst", "while"),
    ("wilful", "wilfull"), ("non commercial", "noncommercial"), ("per cent", "percent"), ("copyright owner", "copyright holder"),
)
COPYRIGHT_LINE = r"(?m)^[^\p{L}\n]*(?:copyright|\(c\)|©|all rights reserved)[^\n]*$"


def canonical(text: Column) -> Column:
    """The text's canonical form."""
    t = F.regexp_replace(F.lower(text), COPYRIGHT_LINE, " ")
    t = F.trim(F.regexp_replace(t, r"[^\p{L}\p{N}]+", " "))
    t = F.concat(F.lit(" "), t, F.lit(" "))
    for spelling, usual in EQUIVALENT:
        t = F.replace(t, F.lit(f" {spelling} "), F.lit(f" {usual} "))
    return F.trim(t)


#: Digest of the empty form.
EMPTY = hashlib.sha256(b"").hexdigest()


def digest(text: Column) -> Column:
    """SHA-256 of the canonical form; never null, so that a join need not test it first."""
    return F.coalesce(F.sha2(canonical(text), 256), F.lit(EMPTY))


def start(text: Column) -> Column:
    """First three letters of the first word: equal wherever the canonical forms are equal."""
    return F.coalesce(F.substring(F.regexp_extract(F.lower(text), r"[\p{L}\p{N}]+", 0), 1, 3), F.lit(""))


def known_digests(known: DataFrame) -> DataFrame:
    """(digest, licence, start) of known texts (licence, text)."""
    rows = known.select(column("licence").alias("licence"), canonical(whole("text")).alias("form")).where("form <> ''")
    return rows.groupBy(F.sha2("form", 256).alias("digest"), start(F.col("form")).alias("start")).agg(F.min("licence").alias("licence"))


def scan_texts(texts: DataFrame, known: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, ``digest`` and the ``licence`` whose text it is, else null."""
    rows = texts.select(column(id_col).alias(id_col), digest(whole(text_col)).alias("digest"))
    return rows.join(known_digests(known).select("digest", "licence"), "digest", "left").select(id_col, F.nullif("digest", F.lit(EMPTY)).alias("digest"), "licence")


def scan_documents(docs: DataFrame, known: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, ``digest`` and ``licence`` of the whole text, and ``notices``: the licences of its lines, each once, in order of name.

    Rows of one id share their notices.
    """
    found = known_digests(known)
    lines = docs.select(column(id_col).alias(id_col), F.explode(F.split(whole(text_col), "\n")).alias("line")).where("line <> ''")
    likely = lines.withColumn("start", start(F.col("line"))).join(found.select("start").distinct(), "start", "left_semi")
    hits = likely.select(id_col, digest(F.col("line")).alias("digest")).join(found, "digest")
    notices = hits.groupBy(id_col).agg(F.array_sort(F.collect_set("licence")).alias("notices"))
    whole_texts = scan_texts(docs, known, id_col, text_col)
    both = whole_texts.withColumnRenamed(id_col, "_id").join(notices, F.col("_id").eqNullSafe(F.col(id_col)), "left")
    return both.select(F.col("_id").alias(id_col), "digest", "licence", F.coalesce("notices", F.array().cast("array<string>")).alias("notices"))
