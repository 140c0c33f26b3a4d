"""Exact copies, found by salted digest groups that compare full contents.

Copies are first combined inside each task (the partial aggregate, whose key
holds the whole normalised text), then per digest and salt, then the winners
of the salts per digest.  The key of each stage is the text itself beside its
digest, so equal digests of different texts never meet.  A group that holds a
third of all rows sends one row per task.

Only texts whose 64-bit hash occurs twice can have a copy; no other text is
compared.  That filter is a join with the list of such hashes: Spark broadcasts
the list while it is below the session's threshold, so texts stay where they
are; beyond, texts are dealt by hash once, and the skew join splits a hot one.
The table of groups is written before rows meet it, so that both sides of that
join are plain shuffles, of which the skew join splits a hot one as well.

Defined cases: null texts are empty; texts that differ in blanks only are
equal; ties go to the smallest id, null ids last; of repeated rows with the id
that stays one is kept; empty tables give empty results; other columns are
carried (``keep_one``) or ignored (``find_copies``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import BLANKS, column, whole, written

#: A digest group is merged in up to so many parts before its winners meet.
SALTS = 64


def normalised(text: Column) -> Column:
    """The text without blank characters."""
    for blank in BLANKS:
        text = F.replace(text, F.lit(blank), F.lit(""))
    return text


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _order(n: Column, key: Column) -> Column:
    return F.struct((-n).alias("n"), key.isNull().alias("no_id"), key.alias("id"))


def merge_copies(rows: DataFrame, digest: Callable[[Column], Column] = sha256, salts: int = SALTS) -> DataFrame:
    """One row per distinct ``norm`` of ``rows`` (norm, best, row): the ``row`` of least ``best``, and ``size``."""
    salted = rows.select("norm", "best", "row", digest(F.col("norm")).alias("digest"), F.pmod(F.spark_partition_id(), F.lit(salts)).alias("salt"))
    parts = salted.groupBy("digest", "salt", "norm").agg(
        F.min("best").alias("best"), F.min_by("row", "best").alias("row"), F.count(F.lit(1)).alias("size"))
    return parts.groupBy("digest", "norm").agg(
        F.min("best").alias("best"), F.min_by("row", "best").alias("row"), F.sum("size").alias("size"))


def find_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                digest: Callable[[Column], Column] = sha256, salts: int = SALTS) -> DataFrame:
    """Per row: id, ``keep_id`` (longest original text, then smallest id), ``group_size``, ``kept`` and ``text_sha256``.

    A content is tied to its rows by SHA-256; two contents with one SHA-256
    would stop the job with an error, not merge.
    """
    src = docs.select(column(id_col).alias("id"), whole(text_col).alias("text"))
    marked = src.select("id", F.length("text").alias("n"), normalised(F.col("text")).alias("norm")).withColumn("h", F.xxhash64("norm"))
    hashed = marked.select("id", "n", "h", sha256(F.col("norm")).alias("sha"))
    # numbered before the join: a Window after it would hold a hot group in one task
    same = Window.partitionBy("sha", "id").orderBy(F.desc("n"))
    thin = written(hashed.withColumn("turn", F.row_number().over(same)), "exact-rows")
    repeated = thin.groupBy("h").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("h")
    rows = marked.join(written(repeated, "exact-hashes"), "h", "left_semi").select(
        "norm", _order(F.col("n"), F.col("id")).alias("best"), F.lit(None).cast("int").alias("row"))
    groups = merge_copies(rows, digest, salts).select(sha256(F.col("norm")).alias("sha"), F.col("best.id").alias("keep_id"), "size")
    groups = groups.groupBy("sha").agg(F.count(F.lit(1)).alias("contents"), F.first("keep_id").alias("keep_id"), F.first("size").alias("size"))
    groups = groups.select("sha", F.when(F.col("contents") > 1, F.raise_error(F.lit("two contents with one SHA-256")).cast("bigint"))
                           .otherwise(F.col("size")).alias("size"), "keep_id")
    out = thin.join(written(groups, "exact-groups"), "sha", "left").withColumn("keep_id", F.when(F.col("size").isNull(), F.col("id")).otherwise(F.col("keep_id")))
    return out.select(
        F.col("id").alias(id_col), "keep_id", F.coalesce("size", F.lit(1)).alias("group_size"),
        (F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("turn") == 1)).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             digest: Callable[[Column], Column] = sha256, salts: int = SALTS) -> DataFrame:
    """The rows of ``docs``, all columns, with one of each group of copies."""
    norm = normalised(whole(text_col))
    packed = docs.select(F.struct(*[column(c) for c in docs.columns]).alias("row"), norm.alias("norm"),
                         _order(F.length(whole(text_col)), column(id_col)).alias("best")).withColumn("h", F.xxhash64("norm"))
    hashes = docs.select(F.xxhash64(norm).alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("c"))
    repeated = written(hashes.where("c > 1").select("h"), "exact-hashes")
    alone = packed.join(repeated, "h", "left_anti").select("row.*")
    return alone.unionByName(merge_copies(packed.join(repeated, "h", "left_semi"), digest, salts).select("row.*"))
