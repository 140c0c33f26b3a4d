"""Extraction quality against gold data, and constraint checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import eval_normalize


def _close(a: Column, b: Column) -> Column:
    return F.contains(a, b) | F.contains(b, a)


def fuzzy_sets(pred: DataFrame, gold: DataFrame) -> DataFrame:
    """Per file: ``want``, ``missing`` and ``extra`` lists under space-padded containment either way.

    Both sides are distinct sets in one row per file, compared inside the row.
    """
    pad = F.concat(F.lit(" "), F.replace("skill", F.lit("/"), F.lit(" ")), F.lit(" "))
    norm = lambda df: df.select("file", F.lower(F.trim(F.regexp_replace("skill", r"\s+", " "))).alias("skill")).withColumn("skill", pad)
    g = norm(gold).groupBy("file").agg(F.collect_set("skill").alias("want"))
    p = norm(pred).groupBy("file").agg(F.collect_set("skill").alias("got"))
    lone = lambda xs, ys: F.filter(xs, lambda x: ~F.exists(ys, lambda y: _close(x, y)))
    return g.join(p, "file").select(
        "file", F.size("want").alias("n_want"), F.size("got").alias("n_got"),
        lone("want", "got").alias("missing"), lone("got", "want").alias("extra"))


def eval_prf(pred: DataFrame, gold: DataFrame) -> DataFrame:
    """One row: micro precision, recall, F1, exact files and checked files."""
    per = fuzzy_sets(pred, gold)
    t = per.agg(
        F.coalesce(F.sum(F.col("n_want") - F.size("missing")), F.lit(0)).alias("tp"), F.coalesce(F.sum(F.size("extra")), F.lit(0)).alias("fp"),
        F.coalesce(F.sum(F.size("missing")), F.lit(0)).alias("fn"), F.count(F.lit(1)).alias("checked"),
        F.count_if((F.size("missing") == 0) & (F.size("extra") == 0)).alias("exact"))
    safe = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    return (
        t.withColumn("precision", safe(F.col("tp"), F.col("tp") + F.col("fp")))
        .withColumn("recall", safe(F.col("tp"), F.col("tp") + F.col("fn")))
        .withColumn("f1", safe(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    )


def eval_sections(pred: DataFrame, gold: DataFrame) -> DataFrame:
    """Counts of files where found, heading and last line agree with gold; a file without prediction fails all."""
    j = gold.join(pred, "file", "left")
    last = F.element_at(F.concat(F.array(F.lit("")), F.filter(F.transform(F.split("section_text", "\n"), lambda x: F.trim(x)), lambda x: x != "")), -1)
    got, want = F.coalesce("found", F.lit(False)), F.col("gold_heading").isNotNull()
    present = F.col("found").isNotNull()
    same = lambda a, b: eval_normalize(a) == eval_normalize(b)
    head = F.when(want, got & same(F.col("heading"), F.col("gold_heading"))).otherwise(~got & (F.coalesce("heading", F.lit("")) == ""))
    bound = F.when(F.col("gold_last_line").isNull(), ~got & (F.coalesce(last, F.lit("")) == "")).otherwise(got & same(last, F.col("gold_last_line")))
    return j.agg(F.count(F.lit(1)).alias("n"), F.count_if(present & (got == want)).alias("found_ok"),
                 F.count_if(present & head).alias("heading_ok"), F.count_if(present & bound).alias("boundary_ok"))


def token_rollup(calls: DataFrame) -> DataFrame:
    """Token totals per file and overall (``file`` null)."""
    z = lambda c: F.sum(F.coalesce(c, F.lit(0))).alias(c)
    return calls.rollup("file").agg(z("prompt_tokens"), z("completion_tokens"))


def constraint_violations(apps: DataFrame, users: DataFrame) -> DataFrame:
    """(rule, key, n) of every broken rule."""
    def twice(df: DataFrame, rule: str, keys: list[str]) -> DataFrame:
        return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(
            F.lit(rule).alias("rule"), F.concat_ws("/", *keys).alias("key"), "n")

    supers = users.where("role = 'superuser'").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(
        F.lit("one superuser").alias("rule"), F.lit("superuser").alias("key"), "n")
    bounds = apps.where("manual_score < 0 OR manual_score > 100").select(
        F.lit("manual score range").alias("rule"), F.col("application_id").cast("string").alias("key"), F.lit(1).cast("bigint").alias("n"))
    return (
        twice(apps.where("user_id is not null"), "user applies once", ["user_id", "job_id"])
        .unionByName(twice(apps.where("user_id is null and resume_id is not null"), "document applies once", ["job_id", "resume_id"]))
        .unionByName(supers).unionByName(bounds)
    )
