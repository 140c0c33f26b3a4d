"""Skill dictionary: normalisation and integrity checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def normalize_skill(df: DataFrame, col: str, alias: DataFrame | None, out: str = "skill") -> DataFrame:
    """Trim, lower-case and replace by the canonical name, one hop; unknown skills stay themselves.

    ``alias(alias, canonical)``.  No broadcast is forced: Spark broadcasts the
    dictionary while it is below the session threshold and shuffles beyond.
    """
    key = F.lower(F.trim(F.col(col)))
    if alias is None:
        return df.withColumn(out, key)
    table = alias.select(F.col("alias").alias("_key"), F.col("canonical").alias("_canonical"))
    return (
        df.withColumn("_key", key)
        .join(table, "_key", "left")
        .withColumn(out, F.coalesce("_canonical", "_key"))
        .drop("_key", "_canonical")
    )


def alias_integrity(alias: DataFrame) -> DataFrame:
    """Rows that break the dictionary: chains, clashes and keys that are not normalised."""
    norm = F.lower(F.trim("alias"))
    chains = (
        alias.join(alias.select(F.col("alias").alias("canonical"), F.col("canonical").alias("_next")), "canonical")
        .where(F.col("_next") != F.col("canonical"))
        .select(F.lit("chain").alias("problem"), F.col("alias").alias("alias"))
    )
    clashes = (
        alias.groupBy(norm.alias("alias"))
        .agg(F.count_distinct("canonical").alias("n"))
        .where("n > 1")
        .select(F.lit("clash").alias("problem"), "alias")
    )
    raw = alias.where(norm != F.col("alias")).select(F.lit("not_normalised").alias("problem"), "alias")
    return chains.unionByName(clashes).unionByName(raw).distinct()


def enum_drift(declared: DataFrame, actual: DataFrame, col: str) -> DataFrame:
    """Declared values that the data does not hold."""
    return declared.select(col).subtract(actual.select(col).distinct())
