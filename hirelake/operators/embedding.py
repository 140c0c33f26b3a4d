"""Vectors for skills from a pluggable embedder."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Embedder = Callable[[list[str]], list[list[float]]]


def skills_to_embed(jd: DataFrame, index: DataFrame) -> DataFrame:
    """Distinct skills of both sides, ``jd(jd_skill)`` and ``index(skill)``.

    A text is embedded once however often it is listed, so each side is made
    distinct first; no application is read.
    """
    return jd.select(F.col("jd_skill").alias("skill")).distinct().union(index.select("skill").distinct()).distinct()


def embed_distinct(skills: DataFrame, embed: Embedder) -> DataFrame:
    """(skill, embedding): each distinct text is embedded once, one call per Arrow batch.

    Write the result as a table to reuse it; it takes the place of a cache.
    """

    def run(batches):
        for pdf in batches:
            texts = pdf["skill"].tolist()
            yield pd.DataFrame({"skill": texts, "embedding": [[float(x) for x in v] for v in embed(texts)]})

    return skills.select("skill").where("skill is not null").distinct().mapInPandas(run, "skill string, embedding array<float>")
