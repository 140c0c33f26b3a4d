"""Column functions on skills and vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize_ws(c: Column) -> Column:
    """Lower case with every run of white space as one blank."""
    return F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; a zero norm gives 0, the longer array is cut to the shorter."""
    n = F.least(F.size(a), F.size(b))

    def total(arr: Column) -> Column:
        return F.aggregate(arr, F.lit(0.0), lambda s, x: s + x)

    dot = total(F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: x.cast("double") * y.cast("double")))
    norm = F.sqrt(total(F.transform(a, lambda x: x.cast("double") * x.cast("double")))) * F.sqrt(
        total(F.transform(b, lambda x: x.cast("double") * x.cast("double")))
    )
    return F.when(norm == 0, F.lit(0.0)).otherwise(dot / norm)


def credit(sim: Column, low: float, high: float) -> Column:
    """Linear ramp from ``low`` to ``high``; a step at ``high`` when the ramp has no width."""
    if high <= low:
        return F.when(sim >= high, 1.0).otherwise(0.0)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), (sim - low) / (high - low)))


def experience_score(months: Column, scale: float) -> Column:
    """Saturating 0..1 curve; unknown or non-positive experience scores 0."""
    if scale <= 0:
        return F.lit(0.0)
    return F.when(months > 0, 1 - F.exp(-months / F.lit(float(scale)))).otherwise(0.0)
