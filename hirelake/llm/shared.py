"""Small helpers of the operators in this package."""

from __future__ import annotations

import sys
import types

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.skew import written
from ..session import shared_dir
from ..sources.entities import read_entity

__all__ = ["UPPER", "LOWER", "WORD", "BLANKS", "ascii_lower", "column", "fold", "read_entity", "remainder", "shared_dir",
           "total", "whole", "worker_cache", "written"]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A word is a run without these six blank characters.
BLANKS = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
#: bytes.translate table that lower-cases A-Z and nothing else.
fold = bytes.maketrans(UPPER.encode(), LOWER.encode())


def column(name: str) -> Column:
    """The column of exactly this name, dots and blanks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def whole(text: Column | str) -> Column:
    """The text, null as empty."""
    return F.coalesce(text if isinstance(text, Column) else column(text), F.lit(""))


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def remainder(c: Column, n: int) -> Column:
    """crc32 of the value as text, modulo ``n``; a null counts as empty text."""
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % n


def total(df: DataFrame, *cols: Column) -> tuple:
    """A few scalars aggregated over the whole frame."""
    return tuple(df.agg(*cols).first())


def worker_cache() -> dict:
    """A dictionary that lives as long as the Python worker; functions travel by value and would lose their own globals."""
    return sys.modules.setdefault("_hirelake_worker_cache", types.ModuleType("_hirelake_worker_cache")).__dict__
