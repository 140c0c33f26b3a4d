"""Document intake: decode, sniff, accept or reject with a reason."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import clean_text
from ..operators.filters import first_reason

# Extensions taken, usable characters needed, upload size cap.
ALLOWED = (".txt", ".pdf", ".docx")
MIN_CHARS = 50
MAX_BYTES = 10 * 1024 * 1024
PDF, DOCX = "application/pdf", "application/vnd.openxmlformats-officedocument.wordprocessingml.document"


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"(\.[^.]*)$", 1))


def decode_bytes(content: Column) -> Column:
    """UTF-8 text without the bytes that are not valid."""
    return F.replace(F.make_valid_utf8(content.cast("string")), F.lit("\ufffd"), F.lit(""))


def read_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Files as (path, file_name, content, text); text is decoded from the bytes."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    return raw.select("path", F.element_at(F.split("path", "/"), -1).alias("file_name"), "content",
                      decode_bytes(F.col("content")).alias("text"))


def ingest_text(df: DataFrame, min_len: int = MIN_CHARS) -> DataFrame:
    """Add ``clean`` and ``reason`` (null = accepted) to (file_name, text) rows.

    Both outputs of an intake are filters on ``reason``; texts are read whole.
    """
    ext = extension(F.col("file_name"))
    return df.withColumn("clean", clean_text(F.col("text"))).withColumn("reason", first_reason(
        (F.coalesce(F.length("text"), F.lit(0)) == 0, "empty"),
        (~ext.isin(*ALLOWED), "unsupported type"),
        (F.length("clean") < min_len, "too little text"),
    ))


def extract_each(files: DataFrame, extract: Callable[[bytes], str], content: str = "content") -> DataFrame:
    """Add ``text`` and ``error``: a file on which ``extract`` fails becomes an error row, the batch goes on.

    ``error`` is the exception's name and message; a null content is an error as well.
    """

    @F.pandas_udf("text string, error string")
    def run(values: pd.Series) -> pd.DataFrame:
        out = []
        for v in values:
            try:
                if v is None:
                    raise ValueError("no content")
                out.append((extract(bytes(v)), None))
            except Exception as e:  # the row tells what failed
                out.append((None, f"{type(e).__name__}: {e}"))
        return pd.DataFrame(out, columns=["text", "error"], dtype=object)

    return files.withColumn("_got", run(F.col(content))).withColumns({"text": F.col("_got.text"), "error": F.col("_got.error")}).drop("_got")


def sniff_type(content: Column, declared: Column) -> Column:
    """True when the leading bytes agree with the declared type; unknown types never do."""
    lead = lambda n: F.hex(F.substring(content, 1, n))
    return (
        F.when(declared == PDF, F.contains(F.substring(content, 1, 1024), F.lit("%PDF-").cast("binary")))
        .when(declared == DOCX, (lead(4) == "504B0304") & F.contains(content, F.lit("word/document.xml").cast("binary")))
        .when(declared == "image/png", lead(8) == "89504E470D0A1A0A")
        .when(declared == "image/jpeg", lead(3) == "FFD8FF")
        .when(declared == "image/webp", (lead(4) == "52494646") & (F.hex(F.substring(content, 9, 4)) == "57454250"))
        .otherwise(False)
    )


def bulk_ingest(items: DataFrame, chunk: int = 25, max_bytes: int = MAX_BYTES) -> DataFrame:
    """One result per item with its own reason, in the given order; a bad item never fails the batch.

    ``items(item_no, file_name, content_type, content, error)``; ``error``
    holds what an earlier step reported for the item.
    """
    return items.select(
        "item_no", "file_name", F.floor(F.col("item_no") / chunk).alias("chunk"),
        first_reason(
            (F.length("content") > max_bytes, "too large"),
            (~F.col("content_type").isin(PDF, DOCX), "unsupported type"),
            (~sniff_type(F.col("content"), F.col("content_type")), "content does not match its type"),
            (F.col("error").isNotNull(), "failed"),
        ).alias("reason"),
    ).withColumn("accepted", F.col("reason").isNull())
