"""From documents to token ids: toxic documents go, copies and near copies go, sources are mixed, texts are encoded.

Each stage takes (spark, docs, sf_dir) and decides over all rows of ``docs``.  All but the last
return the columns that they are given.  Defined cases are those of the operators: null texts
are empty, an empty table passes through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hirelake.llm import byte_bpe, exact_dedup, mixing, near_dups, toxicity
from hirelake.llm.queries import VOCABULARY, learnable
from hirelake.llm.shared import read_entity, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier, fitted on the labels of the table, does not reject."""
    model = toxicity.train(read_entity(spark, sf_dir, "documents"), learnable(spark, sf_dir))
    return toxicity.keep_ordinary(docs, model)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of each group of texts that are equal but for blanks."""
    return exact_dedup.keep_one(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: proposed by SimHash links, beyond their radius by MinHash, and decided by Jaccard similarity of five-word shingles, 0.8 or more."""
    return near_dups.keep_one_of_alike(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often, or as far, as the mix takes them."""
    return mixing.mix_documents(docs)


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per text of the mix: doc_id, lang, source, n_tokens, and digests of its ids and of the bytes decoded from them."""
    codes = byte_bpe.round_trip(F.coalesce("text", F.lit("")), byte_bpe.read_ranks(VOCABULARY))
    return docs.select("doc_id", "lang", "source", codes.alias("r")).select("doc_id", "lang", "source", "r.*")


STAGES = [("toxicity", drop_toxic), ("exact_dedup", drop_copies), ("simhash_near_dedup", drop_near_copies), ("mix_sources", mix_sources), ("byte_bpe", encode_texts)]

#: SQL can express neither a trained classifier nor the seeded blocks; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written before the next one reads it."""
    docs = read_entity(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
