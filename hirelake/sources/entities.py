"""Entity scans with declared schemas, and key lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: DDL of the parquet tables.  Declaring it saves the schema-inference job.
SCHEMAS: dict[str, str] = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, "
                "l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "pages": "page_id bigint, url string, html string",
    "benchmark": "item_id bigint, text string",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}


def read_entity(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Scan one parquet entity; filters and columns are pushed into the scan."""
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def lookup(df: DataFrame, key: str, value) -> DataFrame:
    """Point lookup; an absent key gives an empty frame, not an error."""
    return df.where(F.col(key) == F.lit(value))


def lookup_many(keys: DataFrame, df: DataFrame, key: str) -> DataFrame:
    """Batch lookup: every asked key comes back once, ``found`` tells whether it exists."""
    return keys.join(df.withColumn("_hit", F.lit(True)), key, "left").withColumn(
        "found", F.coalesce("_hit", F.lit(False))
    ).drop("_hit")


def parts(df: DataFrame, rows: int) -> int:
    """Partitions that hold about ``rows`` rows of a scan each, at least those of the session; counting reads the footers of its files."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // rows))


def spread(df: DataFrame) -> DataFrame:
    """Use all cores for costly row work on a scan with few splits.

    A table of many files already has more splits than cores and is left as
    it is; only a small one (one file, one row group) is dealt out.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)
