"""Structured Streaming forms of the event operators.

Event time with a watermark decides what is late; the file and table sources
run to the end with ``availableNow``.  Output goes to tables in the shared
folder, never to memory of the driver.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.operations import task_summary
from ..operators.skew import latest
from ..operators.stateful import out_names, out_schema, verdicts
from ..session import shared_dir
from ..sources.entities import SCHEMAS

LATENESS = "1 day"


def read_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Stream one parquet entity."""
    return spark.readStream.schema(SCHEMAS[name]).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def event_time(df: DataFrame, col: str = "ts", lateness: str = LATENESS) -> DataFrame:
    """Zone-less time as UTC timestamp with a watermark."""
    return df.withColumn(col, F.col(col).cast("timestamp")).withWatermark(col, lateness)


def with_end(stream: DataFrame, at: str = "9999-01-01 00:00:00", col: str = "ts") -> tuple[DataFrame, Callable[[], None]]:
    """A replay that can be ended: the stream, and a function that sends one more row, without a key, whose time is far ahead.

    Sent after all data were read, it moves the watermark past all windows.
    """
    spark, path = stream.sparkSession, shared_dir(stream.sparkSession, "stream-end")
    spark.createDataFrame([], stream.schema).write.parquet(path)
    row = [F.lit(at).cast(f.dataType).alias(f.name) if f.name == col else F.lit(None).cast(f.dataType).alias(f.name) for f in stream.schema.fields]
    return stream.unionByName(spark.readStream.schema(stream.schema).parquet(path)), lambda: spark.range(1).select(*row).write.mode("append").parquet(path)


def run_to_table(stream: DataFrame, mode: str, keep: Callable[[DataFrame], DataFrame] | None = None, key: str | None = None,
                 end: Callable[[], None] | None = None) -> DataFrame:
    """Run a stream over all available data and return its result table.

    ``append`` writes files through the exactly-once file sink.  ``complete``
    replaces the table with each batch, one folder per batch, so a batch that
    runs again after a failure overwrites its own folder only.  ``update`` keeps
    the folders of all batches and gives the last row of each ``key``.  With
    ``end`` (see :func:`with_end`) the data are read to their end, the end is sent, and
    the stream goes on from its checkpoint.
    """
    spark = stream.sparkSession
    out, state = shared_dir(spark, "stream-out"), shared_dir(spark, "stream-state")
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", state).trigger(availableNow=True)
    if mode == "append":
        for send in [lambda: None, end] if end else [lambda: None]:
            send()
            writer.format("parquet").option("path", out).start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(out)
    last = {}

    def save(batch: DataFrame, batch_id: int) -> None:
        path = f"{out}/batch={batch_id}"
        (keep(batch) if keep else batch).write.mode("overwrite").parquet(path)
        last["path"] = path

    writer.foreachBatch(save).start().awaitTermination()
    if "path" not in last:
        return spark.createDataFrame([], stream.schema)
    if mode == "update":
        rows = spark.read.option("basePath", out).parquet(out)
        return latest(rows, [key], ["batch"]).select(*stream.columns)
    return spark.read.parquet(last["path"])


def stream_task_metrics(events: DataFrame) -> DataFrame:
    """Running counters by task and state."""
    return task_summary(events)


def stream_tumbling_limit(hits: DataFrame, limit: int, seconds: int) -> DataFrame:
    """Hits per key and clock bucket, split into allowed and denied; denied hits count.

    In append mode a bucket is given out once, when the watermark has passed its
    end, and its state is dropped then.
    """
    n = hits.groupBy("key", F.window("ts", f"{seconds} seconds").alias("w")).agg(F.count(F.lit(1)).alias("hits"))
    return n.select("key", F.col("w.start").alias("bucket"), "hits", F.least("hits", F.lit(limit)).alias("allowed"),
                    F.greatest(F.col("hits") - limit, F.lit(0)).alias("denied"))


def stream_sessions(events: DataFrame, key: str = "user_id", idle: str = "30 minutes") -> DataFrame:
    """Idle-limited sessions by the built-in session window."""
    return events.groupBy(key, F.session_window("ts", idle).alias("w")).agg(F.count(F.lit(1)).alias("events")).select(
        key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events")


def stream_rule(df: DataFrame, key: str, rule, tie: str) -> DataFrame:
    """Streaming form of a stateful rule.

    Rows of a key are put in time order inside a micro-batch; the state is a
    few numbers, kept as JSON.  It is dropped when the watermark has passed
    the last event by the rule's own memory.
    """
    schema = out_schema(df, rule)
    names, columns = out_names(rule), schema.fieldNames()
    memory_ms = int(getattr(rule, "seconds", 86_400)) * 1000

    def update(_key, batches, state):
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches), ignore_index=True)
        if len(rows) == 0:
            return
        rows = rows.sort_values(["at", tie], kind="stable").reset_index(drop=True)
        now = json.loads(state.get[0]) if state.exists else rule.start()
        now, outs = verdicts(rule, now, rows["at"].tolist(), [rows[c].tolist() for c in rule.inputs])
        state.update((json.dumps(now),))
        state.setTimeoutTimestamp(max(int(rows["at"].iloc[-1]) // 1000, state.getCurrentWatermarkMs()) + memory_ms + 1)
        yield rows.assign(**{n: [o[j] for o in outs] for j, n in enumerate(names)})[columns]

    return df.groupBy(key).applyInPandasWithState(update, schema, "state string", "append", "EventTimeTimeout")


def stream_changes(audit: DataFrame) -> DataFrame:
    """Change feed with the changed fields; stateless."""
    from ..operators.history import with_changes
    return with_changes(audit)


def stream_readiness(resume_done: DataFrame, job_done: DataFrame, apps: DataFrame) -> DataFrame:
    """An application is due when both its sides are done, at the later of the two latest moments.

    The state is one row per application with the latest moment of each side, so
    the sides may be any time apart; Spark keeps it in the state store, and map-side
    sums go before it.  Each side is first tied to its applications (a static table).
    """
    none = F.lit(None).cast("timestamp")
    r = resume_done.join(apps.select("application_id", "resume_id"), "resume_id").select("application_id", F.col("ts").cast("timestamp").alias("resume_ts"), none.alias("job_ts"))
    j = job_done.join(apps.select("application_id", "job_id"), "job_id").select("application_id", none.alias("resume_ts"), F.col("ts").cast("timestamp").alias("job_ts"))
    sides = r.unionByName(j).groupBy("application_id").agg(F.max("resume_ts").alias("resume_ts"), F.max("job_ts").alias("job_ts"))
    return sides.where("resume_ts IS NOT NULL AND job_ts IS NOT NULL").select("application_id", F.greatest("resume_ts", "job_ts").alias("due_at"))


def retry_step(df: DataFrame, now, after_minutes: int = 10, max_retry: int = 3) -> DataFrame:
    """One sweep: what can be retried becomes pending with one more try; the rest stays."""
    from ..operators.filters import retryable
    hit = F.coalesce(retryable(now, after_minutes, max_retry), F.lit(False))
    return df.withColumn("swept", hit).withColumns({
        "retry_count": F.when(hit, F.col("retry_count") + 1).otherwise(F.col("retry_count")),
        "extraction_status": F.when(hit, "pending").otherwise(F.col("extraction_status"))})
