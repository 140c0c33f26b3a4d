"""Session life: idle limit and longest duration.

A session begins at a key's first use, after a pause longer than the idle
limit, or at the first use that comes ``longest`` after the session's start.
The pauses cut a key into runs.  A run shorter than ``longest`` is one
session, and most are.  In longer runs every use points at the use that would
begin the next session, and the pointers that start from the run's first use
are followed by doubling: with one join the first 2, 4, 8, ... sessions are
known.  No key is read in one task, and no Python runs.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .skew import in_pieces, islands, next_of, written

SECOND = 1_000_000


def session_starts(uses: DataFrame, first: DataFrame, longest: int, most: int) -> DataFrame:
    """(key, run, at) of every use that begins a session; ``uses`` and ``first`` hold all uses and the first one of runs of up to ``most`` microseconds."""
    jumps = written(next_of(uses, ["key", "run"], "at", F.col("at") + longest, "next").where("next IS NOT NULL"), "session-jumps")
    starts = first
    for step in range(math.ceil(math.log2(most // longest + 2))):
        if step:
            ahead = jumps.select("key", "run", F.col("at").alias("next"), F.col("next").alias("ahead"))
            jumps = written(jumps.join(ahead, ["key", "run", "next"]).select("key", "run", "at", F.col("ahead").alias("next")), "session-jumps")
        starts = written(starts.unionByName(starts.join(jumps, ["key", "run", "at"]).select("key", "run", F.col("next").alias("at"))), "session-starts")
    return starts


def sessionize(hits: DataFrame, key: str, ts: str, tie: str, idle: int, longest: int) -> DataFrame:
    """Add ``session_start`` (microseconds) to every hit; rows without a key form one key, rows without a time have no start."""
    cols, longest = hits.columns, longest * SECOND
    d = hits.withColumn("at", F.unix_micros(F.col(ts).cast("timestamp"))).withColumn("_k", F.struct(F.col(key).alias("k")))
    untimed = d.where("at IS NULL").select(*cols, F.lit(None).cast("bigint").alias("session_start"))
    runs = islands(d.where("at IS NOT NULL"), ["_k"], ["at", tie], F.col("at") - F.col("_prev") > idle * SECOND, {"at": "_prev"}, "_run").drop("_prev")
    runs = written(runs, "session-hits")
    ends = runs.groupBy("_k", "_run").agg(F.min("at").alias("_low"), F.max("at").alias("_high"))
    placed = runs.join(ends, ["_k", "_run"])
    short = placed.where(F.col("_high") - F.col("_low") < longest).select(*cols, F.col("_low").alias("session_start")).unionByName(untimed)
    most = ends.agg(F.max(F.col("_high") - F.col("_low"))).first()[0] or 0
    if most < longest:
        return short
    long = written(placed.where(F.col("_high") - F.col("_low") >= longest), "session-long")
    names = [F.col("_k").alias("key"), F.col("_run").alias("run")]
    starts = session_starts(long.select(*names, "at").distinct(), long.select(*names, F.col("_low").alias("at")).distinct(), longest, most)
    # the start in force is the latest one so far; a piece takes over the last one of the pieces before
    begun = starts.select(F.col("key").alias("_k"), F.col("run").alias("_run"), "at", F.col("at").alias("_start"))
    p = in_pieces(long.join(begun, ["_k", "_run", "at"], "left"), ["_k", "_run"], ["at", tie])
    so_far = Window.partitionBy("_k", "_run", "_piece").orderBy("at").rangeBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("_k", "_run").orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    carried = p.groupBy("_k", "_run", "_piece").agg(F.max("_start").alias("_s")).withColumn("_carry", F.max("_s").over(before)).drop("_s")
    out = p.withColumn("_now", F.max("_start").over(so_far)).join(carried, ["_k", "_run", "_piece"])
    return short.unionByName(out.select(*cols, F.coalesce("_now", "_carry").alias("session_start")))
