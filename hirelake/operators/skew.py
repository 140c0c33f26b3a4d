"""Ordered computations that stay parallel inside one very large group.

A window over a key puts all rows of that key into one task.  The helpers here
cut a group into ordered pieces, compute inside each piece, and carry over one
small summary row per piece.  All are exact and deterministic.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import shared_dir

def written(df: DataFrame, purpose: str) -> DataFrame:
    """Write a frame to the shared folder and read it back: computed once, and it survives lost executors."""
    path = shared_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def rank_rows(df: DataFrame, group: list[str], order: Column, out: str = "rank") -> DataFrame:
    """``row_number`` over ``group`` by the struct ``order`` without one task per group.

    ``order`` must be a struct whose ascending order is the wanted one and
    whose values are unique in a group.  Spark deals the rows by range of
    (group, order); the placed rows are written once, each with the number of its
    range.  Rank = rank among the group's rows of that range + the group's rows
    in earlier ranges.  Without ``group`` the whole frame is one ranking.
    """
    ranged = df.withColumn("_o", order).repartitionByRange(*group, "_o").withColumn("_piece", F.spark_partition_id())
    placed = written(ranged, "ranked")
    earlier = Window.partitionBy(*group).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    offsets = placed.groupBy(*group, "_piece").agg(F.count(F.lit(1)).alias("_c")).withColumn("_off", F.coalesce(F.sum("_c").over(earlier), F.lit(0))).drop("_c")
    local = Window.partitionBy(*group, "_piece").orderBy("_o")
    ranked = placed.withColumn("_rn", F.row_number().over(local)).alias("r").join(
        offsets.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], F.col("_piece").alias("_p"), "_off"),
        F.expr(" AND ".join(["_piece = _p", *[f"`{g}` <=> _g{i}" for i, g in enumerate(group)]])))
    return ranked.withColumn(out, (F.col("_rn") + F.col("_off")).cast("bigint")).drop("_rn", "_off", "_piece", "_p", "_o", *[f"_g{i}" for i in range(len(group))])


def in_pieces(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Rows dealt by Spark's ranges of (key, order), each with the number of its range in ``_piece``; written once.

    The ranges follow the rows, so a key with most of the rows, all within one
    hour even, is cut into as many pieces as its share of the partitions.
    """
    return written(df.repartitionByRange(*key, *order).withColumn("_piece", F.spark_partition_id()), "pieces")


def lag_rows(df: DataFrame, key: list[str], order: list[str], cols: dict[str, str]) -> DataFrame:
    """``lag(col)`` over ``key`` by ``order``.

    ``cols`` maps the column to read to the name of the lagged one.  Only the
    first row of a piece looks outside, at the last row of the piece before.
    """
    p = in_pieces(df, key, order)
    local = Window.partitionBy(*key, "_piece").orderBy(*order)
    names = list(cols)
    last = (
        p.groupBy(*key, "_piece")
        .agg(F.max_by(F.struct(*names), F.struct(*order)).alias("_last"))
        .withColumn("_before", F.lag("_last").over(Window.partitionBy(*key).orderBy("_piece")))
        .drop("_last")
    )
    out = (
        p.withColumn("_prev", F.lag(F.struct(*names)).over(local))
        .join(last, [*key, "_piece"])
        .withColumn("_prev", F.coalesce("_prev", "_before"))
    )
    for name, alias in cols.items():
        out = out.withColumn(alias, F.col("_prev")[name])
    return out.drop("_prev", "_before", "_piece")


def running_sum(df: DataFrame, key: list[str], order: list[str], col: str, out: str) -> DataFrame:
    """Inclusive running sum of ``col`` over ``key`` by ``order``, cut in the same way."""
    p = in_pieces(df, key, order)
    local = Window.partitionBy(*key, "_piece").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*key).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        p.groupBy(*key, "_piece").agg(F.sum(col).alias("_t"))
        .withColumn("_off", F.coalesce(F.sum("_t").over(earlier), F.lit(0))).drop("_t")
    )
    return (
        p.withColumn("_r", F.sum(col).over(local)).join(offsets, [*key, "_piece"])
        .withColumn(out, F.col("_r") + F.col("_off")).drop("_r", "_off", "_piece")
    )


def islands(df: DataFrame, key: list[str], order: list[str], starts: Column, lagged: dict[str, str],
            out: str = "island") -> DataFrame:
    """Name the runs of each key: a row starts a new run where ``starts`` holds.

    ``starts`` may read the lagged columns; the first row of a key always
    starts one.  A run is named by the order values of its first row.  Runs
    are found inside pieces; one summary row per piece (its first and last row
    and its last start) tells the next pieces which run goes on.
    """
    names, at = list(lagged), F.struct(*order)
    w = Window.partitionBy(*key, "_piece").orderBy(*order)
    local = in_pieces(df, key, order).withColumn("_isl_prev", F.lag(F.struct(*names)).over(w))
    local = local.withColumns({a: F.col("_isl_prev")[n] for n, a in lagged.items()})
    local = local.withColumn("_isl_s", F.when(F.col("_isl_prev").isNotNull() & F.coalesce(starts, F.lit(True)), at))
    pieces = local.groupBy(*key, "_piece").agg(
        F.min_by(F.struct(*df.columns), at).alias("_isl_f"), F.max_by(F.struct(*names), at).alias("_isl_l"), F.max("_isl_s").alias("_isl_ls"))
    by_piece = Window.partitionBy(*key).orderBy("_piece")
    pieces = pieces.withColumn("_isl_b", F.lag("_isl_l").over(by_piece)).select(
        *[F.col("_isl_f")[c].alias(c) for c in df.columns], *[F.col("_isl_b")[n].alias(a) for n, a in lagged.items()], "_piece", "_isl_ls", "_isl_b")
    pieces = pieces.withColumn("_isl_fs", F.when(F.col("_isl_b").isNull() | F.coalesce(starts, F.lit(True)), at))
    carry = F.last(F.coalesce("_isl_ls", "_isl_fs"), ignorenulls=True).over(by_piece.rowsBetween(Window.unboundedPreceding, -1))
    pieces = pieces.select(*key, "_piece", F.coalesce("_isl_fs", carry).alias("_isl_c"), *[F.col(a).alias(f"_b_{a}") for a in lagged.values()])
    first = F.coalesce(F.max("_isl_s").over(w.rowsBetween(Window.unboundedPreceding, 0)), F.col("_isl_c"))
    named = local.join(pieces, [*key, "_piece"]).withColumn("_isl_run", first)
    return named.withColumns({a: F.when(F.col("_isl_prev").isNull(), F.col(f"_b_{a}")).otherwise(F.col(a)) for a in lagged.values()}).withColumn(
        out, F.concat_ws("|", *[F.col("_isl_run")[c].cast("string") for c in order])).select(*df.columns, *lagged.values(), out)


def next_of(df: DataFrame, key: list[str], at: str, probe: Column, out: str) -> DataFrame:
    """Add the least ``at`` of the key's rows that is not below the row's ``probe``, null where there is none.

    Probes and rows are put into one order and each probe reads what follows it;
    pieces hand the first row they hold to the pieces before.
    """
    src = df.withColumn("_probe", probe)
    both = src.select(*key, F.col(at).alias("_at"), F.lit(1).alias("_kind")).unionByName(src.select(*key, F.col("_probe").alias("_at"), F.lit(0).alias("_kind"))).distinct()
    p = in_pieces(both, key, ["_at", "_kind"]).withColumn("_event", F.when(F.col("_kind") == 1, F.col("_at")))
    ahead = Window.partitionBy(*key, "_piece").orderBy("_at", "_kind").rowsBetween(0, Window.unboundedFollowing)
    later = Window.partitionBy(*key).orderBy("_piece").rowsBetween(1, Window.unboundedFollowing)
    firsts = p.groupBy(*key, "_piece").agg(F.min("_event").alias("_first")).withColumn("_later", F.first("_first", ignorenulls=True).over(later)).drop("_first")
    found = p.withColumn("_next", F.first("_event", ignorenulls=True).over(ahead)).where("_kind = 0").join(firsts, [*key, "_piece"])
    found = found.select(*key, F.col("_at").alias("_probe"), F.coalesce("_next", "_later").alias(out))
    return src.join(found, [*key, "_probe"], "left").drop("_probe")


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key, the greatest by ``order``; ``max_by`` combines on the map side."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*keys, "_r.*")


def earliest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key, the least by ``order``."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*keys, "_r.*")
