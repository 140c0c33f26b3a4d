"""Operational measures: counters, latency, budgets, limits and alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .skew import islands, lag_rows, latest, rank_rows

# Latency bounds in seconds, output tokens assumed per call, budget share, backoff seconds.
LATENCY_BOUNDS = (0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0, 30.0, 60.0)
OUTPUT_TOKENS = 1500
BUDGET_SHARE = 0.9
BACKOFF_BASE, BACKOFF_CAP = 2, 20
RETRY_BASE = 30
MAX_RETRIES = 3


def task_summary(runs: DataFrame) -> DataFrame:
    """Runs, timed runs, seconds and last finish by task and state; also valid on a stream."""
    return runs.groupBy("task", "state").agg(
        F.count(F.lit(1)).alias("runs"), F.count("seconds").alias("timed"),
        F.coalesce(F.sum("seconds"), F.lit(0.0)).alias("seconds"), F.max("ts").alias("last_finished"))


def latency_histogram(df: DataFrame, keys: list[str], value: str, bounds: tuple[float, ...] = LATENCY_BOUNDS) -> DataFrame:
    """Cumulative counts per bound (``le``, infinity last) in one pass."""
    counts = [F.struct(F.lit(b).alias("le"), F.count_if(F.col(value) <= b).alias("n")) for b in bounds]
    every = F.struct(F.lit(float("inf")).alias("le"), F.count(F.lit(1)).alias("n"))
    rows = df.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.array(*counts, every).alias("_h"))
    return rows.select(*keys, F.inline("_h"))


def histogram_quantile(hist: DataFrame, keys: list[str], q: float) -> DataFrame:
    """Quantile by linear interpolation in the first bucket that reaches the rank; a handful of rows per key."""
    w = Window.partitionBy(*keys).orderBy("le")
    d = hist.withColumns({"prev_le": F.coalesce(F.lag("le").over(w), F.lit(0.0)), "prev_n": F.coalesce(F.lag("n").over(w), F.lit(0))})
    total = F.max("n").over(Window.partitionBy(*keys))
    d = d.withColumn("target", total * q).where((F.col("n") >= F.col("target")) & (F.col("target") > 0))
    first = d.groupBy(*keys).agg(F.min_by(F.struct("le", "n", "prev_le", "prev_n", "target"), "le").alias("b")).select(*keys, "b.*")
    step = (F.col("le") - F.col("prev_le")) * (F.col("target") - F.col("prev_n")) / (F.col("n") - F.col("prev_n"))
    return first.select(*keys, F.when(F.col("le") == float("inf"), F.col("prev_le")).otherwise(F.col("prev_le") + step).alias("quantile"))


def stuck_rows(resumes: DataFrame, jobs: DataFrame, apps: DataFrame, now, minutes: int = 30) -> DataFrame:
    """(kind, n): long-pending rows, rows out of retries, failed scores."""
    old = F.col("updated_at") < F.lit(now) - F.make_dt_interval(mins=F.lit(minutes))
    pending, failed = F.col("extraction_status") == "pending", F.col("extraction_status") == "failed"
    out = failed & (F.col("retry_count") >= MAX_RETRIES)
    row = lambda df, **kinds: df.agg(*[F.count_if(c).alias(k) for k, c in kinds.items()]).unpivot([], list(kinds), "kind", "n")
    return (
        row(resumes, resume_extraction_pending=pending & old, resume_extraction_failed=out)
        .unionByName(row(jobs, jd_extraction_pending=pending & old & F.col("jd_raw_text").isNotNull(), jd_extraction_failed=out))
        .unionByName(row(apps, match_scoring_failed=F.col("match_status") == "failed"))
    )


def window_usage(hits: DataFrame, now, seconds: int = 60) -> DataFrame:
    """Tokens and requests in the last ``seconds``."""
    live = (F.col("ts") >= F.lit(now) - F.make_dt_interval(secs=F.lit(seconds))) & (F.col("ts") <= F.lit(now))
    return hits.where(live).agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), F.count(F.lit(1)).alias("requests"))


def queue_depth(msgs: DataFrame) -> DataFrame:
    """Waiting messages per queue and in all (``queue`` null)."""
    return msgs.rollup("queue").agg(F.count(F.lit(1)).alias("depth"))


def latest_probe(probes: DataFrame) -> DataFrame:
    """Last result per task; a busy answer is no result."""
    return latest(probes.where("state <> 'busy'"), ["task"], ["ts", "id"])


def metric_rows(name: str, df: DataFrame, labels: list[str], value: str) -> DataFrame:
    """Flatten an aggregate to (metric, labels, value)."""
    pairs = [x for c in labels for x in (F.lit(c), F.col(c).cast("string"))]
    return df.select(F.lit(name).alias("metric"), (F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")).alias("labels"),
                     F.col(value).cast("double").alias("value"))


def stagger(ids: DataFrame, key: str, order: list[str], size: int, delay: int) -> DataFrame:
    """Start delay of each distinct id: batch k of ``size`` starts ``k * delay`` later, in first-seen order."""
    first = ids.groupBy(key).agg(F.min(F.struct(*order)).alias("_at"))
    ranked = rank_rows(first, [], F.struct("_at", key), "_n")
    return ranked.select(key, (F.floor((F.col("_n") - 1) / max(size, 1)) * max(delay, 0)).cast("bigint").alias("countdown"))


def fixed_window_limit(hits: DataFrame, limit: int, seconds: int) -> DataFrame:
    """First ``limit`` hits of a key in each clock bucket pass; retry-after is the rest of the bucket."""
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000
    d = hits.withColumn("bucket", F.floor(at / seconds)).withColumn("retry_after", (seconds - F.floor(at % seconds)).cast("bigint"))
    ranked = rank_rows(d, ["key", "bucket"], F.struct("ts", "hit_id"), "n")
    return ranked.withColumn("allowed", F.col("n") <= limit)


def counter_rate(series: DataFrame, keys: list[str], order: list[str], window: int, step: int = 60) -> DataFrame:
    """Increase of a counter over the last ``window`` seconds at each ``step``, with resets.

    A fall counts as restart from zero.  Increases are summed per step first,
    so the window runs over a time grid.  No extrapolation at the edges.
    """
    d = lag_rows(series, keys, order, {"value": "prev"})
    inc = F.when(F.col("prev").isNull(), 0.0).when(F.col("value") < F.col("prev"), F.col("value")).otherwise(F.col("value") - F.col("prev"))
    grid = (
        d.withColumn("step", (F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / step) * step).cast("bigint"))
        .groupBy(*keys, "step").agg(F.sum(inc).alias("inc"))
    )
    w = Window.partitionBy(*keys).orderBy("step").rangeBetween(-(window - step), 0)
    return grid.select(*keys, "step", F.sum("inc").over(w).alias("increase"))


def alert_hold(series: DataFrame, keys: list[str], cond: Column, hold: int | Column, order: list[str], max_gap: int | None = None) -> DataFrame:
    """Rows where ``cond`` has held without a break for ``hold`` seconds; ``since`` is the start of the run.

    A pause longer than ``max_gap`` seconds between samples also breaks a run.
    """
    d = series.withColumn("_c", F.coalesce(cond, F.lit(False)))
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    starts = F.col("_c") != F.col("_pc")
    if max_gap is not None:
        starts = starts | (micros("ts") - micros("_pt") > max_gap * 1_000_000)
    runs = islands(d, keys, order, starts, {"_c": "_pc", "ts": "_pt"}, "_run").where("_c")
    start = runs.groupBy(*keys, "_run").agg(F.min("ts").alias("since"))
    held = micros("ts") - micros("since")
    return runs.join(start, [*keys, "_run"]).where(held >= F.lit(hold).cast("bigint") * 1_000_000).drop("_c", "_pc", "_pt", "_run")


def token_estimate(prompt_len: Column, doc_len: Column) -> Column:
    return (F.floor((prompt_len + doc_len) / 4) + OUTPUT_TOKENS).cast("bigint")


def fits_budget(tokens: Column, per_minute: int) -> Column:
    return tokens <= per_minute * BUDGET_SHARE


def backoff_seconds(attempt: Column, hint: Column) -> Column:
    """Wait before retry ``attempt`` (from 1); a hint above the cap means give up (null)."""
    own = F.least(BACKOFF_BASE * F.pow(F.lit(2.0), attempt - 1), F.lit(float(BACKOFF_CAP)))
    return F.when(hint.isNull(), own).when(hint <= BACKOFF_CAP, hint)


def task_retry_seconds(retries: Column) -> Column:
    return RETRY_BASE * F.pow(F.lit(2.0), retries)


def classify_error(code: Column, message: Column) -> Column:
    """'bad_output', 'transient' or 'permanent'; no status code means a timeout, which is transient."""
    return (F.when((code == 400) & F.contains(message, F.lit("json_validate_failed")), "bad_output")
            .when(code.isNull() | code.isin(408, 429) | (code >= 500), "transient").otherwise("permanent"))


def validate_json_lists(answer: Column, keys: tuple[str, ...]) -> Column:
    """The answer as a struct of string lists, or null when a key is missing or no list of strings."""
    raw = F.from_json(answer, "struct<" + ", ".join(f"{k}: string" for k in keys) + ">")
    typed = lambda k: F.from_json(raw[k], "array<variant>")
    text_only = lambda k: F.forall(typed(k), lambda v: F.schema_of_variant(v) == "STRING")
    ok = F.lit(True)
    for k in keys:
        ok = ok & F.coalesce(typed(k).isNotNull() & text_only(k), F.lit(False))
    lists = F.from_json(answer, "struct<" + ", ".join(f"{k}: array<string>" for k in keys) + ">")
    return F.when(ok, lists)
