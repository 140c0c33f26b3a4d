"""Order-dependent verdicts: limits, budgets, locks, lockouts, token rotation.

Each verdict depends on the verdicts before it, so a key is read in time order
with a small state.  A rule is that state and one step; the batch form below
and the streaming form in ``hirelake.streaming`` share it.

Batch form: a key is first cut where it was quiet long enough for every entry
to expire (such runs are independent), runs are hash-partitioned and sorted,
and one pass carries the state from row to row.  No group is ever collected:
memory is one Arrow batch and one state, however long a run is.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .skew import islands

SECOND = 1_000_000


@dataclass(frozen=True)
class SlidingLog:
    """At most ``limit`` admitted hits in any ``seconds``; denied hits do not count."""

    limit: int
    seconds: int
    inputs = ()
    outputs = "allowed boolean, retry_after bigint"

    def start(self):
        return []

    def step(self, log, at):
        span = self.seconds * SECOND
        log = [x for x in log if x > at - span]
        if len(log) >= self.limit:
            return log, (False, (span - (at - log[0])) // SECOND + 1)
        return log + [at], (True, 0)


@dataclass(frozen=True)
class RollingBudget:
    """Admit while requests and tokens of the last ``seconds`` stay under 90 % of both limits.

    A request larger than the whole budget is rejected at once.  An admitted
    estimate is replaced by the real use before the next request.
    """

    rpm: int
    tpm: int
    seconds: int = 60
    inputs = ("tokens", "actual_tokens")
    outputs = "verdict string, wait double"

    def start(self):
        return []

    def step(self, log, at, tokens, actual):
        span = self.seconds * SECOND
        if tokens > self.tpm * 0.9:
            return log, ("rejected", None)
        log = [x for x in log if at - x[0] < span]
        if len(log) < self.rpm * 0.9 and sum(x[1] for x in log) + tokens <= self.tpm * 0.9:
            used = tokens if actual is None or actual != actual else max(int(actual), 0)
            return log + [[at, int(used)]], ("admitted", 0.0)
        return log, ("wait", max((span - (at - log[0][0])) / SECOND, 0.001) if log else 1.0)


@dataclass(frozen=True)
class FirstSeen:
    """True for the first sight of a key, false for repeats until ``seconds`` later; repeats do not extend it."""

    seconds: int
    inputs = ()
    outputs = "first boolean"

    def start(self):
        return None

    def step(self, until, at):
        if until is not None and until > at:
            return until, (False,)
        return at + self.seconds * SECOND, (True,)


@dataclass(frozen=True)
class Lockout:
    """``limit`` failures, each within ``seconds`` of the last, lock for ``seconds``; success clears."""

    limit: int = 5
    seconds: int = 900
    inputs = ("failed",)
    outputs = "locked boolean, failures bigint"

    def start(self):
        return [0, None, None]  # failures, last failure, locked until

    def step(self, state, at, failed):
        n, last, until = state
        span = self.seconds * SECOND
        if until is not None and at < until:
            return state, (True, n)
        if not failed:
            return [0, None, None], (False, 0)
        n = 1 if last is None or at - last >= span else n + 1
        return [n, at, at + span if n >= self.limit else None], (False, n)


@dataclass(frozen=True)
class Rotation:
    """Refresh-token use: current rotates, the previous one passes within ``grace`` seconds, later it is a replay."""

    grace: int = 10
    inputs = ("version",)
    outputs = "verdict string"

    def start(self):
        return [0, None, False]  # current version, rotated at, revoked

    def step(self, state, at, version):
        current, rotated, revoked = state
        if revoked:
            return state, ("revoked",)
        if version == current:
            return [current + 1, at, False], ("ok",)
        if rotated is not None and version == current - 1:
            if at - rotated <= self.grace * SECOND:
                return state, ("grace",)
            return [current, rotated, True], ("replay",)
        return state, ("unknown",)


def out_names(rule) -> list[str]:
    return [part.split()[0] for part in rule.outputs.split(", ")]


def out_schema(df: DataFrame, rule) -> T.StructType:
    return T.StructType(df.schema.fields + T.StructType.fromDDL(rule.outputs).fields)


def verdicts(rule, state, at, columns):
    """Run the steps over aligned value lists; returns the state and one list per output."""
    outs = []
    for i, moment in enumerate(at):
        state, out = rule.step(state, int(moment), *[c[i] for c in columns])
        outs.append(out)
    return state, outs


def _scan(rule, keys: list[str]):
    def run(batches):
        last, state = None, None
        names = out_names(rule)
        for pdf in batches:
            ids = list(zip(*[pdf[k].tolist() for k in keys]))
            at, cols, outs = pdf["at"].tolist(), [pdf[c].tolist() for c in rule.inputs], []
            for i, who in enumerate(ids):
                if who != last:
                    last, state = who, rule.start()
                state, out = rule.step(state, at[i], *[c[i] for c in cols])
                outs.append(out)
            yield pdf.assign(**{n: [o[j] for o in outs] for j, n in enumerate(names)})

    return run


def replay(df: DataFrame, keys: list[str], order: list[str], rule) -> DataFrame:
    """Add the rule's outputs to every row; ``at`` holds the time in microseconds."""
    return (
        df.repartition(*keys).sortWithinPartitions(*keys, *order)
        .mapInPandas(_scan(rule, keys), out_schema(df, rule))
    )


def replay_quiet(df: DataFrame, key: str, ts: str, tie: str, rule, quiet: int | None = None) -> DataFrame:
    """Replay per key, cut where a key was quiet for ``quiet`` seconds (the rule's memory by default)."""
    gap = (quiet or rule.seconds) * SECOND
    moment: Column = F.unix_micros(F.col(ts).cast("timestamp"))
    d = df.withColumn("at", moment)
    runs = islands(d, [key], ["at", tie], F.col("at") - F.col("_prev_at") > gap, {"at": "_prev_at"}, "run")
    return replay(runs.drop("_prev_at"), [key, "run"], ["at", tie], rule).drop("run", "at")
