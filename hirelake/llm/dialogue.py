"""Repair of conversations: the cheapest edits after which every conversation alternates user and assistant.

A row is blank, a duplicate (role and text seen earlier), truncated (its last
character that is no blank ends no sentence) or sound.  Keep costs 0, Rerole 3,
Delete 4, Insert 3; a truncated row that stays costs 3 more, blank and
duplicate rows must go.  What stays has role initials ``(s?(ua)+)?``.

The search is a Viterbi recursion over four states (nothing yet, system, user
or assistant stands last), run backward so that its vectors hold the cost to
go, and in parallel by rank convergence:

1. Rows are dealt by range of their order and numbered; ``1 << bits`` numbers
   form a chunk, so one very long conversation is many chunks and a short one is one.
   Blank and duplicate rows only add a constant, each further row is one byte.
2. Every chunk of a conversation of several chunks starts from a speculative vector.
3. Stitching reads one summary row per chunk from right to left: where the vector
   that a chunk must start from is not among those it has run from, a fix-up
   pass runs it again beside its first run and stops as soon as the two
   vectors differ by a constant.  Vectors up to a constant are few, so from the third
   pass on a chunk runs from all of them and the passes end.
4. The stitched costs to go drive the tracing: from each state that a chunk may
   be entered in to the state it is left in, stitched from left to right, then once from
   the right one.  At each step the least letter (D, I, K, R) among the cheapest is taken, which gives the least
   audit, as no audit begins another of the same cost.

Defined cases: rows go by turn (nulls first), then role, then text, in code
point order; null roles and texts are one space; null conversation ids form
one conversation; a conversation without rows has no report row; empty tables give empty results;
columns other than the four named are ignored.  Repaired rows are made chunk by
chunk; only the digest of a whole conversation, a chain by definition, reads one conversation
in one task, as a stream.
"""

from __future__ import annotations

import hashlib
import itertools
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import BLANKS, column, written

#: A chunk has up to ``1 << BITS`` rows.
BITS = 16
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
#: State after the next user or assistant row.
NEXT = (USER, USER, ASSISTANT, USER)
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Costs to go after the last row; two inserts complete a lone system row.
END = (0, 2 * INSERT, INSERT, 0)
#: A row's code is the place of its role's initial in INITIALS (3: any other) and four times its fault.
INITIALS = "sua"
SOUND, CUT, BLANK, REPEATED = range(4)
#: Pairs of initials that may follow each other, four times the first plus the second: su, ua, au.
LEGAL = (1, 6, 9)
#: Passes before a chunk runs from all vectors.
PASSES = 2

REPORT = "chunk_blank bigint, chunk_duplicate bigint, chunk_truncated bigint, chunk_illegal bigint, chunk_cost bigint, head int, tail int, audit string"


class Costs:
    """Steps of the recursion, each worked out once."""

    def __init__(self) -> None:
        self.steps: dict = {}
        self.choices: dict = {}

    @staticmethod
    def row(vector: tuple, code: int, state: int) -> list[tuple[int, str, int]]:
        """(cost to go, letter, state after) of each edit of one row, in the order of the letters, without inserts."""
        initial, fault = code & 3, code >> 2
        out = [(DELETE + vector[state], "D", state)]
        if fault < BLANK:
            extra = TRUNCATED if fault == CUT else 0
            if (initial == 0 and state == NOTHING) or (initial in (1, 2) and NEXT[state] == initial + 1):
                out.append((extra + vector[initial + 1], "K", initial + 1))
            out.append((REROLE + extra + vector[NEXT[state]], "R", NEXT[state]))
        return out

    def back(self, vector: tuple, code: int) -> tuple[tuple, int]:
        """The vector before a row, least entry 0, and what was taken off."""
        known = self.steps.get((vector, code))
        if known is None:
            best = [min(self.row(vector, code, q))[0] for q in range(4)]
            for _ in range(3):
                best = [min(best[q], INSERT + best[NEXT[q]]) for q in range(4)]
            least = min(best)
            known = self.steps[vector, code] = tuple(b - least for b in best), least
        return known

    def choose(self, vector: tuple, code: int, state: int) -> tuple[str, int]:
        """Letters that deal with a row, given the vector after it, and the state after it."""
        known = self.choices.get((vector, code, state))
        if known is None:
            before, off = self.back(vector, code)
            letters, q = "", state
            while True:
                options = self.row(vector, code, q) + [(INSERT + before[NEXT[q]] + off, "I", NEXT[q])]
                letter, after = min((x, s) for cost, x, s in options if cost == before[q] + off)
                letters, q = letters + letter, after
                if letter != "I":
                    break
            known = self.choices[vector, code, state] = letters, q
        return known

    @staticmethod
    def close(state: int) -> str:
        """Inserts after the last row."""
        return "I" * (END[state] // INSERT)

    def run(self, codes: bytes, vector: tuple) -> tuple:
        """Vector at the left end of a chunk."""
        for code in reversed(codes):
            vector = self.back(vector, code)[0]
        return vector

    def rerun(self, codes: bytes, vector: tuple, beside: tuple, left: tuple) -> tuple:
        """The same beside an earlier run that ended in ``left``; stops where both vectors differ by a constant only."""
        for code in reversed(codes):
            if vector == beside:
                return left
            vector, beside = self.back(vector, code)[0], self.back(beside, code)[0]
        return vector

    def vectors(self) -> list[tuple]:
        """All vectors that runs from END can meet."""
        found, open_ = {END}, deque([END])
        while open_:
            vector = open_.popleft()
            for code in range(8):
                after = self.back(vector, code)[0]
                if after not in found:
                    found.add(after)
                    open_.append(after)
        return sorted(found)

    def after(self, codes: bytes, end: tuple) -> list[tuple]:
        """For each row the vector after it."""
        out = [end] * len(codes)
        for i in range(len(codes) - 1, 0, -1):
            out[i - 1] = self.back(out[i], codes[i])[0]
        return out

    def trace(self, codes: bytes, after: list[tuple], state: int) -> tuple[list[str], int]:
        """The letters of each row of a chunk that is entered in ``state``, and the state it is left in."""
        letters = []
        for code, vector in zip(codes, after):
            x, state = self.choose(vector, code, state)
            letters.append(x)
        return letters, state


def _codes(batch: pa.RecordBatch) -> Iterator[tuple[int, bytes]]:
    lists = batch.column("codes")
    ends, values = lists.offsets.to_pylist(), lists.values.to_numpy(zero_copy_only=False).astype("uint8").tobytes()
    yield from ((i, values[a:b]) for i, (a, b) in enumerate(zip(ends, ends[1:])))


def _with(batch: pa.RecordBatch, names: list[str], more: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], *more.values()], names=[*names, *more])


def place_rows(rows: DataFrame, bits: int = BITS, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Rows in their order: conv, turn, role, text, ``seq`` (grows with the order), ``chunk``, ``code`` and ``key`` (digest of role and text), written.

    Dealt by range of the order with the first 32 characters of the text, so a long conversation
    is spread and no bound of a range is long.
    """
    src = rows.select(column(conv_col).alias("conv"), column(turn_col).cast("bigint").alias("turn"), *[
        F.coalesce(column(c).cast("string"), F.lit(" ")).alias(n) for c, n in ((role_col, "role"), (text_col, "text"))])
    ordered = src.repartitionByRange("conv", "turn", "role", F.left("text", F.lit(32))).sortWithinPartitions("conv", "turn", "role", "text")
    seq = ordered.select("*", F.monotonically_increasing_id().alias("seq"))
    end = F.right(F.rtrim("text", F.lit(BLANKS)), F.lit(1))
    fault = F.when(end == "", BLANK).when(end.isin(".", "!", "?"), SOUND).otherwise(CUT)
    initial = F.left("role", F.lit(1))
    place = F.when(initial == "", 3).otherwise(F.pmod(F.instr(F.lit(INITIALS), initial) - 1, F.lit(4)))
    return written(seq.select("*", F.shiftright("seq", bits).alias("chunk"), (place + 4 * fault).cast("tinyint").alias("code"),
                              F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)).alias("key")), "dialogue-rows")


def make_chunks(placed: DataFrame, bits: int = BITS) -> DataFrame:
    """conv, chunk, codes (a byte per row, repeated rows marked), and whether the chunk is its conversation's first and last, written."""
    thin = placed.select("conv", "chunk", "seq", "code", "key")
    first = written(thin.groupBy("conv", "key").agg(F.min("seq").alias("first"), F.count(F.lit(1)).alias("c")).where("c > 1").drop("c"), "dialogue-repeats")
    seen = thin.alias("t").join(first.alias("f"), F.col("t.conv").eqNullSafe(F.col("f.conv")) & (F.col("t.key") == F.col("f.key")), "left")
    code = F.when((F.col("seq") > F.col("first")) & (F.col("code") < 4 * BLANK), F.pmod("code", F.lit(4)) + 4 * REPEATED).otherwise(F.col("code"))
    packed = F.shiftleft(F.col("seq").bitwiseAND((1 << bits) - 1), 4).bitwiseOR(code.cast("bigint"))
    chunks = seen.select("t.conv", "chunk", packed.alias("p")).groupBy("conv", "chunk").agg(F.sort_array(F.collect_list("p")).alias("p"))
    chunks = chunks.select("conv", "chunk", F.transform("p", lambda x: x.bitwiseAND(15).cast("tinyint")).alias("codes"))
    chunks = written(chunks, "dialogue-codes")
    ends = chunks.groupBy("conv").agg(F.min("chunk").alias("low"), F.max("chunk").alias("high"))
    return chunks.alias("c").join(ends.alias("e"), F.col("c.conv").eqNullSafe(F.col("e.conv"))).select(
        "c.*", (F.col("chunk") == F.col("low")).alias("is_first"), (F.col("chunk") == F.col("high")).alias("is_last"))


RUNS = "rights array<array<int>>, lefts array<array<int>>"
VECTORS = pa.list_(pa.list_(pa.int32()))


def _speculate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first run of each chunk."""
    costs = Costs()
    for b in batches:
        runs = [costs.run(codes, END) for _, codes in _codes(b)]
        yield _with(b, ["conv", "chunk", "is_last"], {"rights": pa.array([[END]] * len(runs), VECTORS), "lefts": pa.array([[v] for v in runs], VECTORS)})


def _fix_up(everywhere: bool):
    """Further runs of the chunks whose needed vector is new."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        costs = Costs()
        for b in batches:
            rights, lefts, held = [], [], b.select(["rights", "lefts", "need"]).to_pylist()
            for i, codes in _codes(b):
                right, left = ([tuple(v) for v in held[i][side]] for side in ("rights", "lefts"))
                for v in costs.vectors() if everywhere else [tuple(held[i]["need"])]:
                    if v not in right:
                        left.append(costs.rerun(codes, v, right[0], left[0]))
                        right.append(v)
                rights.append(right)
                lefts.append(left)
            yield _with(b, ["conv", "chunk", "is_last"], {"rights": pa.array(rights, VECTORS), "lefts": pa.array(lefts, VECTORS)})

    return run


def _stitch_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunk summaries from right to left: the vector that each chunk must start from, and whether it has run from it."""
    need = END
    for b in batches:
        needs, met = [], []
        for r in b.select(["is_last", "rights", "lefts"]).to_pylist():
            need = END if r["is_last"] else need
            rights = [tuple(x) for x in r["rights"]]
            needs.append(need)
            met.append(need in rights)
            need = tuple(r["lefts"][rights.index(need) if met[-1] else 0])
        yield _with(b, ["conv", "chunk"], {"need": pa.array(needs, pa.list_(pa.int32())), "met": pa.array(met)})


def _exits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The state that a chunk is left in, for each state it may be entered in."""
    costs = Costs()
    for b in batches:
        needs, out = b.column("need").to_pylist(), []
        for i, codes in _codes(b):
            after = costs.after(codes, tuple(needs[i]))
            out.append([costs.trace(codes, after, q)[1] for q in range(4)])
        yield _with(b, ["conv", "chunk", "is_first"], {"exits": pa.array(out, pa.list_(pa.int32()))})


def _stitch_on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunk summaries from left to right: the state that each chunk is entered in."""
    state = NOTHING
    for b in batches:
        entries = []
        for r in b.select(["is_first", "exits"]).to_pylist():
            state = NOTHING if r["is_first"] else state
            entries.append(state)
            state = r["exits"][state]
        yield _with(b, ["conv", "chunk"], {"entry": pa.array(entries, pa.int32())})


def _report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts and audit of each chunk, from its vector and its entry."""
    costs, price = Costs(), {"D": DELETE, "I": INSERT, "K": 0, "R": REROLE}
    for b in batches:
        facts = b.select(["need", "entry", "is_last"]).to_pylist()
        cols: list[list] = [[] for _ in range(8)]
        for i, codes in _codes(b):
            f = facts[i]
            letters, state = costs.trace(codes, costs.after(codes, tuple(f["need"])), f["entry"])
            audit = "".join(letters) + (costs.close(state) if f["is_last"] else "")
            faults = [c >> 2 for c in codes]
            cost = sum(n * audit.count(x) for x, n in price.items()) + sum(TRUNCATED for x, c in zip(letters, faults) if c == CUT and x[-1] != "D")
            pairs = zip(codes, codes[1:])
            values = (faults.count(BLANK), faults.count(REPEATED), faults.count(CUT), sum(4 * (x & 3) + (y & 3) not in LEGAL for x, y in pairs), cost, codes[0] & 3, codes[-1] & 3, audit)
            for c, v in zip(cols, values):
                c.append(v)
        types = [pa.int64()] * 5 + [pa.int32()] * 2 + [pa.string()]
        names = [x.split()[0] for x in REPORT.split(", ")]
        yield _with(b, ["conv", "chunk", "is_last", "entry"], {n: pa.array(c, t) for n, c, t in zip(names, cols, types)})


def _same(a: str, b: str) -> Column:
    return F.col(f"{a}.conv").eqNullSafe(F.col(f"{b}.conv")) & (F.col(f"{a}.chunk") == F.col(f"{b}.chunk"))


def audit_chunks(chunks: DataFrame) -> DataFrame:
    """Per chunk: conv, chunk, is_last, ``entry``, counts, cost, first and last initial, and ``audit``, written."""
    kind = dict(chunks.dtypes)["conv"]
    several = written(chunks.where("NOT (is_first AND is_last)"), "dialogue-several")
    single = chunks.where("is_first AND is_last").select("conv", "chunk", "codes", "is_last", F.array(*map(F.lit, END)).alias("need"), F.lit(NOTHING).alias("entry"))
    runs = written(several.mapInArrow(_speculate, f"conv {kind}, chunk bigint, is_last boolean, {RUNS}"), "dialogue-runs")
    passes = 0
    while True:
        needs = runs.repartition("conv").sortWithinPartitions("conv", F.desc("chunk")).mapInArrow(_stitch_back, f"conv {kind}, chunk bigint, need array<int>, met boolean")
        needs = written(needs, "dialogue-needs")
        if needs.where("NOT met").isEmpty():
            break
        state = runs.alias("r").join(needs.alias("n"), _same("r", "n")).select("r.*", "need", "met")
        again = several.alias("s").join(state.where("NOT met").alias("r"), _same("s", "r")).select("s.codes", "r.*")
        again = again.mapInArrow(_fix_up(passes >= PASSES), f"conv {kind}, chunk bigint, is_last boolean, {RUNS}")
        runs = written(state.where("met").drop("need", "met").unionByName(again), "dialogue-runs")
        passes += 1
    known = several.alias("s").join(needs.alias("n"), _same("s", "n")).select("s.*", "need")
    exits = written(known.mapInArrow(_exits, f"conv {kind}, chunk bigint, is_first boolean, exits array<int>"), "dialogue-exits")
    entries = exits.repartition("conv").sortWithinPartitions("conv", "chunk").mapInArrow(_stitch_on, f"conv {kind}, chunk bigint, entry int")
    entered = known.alias("k").join(entries.alias("e"), _same("k", "e")).select("k.conv", "k.chunk", "codes", "is_last", "need", "entry")
    return written(single.unionByName(entered).mapInArrow(_report, f"conv {kind}, chunk bigint, is_last boolean, entry int, {REPORT}"), "dialogue-audits")


def report(placed: DataFrame, audits: DataFrame) -> DataFrame:
    """Per conversation with rows: conv, gaps, blank, duplicate, truncated, illegal, cost, audit."""
    parts = audits.groupBy("conv").agg(
        *[F.sum(f"chunk_{n}").alias(n) for n in ("blank", "duplicate", "truncated", "illegal", "cost")],
        F.sort_array(F.collect_list(F.struct("chunk", "audit", "head", "tail"))).alias("parts"))
    seams = F.transform("parts", lambda x, i: F.when((i > 0) & ~(4 * F.get("parts", i - 1)["tail"] + x["head"]).isin(*LEGAL), 1).otherwise(0))
    parts = parts.select("conv", "blank", "duplicate", "truncated", (F.col("illegal") + F.aggregate(seams, F.lit(0), lambda a, x: a + x)).alias("illegal"), "cost",
                         F.array_join(F.transform("parts", lambda x: x["audit"]), "").alias("audit"))
    wide = "decimal(20,0)"
    turns = placed.groupBy("conv", "turn").agg(F.lit(1).alias("one")).groupBy("conv").agg(
        (F.max("turn").cast(wide) - F.min("turn").cast(wide) + 1 - F.count("turn")).alias("gaps"))
    turns = turns.select(F.col("conv").alias("of"), F.coalesce(F.col("gaps"), F.lit(0)).try_cast("bigint").alias("gaps"))
    return parts.join(turns, F.col("conv").eqNullSafe(F.col("of"))).select("conv", "gaps", *[c for c in parts.columns if c != "conv"])


def _play(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, int, str, str, str]]:
    """(conversation, row number, edit, role, text) of what stays, from a chunk's audit followed by its rows."""
    audit, at, state, last, key = "", 0, NOTHING, False, None

    def inserts():
        nonlocal at, state
        while at < len(audit) and audit[at] == "I":
            state, at = NEXT[state], at + 1
            yield "I", ("user" if state == USER else "assistant"), ""

    seq = -1
    for b in batches:
        convs = b.column("conv").to_pylist()
        for conv, r in zip(convs, b.select(["seq", "role", "text", "audit", "entry", "is_last"]).to_pylist()):
            if r["audit"] is not None:
                if last:
                    yield from ((key, seq, *x) for x in inserts())
                audit, at, state, last, key, seq = r["audit"], 0, r["entry"], r["is_last"], (conv,), -1
                continue
            yield from ((key, r["seq"], *x) for x in inserts())
            edit, at, seq = audit[at], at + 1, r["seq"]
            if edit == "D":
                continue
            role = r["role"]
            if edit == "R":
                state = NEXT[state]
                role = "user" if state == USER else "assistant"
            else:
                state = INITIALS.index(role[0]) + 1
            yield key, seq, edit, role, r["text"]
    if last:
        yield from ((key, seq, *x) for x in inserts())


def _conv_type(batches: Iterator[pa.RecordBatch]) -> tuple[pa.DataType, Iterator[pa.RecordBatch]]:
    first = next(batches, None)
    return (pa.null(), iter(())) if first is None else (first.schema.field("conv").type, itertools.chain([first], batches))


def _with_audits(placed: DataFrame, audits: DataFrame) -> DataFrame:
    a = audits.select("conv", "chunk", F.lit(-1).cast("bigint").alias("seq"), F.lit("").alias("role"), F.lit("").alias("text"), "audit", "entry", "is_last")
    nothing = [F.lit(None).cast(t).alias(n) for n, t in (("audit", "string"), ("entry", "int"), ("is_last", "boolean"))]
    return a.unionByName(placed.select("conv", "chunk", "seq", "role", "text", *nothing))


def _batches(rows: Iterator[tuple], schema: pa.Schema, n: int = 2000) -> Iterator[pa.RecordBatch]:
    while held := list(itertools.islice(rows, n)):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def repaired_rows(placed: DataFrame, audits: DataFrame) -> DataFrame:
    """What stays, chunk by chunk in parallel: conv, ``seq`` (grows with the order; an inserted row has that of the row before it in its chunk, -1 at its start), ``edit``, role, text."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, batches = _conv_type(batches)
        schema = pa.schema([("conv", kind), ("seq", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])
        yield from _batches(((key[0], *r) for key, *r in _play(batches)), schema)

    rows = _with_audits(placed, audits).repartition("conv", "chunk").sortWithinPartitions("conv", "chunk", "seq")
    return rows.mapInArrow(make, f"conv {dict(placed.dtypes)['conv']}, seq bigint, edit string, role string, text string")


def digests(placed: DataFrame, audits: DataFrame) -> DataFrame:
    """Per conversation that keeps rows: conv and ``repaired_sha256`` of its repaired ``role:text`` lines.

    A digest is a chain over its bytes, so the rows of one conversation pass through one task, one by one.
    """

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for key, rows in itertools.groupby(_play(batches), lambda r: r[0]):
            digest, gap = hashlib.sha256(), ""
            for _, _, _, role, text in rows:
                digest.update(f"{gap}{role}:{text}".encode())
                gap = "\n"
            yield key[0], digest.hexdigest()

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, batches = _conv_type(batches)
        yield from _batches(chain(batches), pa.schema([("conv", kind), ("repaired_sha256", pa.string())]))

    rows = _with_audits(placed, audits).repartition("conv").sortWithinPartitions("conv", "chunk", "seq")
    return rows.mapInArrow(make, f"conv {dict(placed.dtypes)['conv']}, repaired_sha256 string")


def damage_rows(rows: DataFrame) -> DataFrame:
    """Conversations with planted faults, by crc32 of ``conv_id:turn`` modulo 20: 0 drops a row, 1 empties it, 2 takes its ``.!?``, 3 repeats it, 4 makes its role user."""
    text = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")]
    fault = F.crc32(F.concat(text[0], F.lit(":"), text[1]).cast("binary")) % 20
    src = rows.select("conv_id", "turn", text[2].alias("role"), text[3].alias("text"), fault.alias("fault")).where("fault <> 0")
    return src.select("conv_id", "turn", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"),
                      F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
                      F.explode(F.when(F.col("fault") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy")).drop("copy")


def repair_report(rows: DataFrame, ids: DataFrame, bits: int = BITS) -> DataFrame:
    """``report`` and ``digests`` of ``rows``, a row for every conversation id of ``ids`` (conv_id), those without rows included."""
    placed = place_rows(rows, bits)
    audits = audit_chunks(make_chunks(placed, bits))
    found = report(placed, audits)
    hashed = digests(placed, audits).withColumnRenamed("conv", "of")
    out = ids.select("conv_id").distinct().join(found, F.col("conv_id").eqNullSafe(F.col("conv")), "left").join(hashed, F.col("conv_id").eqNullSafe(F.col("of")), "left")
    counts = [F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"),
                      F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))
