"""Mixing sources to target weights: Sainte-Lague quotas of equal-token blocks.

1. Targets.  All words are shared among the sources by weight.  A target stops
   at ``MAX_REPEAT`` times its source; the excess is shared again by weight
   until none is above.  The words of one unit of weight grow to a fixed point.
2. Quotas.  Uncapped targets are apportioned in blocks of equal size by highest
   quotients target / (1, 3, 5, ...).  A source's quota is the number of its
   quotients at or above a bar, so no list of blocks is made; a grid search,
   one aggregate per round, brackets the bar, and the few quotients left in
   the bracket are ordered by value, then by source.  The mix is cut into
   ``shards`` of equal block counts; quotas of a longer mix never fall, so the
   difference of two neighbouring cumulative quotas is the quota of a shard.
   A capped source gives every block ``MAX_REPEAT`` times.
3. Blocks.  The documents of a source, in seeded order, form one stream of
   words cut into blocks.  Draws go through the blocks in a seeded order,
   ``(a * block + c) mod blocks``, again from the start after the last.  A
   document's words are counted from the blocks that it overlaps.  Offsets in
   the stream come from running sums over pieces, so one hot source is many tasks.

Defined cases: null or blank texts have size 0 and are never taken; a null
source is a source of its own, last in order; repeated rows are rows of their
own; an empty table gives an empty result; other columns are carried
(``mix_documents``) or ignored (``plan_mix``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import BLANKS, WORD, column, total, whole, written

MAX_REPEAT = 3
#: Largest block, in words; smaller where a unit of weight has under a thousand such blocks.
BLOCK_WORDS = 1024
#: Mean words of a piece of a source's stream.
PIECE_WORDS = 1_000_000
SHARDS, SEED, GRID, ROUNDS = 4, 42, 32, 3
#: Multipliers of the seeded order of blocks; one that has no factor in common with the number of blocks is taken.
PRIMES = (104729, 104723, 104717, 104711, 104707, 104701, 104693, 104683, 104681, 104677, 104659, 104651, 104639)


def word_count(text: Column) -> Column:
    """Runs without blank characters."""
    plain = text
    for blank in BLANKS[1:]:
        plain = F.replace(plain, F.lit(blank), F.lit(" "))
    padded = F.concat(F.lit(" "), plain)
    # a word starts where a blank is followed by something else: count blanks, less those followed by a blank
    return F.regexp_count(padded, F.lit(r" [^ ]")).cast("bigint")


def targets(sizes: DataFrame, weights: Column) -> DataFrame:
    """``sizes`` (source, size) with ``target`` and ``capped``; ``weights`` is a column over the source's 0-based ``position``."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").isNull(), "source")  # one row per source
    per = written(per.withColumn("position", F.row_number().over(order) - 1).withColumn("weight", weights.cast("double")), "mix-sources")
    cap = MAX_REPEAT * F.col("source_size")
    unit, whole_size = 0.0, total(per, F.coalesce(F.sum("source_size"), F.lit(0)))[0]
    while whole_size:
        above = cap <= F.lit(unit) * F.col("weight")
        taken, rest = total(per, F.coalesce(F.sum(F.when(above, cap)), F.lit(0)), F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0.0)))
        new = (whole_size - taken) / rest if rest else unit
        if new <= unit:
            break
        unit = new
    return per.withColumns({"capped": cap <= F.lit(unit) * F.col("weight"), "unit": F.lit(unit)}).withColumn(
        "target", F.when(F.col("capped"), cap.cast("double")).otherwise(F.col("weight") * F.col("unit")))


def _seats(bar: Column) -> Column:
    """Quotients target / (2 i + 1) at or above the bar, as many as the source has draws."""
    return F.least(F.floor(F.col("target") / (2 * bar) + 0.5), F.col("draws"))


def quotas(aims: DataFrame, block: int, shards: int = SHARDS) -> DataFrame:
    """``aims`` with ``blocks``, the cumulative quota at the end of each shard (``upto``) and per shard (``quota``)."""
    t = aims.withColumn("blocks", F.ceil(F.col("source_size") / block)).withColumn("draws", MAX_REPEAT * F.col("blocks"))
    open_ = written(t.where("NOT capped AND source_size > 0"), "mix-open")
    sources, words = total(open_, F.count(F.lit(1)), F.coalesce(F.sum("target"), F.lit(0.0)))
    houses = [round(words / block * (k + 1) / shards) for k in range(shards)]
    # bars: at the low end at least as many seats as the house, at the high end at most
    low = [words / (2 * (h + sources + 1)) for h in houses]
    high = [words if h <= sources else words / (2 * (h - sources)) for h in houses]
    rounds, bracketed = 0, not words
    while not bracketed or rounds < ROUNDS and words:
        bars = [[lo + (hi - lo) * g / GRID for g in range(GRID + 1)] for lo, hi in zip(low, high)]
        grid = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(g).alias("g"), F.lit(b).alias("bar")) for k, row in enumerate(bars) for g, b in enumerate(row)]))
        sums = open_.select("target", "draws", grid.alias("at")).groupBy("at.k", "at.g").agg(F.sum(_seats(F.col("at.bar"))).alias("seats"))
        counts = {(r.k, r.g): r.seats for r in sums.collect()}
        rounds, bracketed = rounds + 1, True
        for k in range(shards):
            if counts[k, 0] < houses[k]:  # the draws bound the seats: go lower
                low[k], bracketed = low[k] / 4, False
            else:
                at = max(g for g in range(GRID + 1) if counts[k, g] >= houses[k])
                low[k], high[k] = bars[k][at], bars[k][min(at + 1, GRID)]
    cumulative = open_.withColumns({f"upto{k}": _seats(F.lit(high[k])) if words else F.lit(0).cast("bigint") for k in range(shards)})
    for k in range(shards if words else 0):
        # the quotients between the two ends of the bracket, highest first
        left = houses[k] - (total(cumulative, F.sum(f"upto{k}"))[0] or 0)
        if left > 0:
            more = F.explode(F.sequence(F.col(f"upto{k}") + 1, _seats(F.lit(low[k]))))
            won = (cumulative.where(_seats(F.lit(low[k])) > F.col(f"upto{k}")).select("position", "target", more.alias("i"))
                   .orderBy(F.desc(F.col("target") / (2 * F.col("i") - 1)), "position").limit(left)
                   .groupBy("position").agg(F.count(F.lit(1)).alias("won")))
            cumulative = cumulative.join(won, "position", "left").withColumn(f"upto{k}", F.col(f"upto{k}") + F.coalesce("won", F.lit(0))).drop("won")
    full = t.where("capped OR source_size = 0").withColumns(
        {f"upto{k}": F.floor(F.col("draws") * (k + 1) / shards) for k in range(shards)})
    out = cumulative.unionByName(full).withColumn("upto", F.array(*[F.col(f"upto{k}").cast("bigint") for k in range(shards)]))
    return out.withColumn("quota", F.transform("upto", lambda u, k: u - F.when(k == 0, 0).otherwise(F.element_at("upto", F.greatest(k, F.lit(1)))))).drop(
        *[f"upto{k}" for k in range(shards)])


def _offsets(rows: DataFrame, words: int, seed: int) -> DataFrame:
    """``rows`` with ``begin``, the words before each in the seeded order of its source."""
    pieces = max(1, -(-words // PIECE_WORDS))
    keyed = rows.withColumn("mixed", F.xxhash64(F.lit(seed), "id")).withColumn("piece", F.pmod("mixed", F.lit(pieces)))
    local = Window.partitionBy("position", "piece").orderBy("mixed", "id", "size", "tie").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy("position").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = keyed.groupBy("position", "piece").agg(F.sum("size").alias("t")).select(
        "position", "piece", F.coalesce(F.sum("t").over(before), F.lit(0)).alias("start"))
    return keyed.withColumn("inside", F.coalesce(F.sum("size").over(local), F.lit(0))).join(starts, ["position", "piece"]).withColumn(
        "begin", F.col("start") + F.col("inside")).drop("mixed", "piece", "inside", "start")


def _draws_of(x: Column) -> Column:
    """How often block ``x`` of the row's source is drawn."""
    spot = F.pmod(F.col("step") * x + F.col("shift"), F.col("blocks"))
    return F.col("rounds") + F.when(spot < F.col("rest"), 1).otherwise(0)


def plan_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Column | None = None,
             block_words: int = BLOCK_WORDS, shards: int = SHARDS, seed: int = SEED, tie: Column | None = None) -> DataFrame:
    """Per row: id, source, size, source_size, target, quota, ``begin``, block geometry and ``taken``, repeats counted.

    ``tie`` names rows of one id and size apart where they must be told apart.
    """
    weights = F.pmod(F.col("position"), F.lit(3)) + 1 if weights is None else weights
    rows = written(docs.select(column(id_col).alias("id"), column(source_col).alias("source"), word_count(whole(text_col)).alias("size"),
                               (F.lit(0) if tie is None else tie).alias("tie")), "mix-rows")
    aims = targets(rows.select("source", "size"), weights)
    unit, words = total(aims, F.max("unit"), F.coalesce(F.sum("source_size"), F.lit(0)))
    block = max(1, min(block_words, int(unit or 0) // 1000))
    plan = quotas(aims, block, shards)
    drawn = F.element_at("upto", -1)
    free = F.filter(F.array(*[F.lit(p).cast("bigint") for p in PRIMES]), lambda p: F.col("blocks") % p != 0)
    plan = plan.withColumns({
        "block": F.lit(block).cast("bigint"), "step": F.coalesce(F.try_element_at(free, F.lit(1)), F.lit(1)), "shift": F.pmod(F.xxhash64(F.lit(seed), "position"), F.greatest("blocks", F.lit(1))),
        "rounds": F.when(F.col("blocks") > 0, F.floor(drawn / F.col("blocks"))).otherwise(0),
        "rest": F.when(F.col("blocks") > 0, drawn % F.col("blocks")).otherwise(0)})
    plan = written(plan, "mix-plan")
    named = rows.join(plan.select("source", "position").withColumnRenamed("source", "named"), F.col("source").eqNullSafe(F.col("named"))).drop("named")
    placed = _offsets(named, words, seed).join(plan.drop("source"), "position")
    first, last = F.floor(F.col("begin") / block), F.floor((F.col("begin") + F.col("size") - 1) / block)

    def overlap(x: Column) -> Column:
        return F.least(F.col("begin") + F.col("size"), (x + 1) * block) - F.greatest(F.col("begin"), x * block)

    taken = F.when(F.col("size") > 0, F.aggregate(F.sequence(first, last), F.lit(0).cast("bigint"), lambda s, x: s + _draws_of(x) * overlap(x))).otherwise(F.lit(0).cast("bigint"))
    return placed.withColumn("taken", taken)


def mix_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mixed corpus, columns of ``docs``: a row per pass over a document.

    A pass that takes all blocks of a document is the document; one that takes
    some has the text of those blocks, with the blanks between their words.
    """
    marked = written(docs.select(F.struct(*[column(c) for c in docs.columns]).alias("row"), F.monotonically_increasing_id().alias("at")), "mix-docs")
    flat = marked.select(F.col("row")[id_col].alias("id"), F.col("row")[text_col].alias("text"), F.col("row")[source_col].alias("source"), "at")
    plan = plan_mix(flat, "id", "text", "source", tie=F.col("at"), **options).where("taken > 0")
    first, last = F.floor(F.col("begin") / F.col("block")), F.floor((F.col("begin") + F.col("size") - 1) / F.col("block"))
    draws = F.transform(F.sequence(first, last), lambda x: F.struct(
        (F.greatest(F.col("begin"), x * F.col("block")) - F.col("begin")).alias("word"),
        (F.least(F.col("begin") + F.col("size"), (x + 1) * F.col("block")) - F.col("begin")).alias("end"), _draws_of(x).alias("n")))
    passes = plan.select(F.col("tie").alias("at"), draws.alias("draws")).select(
        "at", "draws", F.explode(F.sequence(F.lit(1).cast("bigint"), F.array_max(F.transform("draws", lambda d: d.n)))).alias("pass"))
    parts = passes.select("at", F.filter("draws", lambda d: d.n >= F.col("pass")).alias("parts"),
                          (F.array_min(F.transform("draws", lambda d: d.n)) >= F.col("pass")).alias("all"))
    joined = marked.join(written(parts, "mix-passes"), "at")
    words = F.regexp_extract_all(F.col("row")[text_col], F.lit(rf"({WORD}[\x20\x09-\x0D]*)"))
    # the words are found once: a one-element array binds them
    cut = F.transform(F.array(words), lambda w: F.array_join(F.flatten(F.transform(
        "parts", lambda d: F.slice(w, (d.word + 1).cast("int"), (d.end - d.word).cast("int")))), ""))
    text = F.when(F.col("all"), F.col("row")[text_col]).otherwise(F.element_at(cut, 1))
    new = joined.select("row", text.alias("text"))
    return new.select(*[F.col("text").alias(c) if c == text_col else F.length("text").cast("bigint").alias(c) if c == "n_chars" else F.col("row")[c].alias(c)
                        for c in docs.columns])
