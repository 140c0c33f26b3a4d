"""Near copies: SimHash fingerprints linked within a Hamming radius, candidates pruned by chains of segments.

A 64-bit fingerprint is a ring of four 16-bit segments.  If two fingerprints
differ in at most three bits, then from some segment on every chain of
``l`` consecutive segments differs in at most ``floor(3 * l / 4)`` bits: 0, 1, 2,
3.  The chain of length two is the join key: its first segment must be equal,
its second may have one bit more on one side, so each fingerprint is stored
under its 32 bits and looked up under those with one zero bit set.  Longer
chains are checked in the bucket, last the whole ring.

Equal fingerprints are one node, so a group of copies is one row.  In a bucket
links are found by a search that visits each fingerprint once and returns a
spanning forest of the bucket's links: no link between components is lost, and
a dense group does not give all its pairs.  Components grow by large-star and
small-star steps, as joins and map-side combined minima; every step is cut by
a checkpoint.

``keep_one_of_alike`` takes these links as candidates and lets the texts decide:
word sets of ``WORDS``-word shingles with a Jaccard similarity of ``ALIKE`` or
more.  Many such pairs differ in about 10 bits of 64 and often in 15, where chains
of segments prune nothing, so candidates beyond the radius come from MinHash:
``BANDS`` keys of ``ROWS`` minima each, of which a pair at 0.8 shares none with
chance 5e-6.  In a bucket, pairs whose sketches of
``LANES`` half bytes agree in ``NEAR`` or more are searched for a spanning forest;
its components, the families, hold every candidate above.  Links are decided by
the exact similarity of shingle sets.  A large family is cut by size class and
hash into cells, and each pair of cells that may hold alike sets is a tile of its
own, in any task, which returns a spanning forest of its links.

Defined cases: null and blank texts have fingerprint zero and are linked like
others; repeated rows share their component; null ids are no candidates for the
smallest id; an empty table gives an empty result; other columns are carried
(``keep_one``) or ignored (``find_groups``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import column, fold, shared_dir, whole, written

RADIUS, SHINGLE, SEED = 3, 3, 42
#: Words of a shingle and least Jaccard similarity of ``keep_one_of_alike``.
WORDS, ALIKE = 5, 0.8
#: Minima of a key, keys of a text, half bytes of a sketch and how many of them candidates share (five deviations below 0.8).
ROWS, BANDS, LANES, NEAR = 6, 40, 64, 36
#: Elements of shingle sets in a block of a family (a tile holds two blocks, a longer set is its own); elements compared at once.
TILE, AT_ONCE = 1 << 22, 1 << 20
#: Sizes of alike sets differ by less than this factor (1 / ``ALIKE``, and a margin for rounding): they are in one size class or in neighbours.
STEP = 1.26
#: Hashes counted at once; keeps the bit table of a long text small.
BLOCK = 8192
#: Runs of a bucket up to this length are compared by shifting, longer ones by search.
SHORT_RUN = 16


def simhash(text: str, size: int = SHINGLE, seed: int = SEED) -> int:
    """Bits set in over half of the XXH64 values of the word shingles."""
    words = text.encode("utf-8", "replace").translate(fold).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    ends = ends.tolist()[min(size, len(words)) - 1:]
    digest = xxhash.xxh64_intdigest
    ones, n = np.zeros(64, np.int64), len(ends)
    for at in range(0, n, BLOCK):
        stop = min(n, at + BLOCK)
        h = np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts[at:stop], ends[at:stop])), np.uint64, stop - at)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprint(text: Column) -> Column:
    """SimHash as a signed 64-bit number."""

    @F.pandas_udf("bigint")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([simhash(t) for t in texts], np.uint64).view(np.int64))

    return of(text)


def hex16(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def _keys(fps: DataFrame) -> DataFrame:
    """(key, fp): a fingerprint under its own two-segment chain at each of the four starts, and under those with one zero bit set."""
    turn = F.transform(F.array(*[F.lit(i) for i in range(4)]), lambda i: F.struct(
        i.alias("i"), F.call_function("shiftrightunsigned", F.when(i == 0, F.col("fp")).otherwise(
            F.call_function("shiftleft", F.col("fp"), i * 16).bitwiseOR(F.call_function("shiftrightunsigned", F.col("fp"), F.lit(64) - i * 16))), F.lit(32)).alias("k")))
    starts = fps.select("fp", F.explode(turn).alias("t")).select("fp", "t.i", "t.k")
    flips = F.array(F.lit(0).cast("bigint"), *[F.lit(1 << b).cast("bigint") for b in range(16)])
    free = F.filter(flips, lambda m: m.bitwiseAND(F.col("k")) == 0)
    return starts.select(F.explode(F.transform(free, lambda m: m.bitwiseOR(F.col("k")).bitwiseOR(
        F.call_function("shiftleft", F.col("i").cast("bigint"), F.lit(32))))).alias("key"), "fp")


def _close(x: np.ndarray, turn: np.ndarray, radius: int) -> np.ndarray:
    """Chain of three segments within its budget, then the whole ring."""
    turn = turn.astype(np.uint64) * np.uint64(16)
    ring = np.where(turn == 0, x, (x << turn) | (x >> (np.uint64(64) - np.maximum(turn, np.uint64(1)))))
    hit = np.bitwise_count(ring >> np.uint64(16)) <= radius * 3 // 4
    hit[hit] = np.bitwise_count(x[hit]) <= radius
    return hit


def _forest(fps: np.ndarray, turn: int, radius: int) -> tuple[list, list]:
    """Spanning forest of the links inside one bucket; every fingerprint is visited once."""
    a, b, left = [], [], np.arange(len(fps))
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            heads = queue[-256:]
            del queue[-256:]
            for head in heads:
                x = fps[left] ^ fps[head]
                hit = _close(x, np.full(len(x), turn), radius)
                if hit.any():
                    found = left[hit]
                    a.append(np.full(len(found), fps[head]))
                    b.append(fps[found])
                    queue.extend(found)
                    left = left[~hit]
    return a, b


def _bucket_links(keys: np.ndarray, fps: np.ndarray, radius: int) -> pa.RecordBatch:
    a, b = [], []
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    length = np.diff(np.r_[first, len(keys)])
    run = np.repeat(length, length)
    small = run <= SHORT_RUN
    k, f = keys[small & (run > 1)], fps[small & (run > 1)]
    for step in range(1, SHORT_RUN):
        if len(k) <= step:
            break
        same = np.flatnonzero(k[step:] == k[:-step])
        x = f[same + step] ^ f[same]
        hit = same[(x != 0) & _close(x, k[same] >> 32, radius)]
        a.append(f[hit])
        b.append(f[hit + step])
    for at, n in zip(first[length > SHORT_RUN], length[length > SHORT_RUN]):
        more = _forest(np.unique(fps[at:at + n]), int(keys[at] >> 32), radius)
        a += more[0]
        b += more[1]
    cat = [np.concatenate(x).view(np.int64) if x else np.empty(0, np.int64) for x in (a, b)]
    return pa.record_batch([pa.array(cat[0]), pa.array(cat[1])], names=["a", "b"])


def links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (a, b) that connect exactly the fingerprints joined by pairs within ``radius`` bits (three at most)."""
    assert 0 <= radius <= RADIUS

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, held = np.empty(0, np.int64), np.empty(0, np.uint64)
        for batch in batches:
            keys = np.concatenate([keys, batch.column(0).to_numpy()])
            held = np.concatenate([held, batch.column(1).to_numpy().view(np.uint64)])
            cut = np.searchsorted(keys, keys[-1]) if len(keys) else 0
            if cut:
                yield _bucket_links(keys[:cut], held[:cut], radius)
                keys, held = keys[cut:], held[cut:]
        if len(keys):
            yield _bucket_links(keys, held, radius)

    keys = _keys(fps)
    n = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return keys.repartition(n, "key").sortWithinPartitions("key").mapInArrow(find, "a bigint, b bigint")


def _cut(df: DataFrame) -> DataFrame:
    """Checkpoint in the shared folder."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_dir(df.sparkSession, "checkpoints"))
    return df.checkpoint()


def components(pairs: DataFrame) -> DataFrame:
    """(node, root): every node of the links (a, b) with the smallest node of its component."""
    e = _cut(pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    seen = None
    while True:
        now = tuple(e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())
        if now == seen:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        seen = now
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # the minima are cut off too: an aggregate in the same stage would keep the skew join from splitting a hub
        least = _cut(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = _cut(large)
        least = _cut(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        e = _cut(small.distinct())


def groups_of(rows: DataFrame, least: Column, radius: int = RADIUS, link: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(fp, root, best): each distinct fingerprint of ``rows`` (fp, ...) with its component and the least ``least`` in it.

    ``link`` makes the links of the nodes (fp, best) in place of the Hamming radius.
    """
    nodes = written(rows.groupBy("fp").agg(F.min(least).alias("best")), "near-nodes")
    roots = _cut(components(link(nodes) if link else links(nodes.select("fp"), radius)))
    joined = nodes.join(roots.withColumnRenamed("node", "fp"), "fp")
    best = joined.groupBy("root").agg(F.min("best").alias("best"))
    linked = joined.select("fp", "root").join(best, "root").select("fp", "root", F.col("best").alias("least"))
    return nodes.join(linked, "fp", "left").select(
        "fp", F.coalesce("root", "fp").alias("root"), F.when(F.col("root").isNull(), F.col("best")).otherwise(F.col("least")).alias("best"))


def find_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """Per row: id, ``fingerprint`` (16 hex digits) and ``component_id``, the smallest id reachable over links."""
    rows = written(docs.select(column(id_col).alias("id"), fingerprint(whole(text_col)).alias("fp")), "near-rows")
    groups = written(groups_of(rows, F.col("id"), radius), "near-groups")
    return rows.join(groups, "fp").select(F.col("id").alias(id_col), hex16(F.col("fp")).alias("fingerprint"), F.col("best").alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """The rows of ``docs``, all columns, with one of each component: smallest id, null ids last."""
    marked = written(docs.select(F.struct(*[column(c) for c in docs.columns]).alias("row"), fingerprint(whole(text_col)).alias("fp"),
                                 F.monotonically_increasing_id().alias("at")), "near-docs")
    rank = F.struct(F.col("row")[id_col].isNull().alias("no_id"), F.col("row")[id_col].alias("id"), F.col("at"))
    thin = marked.select("fp", "at", rank.alias("rank"))
    groups = written(groups_of(thin, F.col("rank"), radius).select("fp", "best"), "near-groups")
    dropped = thin.join(groups, "fp").where(F.col("best.at") != F.col("at")).select("at")
    return marked.join(written(dropped, "near-dropped"), "at", "left_anti").select("row.*")


def shingles(text: str, size: int = WORDS, seed: int = SEED) -> np.ndarray:
    """XXH64 values of the word shingles, distinct and in order; a shorter text is one shingle, a blank one none."""
    words = text.encode("utf-8", "replace").translate(fold).split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    ends = ends.tolist()[min(size, len(words)) - 1:]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts, ends)), np.uint64, len(ends)))


def _minima(h: np.ndarray, by: np.ndarray) -> np.ndarray:
    """Least value of the set under each of the multipliers, the high half of a product counting."""
    least = np.full(len(by), (1 << 64) - 1, np.uint64)
    for at in range(0, len(h), BLOCK // 8):
        x = (h[at:at + BLOCK // 8, None] ^ by[None, :]) * np.uint64(0x9E3779B97F4A7C15)
        least = np.minimum(least, ((x ^ x >> np.uint64(32)) * (by | np.uint64(1))[None, :]).min(0))
    return least


def _multipliers() -> np.ndarray:
    return np.random.default_rng(SEED).integers(1, 1 << 64, ROWS * BANDS, np.uint64, endpoint=False)


def _marks(text: Column) -> Column:
    """(fp, n, sim, keys, sketch): digest and size of the shingle set, SimHash of the text, the set's bands' keys, and half bytes of its first minima."""

    @F.pandas_udf("fp bigint, n bigint, sim bigint, keys array<bigint>, sketch binary")
    def of(texts: pd.Series) -> pd.DataFrame:
        by, band = _multipliers(), np.arange(BANDS, dtype=np.uint64)
        fps, sizes, keys, sketches = [], [], [], []
        for t in texts:
            h = shingles(t)
            sizes.append(len(h))
            fps.append(xxhash.xxh64_intdigest(h.tobytes(), SEED))
            least = _minima(h, by)
            keys.append(np.array([xxhash.xxh64_intdigest(r.tobytes(), b) for b, r in zip(band.tolist(), least.reshape(BANDS, ROWS))], np.uint64).view(np.int64))
            half = (least[:LANES] >> np.uint64(20)).astype(np.uint8) & 15
            sketches.append((half[::2] | half[1::2] << 4).tobytes())
        sims = np.array([simhash(t) for t in texts], np.uint64).view(np.int64)
        return pd.DataFrame({"fp": np.array(fps, np.uint64).view(np.int64), "n": np.array(sizes, np.int64), "sim": sims, "keys": keys, "sketch": sketches})

    return of(text)


def _search(n: int, near: Callable[[int, np.ndarray], np.ndarray]) -> tuple[list[int], list[int]]:
    """Spanning forest over places 0 to n - 1; ``near`` (place, places) tells which are linked. Every place is visited once."""
    a, b, left = [], [], np.arange(n)
    while len(left) > 1:
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            head = queue.pop()
            hit = near(head, left)
            found = left[hit].tolist()
            a += [head] * len(found)
            b += found
            queue += found
            left = left[~hit]
    return a, b


def _by_fingerprint(marks: DataFrame) -> DataFrame:
    """Links (a, b) that join the ``fp`` of ``marks`` (fp, sim) whose SimHash fingerprints are equal or linked.

    A ``fp`` is tied to its fingerprint and fingerprints to each other, so equal ones give no pairs.
    """
    near = written(links(marks.select(F.col("sim").alias("fp")).distinct()), "alike-links")
    equal = marks.groupBy("sim").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("sim")
    met = near.select(F.explode(F.array("a", "b")).alias("sim")).unionByName(equal).distinct()
    return near.unionByName(marks.join(written(met, "alike-met"), "sim").select(F.col("fp").alias("a"), F.col("sim").alias("b")))


def _candidates(marks: DataFrame, near_lanes: int) -> DataFrame:
    """Links (a, b) of ``marks`` (fp, keys, sketch; distinct fp) whose components hold all pairs with a common key and that many equal half bytes."""
    width = LANES // 2

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty((0, width), np.uint8)]

        def forests(keys: np.ndarray, fps: np.ndarray, sketches: np.ndarray) -> pa.RecordBatch:
            first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            length = np.diff(np.r_[first, len(keys)])
            out = [[], []]
            for at, n in zip(first[length > 1].tolist(), length[length > 1].tolist()):
                s = sketches[at:at + n]

                def near(head: int, left: np.ndarray) -> np.ndarray:
                    x = s[left] ^ s[head]
                    return ((x & 15) == 0).sum(1) + ((x >> 4) == 0).sum(1) >= near_lanes

                for side, places in zip(out, _search(n, near)):
                    side += fps[at:at + n][places].tolist()
            return pa.record_batch([pa.array(x, pa.int64()) for x in out], names=["a", "b"])

        for batch in batches:
            new = [batch.column(0).to_numpy(), batch.column(1).to_numpy(), np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(-1, width)]
            held = [np.concatenate(x) for x in zip(held, new)]
            cut = int(np.searchsorted(held[0], held[0][-1])) if len(held[0]) else 0
            if cut:
                yield forests(*[x[:cut] for x in held])
                held = [x[cut:] for x in held]
        if len(held[0]):
            yield forests(*held)

    keys = marks.select(F.explode("keys").alias("key"), "fp", "sketch")
    n = int(marks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return keys.repartition(n, "key").sortWithinPartitions("key").mapInArrow(find, "a bigint, b bigint")


def _tiled(nodes: DataFrame, tile: int) -> DataFrame:
    """``nodes`` (root, fp, n, ...) with ``tiles``: the pairs of cells (p, q) in which a node is compared, and whether it stands on the side of q.

    A family of up to ``tile`` elements is one cell.  A larger one is cut by size class, a
    class by hash into cells of about ``tile`` elements.  A cell meets itself and the cells of
    its class and the next ones, where alike sets are; each such pair of cells is a tile.
    """
    size_class = F.floor(F.log(F.greatest("n", F.lit(1))) / F.log(F.lit(STEP))).cast("int")
    sums = nodes.groupBy("root", size_class.alias("c")).agg(F.sum("n").alias("t"))
    classes = sums.groupBy("root").agg(F.sum("t").alias("t"), F.map_from_entries(F.collect_list(F.struct("c", F.ceil(F.col("t") / tile).alias("cells")))).alias("cells"))
    large = classes.where(F.col("t") > tile).select("root", "cells")
    # written first, so that the join is of plain shuffles and a large family can be split
    placed = nodes.join(written(large, "alike-large"), "root", "left").withColumn("c", size_class)

    def cell(c: Column, block: Column) -> Column:
        return c.cast("bigint") * F.lit(1 << 32) + block

    own = cell(F.col("c"), F.pmod(F.xxhash64("fp"), F.element_at("cells", F.col("c"))))
    rows = placed.withColumn("own", F.when(F.col("cells").isNotNull(), own))
    others = F.flatten(F.transform(F.array(F.col("c") - 1, F.col("c"), F.col("c") + 1), lambda c: F.when(
        F.coalesce(F.try_element_at("cells", c), F.lit(0)) > 0, F.transform(F.sequence(F.lit(0).cast("bigint"), F.element_at("cells", c) - 1), lambda b: cell(c, b))
    ).otherwise(F.array().cast("array<bigint>"))))
    pairs = F.transform(others, lambda o: F.struct(F.least("own", o).alias("p"), F.greatest("own", o).alias("q"), (F.col("own") > o).alias("right")))
    single = F.array(F.struct(F.lit(0).cast("bigint").alias("p"), F.lit(0).cast("bigint").alias("q"), F.lit(False).alias("right")))
    return rows.withColumn("tiles", F.when(F.col("cells").isNull(), single).otherwise(pairs)).drop("c", "cells", "own")


def _confirmed(sets: DataFrame, alike: float) -> DataFrame:
    """Links (a, b) between the sets of each tile of ``sets`` (root, p, q, right, fp, hashes) that connect what pairs of that similarity connect.

    In a tile of two cells only sets of different cells are compared.
    """

    def forest(fps: list[int], right: list[bool], raws: list[bytes]) -> pa.RecordBatch:
        size, side, data = np.array([len(r) // 8 for r in raws]), np.array(right), np.frombuffer(b"".join(raws), np.uint64)
        start, both = np.r_[0, np.cumsum(size)], side.any()

        def near(head: int, left: np.ndarray) -> np.ndarray:
            own, hit = data[start[head]:start[head + 1]], np.zeros(len(left), bool)
            fits = np.minimum(size[left], len(own)) >= alike * np.maximum(size[left], len(own)) - 1e-9
            likely = np.flatnonzero(fits & (side[left] != side[head]) if both else fits)
            step = np.r_[0, np.cumsum(size[left[likely]])] // AT_ONCE
            for block in np.split(likely, np.flatnonzero(np.diff(step[:-1])) + 1) if len(likely) else []:
                rows = left[block]
                flat = np.concatenate([data[start[i]:start[i + 1]] for i in rows])
                same = own[np.minimum(np.searchsorted(own, flat), len(own) - 1)] == flat
                common = np.add.reduceat(same.astype(np.int64), np.r_[0, np.cumsum(size[rows])[:-1]])
                hit[block] = common >= alike * (size[rows] + len(own) - common) - 1e-9
            return hit

        a, b = _search(len(fps), near)
        return pa.record_batch([pa.array([fps[i] for i in x], pa.int64()) for x in (a, b)], names=["a", "b"])

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, ([], [], [])
        for batch in batches:
            for root, p, q, *values in zip(*(batch.column(k).to_pylist() for k in range(6))):
                # cells of one side only have nothing to meet
                if (root, p, q) != now:
                    if held[0] and (now[1] == now[2] or len(set(held[1])) == 2):
                        yield forest(*held)
                    now, held = (root, p, q), ([], [], [])
                for column_, value in zip(held, values):
                    column_.append(value)
        if held[0] and (now[1] == now[2] or len(set(held[1])) == 2):
            yield forest(*held)

    n = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tiles = sets.select("root", "p", "q", "fp", "right", "hashes")
    return tiles.repartition(n, "root", "p", "q").sortWithinPartitions("root", "p", "q").mapInArrow(confirm, "a bigint, b bigint")


def _alike_groups(marked: DataFrame, thin: DataFrame, alike: float, near_lanes: int, tile: int) -> DataFrame:
    """(fp, root, best) of the rows of ``marked`` (at, fp, n, sim, keys, sketch, text); ``thin`` has their (fp, at, rank)."""

    @F.pandas_udf("binary")
    def hashes(texts: pd.Series) -> pd.Series:
        return pd.Series([shingles(t).tobytes() for t in texts], dtype=object)

    def link(nodes: DataFrame) -> DataFrame:
        ones = nodes.select("fp", F.col("best.at").alias("at"))
        marks = marked.select("at", "n", "sim", "keys", "sketch").join(ones, "at")
        sims = written(marks.select("fp", "sim"), "alike-sims")
        coarse = components(_by_fingerprint(sims).unionByName(_candidates(marks.select("fp", "keys", "sketch"), near_lanes)))
        chosen = written(marks.select("fp", "at", "n").join(coarse.withColumnRenamed("node", "fp"), "fp"), "alike-chosen")
        tiled = _tiled(chosen, tile).select("root", "fp", "at", "tiles")
        sets = marked.select("at", "text").join(tiled, "at").select("root", "fp", "tiles", hashes(F.col("text")).alias("hashes"))
        return _confirmed(sets.select("root", "fp", "hashes", F.explode("tiles").alias("t")).select("root", "t.p", "t.q", "t.right", "fp", "hashes"), alike)

    return groups_of(thin, F.col("rank"), link=link)


def keep_one_of_alike(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", alike: float = ALIKE, near_lanes: int = NEAR, tile: int = TILE) -> DataFrame:
    """The rows of ``docs``, all columns, with one of each group joined by pairs whose shingle sets are ``alike`` (0.8 at least): smallest id, null ids last.

    SimHash links and, beyond their radius, MinHash propose pairs; the sets decide.  ``near_lanes``
    of 0 leaves the sketches out: then every pair with a common key is compared by its sets.
    """
    assert ALIKE <= alike <= 1
    marks = docs.select(F.struct(*[column(c) for c in docs.columns]).alias("row"), _marks(whole(text_col)).alias("marks"), F.monotonically_increasing_id().alias("at"))
    marked = written(marks.select("row", "at", "marks.*"), "alike-docs")
    rank = F.struct(F.col("row")[id_col].isNull().alias("no_id"), F.col("row")[id_col].alias("id"), F.col("at"))
    thin = marked.select("fp", "at", rank.alias("rank"))
    groups = _alike_groups(marked.withColumn("text", whole(F.col("row")[text_col])), thin, alike, near_lanes, tile).select("fp", "best")
    groups = written(groups, "alike-groups")
    dropped = thin.join(groups, "fp").where(F.col("best.at") != F.col("at")).select("at")
    return marked.join(written(dropped, "alike-dropped"), "at", "left_anti").select("row.*")
