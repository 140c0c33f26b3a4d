"""SimHash fingerprints of documents, and a search for all within a Hamming radius.

Terms are the words of a text and its pairs of neighbouring words, A-Z
lower-cased, each once, weighted by the logarithm of their length: short
function words say least.  A term's 64-bit hash votes with its weight for each
set bit and against each other bit; the sign of the sum is the fingerprint's
bit.  ``likeness`` estimates the cosine of two term vectors from the share of
differing bits.

Search.  The bits are cut into ``radius + 3`` blocks; whatever ``radius`` bits
differ, three blocks are equal.  For each choice of three blocks there is a
table whose key is those blocks; equal keys give candidates, the Hamming
distance decides.  A pair is reported by the first table that holds it.

``edit_and_compare`` reads documents in descending id order: rows are dealt by
the range of their id, sorted in their piece and read as a stream, and each
piece is also sent the first row of the next, so a text is moved once.

Defined cases: null is empty; a text without words has fingerprint zero;
repeated ids are ordered by text; null ids come last; a single row is its own
next row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import column, fold, whole

BITS, RADIUS, SPARE = 64, 3, 3
#: Terms voted at once, and words of which a task remembers the hash.
BLOCK, REMEMBER = 8192, 500_000


class Hasher:
    """Word hashes, remembered within a task up to a bound."""

    def __init__(self) -> None:
        self.known: dict[bytes, int] = {}

    def __call__(self, words: list[bytes]) -> np.ndarray:
        known = self.known
        if len(known) > REMEMBER:
            known.clear()
        for w in set(words):
            if w not in known:
                known[w] = xxhash.xxh64_intdigest(w, 0)
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def _stir(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(29))


def fingerprint(text: str, hasher: Hasher) -> int:
    words = text.encode("utf-8", "replace").translate(fold).split()
    if not words:
        return 0
    h = hasher(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    terms = np.concatenate([_stir(h), _stir(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:])])
    size = np.concatenate([size, size[:-1] + size[1:] + 1])
    terms, first = np.unique(terms, return_index=True)
    weight = np.log1p(size[first]).astype(np.float32)
    votes = np.zeros(BITS, np.float64)
    for at in range(0, len(terms), BLOCK):
        bits = np.unpackbits(terms[at:at + BLOCK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += weight[at:at + BLOCK] @ bits.astype(np.float32)
    return int(np.packbits(2 * votes > weight.sum(dtype=np.float64), bitorder="little").view(np.uint64)[0])


def likeness(a: int, b: int) -> float:
    """Cosine estimated from two fingerprints, not below 0."""
    return max(0.0, math.cos(math.pi * (a ^ b).bit_count() / BITS))


def _place(ident: Column, cuts: list[int]) -> Column:
    """How many of the descending cuts are above the id: first among every ``step``-th, then in one stretch."""
    step = max(1, math.isqrt(len(cuts)))

    def above(edges: Column) -> Column:
        return F.aggregate(edges, F.lit(0), lambda s, c: s + F.when(c > ident, 1).otherwise(0))

    all_, coarse = (F.array(*[F.lit(c) for c in x]).cast("array<bigint>") for x in (cuts, cuts[step - 1::step]))
    found = above(coarse) * step
    return F.when(ident.isNull(), F.lit(len(cuts))).otherwise(found + above(F.slice(all_, found + 1, F.lit(step))))


def _chained(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(piece, tail, id, text) with the first row of each piece also at the end of the piece before it."""
    rows = docs.select(column(id_col).cast("bigint").alias("id"), whole(text_col).alias("text"))
    n = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = rows.agg(F.percentile_approx("id", [k / n for k in range(1, n)], 10 * n)).first()[0] or []
    cuts = sorted(set(cuts), reverse=True)  # a bounded number of cut points
    place = _place(F.col("id"), cuts)
    heads = rows.select(place.alias("piece"), F.struct(F.col("id").isNull().alias("no_id"), (-F.col("id")).alias("id"), F.xxhash64("text").alias("h")).alias("o")).groupBy("piece").agg(
        F.min("o").alias("o"))
    heads = sorted(heads.select("piece", (-F.col("o.id")).alias("id"), F.col("o.h").alias("h")).collect())  # at most a row per piece
    known = {r.piece: (r.id, r.h, heads[k - 1].piece) for k, r in enumerate(heads)}  # the first is also sent to the last
    info = F.array(*[F.struct(*[F.lit(v).cast("bigint").alias(n) for n, v in zip(("id", "h", "before"), known.get(p, (None,) * 3))]) for p in range(len(cuts) + 1)])
    placed = rows.withColumn("piece", place).withColumn("info", F.element_at(info, F.col("piece") + 1))
    is_head = F.col("id").eqNullSafe(F.col("info.id")) & (F.xxhash64("text") == F.col("info.h"))
    own = F.struct(F.col("piece").cast("bigint").alias("piece"), F.lit(False).alias("tail"))
    twice = F.when(is_head, F.array(own, F.struct(F.col("info.before").alias("piece"), F.lit(True).alias("tail")))).otherwise(F.array(own))
    return placed.select(F.explode(twice).alias("at"), "id", "text").select("at.piece", "at.tail", "id", "text")


RESULT = ("id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def edit_and_compare(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text beside its edited form: the last half replaced by the first characters, as many, of the next text by descending id."""
    names = [f.split()[0] for f in RESULT.split(", ")]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, before = Hasher(), None  # before: (piece, id, text, fingerprint)
        for batch in batches:
            out = []
            for piece, tail, ident, text in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if tail and before is None:
                    continue
                if tail and before[0] != piece:
                    continue
                own = fingerprint(text, hasher)
                if before is not None and before[0] == piece:
                    _, i, t, fp = before
                    half = len(t) // 2
                    edited = t[:len(t) - half] + text[:half]
                    changed = fingerprint(edited, hasher)
                    out.append((i, len(t), hashlib.sha256(edited.encode("utf-8", "replace")).hexdigest(), f"{fp:016x}", f"{changed:016x}",
                                likeness(fp, changed), likeness(fp, own)))
                before = None if tail else (piece, ident, text, own)
            if out:
                yield pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*out)))), pa.schema(
                    [(n, pa.int64() if n in ("id", "n_chars") else pa.float64() if n.startswith("near") else pa.string()) for n in names]))

    rows = _chained(docs, id_col, text_col)
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionById(n, (F.col("piece") % n).cast("int")).sortWithinPartitions("piece", "tail", F.desc_nulls_last("id"), F.xxhash64("text"))
    return ordered.mapInArrow(compare, RESULT).withColumnRenamed("id", id_col)


def add_fingerprint(docs: DataFrame, text_col: str = "text", out: str = "fp") -> DataFrame:
    """``docs`` with the fingerprint as a signed 64-bit number."""

    @F.pandas_udf("bigint")
    def of(texts: pd.Series) -> pd.Series:
        hasher = Hasher()
        return pd.Series(np.array([fingerprint(t, hasher) for t in texts], np.uint64).view(np.int64))

    return docs.withColumn(out, of(whole(text_col)))


def _tables(radius: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """(table, its blocks as (first bit, width)): every choice of three of radius + 3 blocks."""
    edges = [round(BITS * k / (radius + SPARE)) for k in range(radius + SPARE + 1)]
    blocks = [(a, b - a) for a, b in zip(edges, edges[1:])]
    return list(enumerate([list(c) for c in combinations(blocks, SPARE)]))


def _key(fp: Column, blocks: list[tuple[int, int]]) -> Column:
    """The bits of some blocks, the others cleared."""
    mask = sum(((1 << width) - 1) << first for first, width in blocks)
    return fp.bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask).cast("bigint"))


def find_within(queries: DataFrame, fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """All (query, fp, distance) with distance at most ``radius``, of two frames of distinct ``fp``."""
    tables = _tables(radius)

    def dealt(df: DataFrame) -> DataFrame:
        return df.select("fp", F.explode(F.array(*[F.struct(F.lit(t).alias("t"), _key(F.col("fp"), blocks).alias("k")) for t, blocks in tables])).alias("x")).select(
            "fp", "x.t", "x.k")

    x = F.col("query").bitwiseXOR(F.col("fp"))
    first = F.coalesce(*[F.when(_key(x, blocks) == 0, F.lit(t)) for t, blocks in tables])
    pairs = dealt(queries).withColumnRenamed("fp", "query").join(dealt(fps), ["t", "k"])
    return pairs.where((F.bit_count(x) <= radius) & (first == F.col("t"))).select("query", "fp", F.bit_count(x).alias("distance"))
