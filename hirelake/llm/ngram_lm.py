"""Interpolated modified Kneser-Ney bigram model, counted in Spark, kept as sorted hash arrays that workers memory-map.

Tokens are words, A-Z lower-cased, then one end; the end before the first word
is its context.  Tokens are 64-bit hashes.  Counting tasks combine what they
read into sorted arrays of distinct keys and counts, cut into shards by key
range; a shuffle brings the arrays of a shard together, where they are merged.
Only arrays travel: a row is one array of one task and shard.

1. Tokens: hash, count.  ``N`` and ``V`` are their sums.  Tokens with over
   ``N / FREQUENT`` occurrences, at most ``FREQUENT`` by definition, are listed.
2. Pairs (u, w): hash of the pair, count.  A shard holds a range of ``u``, so it
   also has N1, N2, N3+ of each context; the pairs of a listed ``u`` are dealt
   over all shards, and only its sums are added up afterwards.
3. Continuations: how many contexts each ``w`` follows, from the merged pairs.

Each shard is a file in the shared folder: keys in ascending order, then
values.  A scorer maps the files, sorts the distinct keys of a batch and
searches them shard by shard, so each array is passed over in order.  On a store
that cannot be mapped a file is first copied to the task's temporary folder.

P(w|u) = max(c - D(c), 0) / c(u) + g(u) * Pc(w); Pc is the same over
continuation counts, and ends in 1 / (V + 1), the share of one unknown type.
Discounts of both orders come from counts of counts.  The order is two: with
longer n-grams the arrays of this corpus would outgrow the disk allowed.

Defined cases: null is empty; an empty text is its end; repeated rows count as
often as they occur; without training rows every token has the chance 1; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from .shared import column, fold, remainder, shared_dir, total, whole, written
from .warc import _store as store

FREQUENT = 10_000
#: Tokens that a counting task combines at once, tokens that a scoring task looks up at once, words of which it remembers the hash.
HELD, BATCH, REMEMBER = 3_000_000, 1_000_000, 400_000
#: Counts are bytes; from this value on they are in a list beside them.
WIDE = 255
ADD = 0.1
_U = np.uint64
#: Hash of the end of a text; no word hashes to it but by chance.
END = 0x9AE16A3B2F90404F


class Tokens:
    """Token hashes of texts."""

    def __init__(self) -> None:
        self.known: dict[bytes, int] = {}

    def of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all texts, each ended, and the number of tokens of each."""
        if len(self.known) > REMEMBER:
            self.known.clear()
        known, out, sizes = self.known, [], []
        for t in texts:
            words = t.encode("utf-8", "replace").translate(fold).split()
            for w in set(words).difference(known):
                known[w] = xxhash.xxh64_intdigest(w, 7)
            out.append(np.fromiter(map(known.__getitem__, words), _U, len(words)))
            out.append(np.array([END], _U))
            sizes.append(len(words) + 1)
        return np.concatenate(out) if out else np.empty(0, _U), np.array(sizes, np.int64)


def before(tokens: np.ndarray) -> np.ndarray:
    """The token before each; texts follow one another, so before a first word stands an end."""
    return np.concatenate([np.array([END], _U), tokens[:-1]])


def pair_key(u: np.ndarray, w: np.ndarray) -> np.ndarray:
    h = (u ^ u >> _U(31)) * _U(0x9E3779B97F4A7C15) + w
    h = (h ^ h >> _U(33)) * _U(0xFF51AFD7ED558CCD)
    return h ^ h >> _U(29)


def short(h: np.ndarray) -> np.ndarray:
    """40 bits of a token hash, as five bytes: what travels with a pair."""
    return np.ascontiguousarray((h >> _U(24)).view(np.uint8).reshape(-1, 8)[:, :5])


def unshort(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(raw, np.uint8).reshape(-1, 5)
    return out.view(_U).ravel() << _U(24)


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order, their summed counts, and the place of one row of each."""
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]]) if len(k) else np.empty(0, np.int64)
    return k[first], np.add.reduceat(counts[order], first) if len(k) else counts, order[first]


def shard_of(h: np.ndarray, shards: int) -> np.ndarray:
    """Key ranges of equal width."""
    return ((h >> _U(32)) * _U(shards) >> _U(32)).astype(np.int64)


class Store:
    """Files of one folder, written whole under the task's own name, read as maps."""

    def __init__(self, folder: str) -> None:
        self.fs, self.path = store(folder)
        self.copies: list[str] = []

    def write(self, name: str, *arrays: np.ndarray) -> str:
        self.fs.create_dir(self.path, recursive=True)
        file = f"{self.path}/{name}-{TaskContext.get().taskAttemptId() if TaskContext.get() else 0}"
        with self.fs.open_output_stream(file, compression=None) as out:
            for a in arrays:
                out.write(np.ascontiguousarray(a).tobytes())
        return file

    def map(self, file: str) -> np.ndarray:
        if not isinstance(self.fs, pafs.LocalFileSystem):
            handle, local = tempfile.mkstemp()
            os.close(handle)
            self.copies.append(local)
            pafs.copy_files(file, local, source_filesystem=self.fs, destination_filesystem=pafs.LocalFileSystem())
            file = local
        return np.memmap(file, np.uint8, "r") if os.path.getsize(file) else np.empty(0, np.uint8)

    def close(self) -> None:
        for file in self.copies:
            os.unlink(file)


def _views(raw: np.ndarray, *parts: tuple) -> list[np.ndarray]:
    """(type, length) arrays that follow one another in a file."""
    out, at = [], 0
    for kind, n in parts:
        size = np.dtype(kind).itemsize * n
        out.append(raw[at:at + size].view(kind))
        at += size
    return out


def _texts(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[list[str]]:
    """Texts of about ``n`` tokens, six characters each."""
    held, size = [], 0
    for batch in batches:
        for t in batch.column(0).to_pylist():
            held.append(t)
            size += len(t) // 6 + 1
            if size >= n:
                yield held
                held, size = [], 0
    if held:
        yield held


def _rows(shard: np.ndarray, shards: int, **arrays: np.ndarray) -> pa.RecordBatch:
    """A row per shard with the bytes of its part of each array; ``shard`` is in order."""
    cut = np.searchsorted(shard, np.arange(shards + 1))
    at = [s for s in range(shards) if cut[s] < cut[s + 1]]
    return pa.RecordBatch.from_pydict({"shard": pa.array(at, pa.int64()), **{
        k: pa.array([np.ascontiguousarray(a[cut[s]:cut[s + 1]]).tobytes() for s in at], pa.binary()) for k, a in arrays.items()}})


def _per_shard(batches: Iterator[pa.RecordBatch], columns: int) -> Iterator[tuple[int, list[list[bytes]]]]:
    """Shards in order, each with the bytes of its rows by column."""
    now, held = None, [[] for _ in range(columns)]
    for batch in batches:
        rows = [batch.column(c).to_pylist() for c in range(columns + 1)]
        for s, *values in zip(*rows):
            if now is not None and s != now:
                yield now, held
                held = [[] for _ in range(columns)]
            now = s
            for h, v in zip(held, values):
                h.append(v)
    if now is not None:
        yield now, held


MERGED = "kind string, shard bigint, file string, n bigint, wide bigint, total bigint, n1 bigint, n2 bigint, n3 bigint, n4 bigint, extra binary, extra2 binary"
_MERGED = pa.schema([("kind", pa.string()), ("shard", pa.int64()), ("file", pa.string()), *[(c, pa.int64()) for c in ("n", "wide", "total", "n1", "n2", "n3", "n4")],
                     ("extra", pa.binary()), ("extra2", pa.binary())])


def _merged_row(kind: str, shard: int, file: str, n: int, wide: int = 0, counts: np.ndarray | None = None, extra: bytes = b"", extra2: bytes = b"") -> pa.RecordBatch:
    c = np.zeros(0, np.int64) if counts is None else counts
    of = [int((c == k).sum()) for k in (1, 2, 3, 4)]
    return pa.RecordBatch.from_pylist([dict(zip(_MERGED.names, [kind, shard, file, n, wide, int(c.sum()), *of, extra, extra2]))], _MERGED)


def _dealt(df: DataFrame, shards: int) -> DataFrame:
    """A task per shard: the shard's number is its partition."""
    return df.repartitionById(shards, F.col("shard").cast("int")).sortWithinPartitions("shard")


def _count_tokens(texts: DataFrame, folder: str, shards: int) -> DataFrame:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens()
        for group in _texts(batches, HELD):
            h, c = np.unique(tokens.of(group)[0], return_counts=True)
            yield _rows(shard_of(h, shards), shards, keys=h, counts=c.astype(np.uint32))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Store(folder)
        for shard, (keys, counts) in _per_shard(batches, 2):
            k, c, _ = summed(np.frombuffer(b"".join(keys), _U), np.frombuffer(b"".join(counts), np.uint32).astype(np.int64))
            yield _merged_row("tokens", shard, out.write(f"tokens-{shard}", k, c), len(k), counts=c)

    return written(_dealt(texts.mapInArrow(count, "shard bigint, keys binary, counts binary"), shards).mapInArrow(merge, MERGED), "lm-tokens")


def _frequent(tokens: DataFrame, folder: str, least: float) -> np.ndarray:
    """Hashes of the tokens that occur over ``least`` times."""
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = Store(folder)
        for batch in batches:
            for file, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                k, c = _views(files.map(file), (_U, n), (np.int64, n))
                yield pa.record_batch([pa.array(k[c > least].view(np.int64))], names=["h"])
        files.close()

    found = tokens.select("file", "n").mapInArrow(find, "h bigint").collect()  # FREQUENT rows at most
    return np.sort(np.array([r.h for r in found], np.int64).view(_U))


def _count_pairs(texts: DataFrame, folder: str, shards: int, frequent: np.ndarray) -> DataFrame:
    listed = np.unique(frequent >> _U(24))

    def place(u: np.ndarray, key: np.ndarray) -> np.ndarray:
        return shard_of(np.where(np.isin(u >> _U(24), listed), key, u), shards)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens()
        for group in _texts(batches, HELD):
            w = tokens.of(group)[0] >> _U(24) << _U(24)
            u = np.concatenate([np.array([END >> 24 << 24], _U), w[:-1]])
            key, c, at = summed(pair_key(u, w), np.ones(len(w), np.int64))
            u, w = u[at], w[at]
            shard = place(u, key)
            order = np.lexsort((w, u, shard))
            # wide counts are split over several equal pairs, the merge adds them up
            shard, u, w, c = shard[order], u[order], w[order], c[order]
            again = np.maximum(1, -(-c // WIDE))
            last = np.cumsum(again) - 1
            c8 = np.full(int(again.sum()), WIDE, np.int64)
            c8[last] = c - (again - 1) * WIDE
            shard, u, w = np.repeat(shard, again), np.repeat(u, again), np.repeat(w, again)
            starts = np.flatnonzero(np.r_[True, (u[1:] != u[:-1]) | (shard[1:] != shard[:-1])])
            runs = np.diff(np.r_[starts, len(u)]).astype(np.uint32)
            a = _rows(shard[starts], shards, u=short(u[starts]), runs=runs)
            b = _rows(shard, shards, w=short(w), counts=c8.astype(np.uint8))
            yield pa.RecordBatch.from_arrays([*a.columns, b.column("w"), b.column("counts")], names=["shard", "u", "runs", "w", "counts"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Store(folder)
        for shard, (us, runs, ws, counts) in _per_shard(batches, 4):
            u = np.repeat(unshort(b"".join(us)), np.frombuffer(b"".join(runs), np.uint32))
            w = unshort(b"".join(ws))
            key, c, at = summed(pair_key(u, w), np.frombuffer(b"".join(counts), np.uint8).astype(np.int64))
            u, w = u[at], w[at]
            wide = c >= WIDE
            yield _merged_row("pairs", shard, out.write(f"pairs-{shard}", key, np.minimum(c, WIDE).astype(np.uint8), np.zeros(-len(key) % 8, np.uint8), key[wide], c[wide]),
                              len(key), int(wide.sum()), c, *_continuations(w))
            sums, heads = [], None
            for k in (1, 2, 3):
                heads, total_, _ = summed(u, ((c == k) if k < 3 else (c >= k)).astype(np.int64))
                sums.append(total_)
            split = np.isin(heads >> _U(24), listed)
            yield _merged_row("contexts", shard, out.write(f"contexts-{shard}", heads[~split], *[s[~split].astype(np.uint32) for s in sums]), int((~split).sum()),
                              extra=np.concatenate([heads[split], *[s[split].view(_U) for s in sums]]).tobytes())

    def _continuations(w: np.ndarray) -> tuple[bytes, bytes]:
        k, c = np.unique(w, return_counts=True)
        return short(k).tobytes(), c.astype(np.uint32).tobytes()

    counted = texts.mapInArrow(count, "shard bigint, u binary, runs binary, w binary, counts binary")
    return written(_dealt(counted, shards).mapInArrow(merge, MERGED), "lm-pairs")


def _count_continuations(pairs: DataFrame, folder: str, shards: int) -> DataFrame:
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                k = unshort(k)
                yield _rows(shard_of(k, shards), shards, keys=short(k), counts=np.frombuffer(c, np.uint32))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Store(folder)
        for shard, (keys, counts) in _per_shard(batches, 2):
            k, c, _ = summed(unshort(b"".join(keys)), np.frombuffer(b"".join(counts), np.uint32).astype(np.int64))
            yield _merged_row("continuations", shard, out.write(f"continuations-{shard}", k, c.astype(np.uint32)), len(k), counts=c)

    rows = pairs.where("kind = 'pairs'").select("extra", "extra2").mapInArrow(split, "shard bigint, keys binary, counts binary")
    return written(_dealt(rows, shards).mapInArrow(merge, MERGED), "lm-continuations")


def _split_contexts(pairs: DataFrame, folder: str) -> tuple[str, int]:
    """Sums of the listed contexts over all shards, as one more file; FREQUENT rows at most."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                a = np.frombuffer(raw, np.int64).reshape(4, -1)
                yield pa.record_batch([pa.array(x) for x in a], names=["u", "n1", "n2", "n3"])

    sums = pairs.where("kind = 'contexts'").select("extra").mapInArrow(rows, "u bigint, n1 bigint, n2 bigint, n3 bigint").groupBy("u").agg(
        *[F.sum(c).alias(c) for c in ("n1", "n2", "n3")])
    a = np.array([tuple(r) for r in sums.collect()], np.int64).reshape(-1, 4)
    u = a[:, 0].copy().view(_U)
    order = np.argsort(u)
    return Store(folder).write("contexts-listed", u[order], *[a[order, k].astype(np.uint32) for k in (1, 2, 3)]), len(u)


def discounts(n1: int, n2: int, n3: int, n4: int) -> np.ndarray:
    """Of counts 0, 1, 2 and 3 or more, kept between 0 and the count."""
    y = n1 / (n1 + 2 * n2) if n1 + n2 else 0.0
    d = [0.0]
    for k, (a, b) in enumerate(((n1, n2), (n2, n3), (n3, n4)), 1):
        d.append(min(max(k - (k + 1) * y * b / a if a else y, 0.0), k - 1e-3))
    return np.array(d)


def train(docs: DataFrame, text_col: str = "text", shards: int | None = None) -> dict:
    """Count ``docs`` and leave the arrays in a fresh folder of the shared store; what scorers need to know of them."""
    folder = shared_dir(docs.sparkSession, "lm")
    texts = docs.select(whole(text_col).alias("text"))
    shards = shards or max(8, 2 * texts.rdd.getNumPartitions())
    tokens = _count_tokens(texts, folder, shards)
    n, v = total(tokens, F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0)))
    frequent = _frequent(tokens, folder, n / FREQUENT)
    pairs = _count_pairs(texts, folder, shards, frequent)
    continuations = _count_continuations(pairs, folder, shards)
    sums = [F.coalesce(F.sum(c), F.lit(0)) for c in ("n", "n1", "n2", "n3", "n4")]
    kinds = {k: total(df.where(F.col("kind") == k), *sums) for k, df in (("pairs", pairs), ("continuations", continuations))}
    d, e = discounts(*kinds["pairs"][1:]), discounts(*kinds["continuations"][1:])
    types, m1, m2 = kinds["continuations"][:3]
    spare = float(e[1] * m1 + e[2] * m2 + e[3] * (types - m1 - m2))
    files = [(r.kind, r.shard, r.file, r.n, r.wide) for df in (tokens, pairs, continuations) for r in df.select("kind", "shard", "file", "n", "wide").collect()]
    file, size = _split_contexts(pairs, folder)
    return {"folder": folder, "shards": shards, "files": files, "listed": (file, size), "n": int(n), "v": int(v), "pairs": int(kinds["pairs"][0]), "d": d, "e": e, "spare": spare}


class Scorer:
    """Looks tokens up in the mapped arrays."""

    def __init__(self, model: dict) -> None:
        self.m, self.files = model, Store(model["folder"])
        self.at: dict[tuple[str, int], list[np.ndarray]] = {}
        for kind, shard, file, n, wide in model["files"]:
            parts = {"tokens": [(_U, n), (np.int64, n)], "contexts": [(_U, n), *[(np.uint32, n)] * 3], "continuations": [(_U, n), (np.uint32, n)],
                     "pairs": [(_U, n), (np.uint8, n), (np.uint8, -n % 8), (_U, wide), (np.int64, wide)]}[kind]
            self.at[kind, shard] = _views(self.files.map(file), *parts)
        file, n = model["listed"]
        self.listed = _views(self.files.map(file), (_U, n), *[(np.uint32, n)] * 3)

    @staticmethod
    def search(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the wanted keys, and whether each is there."""
        if not len(keys):
            return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return at, keys[at] == wanted

    def look(self, kind: str, keys: np.ndarray, place: np.ndarray, columns: int) -> np.ndarray:
        """Values (columns, keys) of ``keys``, 0 where unknown."""
        out = np.zeros((columns, len(keys)), np.int64)
        order = np.lexsort((keys, place))
        cut = np.searchsorted(place[order], np.arange(self.m["shards"] + 1))
        for s in range(self.m["shards"]):
            held, mine = self.at.get((kind, s)), order[cut[s]:cut[s + 1]]
            if held is None or not len(mine):
                continue
            at, hit = self.search(held[0], keys[mine])
            for k in range(columns):
                out[k, mine] = np.where(hit, held[1 + k][at] if len(held[0]) else 0, 0)
            if kind == "pairs":
                wide = mine[out[0, mine] == WIDE]
                out[0, wide] = held[4][np.searchsorted(held[3], keys[wide])]
        return out

    def token_scores(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each token: its count, and log10 of its chance under the base and under the model."""
        m, shards = self.m, self.m["shards"]
        types, inverse = np.unique(tokens, return_inverse=True)
        count = self.look("tokens", types, shard_of(types, shards), 1)[0]
        cut = types >> _U(24) << _U(24)
        follows = self.look("continuations", cut, shard_of(cut, shards), 1)[0]
        contexts = self.look("contexts", cut, shard_of(cut, shards), 3)
        at, split = self.search(self.listed[0], cut)
        for k in range(3):
            contexts[k][split] = self.listed[1 + k][at[split]]
        base = np.log10((count + ADD) / (m["n"] + ADD * (m["v"] + 1)))
        e, d = m["e"], m["d"]
        low = (np.maximum(follows - e[np.minimum(follows, 3)], 0) + m["spare"] / (m["v"] + 1)) / m["pairs"] if m["pairs"] else np.ones(len(types))
        gain = (d[1] * contexts[0] + d[2] * contexts[1] + d[3] * contexts[2]) / np.maximum(count, 1)
        head = np.concatenate([np.searchsorted(types, np.array([END], _U)), inverse[:-1]])
        w, u = cut[inverse], cut[head]
        key = pair_key(u, w)
        distinct, back = np.unique(key, return_inverse=True)
        first = np.zeros(len(distinct), np.int64)
        first[back] = np.arange(len(key))
        place = shard_of(np.where(split[head[first]], distinct, u[first]), shards)
        c = self.look("pairs", distinct, place, 1)[0][back]
        of_u = count[head]
        chance = np.where(of_u > 0, np.maximum(c - d[np.minimum(c, 3)], 0) / np.maximum(of_u, 1) + gain[head] * low[inverse], low[inverse])
        return count[inverse], base[inverse], np.log10(chance)


SCORED = "id string, n_tokens bigint, n_known bigint, base_score double, score double"


def score(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_tokens, n_known, train_tokens, base_score and score (log10), and perplexity per token."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(whole(text_col).alias("text"), column(id_col).cast("string").alias("id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer, tokens = Scorer(model), Tokens()

        def out(ids: list[str], texts: list[str]) -> pa.RecordBatch:
            h, sizes = tokens.of(texts)
            begin = np.cumsum(sizes) - sizes
            count, base, own = scorer.token_scores(h)
            return pa.record_batch([pa.array(ids, pa.string()), pa.array(sizes), *[pa.array(np.add.reduceat(a, begin)) for a in ((count > 0).astype(np.int64), base, own)]],
                                   names=["id", "n_tokens", "n_known", "base_score", "score"])

        ids, texts, size = [], [], 0
        for batch in batches:
            for t, i in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids.append(i)
                texts.append(t)
                size += len(t) // 6 + 1
                if size >= BATCH:
                    yield out(ids, texts)
                    ids, texts, size = [], [], 0
        if ids:
            yield out(ids, texts)
        scorer.files.close()

    scored = rows.mapInArrow(run, SCORED)
    return scored.select(F.col("id").cast(kind).alias(id_col), "n_tokens", "n_known", F.lit(model["n"]).cast("bigint").alias("train_tokens"), "base_score", "score",
                         F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"))


def is_held_out(docs: DataFrame, id_col: str = "doc_id"):
    """Remainder 0 of crc32 of the id, modulo 10."""
    return remainder(column(id_col), 10) == 0
