"""Byte-level BPE: ranks of a given vocabulary, boundaries by a scan over transition functions.

Pre-tokenising.  Code points are mapped to classes by an array (letter, number,
blank, other); with the class of the next one or two code points each becomes
one of nine symbols.  An automaton of eight states reads the symbols and
marks where a piece starts.  The functions its symbols induce on states close
to a small monoid, so the text is cut into blocks, all blocks fold their
symbols side by side with one table look-up per symbol, an associative scan
over the block functions gives the state at each block's start, and a second
pass marks the starts.  No regular expression is run.

Merging.  Distinct pieces not seen before are merged together: each round every
piece merges its leftmost pair of lowest rank.  Long pieces are merged one by
one with a heap.  Results are cached per worker, with a bound on entries.

Decoding gathers the bytes of the ids from one flat array by offsets; the same
offsets give each token's place in its text.

Long texts are scanned in windows that end at a piece start after a non-blank,
where the automaton starts anew, so memory follows the window.

Defined cases: null is empty; an empty text has no ids; strings that look like
special tokens are plain text; repeated rows are encoded alike; an empty table
gives an empty result; other columns are carried (``encode``).
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import unicodedata
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import column, whole, worker_cache

# Code points that became letters or numbers after Unicode 15.1, first and last of each range.
NEW_LETTERS = ((0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4),
               (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3),
               (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0))
NEW_NUMBERS = ((0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA))
WHITE_SPACE = (*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)

#: Between texts of one scan stands a surrogate, which no text holds.
GAP = "\ud800"
LETTER, NUMBER, OTHER, BLANK, END = range(5)
# Symbols: the classes, apostrophes that may begin a contraction of two or three, a space before a non-blank, a blank before
# another blank or the end, another blank before a non-blank, the gap.
L, N, O, A2, A3, SPACE, INNER, LAST, GAPS = range(9)
FRESH, IN_L, IN_N, IN_O, AFTER_SPACE, IN_BLANK, ONE_LEFT, TWO_LEFT = range(8)
WINDOW, STEP, LONG, CACHE = 1 << 20, 128, 200, 100_000
#: Texts encoded at once, so that the ids of a whole batch are not held beside it.
GROUP = 1024


def _automaton() -> tuple[np.ndarray, np.ndarray]:
    """(next state, starts a piece) by [state, symbol]."""
    to, start = np.zeros((8, 9), np.intp), np.ones((8, 9), bool)
    for s in range(8):
        to[s] = (IN_L, IN_N, IN_O, ONE_LEFT, TWO_LEFT, AFTER_SPACE, IN_BLANK, FRESH, FRESH)
    for s, run in ((IN_L, (L,)), (IN_N, (N,)), (IN_O, (O, A2, A3)), (AFTER_SPACE, (L, N, O, A2, A3)), (IN_BLANK, (INNER,))):
        start[s, list(run)] = False
    to[IN_O, [A2, A3]] = to[AFTER_SPACE, [A2, A3]] = IN_O
    to[TWO_LEFT, L], to[ONE_LEFT, L] = ONE_LEFT, FRESH
    start[[TWO_LEFT, ONE_LEFT], L] = False
    return to, start


def _monoid(to: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All functions the symbols generate: as rows, by [function, symbol], and by [function, function] (first, then second)."""
    found = {tuple(range(8)): 0}
    rows = list(found)
    for f in rows:
        for g in to.T:
            h = tuple(int(g[s]) for s in f)
            if h not in found:
                found[h] = len(found)
                rows.append(h)
    table = np.array(rows, np.intp)
    index = np.array([[found[tuple(int(g[s]) for s in f)] for g in to.T] for f in rows], np.intp)
    both = np.array([[found[tuple(int(table[b][s]) for s in table[a])] for b in range(len(rows))] for a in range(len(rows))], np.intp)
    return table, index, both


class Boundaries:
    """Where pieces start."""

    def __init__(self) -> None:
        kinds = np.full(0x110000, OTHER, np.uint8)
        for c in range(0x110000):
            k = unicodedata.category(chr(c))[0]
            if k == "L":
                kinds[c] = LETTER
            elif k == "N":
                kinds[c] = NUMBER
        for ranges, kind in ((NEW_LETTERS, LETTER), (NEW_NUMBERS, NUMBER)):
            for a, b in ranges:
                kinds[a:b + 1] = kind
        kinds[list(WHITE_SPACE)] = BLANK
        kinds[ord(GAP)] = END
        self.kinds = kinds
        self.to, self.start = _automaton()
        self.rows, self.step, self.both = _monoid(self.to)

    def symbols(self, cp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        kind = self.kinds[cp]
        after = np.append(kind[1:], END)
        sym = kind.astype(np.intp)  # LETTER, NUMBER, OTHER are L, N, O
        blank = kind == BLANK
        inner = blank & (after >= BLANK)
        sym[blank] = np.where(cp[blank] == 32, SPACE, LAST)
        sym[inner] = INNER
        sym[kind == END] = GAPS
        at = np.flatnonzero(cp == 39)
        if len(at):
            padded = np.append(cp, [0, 0])
            one, two = padded[at + 1], padded[at + 2]
            sym[at[np.isin(one, [ord(c) for c in "stmd"])]] = A2
            sym[at[((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))]] = A3
        return kind, sym

    def starts(self, sym: np.ndarray) -> np.ndarray:
        """Boolean per symbol; the first is read in the fresh state."""
        n = len(sym)
        k = -(-n // STEP)
        grid = np.full(k * STEP, GAPS, np.intp)
        grid[:n] = sym
        grid = np.ascontiguousarray(grid.reshape(k, STEP).T)
        f, flat = np.zeros(k, np.intp), self.step.ravel()
        for row in grid:
            f = flat[f * 9 + row]
        reach = 1
        while reach < k:  # inclusive scan of the block functions
            f[reach:] = self.both[f[:-reach], f[reach:]]
            reach *= 2
        state = np.zeros(k, np.intp)
        state[1:] = self.rows[f[:-1], FRESH]
        out, to, start = np.empty((STEP, k), bool), self.to.ravel(), self.start.ravel()
        for t, row in enumerate(grid):
            at = state * 9 + row
            out[t] = start[at]
            state = to[at]
        return out.T.ravel()[:n]


class Codec:
    """Ids and bytes of texts under one table of ranks."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        tokens = sorted(ranks, key=ranks.get)
        self.ids = np.array([ranks[t] for t in tokens], np.int64)
        size = int(self.ids[-1]) + 1
        self.length = np.zeros(size, np.int64)
        self.length[self.ids] = [len(t) for t in tokens]
        self.offset = np.concatenate([[0], np.cumsum(self.length)[:-1]])
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = {}
        for t, r in ranks.items():
            for i in range(1, len(t)):
                a, b = ranks.get(t[:i]), ranks.get(t[i:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = r
        self.pairs = pairs
        self.keys = np.array(sorted(pairs), np.int64)
        self.values = np.array([pairs[k] for k in self.keys.tolist()], np.int64)
        self.none = np.int64(1 << 30)
        self.cache: dict[bytes, bytes] = {}
        self.bounds = Boundaries()

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a << 32 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.values[at], self.none)

    def _merge_one(self, piece: bytes) -> list[int]:
        tok = self.byte[np.frombuffer(piece, np.uint8)].tolist()
        n = len(tok)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(r, i) for i in range(n - 1) if (r := self.pairs.get(tok[i] << 32 | tok[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = right[i] if tok[i] >= 0 else -1
            if j < 0 or self.pairs.get(tok[i] << 32 | tok[j]) != r:
                continue
            tok[i], tok[j], right[i] = r, -1, right[j]
            if right[j] >= 0:
                left[right[j]] = i
            for a, b in ((left[i], i), (i, right[i])):
                if a >= 0 and b >= 0 and (r := self.pairs.get(tok[a] << 32 | tok[b])) is not None:
                    heapq.heappush(heap, (r, a))
        return [t for t in tok if t >= 0]

    def _merge_many(self, pieces: list[bytes]) -> None:
        """Rounds over all pieces at once; results go to the cache."""
        length = np.array([len(p) for p in pieces])
        tok = self.byte[np.frombuffer(b"".join(pieces), np.uint8)]
        seg = np.repeat(np.arange(len(pieces)), length)
        rank = np.full(len(tok), self.none)
        inside = np.flatnonzero(seg[1:] == seg[:-1])
        rank[inside] = self._rank(tok[inside], tok[inside + 1])
        while len(tok):
            first = np.flatnonzero(np.r_[True, seg[1:] != seg[:-1]])
            best = np.minimum.reduceat(rank << 32 | np.arange(len(tok)), first)
            ready = (best >> 32) == self.none
            if ready.any():
                ends = np.r_[first[1:], len(tok)]
                out = tok.astype("<u4").tobytes()
                for s, a, b in zip(seg[first[ready]].tolist(), (first[ready] * 4).tolist(), (ends[ready] * 4).tolist()):
                    self.cache[pieces[s]] = out[a:b]
                live = np.repeat(~ready, ends - first)
                spot = np.cumsum(live) - 1
                at = spot[best[~ready] & 0xFFFFFFFF]
                tok, seg, rank = tok[live], seg[live], rank[live]
            else:
                at = best & 0xFFFFFFFF
            if not len(tok):
                break
            tok[at] = rank[at]
            keep = np.ones(len(tok), bool)
            keep[at + 1] = False
            spot = np.cumsum(keep) - 1
            tok, seg, rank = tok[keep], seg[keep], rank[keep]
            at = spot[at]
            touched = np.concatenate([at, at[at > 0] - 1])
            last = np.minimum(touched + 1, len(tok) - 1)
            joined = (seg[last] == seg[touched]) & (last > touched)
            rank[touched] = np.where(joined, self._rank(tok[touched], tok[last]), self.none)

    def _learn(self, pieces: list[bytes]) -> None:
        if len(self.cache) > CACHE:
            self.cache.clear()
        new = [p for p in set(pieces) if p not in self.cache]
        short = []
        for p in new:
            r = self.ranks.get(p)
            if r is not None:
                self.cache[p] = r.to_bytes(4, "little")
            elif len(p) <= LONG:
                short.append(p)
            else:
                self.cache[p] = np.array(self._merge_one(p), "<u4").tobytes()
        if short:
            self._merge_many(short)

    def _parts(self, text: str) -> Iterator[str]:
        """A long text in windows that end at a safe piece start."""
        at, size = 0, WINDOW
        while len(text) - at > size:
            cp = np.frombuffer(text[at:at + size].encode("utf-32-le", "replace"), "<u4")
            kind, sym = self.bounds.symbols(cp)
            safe = np.flatnonzero(self.bounds.starts(sym)[1:-3] & (kind[:-4] != BLANK)) + 1
            if len(safe):
                yield text[at:at + int(safe[-1])]
                at, size = at + int(safe[-1]), WINDOW
            else:
                size *= 2
        yield text[at:]

    def pieces(self, texts: list[str]) -> tuple[list[bytes], list[int]]:
        """Pieces of all texts, and where each text's pieces begin (one number more than texts)."""
        joined = GAP.join(texts) + GAP
        cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
        _, sym = self.bounds.symbols(cp)
        at = np.flatnonzero(self.bounds.starts(sym))
        width = 1 + (cp >= 0x80).astype(np.int8) + (cp >= 0x800) + (cp >= 0x10000)
        begin = np.concatenate([[0], np.cumsum(width)])
        raw = joined.encode("utf-8", "surrogatepass")
        gap = sym[at] == GAPS
        bounds = np.append(begin[at], len(raw))
        real = np.flatnonzero(~gap)
        out = [raw[a:b] for a, b in zip(bounds[real].tolist(), bounds[real + 1].tolist())]
        counts = np.cumsum(~gap)[gap]
        return out, [0, *counts.tolist()]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        out: list[bytes] = []
        group: list[str] = []
        size = 0

        def flush() -> None:
            nonlocal size
            if group:
                pieces, at = self.pieces(group)
                self._learn(pieces)
                get = self.cache.__getitem__
                out.extend(b"".join(map(get, pieces[a:b])) for a, b in zip(at, at[1:]))
                group.clear()
                size = 0

        for text in texts:
            if len(text) > WINDOW:
                flush()
                out.append(b"".join(self.encode_whole(part) for part in self._parts(text)))
                continue
            group.append(text)
            size += len(text) + 1
            if size > WINDOW:
                flush()
        flush()
        return out

    def encode_whole(self, text: str) -> bytes:
        """One text in one scan."""
        pieces, _ = self.pieces([text])
        self._learn(pieces)
        return b"".join(map(self.cache.__getitem__, pieces))

    def decode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """Bytes of the ids, and the byte offset of each id in them."""
        ids = np.asarray(ids, np.int64)
        width = self.length[ids]
        ends = np.cumsum(width)
        begin = ends - width
        n = int(ends[-1]) if len(ends) else 0
        return self.flat[np.arange(n) + np.repeat(self.offset[ids] - begin, width)].tobytes(), begin


def read_ranks(path: str) -> bytes:
    """The rank file: a line per token, base64 and rank.  A few MB for any vocabulary."""
    with open(path, "rb") as f:
        return f.read()


def codec(raw: bytes) -> Codec:
    """The codec of a rank file, once per worker."""
    held = worker_cache()
    key = ("bpe", hashlib.sha256(raw).hexdigest())
    if key not in held:
        held[key] = Codec({base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())})
    return held[key]


@contextmanager
def task_codec(raw: bytes) -> Iterator[Codec]:
    """The worker's codec for one task; merged pieces are forgotten at its end, as the worker goes on with other work."""
    c = codec(raw)
    try:
        yield c
    finally:
        c.cache.clear()


def encoded(text: Column, raw: bytes) -> Column:
    """struct(ids array<int>, offsets array<int>): offsets are the tokens' first bytes in the text's UTF-8."""

    @F.pandas_udf("ids array<int>, offsets array<int>")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        with task_codec(raw) as c:
            for texts in batches:
                ids = [np.frombuffer(b, "<u4") for b in c.encode(list(texts))]
                yield pd.DataFrame({"ids": [i.astype(np.int32) for i in ids], "offsets": [c.decode(i)[1].astype(np.int32) for i in ids]})

    return of(text)


def decoded(ids: Column, raw: bytes) -> Column:
    """The bytes of an array of ids."""

    @F.pandas_udf("binary")
    def of(rows: pd.Series) -> pd.Series:
        c = codec(raw)
        return pd.Series([c.decode(r)[0] for r in rows])

    return of(ids)


def encode(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """``docs`` with ``ids`` and ``offsets``."""
    out = docs.select(F.struct(*[column(c) for c in docs.columns]).alias("row"), encoded(whole(text_col), read_ranks(path)).alias("new"))
    return out.select(*[F.col("row")[c].alias(c) for c in docs.columns if c not in ("ids", "offsets")], "new.ids", "new.offsets")


def round_trip(text: Column, raw: bytes) -> Column:
    """struct(n_tokens, ids_sha256, decoded_sha256): the text encoded, then its ids decoded, as digests."""

    @F.pandas_udf("n_tokens bigint, ids_sha256 string, decoded_sha256 string")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        with task_codec(raw) as c:
            for texts in batches:
                rows = []
                for at in range(0, len(texts), GROUP):
                    for b in c.encode(texts.iloc[at:at + GROUP].tolist()):
                        rows.append((len(b) // 4, hashlib.sha256(b).hexdigest(), hashlib.sha256(c.decode(np.frombuffer(b, "<u4"))[0]).hexdigest()))
                yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return of(text)
