"""Toxicity by compression distance: which of two zstandard dictionaries shortens a window of text more.

Training reads a bounded sample of labelled rows, ``SAMPLE`` per class at most
(texts of up to ``SAMPLE_CHARS`` characters), chosen by a hash of the id; that
is the only bound, scoring reads whole texts.  The toxic dictionary holds the
words and word stems that toxic texts have and ordinary texts lack (log ratio
of document frequencies, times the root of the count).  They are taken one by
one; a text that holds a chosen one counts less from then on, so that a family
of copies does not fill the dictionary.  The ordinary dictionary holds as many
bytes of ordinary prose.

Windows of ``WINDOW`` words are compressed as codes: each byte becomes a
three-byte code of itself and the two bytes before, so only matches of four
bytes and more shorten a window, and longer ones do so in proportion.  Each
window stands behind an anchor that both dictionaries hold, so even a short
window is compressed, not stored.

A window's gain is its ordinary length less its toxic length.  The gains of a
text give its largest gain, the mean of its three largest, and how many reach
each threshold; a logistic fit on texts that the dictionary has not seen (each
half of the sample is measured with the other half's dictionary) calibrates
them to a probability.

Defined cases: null is empty; an empty text has one empty window, so it gets
the score of a text without gains; repeated rows score alike; without labels of
both classes the score is the share of toxic labels (0 without any); an empty
table gives an empty result; other columns are carried.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import column, whole

SAMPLE, SAMPLE_CHARS, THRESHOLD = 3000, 100_000, 0.3
#: Words of a window, bytes of a class's own text in its dictionary, lengths of stems in characters.
WINDOW, OWN, STEMS = 2, 400, (4, 5, 6, 7, 8)
#: A term is chosen down to this share of the first one's excess; a text's weight once it holds a chosen term; terms considered.
LEAST_SHARE, LEAST_EXCESS, DECAY, CANDIDATES = 0.15, 3.0, 0.7, 3000
#: Gains in bytes that are counted.
GAINS = (3, 5, 7, 9)
PARAMETERS = dict(format=zstandard.FORMAT_ZSTD1, window_log=15, hash_log=14, chain_log=14, search_log=6, min_match=4, target_length=64,
                  strategy=zstandard.STRATEGY_GREEDY, write_content_size=False, write_checksum=False, write_dict_id=False)


@dataclass
class Model:
    """Contents of the two dictionaries, and weights of the features (constant first)."""

    toxic: bytes
    ordinary: bytes
    weights: list[float]


def words_of(text: str) -> list[bytes]:
    return text.lower().encode("utf-8", "replace").split()


def _terms(text: str) -> set[str]:
    """The words of a text and their stems."""
    found = set()
    for w in set(text.lower().split()):
        found.add(w[:40])
        found.update(w[:k] for k in STEMS if len(w) > k)
    return found


def toxic_terms(toxic: list[str], ordinary: list[str]) -> list[str]:
    """Terms of the toxic dictionary, most telling first; no term begins another."""
    plain: Counter = Counter()
    for t in ordinary:
        plain.update(_terms(t))
    holders = defaultdict(list)
    for i, t in enumerate(toxic):
        for w in _terms(t):
            holders[w].append(i)

    def excess(w: str, count: float) -> float:
        return (math.log((count + 0.5) / (len(toxic) + 1)) - math.log((plain[w] + 0.5) / (len(ordinary) + 1))) * math.sqrt(count)

    live = sorted((w for w in holders if len(holders[w]) > 1 and len(w) >= STEMS[0]), key=lambda w: (-excess(w, len(holders[w])), -len(w), w))[:CANDIDATES]
    where, weight = {w: np.array(holders[w]) for w in live}, np.ones(len(toxic))
    chosen, size, least = [], 0, 0.0
    while size < OWN and live:
        value, at = max((excess(w, float(weight[where[w]].sum())), -i) for i, w in enumerate(live))
        least = least or max(LEAST_EXCESS, LEAST_SHARE * value)
        if value < least:
            break
        best = live[-at]
        chosen.append(best)
        size += len(best.encode()) + 1
        weight[where[best]] *= DECAY
        live = [w for w in live if not w.startswith(best) and not best.startswith(w)]
    return chosen


def dictionaries(toxic: list[str], ordinary: list[str]) -> tuple[bytes, bytes]:
    """Contents of the toxic and the ordinary dictionary, before coding."""
    own = (" " + " ".join(toxic_terms(toxic, ordinary)[::-1]) + " ").encode("utf-8", "replace")
    prose = b" ".join(b" ".join(words_of(t)[:60]) for t in ordinary[:OWN])
    return own, b" " + prose[:max(0, len(own) - 2)] + b" "


def coded(raw: bytes) -> bytes:
    """Three bytes for each byte: a hash of it and the two before."""
    b = np.frombuffer(raw, np.uint8).astype(np.uint32)
    padded = np.concatenate([np.full(2, 32, np.uint32), b])
    h = b | padded[1:-1] << np.uint32(8) | padded[:-2] << np.uint32(16)
    h = (h ^ h >> np.uint32(11)) * np.uint32(0x85EBCA6B)
    h ^= h >> np.uint32(13)
    return h.view(np.uint8).reshape(-1, 4)[:, :3].tobytes()


ANCHOR = coded(b"\x01anchor\x02anchor\x03")


class Measure:
    """Features of a text under two dictionaries."""

    def __init__(self, toxic: bytes, ordinary: bytes) -> None:
        p = zstandard.ZstdCompressionParameters(**PARAMETERS)
        self.pack = []
        for content in (toxic, ordinary):
            d = zstandard.ZstdCompressionDict(coded(content) + ANCHOR, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=p)
            self.pack.append(zstandard.ZstdCompressor(dict_data=d, compression_params=p).compress)

    def gains(self, text: str) -> np.ndarray:
        words, (toxic, ordinary) = words_of(text), self.pack
        raw = b" " + b" ".join(words) + b" "
        codes = coded(raw)
        ends = np.cumsum(np.fromiter((len(w) + 1 for w in words), np.int64, len(words))) + 1
        cuts = [0, *(3 * ends[WINDOW - 1::WINDOW]).tolist()]
        if cuts[-1] < len(codes):
            cuts.append(len(codes))
        windows = [ANCHOR + codes[a:b] for a, b in zip(cuts, cuts[1:])]
        return np.array([len(ordinary(w)) - len(toxic(w)) for w in windows])

    def features(self, text: str) -> list[float]:
        g = self.gains(text)
        top = np.sort(g)[-3:]
        return [1.0, float(top[-1]), float(top.mean()), math.log(len(g)), *[math.log1p(float((g >= k).sum())) for k in GAINS]]


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    """Weights by Newton steps; the constant is not shrunk."""
    w, keep = np.zeros(x.shape[1]), np.r_[0.0, np.full(x.shape[1] - 1, ridge)]
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(keep + 1e-9), x.T @ (y - p) - keep * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(toxic: list[str], ordinary: list[str]) -> Model:
    """Dictionaries of all texts; weights from each half under the other half's dictionaries."""
    if len(toxic) < 4 or len(ordinary) < 4:
        share = len(toxic) / max(1, len(toxic) + len(ordinary))
        share = min(max(share, 1e-9), 1 - 1e-9)
        return Model(b"", b"", [math.log(share / (1 - share))])
    rows, marks = [], []
    for half in (0, 1):
        m = Measure(*dictionaries(toxic[half::2], ordinary[half::2]))
        for texts, mark in ((toxic[1 - half::2], 1.0), (ordinary[1 - half::2], 0.0)):
            rows += [m.features(t) for t in texts]
            marks += [mark] * len(texts)
    return Model(*dictionaries(toxic, ordinary), _logistic(np.array(rows), np.array(marks)).tolist())


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> Model:
    """Fit on at most ``sample`` labelled rows per class; ``labels`` (id, label) holds only rows that may be learnt from."""
    marked = labels.select(column(id_col).alias("id"), column(label_col).alias("y")).where("id IS NOT NULL")
    order = (F.xxhash64("id"), F.col("id"))
    chosen = marked.where("y = 1").orderBy(*order).limit(sample).unionByName(marked.where("y = 0").orderBy(*order).limit(sample))
    texts = docs.select(column(id_col).alias("id"), whole(text_col).alias("text")).where(F.length("text") <= SAMPLE_CHARS)
    rows = texts.join(F.broadcast(chosen), "id").select("y", "text").distinct().collect()  # 2 * sample rows at most
    rows = sorted((r.y, r.text) for r in rows)
    mixed = np.random.default_rng(0).permutation(len(rows))
    by = {y: [rows[i][1] for i in mixed if rows[i][0] == y] for y in (0, 1)}
    return fit(by[1], by[0])


def score(text: Column, model: Model) -> Column:
    """Probability that the text is toxic."""

    @F.pandas_udf("double")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        w = np.array(model.weights)
        measure = Measure(model.toxic, model.ordinary) if model.toxic else None
        for texts in batches:
            x = np.array([measure.features(t) for t in texts]) if measure else np.ones((len(texts), 1))
            yield pd.Series(1 / (1 + np.exp(-np.clip(x.reshape(len(texts), -1) @ w, -30, 30))) if len(texts) else [], dtype=float)

    return of(text)


def keep_ordinary(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` with a score below the threshold."""
    packed = docs.select(F.struct(*[column(c) for c in docs.columns]).alias("row"), score(whole(text_col), model).alias("score"))
    return packed.where(F.col("score") < threshold).select("row.*")
