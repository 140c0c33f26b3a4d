"""Personal data: labelers vote on candidate spans, EM weighs the labelers, a classifier trained on its posteriors decides.

1. Base spans (exact patterns and checks per kind) and looser candidates are cut
   out of every text: spelled-out or accented mail addresses, phones without a
   country code, numbers like cards, defanged or colon addresses, and what a base
   pattern matches but its check refuses.  The scans are linear in the text: each starts at a
   rare character (``@``, ``+``, a digit, a colon), never at every letter.
2. Labelers vote for, against, or not at all on a candidate: regexes (strict form, check
   digits, ranges), gazetteers (top-level domains, calling codes, card prefixes,
   address blocks) and context (words before, characters around, keys and tokens).
3. Spans with equal votes are counted in Spark.  On these counts, a few thousand
   at most whatever the corpus (the votes of a kind have 3 ** 7 values), expectation-maximisation
   estimates for each labeler how often it votes which way on true and on false spans.
   Spans that form and check accept are known to be true, those that the check (digits, range) refuses false.
4. A logistic classifier per kind learns the posteriors from all spans, again as counts of equal features
   (votes and shape, all of them bits), and scores every candidate.

Base spans always stay.  Another candidate is added where its score reaches
``ADD`` and it meets no base span and no added one of a better score.

Defined cases: null is empty; an empty text has no spans; spans are in code
points, end exclusive; rows with equal ids are judged one by one; an empty table gives an empty
result; long texts are read whole; without any span of a kind its labelers
keep their prior; other columns are ignored.
"""

from __future__ import annotations

import bisect
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import column, whole, written

KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)
#: Score from which a candidate is added.
ADD = 0.9
LABELERS = ("form", "check", "gazetteer", "words before", "words against", "neighbours", "layout")
SHAPES = 5

#: Words that announce a kind, words that announce something else.
ANNOUNCE = {
    EMAIL: ("mail", "e-mail", "email", "write", "contact", "reply", "correo", "courriel", "kontakt", "adresse"),
    IP: ("ip", "host", "server", "address", "addr", "client", "ping", "peer", "gateway"),
    CARD: ("card", "visa", "mastercard", "credit", "debit", "karte", "carte", "tarjeta", "pan"),
    PHONE: ("phone", "tel", "telephone", "call", "mobile", "fax", "mobil", "telefon", "téléphone", "teléfono", "móvil", "cell", "whatsapp"),
}
AGAINST = ("version", "token", "key", "id", "isbn", "sku", "order", "serial", "hash", "page", "figure", "chapter", "build", "invoice", "section")
#: Common top-level domains, calling codes of one and two digits, first digits of card numbers.
DOMAINS = ("com", "org", "net", "edu", "gov", "info", "io", "de", "fr", "es", "uk", "eu", "it", "nl", "ch", "at", "us", "ca", "mx", "br", "jp", "cn", "in", "au", "example")
CALLING = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "54", "55", "56", "57", "60", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86", "90", "91", "92", "93", "94", "95", "98")
CARD_PREFIXES = ("4", "51", "52", "53", "54", "55", "22", "23", "24", "25", "26", "27", "34", "37", "6011", "65", "35", "30", "36", "38")

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_DIGITS = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_WIDE_DOMAIN = re.compile(r"[^\W_][\w-]*(?:\.[\w-]+)*")
_MARK = re.compile(r"[\[({<] ?[aA][tT] ?[\])}>]| (?:at|AT) (?=[A-Za-z0-9-]+ (?:dot|DOT) [A-Za-z])")
_SPELLED = re.compile(r" ?[A-Za-z0-9-]+(?:(?:\.| ?[\[({<] ?(?:dot|DOT) ?[\])}>] ?| (?:dot|DOT) )[A-Za-z0-9-]+)+")
_NATIONAL = re.compile(r"(?:\([0-9]{2,5}\)|[0-9]{2,5})(?:[\x20./-]{1,2}[0-9]{2,5}){1,5}")
_GROUPS = re.compile(r"[0-9]{4}(?:[\x20._/-]{1,2}[0-9]{4}){2,3}(?:[\x20._/-]{1,2}[0-9]{1,3})?")
_ALONE = re.compile(r"[0-9]+(?:-[0-9]+)*")
_COLONS = re.compile(r"[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{0,4}){2,7}")
_DEFANGED = re.compile(r"[0-9]{1,3}(?: ?\[\.\] ?[0-9]{1,3}){3}")
_WORD = re.compile(r"[^\W\d_][\w-]*")
_NUMBER = str.maketrans("", "", " -().+/_[]")


def luhn(digits: str) -> bool:
    total = 0
    for i, x in enumerate(reversed(digits)):
        x = int(x) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or 0) <= 255


def matches(text: str) -> list[tuple[int, int, int, bool]]:
    """(kind, start, end, whether its check holds) of every match of a base pattern, leftmost and disjoint per kind."""
    out, at, free = [], text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            free = m.end()
            out.append((EMAIL, start, free, True))
        at = text.find("@", max(at + 1, free))
    for m in _DOTTED.finditer(text):
        if m[0].count(".") > 2:
            parts, place = m[0].split("."), m.start()
            for i in range(0, len(parts) - 3, 4):
                four = parts[i:i + 4]
                end = place + sum(map(len, four)) + 3
                out.append((IP, place, end, all(map(_small, four))))
                place = end + 1
    for m in _DIGITS.finditer(text):
        if m.end() - m.start() > 12:
            digits = m[0].translate(_NUMBER)
            out.append((CARD, m.start(), m.end(), 14 <= len(digits) <= 19 and luhn(digits)))
    if "+" in text:
        for m in _PHONE.finditer(text):
            out.append((PHONE, m.start(), m.end(), 10 <= sum(map(str.isdigit, m[0])) <= 15))
    return out


def loose(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of looser candidates."""
    out, at = [], text.find("@")
    while at >= 0:
        start = at
        while start > max(0, at - 64) and (text[start - 1].isalnum() or text[start - 1] in LOCAL):
            start -= 1
        m = _WIDE_DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((EMAIL, start, m.end()))
        at = text.find("@", at + 1)
    for m in _MARK.finditer(text):
        low = high = m.start() - (m.start() > 0 and text[m.start() - 1] == " ")
        while low > max(0, high - 64) and text[low - 1] in LOCAL:
            low -= 1
        after = _SPELLED.match(text, m.end())
        if low < high and after:
            out.append((EMAIL, low, after.end()))
    out += [(PHONE, m.start(), m.end()) for m in _NATIONAL.finditer(text) if 9 <= sum(map(str.isdigit, m[0])) <= 14]
    out += [(CARD, m.start(), m.end()) for m in _GROUPS.finditer(text)]
    for m in _DIGITS.finditer(text):
        if m.end() - m.start() > 19 and " " in m[0]:  # several numbers side by side
            out += [(CARD, m.start() + x.start(), m.start() + x.end()) for x in _ALONE.finditer(m[0]) if 13 <= sum(map(str.isdigit, x[0])) <= 19]
    if text.count(":") > 1:
        out += [(IP, m.start(), m.end()) for m in _COLONS.finditer(text) if len(m[0]) > 6]
    if "[.]" in text:
        out += [(IP, m.start(), m.end()) for m in _DEFANGED.finditer(text)]
    return out


def _vote(yes: bool, no: bool) -> int:
    return 1 if yes else 2 if no else 0


def judge(text: str, kind: int, start: int, end: int, base: bool) -> tuple[int, int]:
    """Votes of the labelers as a number of base 3 (0 none, 1 for, 2 against), and shape bits."""
    span, digits = text[start:end], "".join(c for c in text[start:end] if c in "0123456789")
    before, left, right = text[max(0, start - 40):start], text[start - 1:start], text[end:end + 1]
    words = [w.lower() for w in _WORD.findall(before)][-3:]
    plain = not (left.isalnum() or left in ("_", "/", ".", "@") or right.isalnum() or right in ("_", "@", "/"))
    separators = {c for c in span if not c.isalnum()}
    last = re.split(r"[.\W]+", span.lower())[-1]
    if kind == EMAIL:
        form, check = _vote(base, "@" not in span and " at " not in span.lower() and span.count(" ") > 4), _vote(2 <= len(last) <= 12 and last.isalpha(), not last.isalpha())
        gazetteer, layout = _vote(last in DOMAINS, False), _vote(span.count("@") == 1 and ".." not in span, ".." in span or span[0] in ".%+-")
    elif kind == IP:
        parts = re.split(r"[^0-9A-Fa-f]+", span)
        colon = ":" in span
        form, check = _vote(base, False), _vote(not colon and all(map(_small, parts)), not colon and not all(map(_small, parts)) or colon and (len(parts) < 4 or not re.search("[0-9]", span)))
        gazetteer, layout = _vote(not colon and parts[0] in ("10", "127", "172", "192"), not colon and (parts[0] == "0" or parts[0][:1] == "0")), _vote(not colon and len(parts) == 4, any(len(p) > 1 and p[0] == "0" for p in parts) and not colon or "::" not in span and colon and len(parts) < 8)
    elif kind == CARD:
        valid = 13 <= len(digits) <= 19 and luhn(digits)
        form, check = _vote(base, False), _vote(valid, not valid)
        gazetteer, layout = _vote(digits.startswith(CARD_PREFIXES), not digits.startswith(CARD_PREFIXES)), _vote(len(separators) < 2, len(separators) > 1)
    else:
        form, check = _vote(base, span[:1] != "+" and not span.startswith(("(", "0"))), _vote(10 <= len(digits) <= 15, not 9 <= len(digits) <= 15)
        gazetteer, layout = _vote(span[:1] == "+" and digits.startswith(CALLING), span[:1] != "+" and not digits.startswith("0")), _vote("(" in span and ")" in span or span[:1] == "+", len(separators) > 3 or span.count(".") > 3)
    announced = any(w in ANNOUNCE[kind] for w in words)
    keyed = any(w in AGAINST for w in words) or before.rstrip(" ")[-1:] in ("=", '"', "#", "$") or before[-2:] in ("v.", "n°")
    votes = 0
    for v in (form, check, gazetteer, _vote(announced, False), _vote(False, keyed), _vote(plain, not plain), layout):
        votes = 3 * votes + v
    shape = sum(bit << i for i, bit in enumerate((len(separators) > 0, len(separators) > 1, len(span) > 20, left in ("", "\n"), right in ("", "\n"))))
    return votes, shape


FOUND = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()), ("votes", pa.int32()), ("shape", pa.int32())]))


def spans_of(text: str) -> list[dict]:
    """Base spans and candidates of a text with votes and shape."""
    found = {(k, a, b): ok for k, a, b, ok in matches(text)}
    for span in loose(text):
        found.setdefault(span, False)
    return [dict(zip(("kind", "start", "end", "base", "votes", "shape"), (k, a, b, ok, *judge(text, k, a, b, ok)))) for (k, a, b), ok in sorted(found.items(), key=lambda x: (x[0][1], x[0][0], x[0][2]))]


def find_candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id`` and ``found`` (array of kind, start, end, base, votes, shape) of every row, written: spans only, no text."""
    kind = dict(docs.select(column(id_col).alias("id")).dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [spans_of(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, FOUND)], names=["id", "found"])

    src = docs.select(column(id_col).alias("id"), whole(text_col).alias("text"))
    schema = f"id {kind}, found array<struct<kind:int,start:int,end:int,base:boolean,votes:int,shape:int>>"
    return written(src.mapInArrow(run, schema), "pii-candidates")


def _digits3(votes: np.ndarray) -> np.ndarray:
    return np.stack([votes // 3 ** i % 3 for i in range(len(LABELERS))][::-1], 1)


def anchors(votes: np.ndarray) -> np.ndarray:
    """0 where the check refuses a span, 1 where form and check accept it, else nan."""
    v = _digits3(votes)
    return np.where(v[:, 1] == 2, 0.0, np.where((v[:, 0] == 1) & (v[:, 1] == 1), 1.0, np.nan))


def estimate(votes: np.ndarray, counts: np.ndarray, known: np.ndarray | None = None, rounds: int = 100) -> tuple[np.ndarray, np.ndarray, float]:
    """Posterior of each vote pattern, how labelers vote on false and true spans (class, labeler, vote), and the share of true spans.

    Expectation-maximisation over counted patterns; ``known`` holds posteriors that are given, nan elsewhere.  The prior counts say that a labeler
    is right more often than wrong, three to one, so the classes cannot change places.
    """
    v = _digits3(votes)
    prior = np.array([[4.0, 2.0, 6.0], [4.0, 6.0, 2.0]])  # none, for, against on a false and on a true span
    tables = np.repeat((prior / prior.sum(1, keepdims=True))[:, None, :], len(LABELERS), 1)
    share, post = 0.5, np.full(len(votes), 0.5)
    columns = np.arange(len(LABELERS))
    for _ in range(rounds):
        if len(votes):
            odds = np.log(tables[1][columns, v]).sum(1) - np.log(tables[0][columns, v]).sum(1) + math.log(share / (1 - share))
            post = 1 / (1 + np.exp(-np.clip(odds, -40, 40)))
            post = post if known is None else np.where(np.isnan(known), post, known)
        weight, old = np.stack([counts * (1 - post), counts * post]), tables
        tables = np.stack([[prior[y] + np.bincount(v[:, j], weight[y], 3) for j in range(len(LABELERS))] for y in (0, 1)])
        tables /= tables.sum(2, keepdims=True)
        share = float((weight[1].sum() + 1) / (counts.sum() + 2))
        if np.abs(tables - old).max() < 1e-9:
            break
    return post, tables, share


def _features(votes: np.ndarray, shape: np.ndarray) -> np.ndarray:
    v = _digits3(votes)
    bits = [shape >> i & 1 for i in range(SHAPES)]
    return np.column_stack([np.ones(len(votes)), *(v.T == 1), *(v.T == 2), *bits]).astype(float)


def train(found: DataFrame, ridge: float = 1.0) -> dict:
    """Per kind the weights of the span classifier and the estimates behind them, from all spans of ``find_candidates``.

    Only counts of equal (kind, base, votes, shape) come to the driver: 4 * 2 * 3 ** 7 * 2 ** 5 at most, a few hundred in practice.
    """
    s = found.select(F.explode("found").alias("s")).select("s.kind", "s.votes", "s.shape")
    rows = s.groupBy("kind", "votes", "shape").agg(F.count(F.lit(1)).alias("n")).collect()
    rows = sorted(map(tuple, rows))
    model = {}
    for kind in range(len(KINDS)):
        own = np.array([r[1:] for r in rows if r[0] == kind], np.int64).reshape(-1, 3)
        patterns, where = np.unique(own[:, 0], return_inverse=True)
        post, tables, share = estimate(patterns, np.bincount(where, own[:, 2], len(patterns)).astype(float) if len(own) else np.zeros(0), anchors(patterns))
        x, y, n = _features(own[:, 0], own[:, 1]), post[where] if len(own) else np.zeros(0), own[:, 2].astype(float)
        w, keep = np.zeros(x.shape[1]), np.r_[1e-6, np.full(x.shape[1] - 1, ridge)]
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + np.diag(keep), x.T @ (n * (y - p)) - keep * w)
            w += np.clip(step, -3, 3)
            if np.abs(step).max() < 1e-8:
                break
        model[kind] = {"weights": w.tolist(), "reliability": tables.tolist(), "share": share}
    return model


def choose(found: list[dict], scores: list[float], add: float = ADD) -> list[tuple[int, int, int, bool, float]]:
    """(kind, start, end, base, score): all base spans, and the candidates of sufficient score that meet none of them, best first."""
    kept = [(f["kind"], f["start"], f["end"], True, s) for f, s in zip(found, scores) if f["base"]]
    rest = sorted((-s, f["start"], -f["end"], f["kind"]) for f, s in zip(found, scores) if not f["base"] and s >= add)
    taken: list[tuple[int, int]] = []  # disjoint, in order
    for _, a, b, _, _ in sorted(kept, key=lambda r: r[1]):
        if taken and a < taken[-1][1]:
            taken[-1] = (taken[-1][0], max(b, taken[-1][1]))
        else:
            taken.append((a, b))
    for s, a, b, kind in rest:
        i = bisect.bisect(taken, (a, -b))
        if (i == 0 or taken[i - 1][1] <= a) and (i == len(taken) or -b <= taken[i][0]):
            taken.insert(i, (a, -b))
            kept.append((kind, a, -b, False, -s))
    return sorted(kept, key=lambda r: (r[1], r[0], r[2]))


def find_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", add: float = ADD) -> DataFrame:
    """Per row: id and ``spans``, an array of kind (name), start, end, base, score by start, then kind."""
    found = find_candidates(docs, id_col, text_col)
    weights = {k: np.array(m["weights"]) for k, m in train(found).items()}
    kind = dict(found.dtypes)["id"]
    spans = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        for b in batches:
            out = []
            for own in b.column(1).to_pylist():
                scores = []
                for f in own:
                    key = f["kind"], f["votes"], f["shape"]
                    if key not in known:
                        x = _features(np.array([f["votes"]]), np.array([f["shape"]]))
                        known[key] = float(1 / (1 + np.exp(-np.clip(x @ weights[f["kind"]], -30, 30)))[0])
                    scores.append(known[key])
                out.append([dict(zip(("kind", "start", "end", "base", "score"), (KINDS[k], *rest))) for k, *rest in choose(own, scores, add)])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, spans)], names=["id", "spans"])

    return found.mapInArrow(run, f"id {kind}, spans array<struct<kind:string,start:int,end:int,base:boolean,score:double>>").withColumnRenamed("id", id_col)


def joined(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
