import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from hirelake.llm import pii
from hirelake.llm.queries import QUERIES

SCHEMA = "doc_id bigint, text string, spans int, found string"
PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_luhn(d):
    return sum(sum(divmod(int(x) * (1 + i % 2), 10)) for i, x in enumerate(d[::-1])) % 10 == 0


def brute_base(text):
    """The patterns as they are stated."""
    out = []
    for k, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(len(p.lstrip("0")) > 3 or int(p.lstrip("0") or 0) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (14 <= len(digits) <= 19 and brute_luhn(digits)):
                continue
            if kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), k, kind, m.end()))
    return [f"{kind}:{a}:{b}" for a, _, kind, b in sorted(out)]


CASES = ["", None, "a@b.c@d.ef g@h", "x@y z@w.v..u", "1.2.3.4.5.6.7.8.9 256.1.1.1 001.002.003.0004 " + "9" * 5000 + ".1.1.1", "4111 1111 1111 1111, 4111-1111-1111-1112 411111111111111",
         "+1 (555) 010-0199 +1  +44 20 7946 0958 9 +1+15550100199", "é.x@ü.com josé@mail.example", "é" * 70_000 + " jo.doe@mail.example 10.0.0.1 " + "b" * 50_000 + "@",
         "write to jo.doe [at] mail [dot] example or ann (at) mail.example", "+1 (555) 010-0199 " * 3000]


def noise(seed, n):
    rng = random.Random(seed)
    parts = ["@", ".", "+", "-", " ", "(", ")", "a", "b1", "é", "1", "23", "255", "256", "4111111111111111", "0", "x@y.z", "%", "\n"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for _ in range(n)]


def test_scans_find_what_the_patterns_find():
    for text in [c or "" for c in CASES] + noise(1, 4000):
        got = sorted((a, k, pii.KINDS[k], b) for k, a, b, ok in pii.matches(text) if ok)
        assert [f"{kind}:{a}:{b}" for a, _, kind, b in got] == brute_base(text), text[:200]


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)


def test_base_spans_stay_and_added_ones_meet_none(spark):
    rows = list(enumerate([*CASES, *noise(2, 500)])) + [(None, "x@y.zz"), (3, "x@y.zz")]
    out = pii.find_spans(frame(spark, rows)).collect()
    assert len(out) == len(rows)
    want = sorted((str(i), ",".join(brute_base(t))) for i, t in rows)
    assert sorted((str(r.doc_id), ",".join(f"{s.kind}:{s.start}:{s.end}" for s in r.spans if s.base)) for r in out) == want
    for r in out:
        added = [(s.start, s.end) for s in r.spans if not s.base]
        for a, b in added:
            assert sum(x.start < b and a < x.end for x in r.spans) == 1
    assert pii.find_spans(frame(spark, rows).where(F.lit(False))).count() == 0


def planted(seed, n):
    """Texts with true base spans, true looser ones and decoys; the looser ones and the decoys are listed apart."""
    rng, rows, loose, decoys = random.Random(seed), [], [], []

    def card(valid):
        d = "4" + "".join(rng.choice("0123456789") for _ in range(14))
        check = next(c for c in "0123456789" if brute_luhn(d + c) == valid)
        return d + check

    for i in range(n):
        kind = i % 8
        words = " ".join("".join(rng.choice("aeinorst") for _ in range(rng.randint(2, 8))) for _ in range(20))
        d = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
        span = {0: f"{rng.choice('abcd')}n.{d(2)}@mail{d(1)}.example", 1: f"+1 (555) {d(3)}-{d(4)}", 2: card(True), 3: f"10.{rng.randint(0, 255)}.{rng.randint(0, 255)}.7",
                4: f"ann.{d(2)} [at] mail{d(1)} [dot] com", 5: card(False), 6: f"10.{rng.randint(256, 999)}.3.4", 7: f"ana{d(2)}.josé@mail{d(1)}.com"}[kind]
        before = {4: "contact "}.get(kind, "")
        rows.append((i, f"{words} {before}{span} {words}"))
        place = len(words) + 1 + len(before)
        (loose if kind in (4, 7) else decoys if kind in (5, 6) else []).append((i, place, place + len(span)))
    return rows, loose, decoys


def test_looser_spans_are_added_and_decoys_are_not(spark):
    rows, loose, decoys = planted(5, 800)
    added = {(r.doc_id, s.start, s.end) for r in pii.find_spans(frame(spark, rows)).collect() for s in r.spans if not s.base}
    assert len(added & set(loose)) >= 0.9 * len(loose)
    assert not added & set(decoys) and len(added - set(loose)) <= 0.01 * len(rows)


def test_em_finds_the_reliabilities_of_simulated_labelers():
    rng = np.random.default_rng(3)
    right, speaks = np.array([0.95, 0.9, 0.8, 0.7, 0.85, 0.6, 0.75]), np.array([0.9, 0.8, 0.7, 0.6, 0.5, 0.9, 0.4])
    y = rng.random(60_000) < 0.3
    v = np.where(rng.random((len(y), 7)) < right, np.where(y, 1, 2)[:, None], np.where(y, 2, 1)[:, None]) * (rng.random((len(y), 7)) < speaks)
    number = (v * 3 ** np.arange(6, -1, -1)).sum(1)
    patterns, where, counts = np.unique(number, return_inverse=True, return_counts=True)
    post, tables, share = pii.estimate(patterns, counts.astype(float))
    assert abs(share - 0.3) < 0.02
    assert np.abs(tables[1][:, 1] - right * speaks).max() < 0.03 and np.abs(tables[0][:, 2] - right * speaks).max() < 0.03
    assert ((post[where] > 0.5) == y).mean() > 0.95


def test_query_matches_brute_force_on_base_spans(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    out = QUERIES["op12_personal_data"](spark, "/root/testdata/sf0.01").collect()
    assert len(out) == len(docs)
    for r in out:
        base = brute_base(docs[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(s.startswith(k) for s in base) for k in pii.KINDS)
        assert set(base) <= set(r.spans.split(","))
        for s in set(r.spans.split(",")) - set(base) - {""}:
            if s.startswith("card:"):  # one of several numbers side by side
                assert brute_luhn(docs[r.doc_id][int(s.split(":")[1]):int(s.split(":")[2])].replace("-", ""))
                continue
            pytest.fail(f"clean text marked: {s} {docs[r.doc_id][int(s.split(':')[1]):int(s.split(':')[2])]!r}")
