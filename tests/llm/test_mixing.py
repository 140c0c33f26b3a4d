import heapq
import re
from collections import defaultdict

from pyspark.sql import functions as F

from hirelake.llm import mixing

SCHEMA = "doc_id bigint, text string, source string, n_chars bigint, size int, taken string, position int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def frame(spark, rows):
    return spark.createDataFrame([(i, t, s, len(t or ""), 1, "x", 3) for i, t, s in rows], SCHEMA)


def corpus():
    rows, n = [], 0
    for source, count, length in (("big", 60, 400), ("é", 10, 150), (None, 8, 90), ("a", 3, 20), ("z", 5, 0), ("tiny", 1, 2)):
        for k in range(count):
            rows.append((n, " ".join(f"w{j}" for j in range(length + k)) if length else None, source))
            n += 1
    return rows + [rows[0], rows[0]]


def brute_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    capped = set()
    while True:
        rest = sum(sizes.values()) - sum(3 * sizes[s] for s in capped)
        open_ = sum(weight[s] for s in order if s not in capped)
        aim = {s: 3 * sizes[s] if s in capped else rest * weight[s] / open_ for s in order}
        more = {s for s in order if s not in capped and aim[s] >= 3 * sizes[s]}
        if not more:
            return aim
        capped |= more


def test_targets_and_taken_words(spark):
    rows = corpus()
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len(WORD.findall(t or ""))
    aims = brute_targets(sizes)
    plan = mixing.plan_mix(frame(spark, rows)).collect()
    assert len(plan) == len(rows)
    taken = defaultdict(int)
    for r in plan:
        assert abs(r.target - aims[r.source]) < 1e-6 and r.source_size == sizes[r.source]
        assert 0 <= r.taken <= 3 * r["size"]
        taken[r.source] += r.taken
    for s, aim in aims.items():
        assert abs(taken[s] - aim) <= max(2, 0.01 * aim), (s, taken[s], aim)
    again = mixing.plan_mix(frame(spark, rows).repartition(5)).collect()
    assert sorted((r.id, r["size"], r.taken) for r in again) == sorted((r.id, r["size"], r.taken) for r in plan)


def test_quotas_are_highest_quotients(spark):
    sizes = {"a": 5000, "b": 5000, "c": 333, "d": 8100, "e": 41}
    aims = {"a": 4000.0, "b": 4000.0, "c": 700.0, "d": 9000.0, "e": 100.0}
    df = spark.createDataFrame([(s, sizes[s], aims[s], False, i) for i, s in enumerate(sizes)], "source string, source_size bigint, target double, capped boolean, position int")
    block, shards = 50, 3
    got = {r.source: r for r in mixing.quotas(df, block, shards).collect()}
    house = [round(sum(aims.values()) / block * (k + 1) / shards) for k in range(shards)]
    heap = [(-aims[s], i, s, 0) for i, s in enumerate(sizes)]
    seats, want = defaultdict(int), []
    heapq.heapify(heap)
    for seat in range(1, house[-1] + 1):
        _, i, s, n = heapq.heappop(heap)
        seats[s] += 1
        heapq.heappush(heap, (-aims[s] / (2 * n + 3), i, s, n + 1))
        if seat in house:
            want.append(dict(seats))
    for s in sizes:
        assert list(got[s].upto) == [w.get(s, 0) for w in want]
        assert sum(got[s].quota) == got[s].upto[-1] and all(q >= 0 for q in got[s].quota)


def test_mixed_documents_hold_the_words_taken(spark):
    rows = corpus()
    df = frame(spark, rows)
    out = mixing.mix_documents(df, block_words=16)
    assert out.columns == df.columns
    want = sum(r.taken for r in mixing.plan_mix(df, block_words=16).collect())
    texts = out.collect()
    assert sum(len(WORD.findall(r.text or "")) for r in texts) == want
    whole = {i: t for i, t, _ in rows}
    assert all(set(WORD.findall(r.text)) <= set(WORD.findall(whole[r.doc_id])) and r.n_chars == len(r.text) for r in texts)


def test_empty_and_blank_tables(spark):
    empty = frame(spark, corpus()).limit(0)
    assert mixing.plan_mix(empty).count() == 0 and mixing.mix_documents(empty).count() == 0
    blank = mixing.plan_mix(frame(spark, [(1, None, None), (1, " \n", "s")])).collect()
    assert [r.taken for r in blank] == [0, 0]


def test_word_count(spark):
    texts = ["", "a", " a\tb\n\nc ", "\x0b\x0cx\r", "é 中文\u00a0y"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(mixing.word_count(F.col("t")).alias("n"), "t")
    assert all(r.n == len(WORD.findall(r.t)) for r in df.collect())
