import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from hirelake.llm import exact_dedup, near_dups

SCHEMA = "doc_id bigint, text string, size int, row string"
BLANK = re.compile(r"[\x20\x09-\x0D]")


def frame(spark, rows):
    """Rows (id, text) with extra columns whose names clash with names used inside."""
    return spark.createDataFrame([(i, t, 7, "x") for i, t in rows], SCHEMA)


EXACT = [(5, "a b"), (2, "ab"), (9, " a  b "), (7, None), (3, ""), (1, "\n"), (None, "ab"), (4, "c"), (4, "c"), (None, "zz"), (8, "long " * 50_000), (6, "long" * 50_000)]


def brute_exact(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(BLANK.sub("", t or ""), []).append((-len(t or ""), i is None, i or 0, i))
    return {k: (min(v)[3], len(v)) for k, v in groups.items()}


@pytest.mark.parametrize("digest", [exact_dedup.sha256, lambda c: F.pmod(F.length(c), F.lit(2))])
def test_copies_match_brute_force_also_when_digests_collide(spark, digest):
    want = brute_exact(EXACT)
    out = exact_dedup.find_copies(frame(spark, EXACT), digest=digest).collect()
    assert len(out) == len(EXACT)
    got = sorted((str(r.doc_id), str(r.keep_id), r.group_size) for r in out)
    assert got == sorted((str(i), str(want[BLANK.sub("", t or "")][0]), want[BLANK.sub("", t or "")][1]) for i, t in EXACT)
    kept = [r for r in out if r.kept]
    assert len(kept) == len(want) and all(r.doc_id == r.keep_id for r in kept)


def test_keep_one_carries_all_columns_and_keeps_one_of_each(spark):
    out = exact_dedup.keep_one(frame(spark, EXACT))
    assert out.columns == ["doc_id", "text", "size", "row"]
    assert sorted(BLANK.sub("", r.text or "") for r in out.collect()) == sorted(brute_exact(EXACT))
    empty = frame(spark, EXACT).limit(0)
    assert exact_dedup.keep_one(empty).count() == 0 and exact_dedup.find_copies(empty).count() == 0


def plain_simhash(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps, radius=3):
    root = {f: f for f in fps}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    order = sorted(fps)
    for i, a in enumerate(order):
        for b in order[i + 1:]:
            if (a ^ b).bit_count() <= radius:
                root[find(a)] = find(b)
    return {f: find(f) for f in fps}


def test_groups_match_brute_force(spark):
    rng = random.Random(3)
    words = ["alpha", "Beta", "gamma", "déjà", "ÉTÉ", "x", "9"]
    base = [rng.choices(words, k=rng.randint(1, 300)) for _ in range(12)]
    rows = [(7, None), (3, ""), (None, " \n"), (11, "one"), (11, "one"), (12, "a b")]
    for k, w in enumerate(base):
        for j in range(6):
            v = list(w)
            for _ in range(j // 2):
                v[rng.randrange(len(v))] = rng.choice(words)
            rows.append((100 + 10 * k + j, ("\t" if j else " ").join(v)))
    fps = {i: plain_simhash(t) for i, (_, t) in enumerate(rows)}
    parts = brute_components(set(fps.values()))
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[parts[fps[i]]] = min(least.get(parts[fps[i]], d), d)
    got = sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in near_dups.find_groups(frame(spark, rows)).collect())
    assert got == sorted((str(d), f"{fps[i]:016x}", least[parts[fps[i]]]) for i, (d, _) in enumerate(rows))
    kept = near_dups.keep_one(frame(spark, rows))
    assert kept.columns == ["doc_id", "text", "size", "row"]
    assert sorted(parts[plain_simhash(r.text)] for r in kept.collect()) == sorted(set(parts.values()))
    empty = frame(spark, rows).limit(0)
    assert near_dups.find_groups(empty).count() == 0 and near_dups.keep_one(empty).count() == 0


def test_links_connect_what_pairs_within_the_radius_connect(spark):
    rng = random.Random(5)
    fps = {0, (1 << 64) - 1}
    for _ in range(40):
        centre = rng.getrandbits(64)
        fps.add(centre)
        for _ in range(rng.choice([1, 2, 60])):  # some buckets are long enough for the search
            f = centre
            for b in rng.sample(range(64), rng.randint(1, 5)):
                f ^= 1 << b
            fps.add(f)
    df = spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in fps], "fp bigint")
    found = near_dups.links(df).collect()
    unsigned = lambda x: x & (2**64 - 1)
    assert all((unsigned(r.a) ^ unsigned(r.b)).bit_count() <= 3 for r in found)
    roots = {unsigned(r.node): unsigned(r.root) for r in near_dups.components(spark.createDataFrame(found, "a bigint, b bigint")).collect()}
    want = brute_components(fps)
    same = {}
    for f in fps:
        same.setdefault(want[f], set()).add(roots.get(f, f))
    assert all(len(s) == 1 for s in same.values()) and len(set().union(*same.values())) == len(same)


def test_long_text_fingerprint_is_exact():
    text = " ".join(str(i % 977) for i in range(20_000))
    assert near_dups.simhash(text) == plain_simhash(text)


def five_words(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {" ".join(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_alike(rows, share=0.8):
    """Rows joined by pairs of that Jaccard similarity, as the least place of each row's group."""
    sets, root = [five_words(t) for _, t in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] == sets[j] or len(sets[i] & sets[j]) * 10 >= share * 10 * len(sets[i] | sets[j]) > 0:
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    return root


def test_alike_texts_match_brute_force(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(300)]
    rows = [(7, None), (3, ""), (None, " \n"), (11, "one"), (11, "One"), (12, "a b")]
    for k in range(25):
        v = rng.choices(words, k=rng.randint(20, 300))
        for j in range(8):
            rows.append((1000 - 10 * k - j, " ".join(v)))
            v = list(v)
            for _ in range(1 + len(v) * (k % 4) // 100):
                v[rng.randrange(len(v))] = rng.choice(words)
    root = brute_alike(rows)
    best = {}
    for (i, _), r in zip(rows, root):
        best[r] = min(best.get(r, (True, 0)), (i is None, i or 0))
    kept = near_dups.keep_one_of_alike(frame(spark, rows))
    assert kept.columns == ["doc_id", "text", "size", "row"]
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for _, i in best.values())
    assert len(best) < near_dups.keep_one(frame(spark, rows)).count()  # op10's radius joins fewer
    assert near_dups.keep_one_of_alike(frame(spark, rows).limit(0)).count() == 0


def families():
    """Families of near copies of all sizes, one with a third of all rows, that share words with each other."""
    rng = random.Random(3)
    common = [f"c{i}" for i in range(120)]
    rows = []
    for k in range(6):
        v = common[:20 * k] + [f"f{k}w{i}" for i in range(40 + 30 * k)]
        for j in range(70 if k == 3 else 20):
            w = list(v)
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = f"x{rng.randrange(50)}"
            rows.append((100 * k + j, " ".join(w + [f"t{i}" for i in range(rng.choice((0, 0, 5, 20)))])))
    return rows


@pytest.mark.parametrize("tile, lanes", [(100, near_dups.NEAR), (700, 0), (1 << 22, 0)])
def test_large_families_are_confirmed_in_tiles(spark, tile, lanes):
    rows, best = families(), {}
    for (i, _), r in zip(rows, brute_alike(rows)):
        best[r] = min(best.get(r, i), i)
    kept = near_dups.keep_one_of_alike(frame(spark, rows), near_lanes=lanes, tile=tile)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(best.values()) and 1 < len(best) < len(rows) / 2


def test_simhash_links_propose_alike_pairs(spark):
    words = [f"a{i}" for i in range(400)]
    near = words[:-1] + ["end"]
    # equal fingerprints and unlike sets: one shingle outweighs all others
    loud = ["again"] * 300
    rows = [(1, " ".join(words)), (2, " ".join(near)), (3, " ".join(loud + words[:30])), (4, " ".join(loud + words[30:60])), (5, None)]
    assert (plain_simhash(rows[0][1]) ^ plain_simhash(rows[1][1])).bit_count() <= near_dups.RADIUS
    assert plain_simhash(rows[2][1]) == plain_simhash(rows[3][1])
    kept = near_dups.keep_one_of_alike(frame(spark, rows), near_lanes=near_dups.LANES + 1)  # no pair of MinHash is near enough
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 4, 5]


def test_cells_meet_all_sets_of_like_size(spark):
    nodes = spark.createDataFrame([(r, 1000 * r + i, n) for r, sizes in ((1, (1, 4, 5, 80, 100, 100, 125, 126, 4000)), (2, (3, 3))) for i, n in enumerate(sizes)], "root bigint, fp bigint, n bigint")
    rows = near_dups._tiled(nodes, 100).collect()
    tiles = {r.fp: {(t.p, t.q) for t in r.tiles} for r in rows}
    for a in rows:
        for b in rows:
            if a.root == b.root and 0.8 * max(a.n, b.n) <= min(a.n, b.n):
                assert tiles[a.fp] & tiles[b.fp]
    assert all(tiles[r.fp] == {(0, 0)} for r in rows if r.root == 2)
    assert not tiles[1000] & tiles[1008] and near_dups._tiled(nodes.limit(0), 100).count() == 0


def test_alike_sets_of_one_large_family(spark):
    rows = [(i, " ".join(f"w{j}" for j in range(100)) + f" end{i}") for i in range(30)] + [(99, "another text of some words")]
    assert sorted(r.doc_id for r in near_dups.keep_one_of_alike(frame(spark, rows), tile=100).collect()) == [0, 99]


def test_hot_group_of_copies_is_joined_by_a_split_shuffle(spark):
    keys = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes",
            "spark.sql.adaptive.skewJoin.skewedPartitionFactor", "spark.sql.adaptive.advisoryPartitionSizeInBytes")
    before = {k: spark.conf.get(k, None) for k in keys}
    for k, v in zip(keys, ("-1", "-1", "20KB", "1.5", "20KB")):
        spark.conf.set(k, v)
    try:
        docs = spark.range(0, 60_000, numPartitions=8).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, "one text").otherwise(F.concat(F.lit("text of "), "id")).alias("text"))
        for out in (exact_dedup.find_copies(docs), near_dups.find_groups(docs)):
            assert len(out.toPandas()) == 60_000
            plan = out._jdf.queryExecution().executedPlan().toString()
            assert "skew=true" in plan and "Window" not in plan
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
