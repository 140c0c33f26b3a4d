import base64
import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow.fs as pafs
import pytest
import tiktoken
from pyspark.sql import functions as F

from hirelake.llm import byte_bpe, fingerprints, ngram_lm, warc
from hirelake.llm.queries import VOCABULARY
from hirelake.session import shared_dir


@pytest.fixture(scope="module")
def raw():
    return byte_bpe.read_ranks(VOCABULARY)


@pytest.fixture(scope="module")
def library(raw):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def odd_texts():
    rng = random.Random(1)
    letters = "aZéß中 \t\n\r  '\"!.-_012½stmdrevl'''   \U0001F600\u0301\x00\u00a0"
    texts = ["".join(rng.choices(letters, k=rng.randrange(60))) for _ in range(3000)]
    texts += ["".join(chr(rng.choice([rng.randrange(32, 0xD7FF), rng.randrange(0xE000, 0x10FFFF)])) for _ in range(20)) for _ in range(500)]
    return texts + ["", "'", "I'll we're ''s 's's it'S", "a \n\n b\n c  ", "<|endoftext|>", "=" * 900, "ab" * 700, " " * 3000 + "x", "\U00010d40\U000105c0a1"]


def test_encoding_equals_the_library(raw, library, monkeypatch):
    codec, texts = byte_bpe.codec(raw), odd_texts()
    want = library.encode_ordinary_batch(texts, num_threads=1)
    for window in (byte_bpe.WINDOW, 50):
        monkeypatch.setattr(byte_bpe, "WINDOW", window)
        got = codec.encode(texts)
        assert [np.frombuffer(g, "<u4").tolist() for g in got] == want
    for text, g in zip(texts, got):
        data, at = codec.decode(np.frombuffer(g, "<u4"))
        assert data == text.encode() and len(at) == len(g) // 4


def test_encode_and_decode_columns(spark, raw, library):
    rows = [(1, "Hello wörld's  end", 5), (2, None, 6), (2, "", 7), (2, "", 7)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, offsets int")
    out = byte_bpe.encode(df, VOCABULARY)
    assert out.columns == ["doc_id", "text", "ids", "offsets"]
    back = out.withColumn("bytes", byte_bpe.decoded(F.col("ids"), raw)).collect()
    for r in back:
        text = (r.text or "").encode()
        assert bytes(r.bytes) == text and list(r.ids) == library.encode_ordinary(r.text or "")
        assert list(r.offsets) == [0, *np.cumsum([len(library.decode_single_token_bytes(i)) for i in r.ids])[:-1].tolist()][:len(r.ids)]
    digests = df.select(byte_bpe.round_trip(F.coalesce("text", F.lit("")), raw).alias("r")).select("r.*").collect()
    assert digests[0].ids_sha256 == hashlib.sha256(np.array(library.encode_ordinary(rows[0][1]), "<u4").tobytes()).hexdigest()
    assert digests[1].decoded_sha256 == hashlib.sha256(b"").hexdigest()
    assert byte_bpe.encode(df.limit(0), VOCABULARY).count() == 0


def page_rows():
    rng = random.Random(2)
    big = "<p>" + "".join(rng.choices("abcdefgh ", k=5000)) + "</p>"
    rows = [(i, f"http://h/{i}", big + str(i % 7)) for i in range(40)] + [(50, None, None), (51, "u\r\nv", ""), (52, "u", "x" * 999), (53, "u", "x" * 999), (54, "u", "é" * 600),
            (55, "u", "é" * 600), (55, "u", "é" * 600), (None, "u", "é" * 600), (60, "u", "\x1f\x8b\x08 WARC/1.1\r\n\r\n" * 200)]
    return rows + [(70 + k, "u", "".join(chr(rng.randrange(32, 0x2FF)) for _ in range(9000))) for k in range(20)]


@pytest.mark.parametrize("split", [700, 5000, 1 << 22])
def test_archives_round_trip_at_any_split(spark, split):
    rows = page_rows()
    pages = spark.createDataFrame([(i, u, h, "x") for i, u, h in rows], "page_id bigint, url string, html string, digest string").repartition(3)
    files, folder = warc.store_pages(pages)
    back = warc.read_archives(files, folder, split_bytes=split).collect()
    tops = {}
    for i, _, h in rows:
        if len((h or "").encode()) >= 1000 and i is not None:
            tops[h] = max(tops.get(h, i), i)
    want = []
    for i, _, h in rows:
        data, top = (h or "").encode(), tops.get(h)
        other = top is not None and top != i
        want.append((str(i or ""), len(data), hashlib.sha1(data).hexdigest(), "revisit" if other else "response", str(top) if other else "", b"" if other else data))
    assert sorted((r.id if r.id != "0" else "", r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, bytes(r.payload)) for r in back) == sorted(want)
    assert sorted(f.file for f in warc.find_archives(spark, folder).collect()) == sorted(f.file for f in files.collect())
    assert warc.read_archives(warc.store_pages(pages.limit(0))[0], folder).count() == 0


def test_reader_goes_on_after_damage(spark, tmp_path):
    import zlib

    def member(i):
        packer = zlib.compressobj(6, zlib.DEFLATED, 31)
        data = f"payload {i} ".encode() * 100
        return packer.compress(warc.record_bytes("response", str(i), "u", data, hashlib.sha1(data).hexdigest(), "")) + packer.flush()

    parts = [member(i) for i in range(5)]
    parts[2] = parts[2][:40] + b"\x00" * 20 + parts[2][60:]
    path = tmp_path / "a.warc.gz"
    path.write_bytes(b"junk" + b"".join(parts) + member(9)[:60])
    found = [r["id"] for r in warc.records_in(str(path), pafs.LocalFileSystem(), 0, 1 << 20)]
    assert found == ["0", "1", "3", "4"]
    rows = list(warc.records_in(str(path), pafs.LocalFileSystem(), 0, 1 << 20, damage=True))
    assert [r["id"] for r in rows] == ["0", "1", None, "3", "4", None]
    assert [r["record_type"] for r in rows if r["error"]] == [warc.DAMAGED] * 2
    assert [r["position"] for r in rows if r["error"]] == [4 + len(parts[0]) + len(parts[1]), 4 + sum(map(len, parts))]


def test_lost_and_damaged_records_stop_the_reader_of_stored_pages(spark):
    pages = spark.createDataFrame([(i, f"u{i}", f"text {i} " * (20_000 if i == 3 else 30)) for i in range(60)], "page_id bigint, url string, html string")
    files, folder = warc.store_pages(pages.coalesce(1))
    assert warc.read_stored(files, folder, 500).count() == 60
    file = files.first()
    raw = open(file.file, "rb").read()
    at = [r["position"] for r in warc.records_in(file.file, pafs.LocalFileSystem(), 0, len(raw))]
    for bad in (raw[:at[20]] + b"\0\0\0" + raw[at[20] + 3:], raw[:at[30]] + raw[at[31]:], raw[:-20]):
        with open(file.file, "wb") as out:
            out.write(bad)
        with pytest.raises(RuntimeError, match="60 records were written, 59 read"):
            warc.read_stored(files, folder)


def test_candidates_without_a_whole_header_are_no_records(tmp_path):
    import zlib

    def member(data):
        packer = zlib.compressobj(6, zlib.DEFLATED, 31)
        return packer.compress(data) + packer.flush()

    good = member(warc.record_bytes("response", "1", "u" * 5000, b"x", hashlib.sha1(b"x").hexdigest(), ""))
    path = tmp_path / "b.warc.gz"
    path.write_bytes(member(b"WARC/1.1\r\nWARC-Type: response\r\n\r\n") + member(b"WARC/1.1\r\nno end") + good)
    assert [r["id"] for r in warc.records_in(str(path), pafs.LocalFileSystem(), 0, 1 << 20, damage=True)] == ["1"]


def lm_rows():
    rng = random.Random(4)
    words = [f"w{i}" for i in range(30)]
    rows = [(i, " ".join(rng.choices(words, weights=[30 - k for k in range(30)], k=rng.randint(1, 40)))) for i in range(200)]
    return rows + [(500, None), (501, ""), (502, "W1 unknown w2\tunknown2"), (502, "W1 unknown w2\tunknown2")] + [(600 + k, "same pair " * 20) for k in range(30)]


def test_model_matches_brute_force(spark, monkeypatch):
    rows = lm_rows()
    tokens = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), None]
    learnt = [(i, t) for i, t in rows if i % 3]
    uni, pairs = Counter(), Counter()
    for _, t in learnt:
        seq = tokens(t)
        uni.update(seq)
        pairs.update(zip([None, *seq], seq))
    follows = Counter(w for _, w in pairs)

    def cuts(counts):
        n = [sum(c == k for c in counts) for k in (1, 2, 3, 4)]
        y = n[0] / (n[0] + 2 * n[1])
        return lambda c: 0 if not c else min(max(min(c, 3) - (min(c, 3) + 1) * y * n[min(c, 3)] / n[min(c, 3) - 1], 0), min(c, 3) - 1e-3)

    d, e = cuts(pairs.values()), cuts(follows.values())
    spare, size, n = sum(e(c) for c in follows.values()), len(uni), sum(uni.values())
    spread = Counter()
    for (u, _), c in pairs.items():
        spread[u] += d(c)

    def chance(u, w):
        low = ((max(follows[w] - e(follows[w]), 0)) + spare / (size + 1)) / len(pairs)
        return (max(pairs[u, w] - d(pairs[u, w]), 0) + spread[u] * low) / uni[u] if uni[u] else low

    assert abs(sum(chance("w3", w) for w in [*uni, "?"]) - 1) < 1e-9
    for frequent in (10_000, 8):  # with 8, common contexts are dealt over all shards
        monkeypatch.setattr(ngram_lm, "FREQUENT", frequent)
        df = spark.createDataFrame([(i, t, 1.0) for i, t in rows], "doc_id bigint, text string, score double").repartition(3)
        model = ngram_lm.train(df.where("doc_id % 3 <> 0"))
        assert (model["n"], model["v"], model["pairs"]) == (n, size, len(pairs))
        out = ngram_lm.score(df, model).collect()
        assert len(out) == len(rows)
        want = {}
        for i, t in rows:
            seq = tokens(t)
            want[i] = (len(seq), sum(uni[w] > 0 for w in seq), sum(math.log10((uni[w] + .1) / (n + .1 * (size + 1))) for w in seq),
                       sum(math.log10(chance(u, w)) for u, w in zip([None, *seq], seq)))
        for r in out:
            assert (r.n_tokens, r.n_known) == want[r.doc_id][:2] and r.train_tokens == n
            assert abs(r.base_score - want[r.doc_id][2]) < 1e-6 and abs(r.score - want[r.doc_id][3]) < 1e-6
    empty = ngram_lm.train(df.limit(0))
    assert [r.score for r in ngram_lm.score(df.where("doc_id = 500"), empty).collect()] == [0.0]
    assert ngram_lm.score(df.limit(0), model).count() == 0


def test_edited_texts_match_brute_force(spark):
    rng = random.Random(7)
    rows = [(i * 3 - 50, "".join(rng.choices("ab é\n中", k=rng.randint(0, 80)))) for i in range(300)] + [(None, "last"), (2000, None), (2001, "x" * 100_001)]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id bigint, text string, piece int").repartition(6)
    out = {r.doc_id: r for r in fingerprints.edit_and_compare(df).collect()}
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    hasher = fingerprints.Hasher()
    assert len(out) == len(rows)
    for k, (i, t) in enumerate(order):
        t, after = t or "", order[(k + 1) % len(order)][1] or ""
        edited = t[:len(t) - len(t) // 2] + after[:len(t) // 2]
        r = out[i]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        a, b, c = (fingerprints.fingerprint(x, hasher) for x in (t, edited, after))
        assert (r.fingerprint, r.edited_fingerprint) == (f"{a:016x}", f"{b:016x}")
        assert r.near_edited == fingerprints.likeness(a, b) and r.near_next == fingerprints.likeness(a, c)
    assert fingerprints.edit_and_compare(df.limit(0)).count() == 0
    one = fingerprints.edit_and_compare(df.where("doc_id = 2001")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0


@pytest.mark.parametrize("radius", [1, 3, 5])
def test_block_tables_find_all_within_the_radius(spark, radius):
    rng = random.Random(radius)
    fps = {rng.getrandbits(64) for _ in range(60)}
    for f in list(fps):
        for _ in range(8):
            g = f
            for b in rng.sample(range(64), rng.randint(1, 7)):
                g ^= 1 << b
            fps.add(g)
    df = spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in fps], "fp bigint")
    got = sorted((r.query & (2**64 - 1), r.fp & (2**64 - 1), r.distance) for r in fingerprints.find_within(df, df, radius).collect())
    assert got == sorted((a, b, (a ^ b).bit_count()) for a in fps for b in fps if (a ^ b).bit_count() <= radius)


def test_shared_folder_is_used(spark):
    assert shared_dir(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))


def test_codec_keeps_no_pieces_of_a_task():
    raw = byte_bpe.read_ranks(VOCABULARY)
    with byte_bpe.task_codec(raw) as c:
        c.encode(["a few words that the codec has to merge"])
        assert c.cache
    assert not byte_bpe.codec(raw).cache and c is byte_bpe.codec(raw)
