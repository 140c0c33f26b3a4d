import base64
import hashlib
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from hirelake.llm import near_dups, queries, toxicity
from hirelake.llm.queries import VOCABULARY
from hirelake.llm.shared import written
from hirelake.sources.entities import SCHEMAS, read_entity

from .test_dedup import brute_alike, plain_simhash

SF = "/root/testdata/sf0.001"
BLANK, WORD = re.compile(r"[\x20\x09-\x0D]"), re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    """Documents of the smallest table with planted copies, near copies, nulls and repeated rows."""
    rows = [tuple(r) for r in read_entity(spark, SF, "documents").collect()]
    text = " ".join(f"planted{i % 83} word{i}" for i in range(400))
    more = [(10_000, text, "en", "src1", len(text)), (10_001, text.replace(" ", "\n") + " ", "en", "src2", len(text) + 1), (10_002, text.replace("word7 ", "other "), "en", None, len(text)),
            (10_003, None, None, None, None), (10_004, "", "en", "src1", 0), (10_005, "clean words of their own " + "lovely " * 30, "en", "src3", 235)]
    return spark.createDataFrame([*rows, *more, rows[3], rows[3]], SCHEMAS["documents"])


def test_stages_are_registered_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "simhash_near_dedup", "mix_sources", "byte_bpe"]
    assert {f"op{n}" for n in range(1, 14)} == {name.split("_")[0] for name in queries.QUERIES}


def test_toxicity_stage_follows_the_score(spark, docs):
    out = corpus_pipeline.drop_toxic(spark, docs, SF)
    assert out.columns == docs.columns
    model = toxicity.train(read_entity(spark, SF, "documents"), queries.learnable(spark, SF))
    measure = toxicity.Measure(model.toxic, model.ordinary)
    chance = lambda t: 1 / (1 + np.exp(-np.dot(measure.features(t), model.weights)))
    want = Counter(r.doc_id for r in docs.collect() if chance(r.text or "") < toxicity.THRESHOLD)
    assert Counter(r.doc_id for r in out.collect()) == want and {10_005, 10_003} <= set(want)


def test_dedup_stages(spark, docs):
    exact = corpus_pipeline.drop_copies(spark, docs, SF)
    assert exact.columns == docs.columns
    kept = exact.collect()
    forms = Counter(BLANK.sub("", r.text or "") for r in docs.collect())
    assert Counter(BLANK.sub("", r.text or "") for r in kept) == Counter(dict.fromkeys(forms, 1))
    assert 10_001 in {r.doc_id for r in kept} and 10_000 not in {r.doc_id for r in kept}
    near = corpus_pipeline.drop_near_copies(spark, exact, SF)
    least = {}
    for r, root in zip(kept, brute_alike([(r.doc_id, r.text) for r in kept])):
        least[root] = min(least.get(root, 10**9), r.doc_id)
    assert near.columns == docs.columns and sorted(r.doc_id for r in near.collect()) == sorted(least.values())


def test_mix_and_encoding(spark, docs):
    mixed = written(corpus_pipeline.mix_sources(spark, docs, SF), "mixed")  # as the pipeline does between stages
    assert mixed.columns == docs.columns
    size, taken = Counter(), Counter()
    for r in docs.collect():
        size[r.source] += len(WORD.findall(r.text or ""))
    rows = mixed.collect()
    for r in rows:
        taken[r.source] += len(WORD.findall(r.text))
    order = sorted(size, key=lambda s: (s is None, s or ""))
    total, weight, aim = sum(size.values()), {s: i % 3 + 1 for i, s in enumerate(order)}, {}
    capped = set()
    while True:
        unit = (total - sum(3 * size[s] for s in capped)) / sum(weight[s] for s in order if s not in capped)
        more = {s for s in order if s not in capped and weight[s] * unit >= 3 * size[s]}
        if not more:
            break
        capped |= more
    for s in order:
        aim = 3 * size[s] if s in capped else unit * weight[s]
        assert abs(taken[s] - aim) <= max(3, 0.01 * aim)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(VOCABULARY, "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    out = corpus_pipeline.encode_texts(spark, mixed, SF).collect()
    digest = lambda b: hashlib.sha256(b).hexdigest()
    want = Counter((r.doc_id, digest(np.array(library.encode_ordinary(r.text), "<u4").tobytes()), digest(r.text.encode())) for r in rows)
    assert Counter((r.doc_id, r.ids_sha256, r.decoded_sha256) for r in out) == want


def test_stages_pass_empty_tables(spark, docs):
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0
    assert near_dups.keep_one(empty).columns == docs.columns


def test_near_stage_drops_texts_that_share_four_fifths_of_their_five_word_shingles(spark, docs):
    words = [f"own{i}" for i in range(200)]
    changed = list(words)
    for at in (40, 90, 150):
        changed[at] = "other"
    apart = [w if i % 9 else "other" for i, w in enumerate(words)]
    rows = spark.createDataFrame([(i, " ".join(w), "en", "src1", 0) for i, w in ((20_000, words), (20_001, changed), (20_002, apart))], SCHEMAS["documents"])
    assert (plain_simhash(" ".join(words)) ^ plain_simhash(" ".join(changed))).bit_count() > near_dups.RADIUS
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_copies(spark, rows, SF).collect()) == [20_000, 20_002]
