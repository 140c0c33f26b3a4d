import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from hirelake.llm import variants
from hirelake.llm.queries import QUERIES
from hirelake.llm.shared import LOWER, UPPER

SCHEMA = "doc_id bigint, text string, word int, n string"


def brute_words(rows, least=6, count=5):
    n = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(str.maketrans(UPPER, LOWER))
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 199 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= least and c >= count}


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute_groups(n):
    near = {w: [x for x in n if one_edit(w, x)] for w in n}
    form = {}
    for w, own in near.items():
        top = min(own, key=lambda x: (-n[x], x), default=None)
        form[w] = top if top and n[top] >= 5 * n[w] else None

    def root(w):
        return root(form[w]) if form[w] else w

    return {(w, form[w], root(w), n[w], len(near[w]), n.get(form[w])) for w in n}


def rows_of(df):
    return {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


def vocabulary(seed, letters, size, longest):
    """Words over few letters, so that many are near each other and grams repeat, with counts that make chains."""
    rng = random.Random(seed)
    words = {"".join(rng.choice(letters) for _ in range(rng.randint(4, longest))) for _ in range(size)}
    for w in list(words)[:size // 2]:
        i = rng.randrange(len(w))
        words |= {w[:i] + w[i + 1:], w[:i] + rng.choice(letters) + w[i:], w[:i] + rng.choice(letters) + w[i + 1:]}
    return {w: 5 ** rng.randint(0, 7) + rng.randint(0, 2) for w in words if len(w) > 3}


@pytest.mark.parametrize("letters,longest", [("ab", 9), ("aé", 7), ("abcdefgh", 8)])
def test_groups_match_brute_force(spark, letters, longest):
    n = vocabulary(len(letters), letters, 150, longest)
    out = variants.group_variants(spark.createDataFrame(list(n.items()), "word string, n bigint"))
    assert rows_of(out) == brute_groups(n)


def test_pivots_are_disjoint_cheapest_and_in_the_prefix(spark):
    n = vocabulary(4, "abc", 100, 10)
    grams = Counter(w[i:i + 2] for w in n for i in range(len(w) - 1))
    for r in variants.gram_prefixes(spark.createDataFrame(list(n.items()), "word string, n bigint")).collect():
        order = sorted((grams[r.word[i:i + 2]], r.word[i:i + 2], i) for i in range(len(r.word) - 1))
        prefix = [x for x in order if x[:2] <= order[2][:2]]
        assert sorted(r.places) == sorted(i for *_, i in prefix) and tuple(r["last"]) == order[2][:2]
        a, b = r.pivots
        best = min(x[0] + y[0] for x in prefix for y in prefix if y[2] - x[2] > 1)
        assert b - a > 1 and {a, b} <= set(r.places) and grams[r.word[a:a + 2]] + grams[r.word[b:b + 2]] == best


def test_short_words_are_refused(spark):
    with pytest.raises(ValueError):
        variants.near_words(spark.createDataFrame([("abc", 9)], "word string, n bigint"))


def test_words_of_whole_texts(spark):
    rows = [(None, "Straße straße"), (1, None), (2, ""), (3, "Größer×größer " * 30_000 + "lastword" * 20_000), (4, "colour COLOUR colouR ÀÉÎõü÷ÿ"), (4, "colour COLOUR colouR ÀÉÎõü÷ÿ")]
    rows += [(i, "colour color flavour flavor ÀÉÎõü÷ÿ straße") for i in range(400)]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)
    counted = variants.count_words(docs)
    assert {r.word: r.n for r in counted.collect()} == brute_words(rows)
    assert rows_of(variants.group_variants(counted)) == brute_groups(brute_words(rows))
    assert variants.group_variants(variants.count_words(docs.where(F.lit(False)))).count() == 0


def test_query_matches_brute_force(spark):
    docs = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    assert rows_of(QUERIES["op13_spelling_variants"](spark, "/root/testdata/sf0.001")) == brute_groups(brute_words(docs))
