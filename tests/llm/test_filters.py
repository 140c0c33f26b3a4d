import random

import numpy as np
from pyspark.sql import functions as F

from hirelake.llm import licences, toxicity, url_reputation
from hirelake.llm.queries import RULES

URLS = [("http://a.NET/x", "a.net", "/x", "net/", "block"), ("https://www.Example.net/en/1?q", "www.example.net", "/en/1", "example.net/en/", "allow"),
        ("x://example.com/de/", "example.com", "/de/", "example.com/de/", "block"), ("x://b.org/fr/z#t", "b.org", "/fr/z", "org/fr/", "allow"),
        ("http://notexample.com/de/1", "notexample.com", "/de/1", None, "allow"), ("http://a.net", "a.net", "", None, "allow"),
        ("http://a.net?u=http://b.org/fr/", "a.net", "", None, "allow"), (None, "", "", None, "allow"), ("nothing", "", "", None, "allow"),
        ("http://ÀB.example.com/é", "Àb.example.com", "/é", None, "allow"), ("a\n://h.org/fr/\n", "h.org", "/fr/\n", "org/fr/", "allow")]


def pages(spark, urls):
    return spark.createDataFrame([(i, u, "h", True) for i, u in enumerate(urls)], "page_id bigint, url string, host string, bad boolean")


def outcomes(spark, rows):
    return spark.createDataFrame([(h, b) for h, n, bad in rows for b in [True] * bad + [False] * (n - bad)] + [("x.example.com", None)], "host string, bad boolean")


def test_hosts_paths_and_rules(spark):
    out = {r.page_id: r for r in url_reputation.judge(pages(spark, [u[0] for u in URLS]), outcomes(spark, [("c.com", 3, 0)]), RULES).collect()}
    assert [(out[i].host, out[i].path, out[i].rule, out[i].verdict) for i in range(len(URLS))] == [tuple(u[1:]) for u in URLS]


def test_reputation_needs_evidence_and_borrows_it(spark):
    labels = [("bad.com", 60, 57), ("few.com", 2, 2), ("good.com", 80, 2), ("m.farm.org", 40, 39), ("w.farm.org", 30, 30), ("fine.org", 60, 1)]
    hosts = ["bad.com", "few.com", "good.com", "m.farm.org", "fine.org", "new.farm.org", "new.com"]
    out = {r.host: r for r in url_reputation.judge(pages(spark, [f"http://{h}/" for h in hosts]), outcomes(spark, labels)).collect()}
    assert out["bad.com"].verdict == out["m.farm.org"].verdict == "block"
    assert out["good.com"].verdict == out["fine.org"].verdict == out["new.com"].verdict == "allow"
    assert out["new.farm.org"].rate > out["new.com"].rate  # the domain's record counts for a host without labels
    assert out["few.com"].rate < 1.0 and out["few.com"].bound < out["bad.com"].bound


def test_url_filters_on_empty_tables(spark):
    assert url_reputation.judge(pages(spark, []).limit(0), outcomes(spark, [])).count() == 0
    assert url_reputation.judge(pages(spark, ["http://a.b/"]), outcomes(spark, []).limit(0)).collect()[0].verdict == "allow"


def test_domains(spark):
    df = spark.createDataFrame([("a.b.co.uk",), ("b.co.uk",), ("x.y.com",), ("com",), ("",)], "h string")
    got = [tuple(r) for r in df.select(url_reputation.suffix_of(F.col("h")), url_reputation.domain_of(F.col("h"))).collect()]
    assert got == [("co.uk", "b.co.uk"), ("co.uk", "b.co.uk"), ("com", "y.com"), ("com", "com"), ("", "")]


KNOWN = [("one", "Copyright (c) 2020 A. Person\nYou may use this licence, wilfully."), ("two", "Second text"), ("two again", "SECOND   text!!"), ("none", " "), ("null", None)]


def test_licence_scan_of_whole_texts_and_lines(spark):
    docs = spark.createDataFrame([(1, "you MAY use  this License -- wilfully\n(c) 1999 B", 0), (2, "intro\nSecond; text\nend", 0), (3, None, 0), (4, "", 0), (2, "second text", 0),
                                  (None, "second text", 0), (5, "second text and more", 0)], "doc_id bigint, text string, licence int")
    known = spark.createDataFrame(KNOWN, "licence string, text string")
    got = sorted((str(r.doc_id), str(r.licence), tuple(r.notices)) for r in licences.scan_documents(docs, known).collect())
    assert got == [("1", "one", ("one",)), ("2", "None", ("two",)), ("2", "two", ("two",)), ("3", "None", ()), ("4", "None", ()), ("5", "None", ()), ("None", "two", ("two",))]
    assert licences.scan_documents(docs.limit(0), known).count() == 0
    assert all(r.licence is None for r in licences.scan_texts(docs, known.limit(0)).collect())


def toxic_corpus(seed=1):
    rng = random.Random(seed)
    syllables = ["an", "er", "th", "ou", "in", "re", "st", "al", "on", "ti", "ed", "ng"]
    prose = lambda n: ["".join(rng.choices(syllables, k=rng.randint(1, 5))) for _ in range(n)]
    rows = []
    for i in range(600):
        words, toxic = prose(rng.randint(20, 200)), i % 6 == 0
        if toxic:
            for _ in range(rng.randint(2, 6)):
                words.insert(rng.randrange(len(words)), rng.choice(["blockhead", "vermin", "zuckling", "zuckfrau", "zuckmann"]))
        rows.append((i, " ".join(words), int(toxic)))
    return rows


def test_toxicity_on_rows_not_learnt_from(spark):
    rows = toxic_corpus()
    docs = spark.createDataFrame([(i, t, 0.5) for i, t, _ in rows] + [(None, None, 0.5), (999, "", 0.5)], "doc_id bigint, text string, score double")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i % 4] + [(None, 1), (5000, None)], "doc_id bigint, toxic int")
    model = toxicity.train(docs, labels)
    scored = {r.doc_id: r.s for r in docs.select("doc_id", toxicity.score(F.coalesce("text", F.lit("")), model).alias("s")).collect()}
    held = [(scored[i] >= toxicity.THRESHOLD, y) for i, _, y in rows if i % 4 == 0]
    assert np.mean([p for p, y in held if y]) > 0.9 and np.mean([p for p, y in held if not y]) < 0.05
    assert scored[None] == scored[999] < toxicity.THRESHOLD
    kept = toxicity.keep_ordinary(docs, model)
    assert kept.columns == docs.columns and 490 < kept.count() < 525
    assert toxicity.keep_ordinary(docs.limit(0), model).count() == 0


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id bigint, text string")
    model = toxicity.train(docs, spark.createDataFrame([], "doc_id bigint, toxic int"))
    assert [round(r.s, 6) for r in docs.select(toxicity.score(F.coalesce("text", F.lit("")), model).alias("s")).collect()] == [0.0, 0.0]
