"""Groups of spelling variants: words one edit apart, found by pivotal grams, and the usual form of each.

Every word has its bigrams, in one order for all words: rare ones first.  Its
prefix is the first three in that order (all that equal the third are in), its
pivots are two of the prefix that do not overlap, with the least
sum of frequencies, chosen by dynamic programming along the word.  One edit changes
one pivot at most.  So of two words one edit apart, the one whose prefix ends
earlier in the order has a pivot that the other has in its prefix.

Position limits: the edit stands on one side of that pivot, so what
stands on the other side is equal, and the gram moves by the difference of the
lengths at most.  Pivots are therefore looked up by the part of the word from its
start to the pivot's end, or from the pivot's start to the end, and the other
word's length.  Candidates are verified by edit distance.

A word's form is the near word of most occurrences, if it has ``RATIO`` times its own; roots
follow forms by pointer doubling.  Occurrences grow by that ratio at each step, so
the number of rounds is the logarithm of a logarithm.

Defined cases: null and empty texts have no words; null ids count as empty text in the
planted deletions; runs of any length are words; ties go to the smallest word in code point
order; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import column, fold, whole, written

RUN = "[A-Za-zÀ-ÿ]+"
LEAST_LENGTH, LEAST_COUNT, RATIO = 6, 5, 5
#: Distinct words that a task holds before it passes their counts on.
HELD = 300_000
#: Counts of grams are broadcast up to so many rows, beyond they are joined; the letters of RUN have 90 ** 2 pairs.
GRAMS = 50_000
#: One edit spoils two bigrams at most, so three are a prefix and two of them are disjoint.
PREFIX = 3


def planted(doc_id: int | None, run: str) -> str:
    """The run, without one of its code points where 199 divides the crc32 of ``doc_id:run``."""
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
    at = h % len(run)
    return run if h % 199 else run[:at] + run[at + 1:]


def count_words(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, change: Callable = planted,
                id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``word`` and its occurrences ``n`` in all texts; tasks combine before the shuffle. ``change`` maps (id, lower-cased run) to a word."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs_of, held = re.compile(RUN).findall, Counter()

        def out() -> pa.RecordBatch:
            b = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])
            held.clear()
            return b

        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
                for run, n in Counter(runs_of(text.as_buffer().to_pybytes().translate(fold).decode())).items():
                    if len(run) >= least_length:
                        word = change(doc, run)
                        if len(word) >= least_length:
                            held[word] += n
                if len(held) >= HELD:
                    yield out()
        if held:
            yield out()

    texts = docs.select(column(id_col).alias("id"), whole(text_col).alias("text"))
    return texts.mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def _pivots(prefix: Column) -> Column:
    """Positions of two disjoint grams of a prefix (structs c, g, p by position) with the least sum of frequencies.

    Along the word: ``one`` is the best gram that ends before the last one seen, ``held`` the last one seen, ``pair`` the best pair.
    """
    one, pair = "struct<c:bigint,p:int>", "struct<c:bigint,a:int,b:int>"
    start = F.struct(F.lit(None).cast(one).alias("one"), F.lit(None).cast(one).alias("held"), F.lit(None).cast(pair).alias("pair"))

    def step(acc: Column, x: Column) -> Column:
        before = F.least(acc["one"], acc["held"])
        free = F.when(acc["held"]["p"] <= x["p"] - 2, before).otherwise(acc["one"])
        found = F.when(free.isNotNull(), F.struct((free["c"] + x["c"]).alias("c"), free["p"].alias("a"), x["p"].alias("b")))
        return F.struct(before.alias("one"), F.struct(x["c"].alias("c"), x["p"].alias("p")).alias("held"), F.least(acc["pair"], found).alias("pair"))

    return F.aggregate(prefix, start, step, lambda acc: F.array(acc["pair"]["a"], acc["pair"]["b"]))


def gram_prefixes(words: DataFrame) -> DataFrame:
    """``words`` with ``length``, ``last`` (order of the last gram of the prefix), ``places`` (positions of its grams) and ``pivots`` (two of them), from 0."""
    grams = words.select("word", "n", F.posexplode(F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.substring(F.col("word"), i, F.lit(2)))).alias("p", "g"))
    counts = written(grams.groupBy("g").agg(F.count(F.lit(1)).alias("c")), "variant-counts")
    if counts.count() <= GRAMS:
        counts = F.broadcast(counts)
    by_word = grams.join(counts, "g").groupBy("word", "n").agg(F.sort_array(F.collect_list(F.struct("c", "g", "p"))).alias("grams"))
    ordered = by_word.withColumn("last", F.struct(F.get("grams", F.lit(PREFIX - 1))["c"].alias("c"), F.get("grams", F.lit(PREFIX - 1))["g"].alias("g")))
    prefix = F.filter("grams", lambda x: F.struct(x["c"].alias("c"), x["g"].alias("g")) <= F.col("last"))
    placed = ordered.withColumn("prefix", F.array_sort(prefix, lambda a, b: a["p"] - b["p"]))
    return placed.select("word", "n", F.length("word").alias("length"), "last", F.transform("prefix", lambda x: x["p"]).alias("places"), _pivots(F.col("prefix")).alias("pivots"))


def _parts(at: Column) -> Column:
    """The two parts of ``word`` that end and begin with the gram at a position."""
    return F.array(F.struct(F.lit(0).alias("side"), F.left("word", at + 2).alias("part")), F.struct(F.lit(1).alias("side"), F.substring(F.col("word"), at + 1, F.length("word")).alias("part")))


def near_words(words: DataFrame) -> DataFrame:
    """Both directions of every pair of ``words`` (word, n) that differ by one edit: word, n, other, other_n."""
    if not words.where(F.length("word") <= PREFIX).isEmpty():
        raise ValueError("words need four code points or more")
    marked = written(gram_prefixes(words), "variant-grams")
    shifts = F.array(*[F.lit(x) for x in (-1, 0, 1)])
    own = marked.select(F.col("word").alias("a"), F.col("n").alias("a_n"), F.col("last").alias("a_last"), "length", F.explode(F.flatten(F.transform("pivots", _parts))).alias("k"))
    asked = own.select("a", "a_n", "a_last", "k.side", "k.part", F.explode(F.transform(shifts, lambda x: x + F.col("length"))).alias("length"))
    index = marked.select(F.col("word").alias("b"), F.col("n").alias("b_n"), F.col("last").alias("b_last"), "length", F.explode(F.flatten(F.transform("places", _parts))).alias("k"))
    index = index.select("b", "b_n", "b_last", "k.side", "k.part", "length")
    met = asked.join(index, ["side", "part", "length"]).where((F.col("a_last") <= F.col("b_last")) & (F.col("a") != F.col("b")) & (F.levenshtein("a", "b", 1) == 1))
    swap = F.col("a") > F.col("b")
    pairs = met.select(*[F.when(swap, y).otherwise(F.col(x)).alias(x) for x, y in (("a", F.col("b")), ("a_n", F.col("b_n")), ("b", F.col("a")), ("b_n", F.col("a_n")))]).distinct()
    both = F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("a_n").alias("n"), F.col("b").alias("other"), F.col("b_n").alias("other_n")),
                             F.struct(F.col("b").alias("word"), F.col("b_n").alias("n"), F.col("a").alias("other"), F.col("a_n").alias("other_n"))))
    return pairs.select(both.alias("r")).select("r.*")


def follow_forms(forms: DataFrame, most: int) -> DataFrame:
    """``word`` and ``root`` of each row of ``forms`` (word, form), by pointer doubling; ``most`` is the greatest number of occurrences."""
    roots = written(forms.select("word", F.col("form").alias("root")), "variant-roots")
    for _ in range(math.ceil(math.log2(max(2.0, math.log(max(most, RATIO), RATIO) + 1)))):
        ahead = roots.select(F.col("word").alias("root"), F.col("root").alias("ahead"))
        roots = written(roots.join(ahead, "root", "left").select("word", F.coalesce("ahead", "root").alias("root")), "variant-roots")
    return roots


def group_variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """Per row of ``words`` (word, n): word, form, root, n, n_near, form_n."""
    words = written(words.select("word", "n"), "variant-words")
    near = near_words(words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other"))).alias("top"))
    fits = -F.col("top.less") >= ratio * F.col("n")
    out = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(fits, F.col("top.other")).alias("form"), F.when(fits, -F.col("top.less")).alias("form_n"))
    out = written(out, "variant-forms")
    roots = follow_forms(out.where("form IS NOT NULL"), words.agg(F.max("n")).first()[0] or 0)
    return out.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
