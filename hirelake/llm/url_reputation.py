"""URL filters by host reputation, shrunk from host to registered domain to suffix. DataFrame functions only.

Labelled page outcomes give each host ``n`` labels, ``bad`` of them bad.  The
rate of a suffix has a beta prior around the rate of all pages, that of a
registered domain one around its suffix, that of a host one around its
domain.  The strength of a level's prior (its pseudo-count) is fitted to the
data by moments: the spread of the observed rates beyond binomial noise.  A
host is blocked when the lower posterior bound of its bad rate, mean less
``Z`` standard deviations of its beta posterior, is above ``BLOCK_ABOVE``.  A
host without labels keeps its domain's rate with the prior's width, so it is
blocked only by strong evidence above it.

A rule set beside it is a bounded argument (a literal in the plan); the
longest fitting rule wins over reputation.

Defined cases: a null url or one without ``://`` has empty host and path and
is judged as the host of no name; ties between rules of one length go to the
longer host, then by code point; repeated rows are judged alike; empty tables
give empty results; labels that are null do not count; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import ascii_lower, column, written

#: (rule, verdict); a rule is a host, its subdomains included, and a path prefix.
Rules = Iterable[tuple[str, str]]
Z, BLOCK_ABOVE = 1.645, 0.5
#: Least and largest pseudo-count of a prior.
STRENGTH = (2.0, 1000.0)
#: Suffixes of several labels under which names are registered; else the last label is the suffix.
SUFFIXES = ("co.uk", "org.uk", "ac.uk", "com.au", "net.au", "co.jp", "co.nz", "com.br", "co.in", "co.za")


def host_of(url: Column) -> Column:
    """Between the first ``://`` and ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without one."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def suffix_of(host: Column, suffixes: Iterable[str] = SUFFIXES) -> Column:
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*suffixes), two).otherwise(F.substring_index(host, ".", -1))


def domain_of(host: Column, suffixes: Iterable[str] = SUFFIXES) -> Column:
    """The suffix and one label more."""
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*suffixes), F.substring_index(host, ".", -3)).otherwise(two)


def matching_rule(host: Column, path: Column, rules: Rules) -> Column:
    """(rule, verdict) of the longest rule that fits, else null."""
    ordered = sorted(rules, key=lambda r: (-len(r[0]), -r[0].find("/"), r[0]))
    out = None
    for rule, verdict in ordered:
        name, _, prefix = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + prefix)
        value = F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out if out is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def _strength(level: DataFrame, mean: Column) -> Column:
    """Pseudo-count by moments: rate variance beyond noise, over names with labels; one scalar."""
    n, p = F.col("n"), F.col("bad") / F.col("n")
    noise = F.sum(mean * (1 - mean))  # expected sum of n * (p - mean)^2 from binomial noise alone
    seen = F.sum(n * (p - mean) * (p - mean))
    between = (seen - noise) / F.greatest(F.sum(n) - F.sum(n * n) / F.sum(n), F.lit(1e-9))
    spread = F.avg(mean * (1 - mean))
    fitted = F.when(between <= 0, F.lit(STRENGTH[1])).otherwise(F.greatest(F.lit(STRENGTH[0]), F.least(F.lit(STRENGTH[1]), spread / between - 1)))
    return level.where("n > 0").agg(F.coalesce(fitted, F.lit(STRENGTH[1]))).scalar()


def reputation(pages: DataFrame, suffixes: Iterable[str] = SUFFIXES) -> DataFrame:
    """``pages`` (host, bad: boolean or null) to one row per host: n, bad, rate, sd and bound."""
    hosts = pages.groupBy("host").agg(F.count("bad").alias("n"), F.count_if("bad").alias("bad")).withColumns(
        {"domain": domain_of(F.col("host"), suffixes), "suffix": suffix_of(F.col("host"), suffixes)})
    hosts = written(hosts, "url-hosts")
    sums = (F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    top = hosts.agg(((F.sum("bad") + 1) / (F.sum("n") + 2)).alias("r")).scalar()
    by_suffix = written(hosts.groupBy("suffix").agg(*sums), "url-suffixes").withColumn("up", F.coalesce(top, F.lit(0.5)))
    by_suffix = by_suffix.withColumn("m", _strength(by_suffix, F.col("up"))).withColumn("rate", (F.col("bad") + F.col("m") * F.col("up")) / (F.col("n") + F.col("m")))
    by_domain = hosts.groupBy("domain", "suffix").agg(*sums).join(by_suffix.select("suffix", F.col("rate").alias("up")), "suffix")
    by_domain = written(by_domain, "url-domains")
    by_domain = by_domain.withColumn("m", _strength(by_domain, F.col("up"))).withColumn("rate", (F.col("bad") + F.col("m") * F.col("up")) / (F.col("n") + F.col("m")))
    named = written(hosts.join(by_domain.select("domain", F.col("rate").alias("up")), "domain"), "url-named")
    named = named.withColumn("m", _strength(named, F.col("up")))
    a, b = F.col("bad") + F.col("m") * F.col("up"), F.col("n") - F.col("bad") + F.col("m") * (1 - F.col("up"))
    return named.select("host", "domain", "suffix", "n", "bad", (a / (a + b)).alias("rate"),
                        F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))).alias("sd")).withColumn("bound", F.col("rate") - Z * F.col("sd"))


def judge(pages: DataFrame, outcomes: DataFrame, rules: Rules = (), id_col: str = "page_id", url_col: str = "url",
          suffixes: Iterable[str] = SUFFIXES, above: float = BLOCK_ABOVE) -> DataFrame:
    """Per page: id, host, path, rule, verdict, and the host's rate and bound.

    ``outcomes`` (host, bad) has a row per labelled page.
    """
    urls = pages.select(column(id_col).alias("id"), host_of(column(url_col)).alias("host"), path_of(column(url_col)).alias("path"))
    known = urls.select("host", F.lit(None).cast("boolean").alias("bad")).unionByName(outcomes.select("host", F.col("bad").cast("boolean").alias("bad")))
    judged = urls.join(reputation(known, suffixes), "host", "left").withColumn("fit", matching_rule(F.col("host"), F.col("path"), rules))
    own = F.when(F.col("bound") > above, F.lit("block")).otherwise(F.lit("allow"))
    return judged.select(F.col("id").alias(id_col), "host", "path", F.col("fit.rule").alias("rule"), F.coalesce(F.col("fit.verdict"), own).alias("verdict"),
                         "rate", "bound")
