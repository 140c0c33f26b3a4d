"""Applicant-to-job scoring.

Plan: both skill lists are reduced to one array of names per job and one per
resume (grouped with map-side combine and already distinct, so a hot resume
shrinks before the shuffle), then joined to the applications.  Vectors never
enter an application's row: blocks of applications get the vectors of their
distinct skills once (``similarity.py``), numpy finds the strongest evidence
per skill, and Spark's functions make the scores.  No pair of skills is ever
emitted as a row.  A job with very many applicants is on the large side of a
join with one row per job, which AQE splits, and is spread over all blocks.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.skills import experience_score
from .lexicon import normalize_skill
from .similarity import Cells, Vectors, map_blocks

# Source names in scoring order, and the credit that counts as "has it".
SOURCES = ("work_experience", "projects", "skills_section")
PROVEN_SOURCES = ("work_experience", "projects")
MATCHED_CREDIT = 0.5
PLACES = 1 << 48  # list positions stay below this


@dataclass(frozen=True)
class Weights:
    """The thirteen numbers of the scorer (fixed default values)."""

    skills: float = 0.55
    experience: float = 0.45
    sim_low: float = 0.40
    sim_high: float = 0.85
    experience_scale_months: int = 48
    tier_work: float = 1.0
    tier_projects: float = 0.70
    tier_mention: float = 0.35
    support_rho: float = 0.25
    balance_eps: float = 0.10
    blend_coverage: float = 0.50
    blend_proof: float = 0.25
    blend_balance: float = 0.25

    def tiers(self) -> dict[str, float]:
        return dict(zip(SOURCES, (self.tier_work, self.tier_projects, self.tier_mention)))


def _place_in(source: Column, names: tuple[str, ...] | list[str]) -> Column:
    expr = F.when(source == names[0], F.lit(0).cast("bigint"))
    for i, name in enumerate(names[1:], 1):
        expr = expr.when(source == name, i)
    return expr


def _ranking(w: Weights) -> list[str]:
    return sorted(SOURCES, key=lambda s: -w.tiers()[s])  # stable: earlier source first on equal weight


def _tier_of(order: Column, w: Weights) -> tuple[Column, Column]:
    """Weight and source of a place in the ranking."""
    best = lambda values: F.get(F.array(*[F.lit(v) for v in values]), order)
    return best([w.tiers()[s] for s in _ranking(w)]), best(_ranking(w))


def best_tier(skills: DataFrame, w: Weights = Weights(), alias: DataFrame | None = None) -> DataFrame:
    """(resume_id, skill) -> best tier weight, its source, and place in the index.

    Highest weight wins and the first source wins ties; the place is that of
    the first sighting, in source order and then list order.  Both are plain
    numbers, so the aggregation stays in the hash operator and combines on
    the map side.
    """
    rows = normalize_skill(skills.where(F.trim("skill") != ""), "skill", alias)
    rank = _place_in(F.col("source"), SOURCES)
    weight, source = _tier_of(F.col("_o"), w)
    return (
        rows.where(rank.isNotNull())
        .groupBy("resume_id", "skill")
        .agg(F.min(_place_in(F.col("source"), _ranking(w))).alias("_o"), F.min(rank * PLACES + F.col("pos")).alias("place"))
        .select("resume_id", "skill", weight.alias("weight"), source.alias("source"), "place")
    )


def flat_tier(skills: DataFrame, w: Weights = Weights(), alias: DataFrame | None = None) -> DataFrame:
    """Index of a flat list (resume_id, skill, pos): everything is a mention."""
    rows = skills.select("resume_id", "skill", "pos").withColumn("source", F.lit(SOURCES[2]))
    return best_tier(rows, w, alias)


def tier_fallback(skills: DataFrame, flat: DataFrame | Column, w: Weights = Weights(), alias: DataFrame | None = None) -> DataFrame:
    """Per-source index where any source list has an entry, else the flat list; ``basis`` says which.

    ``flat`` is a frame, or a condition: the flat lists are then the rows of
    ``skills`` where it holds, and both indexes are made in one pass over them,
    grouped by resume throughout.
    """
    if isinstance(flat, Column):
        return _fallback_in_place(skills, flat, w, alias)
    has_source = skills.where(F.col("source").isin(*SOURCES)).select("resume_id").distinct()
    return (
        best_tier(skills, w, alias).withColumn("basis", F.lit("by_source"))
        .unionByName(flat_tier(flat.join(has_source, "resume_id", "left_anti"), w, alias)
                     .withColumn("basis", F.lit("flat_fallback")))
    )


def _fallback_in_place(skills: DataFrame, flat: Column, w: Weights, alias: DataFrame | None) -> DataFrame:
    mention = SOURCES[2]
    rank, listed = _place_in(F.col("source"), SOURCES), F.coalesce(flat, F.lit(False))
    # a blank skill is none, but its source counts as present
    rows = skills.select("resume_id", "source", "pos", listed.alias("_flat"), F.when(F.trim("skill") != "", F.col("skill")).alias("skill"))
    rows = normalize_skill(rows.where(rank.isNotNull() | F.col("_flat")), "skill", alias)
    seen = rows.groupBy("resume_id", "skill").agg(
        F.min(_place_in(F.col("source"), _ranking(w))).alias("_o"), F.min(rank * PLACES + F.col("pos")).alias("_place"),
        F.max("_flat").alias("_flat"), F.min(F.when(F.col("_flat"), SOURCES.index(mention) * PLACES + F.col("pos"))).alias("_flat_place"))
    # rows without a resume have no lists to compare and stay in both indexes
    has_source = F.col("resume_id").isNotNull() & F.max(F.col("_o").isNotNull()).over(Window.partitionBy("resume_id"))
    seen = seen.withColumn("_flat", F.col("_flat") & ~has_source).where(F.col("skill").isNotNull() & (F.col("_o").isNotNull() | F.col("_flat")))
    seen = seen.withColumn("_by", F.explode(F.when(F.col("_flat") & F.col("_o").isNotNull(), F.array(F.lit(True), F.lit(False))).otherwise(F.array(~F.col("_flat")))))
    weight, source = _tier_of(F.col("_o"), w)
    either = lambda a, b: F.when(F.col("_by"), a).otherwise(b)
    return seen.select(
        "resume_id", "skill", either(weight, F.lit(w.tiers()[mention])).alias("weight"), either(source, F.lit(mention)).alias("source"),
        either(F.col("_place"), F.col("_flat_place")).alias("place"), either(F.lit("by_source"), F.lit("flat_fallback")).alias("basis"))


def clean_jd(jd: DataFrame, alias: DataFrame | None = None) -> DataFrame:
    """(job_id, jd_skill, pos): normalised, blanks dropped, first sighting kept."""
    rows = normalize_skill(jd.where(F.trim("skill") != ""), "skill", alias, "jd_skill")
    return rows.groupBy("job_id", "jd_skill").agg(F.min("pos").alias("pos"))


def job_arrays(jd: DataFrame) -> DataFrame:
    """One row per job: ``jd`` skills in list order.  A job lists at most 100 skills."""
    return jd.groupBy("job_id").agg(F.sort_array(F.collect_list(F.struct("pos", "jd_skill"))).alias("_jd")).select("job_id", F.col("_jd.jd_skill").alias("jd"))


def resume_arrays(index: DataFrame) -> DataFrame:
    """One row per resume: indexed skills in insertion order.  Length is bounded by the distinct skills."""
    if "basis" not in index.columns:
        index = index.withColumn("basis", F.lit("by_source"))
    return (
        index.groupBy("resume_id")
        .agg(F.sort_array(F.collect_list(F.struct("place", "skill", "weight", "source"))).alias("_rs"), F.first("basis").alias("skills_basis"))
        .select("resume_id", "skills_basis", F.transform("_rs", lambda x: F.struct(
            x["skill"].alias("skill"), x["weight"].alias("weight"), x["source"].alias("source"))).alias("rs"))
    )


def with_lists(apps: DataFrame, jobs: DataFrame, resumes: DataFrame) -> DataFrame:
    """Applications with the lists of their job (``jd``) and resume (``rs``), empty where there is none."""
    return (
        apps.join(jobs, "job_id", "left").join(resumes, "resume_id", "left")
        .withColumn("jd", F.coalesce("jd", F.array().cast("array<string>")))
        .withColumn("rs", F.coalesce("rs", F.array().cast("array<struct<skill:string,weight:double,source:string>>")))
    )


def _credits(cells: Cells, w: Weights) -> np.ndarray:
    if w.sim_high <= w.sim_low:
        c = (cells.sim >= w.sim_high).astype(float)
    else:
        c = np.clip((cells.sim - w.sim_low) / (w.sim_high - w.sim_low), 0.0, 1.0)
    return c if w.sim_high <= 1.0 else np.where(cells.same, 1.0, c)


CANDIDATES = "array<array<struct<e:double,k:int,c:double,sim:double>>>"
FOUND = "array<struct<mine:int,e1:double,e2:double,shown:int,sim:double,c:double,u:double,proven:boolean>>"


def _struct(names: str, *arrays: np.ndarray) -> pa.StructArray:
    return pa.StructArray.from_arrays([pa.array(a) for a in arrays], names=names.split())


def with_candidates(apps: DataFrame, jobs: DataFrame, resumes: DataFrame, vectors: DataFrame, w: Weights) -> DataFrame:
    """Add ``cands``: for each JD skill its supporting resume skills, strongest evidence first.

    A candidate is (evidence, place in ``rs``, credit, similarity); those without
    credit are left out.  Equal evidence keeps index order.
    """

    def judge(b: pa.RecordBatch, v: Vectors) -> pa.Array:
        x = Cells(b.column("jd"), b.column("rs"), v)
        c = _credits(x, w)
        e = c * b.column("rs").flatten().field("weight").to_numpy(zero_copy_only=False)[x.own]
        at, _ = x.firsts(c > 0, -e, x.k)
        counts = np.bincount(x.group[at], minlength=x.offsets[-1])
        inner = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)], pa.int32()), _struct("e k c sim", e[at], x.k[at].astype(np.int32), c[at], x.sim[at]))
        return pa.ListArray.from_arrays(pa.array(x.offsets, pa.int32()), inner)

    return map_blocks(with_lists(apps, jobs, resumes), "application_id", "jd", "rs", vectors, judge, "cands", T.DataType.fromDDL(CANDIDATES))


def with_found(df: DataFrame, vectors: DataFrame, w: Weights) -> DataFrame:
    """Add ``found``: per JD skill its own entry of weight 1, the two strongest evidences, the match to show with similarity and credit,
    the top-2 evidence ``u``, and whether it is proven.

    Entries are places in ``rs``, -1 for none.  The match to show has a credit of one half at least; a proven one comes first.
    """

    def judge(b: pa.RecordBatch, v: Vectors) -> pa.Array:
        rs = b.column("rs").flatten()
        x, weight = Cells(b.column("jd"), b.column("rs"), v), rs.field("weight").to_numpy(zero_copy_only=False)
        proven = pc.is_in(rs.field("source"), value_set=pa.array(PROVEN_SOURCES)).to_numpy(zero_copy_only=False)
        c, n = _credits(x, w), x.offsets[-1]
        e = c * weight[x.own]
        e1, e2, sim, credit = (np.zeros(n) for _ in range(4))
        mine, shown = np.full(n, -1, np.int32), np.full(n, -1, np.int32)
        at, first = x.firsts(c > 0, -e, x.k)
        e1[x.group[at[first]]] = e[at[first]]
        second = np.setdiff1d(first + 1, np.r_[first, len(at)])
        e2[x.group[at[second]]] = e[at[second]]
        at_own, first_own = x.firsts(x.same & (weight[x.own] >= 1.0), x.k)
        mine[x.group[at_own[first_own]]] = x.k[at_own[first_own]]
        at, first = x.firsts(c >= MATCHED_CREDIT, ~proven[x.own], -e, x.k)
        best = at[first]
        shown[x.group[best]], sim[x.group[best]], credit[x.group[best]] = x.k[best], x.sim[best], c[best]
        # an own entry of full weight settles the skill; otherwise the match to show is a proven one wherever there is any
        settled, sure = mine >= 0, np.zeros(n, bool)
        sure[x.group[best]] = proven[x.own[best]]
        own = at_own[first_own]
        sure[x.group[own]] = proven[x.own[own]]
        u = np.where(settled, 1.0, np.minimum(1.0, e1 + w.support_rho * (1 - e1) * e2))
        return pa.ListArray.from_arrays(pa.array(x.offsets, pa.int32()), _struct("mine e1 e2 shown sim c u proven", mine, e1, e2, shown, sim, credit, u, sure))

    return map_blocks(df, "application_id", "jd", "rs", vectors, judge, "found", T.DataType.fromDDL(FOUND))


def with_evidence(df: DataFrame) -> DataFrame:
    """Add ``per_skill``: top-2 evidence ``u``, proven flag and the match to show, per JD skill."""

    def told(j: Column, v: Column) -> Column:
        entry = lambda k: F.when(v[k] >= 0, F.get(F.col("rs"), v[k]))
        mine, shown, settled, seen = entry("mine"), entry("shown"), v["mine"] >= 0, v["shown"] >= 0
        return F.struct(
            j.alias("jd_skill"),
            v["u"].alias("u"), v["proven"].alias("proven"),
            F.when(settled, j).otherwise(shown["skill"]).alias("resume_skill"),
            F.when(settled, 1.0).when(seen, v["sim"]).alias("similarity"),
            F.when(settled, 1.0).when(seen, v["c"]).alias("credit"),
            F.when(settled, mine["source"]).otherwise(shown["source"]).alias("source"),
            F.when(settled, mine["weight"]).otherwise(shown["weight"]).alias("tier_weight"),
            v["e1"].alias("e1"), v["e2"].alias("e2"),
        )

    return df.withColumn("per_skill", F.transform("jd", lambda j, i: told(j, F.get(F.col("found"), i))))


def _mean(arr: str, field: str) -> Column:
    return F.aggregate(arr, F.lit(0.0), lambda s, x: s + x[field].cast("double")) / F.size(arr)


def with_skills_score(df: DataFrame, w: Weights) -> DataFrame:
    """Add coverage, proof_rate, balance and skills_score; all null when the job lists no skills.  Reads ``found`` only, not the explanation."""
    eps = max(w.balance_eps, 1e-6)
    floor = eps / (1 + eps)
    logs = F.aggregate("found", F.lit(0.0), lambda s, x: s + F.ln((x["u"] + eps) / (1 + eps)))
    bc, bp, bb = (max(0.0, x) for x in (w.blend_coverage, w.blend_proof, w.blend_balance))
    total = bc + bp + bb
    some = F.size("jd") > 0
    df = df.withColumns({
        "coverage": F.when(some, _mean("found", "u")),
        "proof_rate": F.when(some, _mean("found", "proven")),
        "balance": F.when(some, F.greatest(F.lit(0.0), (F.exp(logs / F.size("jd")) - floor) / (1 - floor))),
    })
    blend = F.col("coverage") if total <= 0 else (
        bc * F.col("coverage") + bp * F.col("proof_rate") + bb * F.col("balance")) / total
    return df.withColumn("skills_score", blend)


def score_applications(
    apps: DataFrame, jd: DataFrame, index: DataFrame, vectors: DataFrame,
    resumes: DataFrame, jobs: DataFrame, w: Weights = Weights(),
) -> DataFrame:
    """Score every application; the parts are unrounded, the explanation per skill has three decimals.

    ``n_matched`` and ``n_missing`` are the lengths of ``matched`` and ``missing``, for callers that store no explanation.

    ``apps(application_id, job_id, resume_id)``, ``jd`` from :func:`clean_jd`,
    ``index`` from :func:`best_tier` or :func:`tier_fallback`,
    ``resumes(resume_id, experience_months)``, ``jobs(job_id, min_experience_months)``.
    """
    df = with_lists(
        apps.select("application_id", "job_id", "resume_id"),
        jobs.select("job_id", "min_experience_months").join(job_arrays(jd), "job_id", "left"),
        resumes.select("resume_id", "experience_months").join(resume_arrays(index), "resume_id", "left"),
    )
    df = with_evidence(with_skills_score(with_found(df, vectors, w), w))
    ws, we = max(0.0, w.skills), max(0.0, w.experience)
    df = df.withColumn("experience_score", experience_score(F.col("experience_months"), w.experience_scale_months))
    usable = F.col("skills_score").isNotNull() if ws + we > 0 else F.lit(False)
    final = (ws * F.col("skills_score") + we * F.col("experience_score")) / (ws + we) if ws + we > 0 else F.lit(0.0)
    used = F.create_map(F.lit("skills"), F.lit(ws / (ws + we)), F.lit("experience"), F.lit(we / (ws + we))) \
        if ws + we > 0 else F.create_map().cast("map<string,double>")
    meets = F.when(F.col("min_experience_months") > 0, F.col("experience_months") >= F.col("min_experience_months"))

    n_matched = F.size(F.filter("found", lambda v: (v["mine"] >= 0) | (v["shown"] >= 0)))
    r3 = lambda c: F.round(c, 3)

    def explain(x: Column) -> Column:
        return F.struct(
            x["jd_skill"].alias("jd_skill"), x["resume_skill"].alias("resume_skill"),
            r3(x["similarity"]).alias("similarity"), r3(x["credit"]).alias("credit"), x["source"].alias("source"),
            r3(x["tier_weight"]).alias("tier_weight"),
            F.when(x["proven"], "proven").otherwise("mentioned").alias("status"), r3(x["u"]).alias("evidence"),
        )

    return df.select(
        "application_id", "job_id", "resume_id",
        F.when(usable, final * 100).otherwise(0.0).alias("score"),
        "skills_score", "experience_score", "coverage", "proof_rate", "balance",
        F.transform(F.filter("per_skill", lambda x: x["resume_skill"].isNotNull()), explain).alias("matched"),
        F.transform(F.filter("per_skill", lambda x: x["resume_skill"].isNull()), lambda x: x["jd_skill"]).alias("missing"),
        F.col("experience_months").alias("resume_months"), F.col("min_experience_months").alias("jd_min_months"),
        meets.alias("meets_min_experience"),
        F.when(usable, used).otherwise(F.create_map().cast("map<string,double>")).alias("weights_used"),
        F.lit(w.experience_scale_months).alias("experience_scale_months"),
        F.when(F.size("jd") == 0, "by_source").otherwise(F.coalesce("skills_basis", F.lit("flat_fallback"))).alias("skills_basis"),
        "per_skill", n_matched.alias("n_matched"), (F.size("found") - n_matched).alias("n_missing"),
    )


def match_readiness(apps: DataFrame, resumes: DataFrame, jobs: DataFrame, jd: DataFrame) -> DataFrame:
    """Route each application: failed with a reason, gone (its job is deleted), pending, or score."""
    r = resumes.select("resume_id", F.col("extraction_status").alias("_rs"))
    j = jobs.select("job_id", F.col("extraction_status").alias("_js"))
    has = jd.select("job_id").distinct().withColumn("_has", F.lit(True))
    reason = F.coalesce(
        F.when(F.col("_rs").isNull(), "no resume"),
        F.when(F.col("_rs") == "failed", "resume failed"),
        F.when(F.col("_js") == "failed", "job failed"),
        F.when((F.col("_rs") == "done") & (F.col("_js") == "done") & F.col("_has").isNull(), "job lists no skills"),
    )
    return (
        apps.select("application_id", "job_id", "resume_id")
        .join(r, "resume_id", "left").join(j, "job_id", "left").join(has, "job_id", "left")
        .withColumn("reason", reason)
        .withColumn("route", F.when(F.col("reason").isNotNull(), "failed").when(F.col("_js").isNull(), "gone")
                    .when((F.col("_rs") != "done") | (F.col("_js") != "done"), "pending").otherwise("score"))
        .select("application_id", "job_id", "resume_id", "route", "reason")
    )


def compulsory_ratio(apps: DataFrame, jd: DataFrame, skills: DataFrame, alias: DataFrame | None = None) -> DataFrame:
    """Matched JD skills and the 0..1 ratio; a job without skills is neutral (1.0).

    The JD list keeps duplicates, the candidate side is a set.
    """
    need = normalize_skill(jd.select("job_id", "skill"), "skill", alias)
    have = normalize_skill(skills.where(F.trim("skill") != "").select("resume_id", "skill"), "skill", alias).distinct()
    rows = apps.select("application_id", "job_id", "resume_id").join(need, "job_id", "left")
    rows = rows.join(have.withColumn("_hit", F.lit(1)), ["resume_id", "skill"], "left")
    n, m = F.count("skill"), F.count("_hit")
    return rows.groupBy("application_id").agg(
        n.alias("jd_count"), m.alias("matched_count"),
        F.when(n == 0, 1.0).otherwise(F.least(m / n, F.lit(1.0))).alias("ratio"),
    )


def explain_score(scored: DataFrame, w: Weights = Weights()) -> DataFrame:
    """Points from skills and from experience, and the count of each skill state."""
    return scored.select(
        "application_id",
        (F.coalesce(F.col("weights_used")["skills"], F.lit(0.0)) * F.coalesce("skills_score", F.lit(0.0)) * 100).alias("skill_points"),
        (F.coalesce(F.col("weights_used")["experience"], F.lit(0.0)) * F.col("experience_score") * 100).alias("experience_points"),
        F.size(F.filter("matched", lambda x: x["status"] == "proven")).alias("n_proven"),
        F.size(F.filter("matched", lambda x: x["status"] == "mentioned")).alias("n_mentioned"),
        F.size("missing").alias("n_missing"),
    )
