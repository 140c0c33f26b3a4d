"""Hand-derivable scores."""

import math

import pytest
from pyspark.sql import functions as F

from hirelake.operators import scoring as sc

ALONE = {f"s{i}": [1.0 if i == j else 0.0 for j in range(6)] for i in range(6)}


def run(spark, jd, work=(), projects=(), mention=(), months=None, need=None, vec=ALONE, w=sc.Weights(), flat=None):
    S = spark.createDataFrame
    rows = [(1, src, s, i) for src, l in (("work_experience", work), ("projects", projects), ("skills_section", mention)) for i, s in enumerate(l)]
    skills = S(rows, "resume_id long, source string, skill string, pos long")
    index = sc.best_tier(skills, w) if flat is None else sc.tier_fallback(skills, S([(1, s, i) for i, s in enumerate(flat)], "resume_id long, skill string, pos long"), w)
    out = sc.score_applications(
        S([(1, 1, 1)], "application_id long, job_id long, resume_id long"),
        sc.clean_jd(S([(1, s, i) for i, s in enumerate(jd)], "job_id long, skill string, pos long")), index,
        S([(k, v) for k, v in vec.items()], "skill string, embedding array<float>"),
        S([(1, months)], "resume_id long, experience_months long"), S([(1, need)], "job_id long, min_experience_months long"), w)
    return out.first()


def test_worked_number(spark):
    r = run(spark, ["s0", "S1 ", "s2"], work=["s0", "s1"], months=24, need=48)
    assert r.coverage == pytest.approx(2 / 3) and r.proof_rate == pytest.approx(2 / 3)
    assert r.skills_score == pytest.approx(0.599, abs=5e-4) and r.experience_score == pytest.approx(0.393, abs=5e-4)
    assert round(r.score, 1) == 50.6 and r.meets_min_experience is False and r.missing == ["s2"]


def test_tiers_order(spark):
    cov = [run(spark, ["s0"], **{k: ["s0"]}).coverage for k in ("work", "projects", "mention")]
    assert cov == pytest.approx([1.0, 0.7, 0.35])


def test_close_skill_and_top_two(spark):
    c = 0.7
    vec = {"a": [1.0, 0.0], "b": [c, math.sqrt(1 - c * c)], "d": [0.9, math.sqrt(1 - 0.81)]}
    r = run(spark, ["a"], projects=["b"], mention=["d"], vec=vec)
    eb, ed = (c - 0.4) / 0.45 * 0.7, 1.0 * 0.35
    e1, e2 = max(eb, ed), min(eb, ed)
    assert r.coverage == pytest.approx(e1 + 0.25 * (1 - e1) * e2, abs=1e-5)
    assert r.matched[0].resume_skill == "b" and r.matched[0].status == "proven"


def test_mention_of_the_skill_loses_to_proven_neighbour(spark):
    vec = {"a": [1.0, 0.0], "b": [0.8, 0.6]}
    r = run(spark, ["a"], work=["b"], mention=["a"], vec=vec)
    assert r.matched[0].resume_skill == "b" and r.matched[0].status == "proven"


def test_no_job_skills_scores_zero(spark):
    r = run(spark, [], work=["s0"], months=100)
    assert r.score == 0.0 and r.skills_score is None and r.weights_used == {}


def test_unknown_experience_and_zero_minimum(spark):
    r = run(spark, ["s0"], work=["s0"], months=None, need=0)
    assert r.experience_score == 0.0 and r.meets_min_experience is None


def test_flat_fallback(spark):
    r = run(spark, ["s0"], flat=["S0", "s3"])
    assert r.skills_basis == "flat_fallback" and r.matched[0].source == "skills_section" and r.coverage == pytest.approx(0.35)


def test_project_tier_of_one_is_settled(spark):
    r = run(spark, ["s0"], projects=["s0"], w=sc.Weights(tier_projects=1.0))
    assert r.coverage == 1.0 and r.matched[0].similarity == 1.0 and r.proof_rate == 1.0


def test_score_range(stage):
    from hirelake.catalog.scoring import scored
    r = scored(stage).agg(F.min("score").alias("lo"), F.max("score").alias("hi"), F.count("*").alias("n")).first()
    assert 0 <= r.lo <= r.hi <= 100 and r.n == 1500


def test_wide_vectors(spark):
    wide = {f"s{i}": [1.0 if i == j else 0.0 for j in range(128)] for i in range(6)}
    r = run(spark, ["s0", "unknown"], work=["s0"], months=24, vec=wide)
    assert r.coverage == pytest.approx(0.5) and r.missing == ["unknown"]
    assert run(spark, [], work=["s0"], months=24).skills_basis == "by_source"


@pytest.mark.parametrize("cells", [7, 1 << 20])
def test_blocks_send_each_vector_once_and_match_pairwise_cosines(spark, monkeypatch, cells):
    """Every application against its lists by plain numpy; one job has half of the applications, some skills have no vector."""
    import numpy as np

    from hirelake.operators import similarity
    monkeypatch.setattr(similarity, "CELLS", cells)
    rng = np.random.default_rng(1)
    names = [f"n{i}" for i in range(30)]
    vec = {n: rng.normal(size=8).tolist() for n in names[:25]} | {"n24": [0.0] * 8}
    jd = {j: rng.choice(names, rng.integers(0, 5), replace=False).tolist() for j in range(12)}
    rs = {r: [(s, float(rng.choice([1.0, 0.7, 0.35])), "projects") for s in rng.choice(names, rng.integers(0, 6), replace=False).tolist()] for r in range(20)}
    apps = [(i, 0 if i % 2 else i % 13, i % 21) for i in range(300)]
    S = spark.createDataFrame
    df = sc.with_candidates(
        S(apps, "application_id long, job_id long, resume_id long"), S(list(jd.items()), "job_id long, jd array<string>"),
        S([(r, "by_source", v) for r, v in rs.items()], "resume_id long, skills_basis string, rs array<struct<skill:string,weight:double,source:string>>"),
        S([(n, v) for n, v in vec.items()], "skill string, embedding array<float>"), sc.Weights())

    def cosine(a, b):
        if a == b:
            return 1.0
        x, y = (np.float32(vec.get(n, [0.0] * 8)).astype(float) for n in (a, b))
        n = np.linalg.norm(x) * np.linalg.norm(y)
        return float(x @ y / n) if n else 0.0

    rows = df.collect()
    assert len(rows) == len(apps)
    for r in rows:
        assert list(r.jd) == jd.get(r.job_id, []) and len(r.cands) == len(r.jd)
        for wanted, cands in zip(r.jd, r.cands):
            want = []
            for k, (s, weight, _) in enumerate(rs.get(r.resume_id, [])):
                c = min(1.0, max(0.0, (cosine(wanted, s) - 0.4) / 0.45))
                if c > 0:
                    want.append((-c * weight, k, c))
            assert [(x.k, pytest.approx(x.c)) for x in cands] == [(k, c) for _, k, c in sorted(want)]


def test_no_vector_column_in_the_application_row(spark, stage):
    lists = sc.with_lists(stage.applications.select("application_id", "job_id", "resume_id"), sc.job_arrays(sc.clean_jd(stage.jd_skills)), sc.resume_arrays(sc.best_tier(stage.resume_skills)))
    assert "float" not in lists.schema.simpleString()


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("aliased", [False, True])
def test_index_in_one_pass_equals_two_frames(spark, aliased):
    """Blank and null skills, unknown sources, rows that come twice, rows without a resume, and resumes whose only listed skill is blank."""
    rows = [(1, "projects", "s1", 4), (1, "work_experience", "S1 ", 7), (1, "skills_section", "s2", 1), (1, None, "s3", 0), (2, None, "s1", 3), (2, None, " s1", 2),
            (2, "hobby", "s4", 5), (3, "projects", " ", 1), (3, None, "s1", 2), (4, "projects", None, 1), (4, None, "s2", 2), (None, "work_experience", "s1", 1),
            (None, None, "s5", 2), (5, "projects", "s1", None), (6, None, "s-6", None), (7, None, "", 1), (8, "skills_section", "s-6", 1), (8, "skills_section", "s 6", 0)]
    skills = spark.createDataFrame(rows + rows[:3], "resume_id long, source string, skill string, pos long")
    alias = spark.createDataFrame([("s-6", "s 6"), ("s4", "s1")], "alias string, canonical string") if aliased else None
    w = sc.Weights(tier_projects=1.0)
    for flat in (F.lit(True), F.col("pos") > 1):
        got = sc.tier_fallback(skills, flat, w, alias)
        want = sc.tier_fallback(skills, skills.where(flat).select("resume_id", "skill", "pos"), w, alias)
        assert sorted(map(repr, got.select(want.columns).collect())) == sorted(map(repr, want.collect()))


def test_index_reads_the_skills_once(spark, stage):
    """Three joins of lineitem with part before: lists by source, flat lists, and the resumes that have the former."""
    from hirelake.catalog import all_queries
    assert _plan(all_queries()["tier_fallback"](spark, stage.sf_dir)).count("Relation [l_orderkey") == 1


def test_score_and_rank_reads_skills_and_routes_once_and_makes_no_explanation(spark, stage, monkeypatch):
    from hirelake.catalog import all_queries
    from hirelake.operators import similarity
    from hirelake.plans import composed
    plans = {}
    for module in (composed, similarity):
        monkeypatch.setattr(module, "written", lambda df, purpose, real=module.written: (plans.setdefault(purpose, _plan(df)), real(df, purpose))[1])
    all_queries()["score_and_rank"](spark, stage.sf_dir)
    assert plans["blocks"].count("Relation [l_orderkey") == 1 and "extraction_status" not in plans["blocks"]
    assert list(plans) == ["routes", "blocks", "scores"] and "tier_weight" not in plans["scores"]


def test_counts_are_the_lengths_of_the_explanation(stage):
    from hirelake.catalog.scoring import scored
    r = scored(stage).agg(
        F.count_if((F.col("n_matched") != F.size("matched")) | (F.col("n_missing") != F.size("missing"))).alias("bad"), F.sum("n_matched").alias("n")).first()
    assert r.bad == 0 and r.n > 0
