"""Whole computations composed of the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import dashboards as dash
from ..operators import experience as xp
from ..operators import extraction as ex
from ..operators import filters as flt
from ..operators import history as hist
from ..operators import listing, operations, scoring
from ..operators import sections as sec
from ..operators.skew import written


def score_and_rank(apps: DataFrame, jobs: DataFrame, resumes: DataFrame, users: DataFrame, jd: DataFrame, skills: DataFrame,
                   vectors: DataFrame, weights: scoring.Weights = scoring.Weights(), alias: DataFrame | None = None, flat: DataFrame | Column | None = None) -> DataFrame:
    """Route, score and rank all applications; those not ready keep a null score and rank last.

    ``alias`` maps the skills of both sides to canonical names; ``flat`` holds the
    lists used for resumes without any list by source, or says which rows of
    ``skills`` they are.  Ranking uses the stored score, which has one decimal.
    """
    clean = scoring.clean_jd(jd, alias)
    index = scoring.best_tier(skills, weights, alias) if flat is None else scoring.tier_fallback(skills, flat, weights, alias)
    route = written(scoring.match_readiness(apps, resumes, jobs, clean), "routes")  # read twice, to score and beside the scores
    ready = route.where("route = 'score'").select("application_id", "job_id", "resume_id")
    scored = scoring.score_applications(ready, clean, index, vectors, resumes, jobs, weights)
    stored = scored.select("application_id", F.round("score", 1).alias("score"), "skills_score", "experience_score", "n_matched", "n_missing")
    stored = written(stored, "scores")  # ranking deals rows by ranges, which would run the scorer once more to sample it
    people = listing.display_identity(listing.with_people(apps, users, resumes)).select("application_id", "job_id", "applied_at", "sort_name")
    df = people.join(route.select("application_id", "route", "reason"), "application_id").join(stored, "application_id", "left")
    return listing.rank_applicants(df, "score")


def extract_resume_skills(docs: DataFrame, lexicon: DataFrame, today: Column) -> DataFrame:
    """Documents -> skills by source, flat skills and months of experience.

    Everything but the dictionary match happens inside the document row.  A
    skill is kept as the text spells it; scoring maps it to its canonical name.
    """
    docs = docs.withColumn("text", t.clean_text(F.col("text")))
    d = sec.best_skills_heading(sec.partition_sections(docs)).withColumns({
        "work": sec.collect_section("sections", "experience"), "proj": sec.collect_section("sections", "projects")})
    d = xp.resume_experience(d, today).select(
        "doc_id", "experience_months", "experience_source",
        F.create_map(
            F.lit("skills_section"), t.strip_labels(t.expand_parens(t.strip_dates(F.col("skills.section_text")))),
            F.lit("work_experience"), t.strip_bullets(F.col("work.section_text")),
            F.lit("projects"), t.strip_bullets(F.col("proj.section_text"))).alias("blocks"))
    d = written(d, "resume-blocks")  # read twice, by the dictionary match and beside its result
    # *_outer generators: a plain explode infers a filter that evaluates the whole row work again
    parts = d.select("doc_id", F.explode_outer("blocks").alias("source", "body"))
    found = ex.tag_skills(parts, ["doc_id", "source"], "body", lexicon.select("alias", F.col("alias").alias("canonical")))
    lists = (
        found.groupBy("doc_id", "source").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "skill"))), lambda x: x["skill"]).alias("l"))
        .groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("source", "l"))).alias("raw"))
    )
    d = d.join(lists, "doc_id", "left").withColumn("raw", F.coalesce("raw", F.create_map().cast("map<string,array<string>>")))
    d = d.withColumn("routed", ex.by_source(ex.reroute(F.col("raw"), F.col("blocks"))))
    kept = F.map_from_arrays(F.array(*[F.lit(k) for k in ex.SOURCE_KEYS]), F.array(*[
        ex.ground(F.try_element_at("routed", F.lit(k)), F.try_element_at("blocks", F.lit(k)))["kept"] for k in ex.SOURCE_KEYS]))
    d = d.withColumn("kept", kept).withColumn("skills_by_source", ex.fill_occurrences(F.col("kept"), F.col("blocks")))
    return d.withColumn("skills", ex.merge(F.col("skills_by_source"))).select(
        "doc_id", "skills_by_source", "skills", "experience_months", "experience_source")


def extract_job_requirements(docs: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Job texts -> required skills in order of appearance and minimum experience."""
    d = sec.requirements_section(docs).withColumn("section", F.col("requirements.section_text"))
    d = xp.min_experience(d, "section", "text").withColumn("items", t.unlines(sec.join_wrapped(t.lines_of(F.col("section")))))
    d = d.select("doc_id", "min_months", "min_source", F.col("requirements.found").alias("found"),
                 t.strip_labels(t.expand_parens(t.clean_bullets(F.col("items")))).alias("body"))
    lists = ex.tag_skills(d, ["doc_id"], "body", lexicon.select("alias", F.col("alias").alias("canonical"))).groupBy("doc_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("pos", "skill"))), lambda x: x["skill"]).alias("l"))
    d = d.join(lists, "doc_id", "left").withColumn("l", F.coalesce("l", F.array().cast("array<string>")))
    return d.select("doc_id", "found", "min_months", "min_source", ex.ground(F.col("l"), F.col("body"))["kept"].alias("skills"))


def _metric(df: DataFrame, section: str, key: Column, value: Column) -> DataFrame:
    return df.select(F.lit(section).alias("section"), key.cast("string").alias("key"), value.cast("string").alias("value"))


def dashboard_applicant(user_id: int, users: DataFrame, resumes: DataFrame, apps: DataFrame, jobs: DataFrame, now) -> DataFrame:
    """(section, key, value) rows of one applicant's dashboard; never scores or notes."""
    mine = apps.where(F.col("user_id") == user_id)
    docs = resumes.where((F.col("owner_id") == user_id) & ~F.col("is_archived"))
    titled = mine.join(jobs.select("job_id", "title"), "job_id")
    up = listing.top(titled.where((F.col("interview_stage") == "scheduled") & (F.col("interview_at") >= F.lit(now))),
                     [F.asc("interview_at"), F.asc("application_id")], 10)
    recent = listing.top(titled, [F.desc("applied_at"), F.asc("application_id")], 5)
    newest = listing.top(jobs.where("status = 'published'"), [F.desc("created_at"), F.asc("job_id")], 5)
    steps = dash.onboarding(users.where(F.col("user_id") == user_id), docs, mine)
    return (
        _metric(dash.count_by(docs, "extraction_status"), "documents", F.col("extraction_status"), F.col("n"))
        .unionByName(_metric(dash.count_by(mine, "status"), "applications", F.col("status"), F.col("n")))
        .unionByName(_metric(steps.unpivot([], ["profile_complete", "has_resume", "has_applied"], "k", "v"), "onboarding", F.col("k"), F.col("v")))
        .unionByName(_metric(up, "upcoming", F.col("application_id"), F.col("title")))
        .unionByName(_metric(recent, "recent", F.col("application_id"), F.col("title")))
        .unionByName(_metric(newest, "newest jobs", F.col("job_id"), F.col("title")))
    )


def dashboard_recruiter(viewer_id: int, apps: DataFrame, jobs: DataFrame, now) -> DataFrame:
    """(section, key, value) rows of one recruiter's dashboard."""
    own = jobs.where(F.col("created_by") == viewer_id)
    theirs = apps.join(own.select("job_id"), "job_id", "left_semi")
    counters = dash.job_counters(apps).join(own.select("job_id"), "job_id", "left_semi")  # count first: a hot job shrinks before the join
    up = theirs.where((F.col("interview_stage") == "scheduled") & (F.col("interview_at") >= F.lit(now)))
    board = dash.job_board(own, counters)
    quick = dash.quick_actions(own, counters, up)
    return (
        _metric(board, "job", F.col("job_id"), F.concat_ws("/", "total", "new", "scoring", "shortlisted"))
        .unionByName(_metric(dash.funnel(theirs), "funnel", F.col("bucket"), F.col("n")))
        .unionByName(_metric(quick.unpivot([], quick.columns, "k", "v"), "quick", F.col("k"), F.col("v")))
        .unionByName(_metric(listing.top(up, [F.asc("interview_at"), F.asc("application_id")], 20), "upcoming", F.col("application_id"), F.col("job_id")))
    )


def dashboard_admin(company: int | None, users: DataFrame, configs: DataFrame, msgs: DataFrame, hits: DataFrame, audit: DataFrame,
                    jobs: DataFrame, now, superuser: bool = False) -> DataFrame:
    """(section, key, value) rows of an admin's dashboard; requests and feed are scoped, system health is not."""
    pending = users.where("requested_role is not null")
    if not superuser:
        pending = pending.where(F.col("company") == company) if company is not None else pending.where(F.lit(False))
    feed = audit if superuser else hist.admin_scope(audit, jobs, company)
    unset = configs.where("provider = 'unset' OR model = 'unset'")
    usage = operations.window_usage(hits, now)
    n = F.count(F.lit(1)).alias("n")
    return (
        _metric(pending.agg(n), "requests", F.lit("count"), F.col("n"))
        .unionByName(_metric(listing.top(pending, [F.asc("created_at"), F.asc("user_id")], 5), "oldest request", F.col("user_id"), F.col("email")))
        .unionByName(_metric(unset, "unset", F.col("task"), F.lit("unset")))
        .unionByName(_metric(msgs.agg(n), "queue", F.lit("total"), F.col("n")))
        .unionByName(_metric(usage.unpivot([], ["tokens", "requests"], "k", "v"), "quota", F.col("k"), F.col("v")))
        .unionByName(_metric(listing.top(feed, [F.desc("created_at"), F.desc("id")], 10), "activity", F.col("id"), F.col("action")))
    )


def audit_page(audit: DataFrame, jobs: DataFrame, users: DataFrame, resumes: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of scoped and filtered history, newest first, with labels and changed fields."""
    page = listing.page(audit, [F.desc("created_at"), F.desc("id")], limit, offset)
    return hist.with_changes(hist.label_audit(page, jobs, users, resumes))


def system_snapshot(resumes: DataFrame, jobs: DataFrame, apps: DataFrame, msgs: DataFrame, hits: DataFrame, configs: DataFrame,
                    probes: DataFrame, now, usage_now) -> DataFrame:
    """(section, key, value) rows: stuck and running rows, queues, budget use, task configuration with last probe."""
    running = lambda df, k: df.agg(F.count_if(F.col("extraction_status") == "processing").alias("n")).withColumn("kind", F.lit(k))
    tasks = configs.join(operations.latest_probe(probes).select("task", F.col("state").alias("probe")), "task", "left").withColumn(
        "ok", (F.col("provider") != "unset") & (F.col("model") != "unset"))
    usage = operations.window_usage(hits, usage_now)
    return (
        _metric(operations.stuck_rows(resumes, jobs, apps, now), "stuck", F.col("kind"), F.col("n"))
        .unionByName(_metric(running(resumes, "resume_extractions").unionByName(running(jobs, "job_extractions")), "running", F.col("kind"), F.col("n")))
        .unionByName(_metric(operations.queue_depth(msgs), "queue", F.coalesce("queue", F.lit("total")), F.col("depth")))
        .unionByName(_metric(usage.unpivot([], ["tokens", "requests"], "k", "v"), "quota", F.col("k"), F.col("v")))
        .unionByName(_metric(tasks, "task", F.col("task"), F.concat_ws("/", F.col("ok").cast("string"), F.coalesce("probe", F.lit("none")))))
    )
