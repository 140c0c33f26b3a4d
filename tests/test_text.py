"""Text rules against small examples and plain Python."""

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from hirelake.functions import dates as d
from hirelake.functions import text as t
from hirelake.operators import experience as xp
from hirelake.operators import extraction as ex
from hirelake.operators import sections as sec

TODAY = dt.date(2024, 6, 15)


def one(spark, text, fn):
    return spark.createDataFrame([(text,)], "x string").select(fn(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize("text,want", [
    ("AWS (ECS, S3)", "aws, aws ecs, aws s3"), ("Cloud Azure (basic)", "azure, azure basic"), ("cloud computing (x)", "cloud computing, cloud computing x"),
    ("languages: Java (8; 11), c++", "languages: java, java 8, java 11, c++"), ("we used it a lot there (in prod)", "we used it a lot there (in prod)"),
    ("Done. Then x (y)", "done. then x (y)"), ("x ()", "x ()")])
def test_expand_parens(spark, text, want):
    got = one(spark, text, t.expand_parens)
    assert got == want


def brute_expand(text):
    text = re.sub(r"\(\s*cid:127\s*\)", ", ", text.lower()).replace("•", ", ")

    def sub(m):
        base, inner = m.group(1).strip(), m.group(2).strip()
        w = base.split()
        items = [i.strip() for i in re.split("[,;|]", inner) if i.strip()]
        if not base or not items or len(w) > 4 or re.search(r"[.!?]\s", base):
            return m.group(0)
        if len(w) > 1 and w[0] in t.STRUCTURAL_LEADERS and w[1] not in t.GENERIC_HEADS:
            base = " ".join(w[1:])
        lead = m.group(1)[: len(m.group(1)) - len(m.group(1).lstrip())]
        return lead + ", ".join([base] + [f"{base} {i}" for i in items])

    before = None
    while before != text:
        before, text = text, re.sub(r"([^()\n,:|]+?)\s*\(([^()]*)\)", sub, text)
    return text


def test_expand_parens_on_documents(spark, stage):
    rows = stage.resume_docs.select("text", t.expand_parens(F.col("text")).alias("y")).collect()
    assert all(r.y == brute_expand(r.text) for r in rows)


def brute_join(lines):
    bullet = re.compile(t.ITEM_BULLET)
    lines = [x.strip() for x in lines if x.strip()]
    has, items = any(bullet.match(x) for x in lines), []

    def titled(x):
        ws = [w for w in re.findall(r"[A-Za-z][A-Za-z']*", x) if w.lower() not in sec.SMALL_WORDS]
        return bool(ws) and all(w[0].isupper() for w in ws)

    def cont(p, x):
        if x[0].islower() or x[0] in ")],;":
            return True
        if re.search(sec.CONTINUES_AFTER, p) or (p.endswith(":") and len(p.split()) <= 4):
            return True
        if 2 <= len(x.split()) <= 6 and re.search(sec.SUBHEADING_TAIL, x) and titled(x):
            return False
        return has and not re.search(r"[.!?;:]$", p)

    for x in lines:
        if not items or bullet.match(x) or not cont(items[-1], x):
            items.append(x)
        elif items[-1].endswith("-") and len(items[-1]) > 1 and items[-1][-2].isalpha() and x[0].islower():
            items[-1] += x
        else:
            items[-1] += " " + x
    return items


def test_join_wrapped(spark, stage):
    own = ["- Build web-\nservices and\nAPIs\nManagement Skills\n* own it\nDomain Knowledge:\nfinance", "A line.\nNext one", "• x\nY z"]
    texts = own + [r.text for r in stage.job_docs.select("text").collect()]
    df = spark.createDataFrame([(x,) for x in texts], "x string").select("x", sec.join_wrapped(F.split("x", "\n")).alias("y"))
    assert all(r.y == brute_join(r.x.split("\n")) for r in df.collect())


def test_strip_labels(spark):
    text = "languages:\ncloud & devops: aws, docker\nCloud\naws, gcp\ntools\nsaas\n\nplain"
    assert one(spark, text, t.strip_labels) == "aws, docker\naws, gcp\ntools\nsaas\nplain"


def test_whole_word(spark):
    f = lambda s: lambda c: ex.contains_word(F.lower(c), F.lit(s))
    assert one(spark, "C++ and C# with node.js", f("c++")) and not one(spark, "C++ and C#", f("c"))
    assert one(spark, "uses node.js.", f("node.js")) and not one(spark, "javascript", f("java"))
    assert not one(spark, "nodexjs", f("node.js"))


def test_skill_blocks(spark):
    df = spark.createDataFrame([({"skills_section": ["Java", "Go", "ghost"], "work_experience": ["java "]},
                                 {"skills_section": "java, rust", "work_experience": "wrote go services in java", "projects": ""})],
                               "s map<string,array<string>>, b map<string,string>")
    r = df.select(ex.by_source(ex.reroute(F.col("s"), F.col("b"))).alias("routed"), ex.ground(F.col("s")["skills_section"], F.col("b")["skills_section"]).alias("g"),
                  ex.merge(F.col("s")).alias("m"), ex.fill_occurrences(F.col("s"), F.col("b")).alias("f")).first()
    assert r.routed == {"skills_section": ["Java", "ghost"], "work_experience": ["Go", "java "], "projects": []}
    assert r.g.kept == ["Java"] and r.g.dropped == ["Go", "ghost"] and r.m == ["Java", "Go", "ghost"]
    assert r.f["work_experience"] == ["java ", "Go"]


@pytest.mark.parametrize("text,want", [
    ("5+ years of experience", [(60, None, False)]), ("3-5 years experience", [(36, 60, False)]), ("two years of hands-on work", [(24, None, False)]),
    ("6 months - 1 year experience", [(6, 12, False)]), ("experience: 5 to 2 years", [(60, None, False)]), ("founded 10 years ago, experience matters", []),
    ("in the last 3 years experience grew", []), ("4 weeks of leave", []), ("99 years experience", []), ("Nice to have:\n2 years experience with x", [(24, None, True)]),
    ("1.5 yrs exp needed", [(18, None, False)]), ("5 years overall experience, 2 years with AWS", [(60, None, False), (24, None, False)])])
def test_mentions(spark, text, want):
    assert [(m.min_months, m.max_months, m.preferred) for m in one(spark, text, d.find_mentions)] == want


def test_min_experience(spark):
    df = spark.createDataFrame([("2 years experience", "9 years experience"), (None, "open to freshers"), (None, "nothing"),
                                ("ideally 3 years experience", "4 years experience")], "a string, b string")
    got = [(r.min_months, r.min_source) for r in xp.min_experience(df, "a", "b").collect()]
    assert got == [(24, "requirements_section"), (0, "entry_level_marker"), (None, None), (48, "full_text")]


@pytest.mark.parametrize("text,want", [
    ("Jun 2021", dt.date(2021, 6, 1)), ("September, 2019", dt.date(2019, 9, 1)), ("Sept. 2018", dt.date(2018, 9, 1)), ("06/2021", dt.date(2021, 6, 1)),
    ("2021-06", dt.date(2021, 6, 1)), ("2019", dt.date(2019, 1, 1)), ("Jan '20", None), ("1965", None), ("Present", TODAY), ("??", None)])
def test_parse_month(spark, text, want):
    assert one(spark, text, lambda c: d.parse_month(c, True, F.lit(TODAY))) == want


def test_resume_experience(spark):
    text = "Jane\nWork Experience\nJan 2020 - Mar 2021 Acme\nMarch 2021 to Present Other\nEducation\n2010 - 2014 School"
    r = xp.resume_experience(spark.createDataFrame([(1, text)], "doc_id long, text string"), F.lit(TODAY)).first()
    assert r.experience_months == 14 + 39 and r.experience_source == "experience_section" and len(r.experience_entries) == 2
    r = xp.resume_experience(spark.createDataFrame([(1, "Education\n2010 - 2014 School")], "doc_id long, text string"), F.lit(TODAY)).first()
    assert r.experience_months is None and r.experience_source is None


def test_requirements_section(spark):
    text = "About us\nWe build\nRequired Technical Skills\nx\nRequirements:\n- Python\nSQL\nRequired Skills\n- own the line Our Office\nrest"
    r = sec.requirements_section(spark.createDataFrame([(text,)], "text string")).first().requirements
    assert r.found and r.heading == "Requirements:" and r.section_text == "- Python\nSQL\n- own the line"
    r = sec.requirements_section(spark.createDataFrame([("just prose here.",)], "text string")).first().requirements
    assert not r.found and r.section_text == ""


@pytest.mark.parametrize("line,want", [
    ("Rewards", True), ("REWARDS:", True), ("- Rewards", False), ("SQL", False), ("AWS", False), ("Requirements", False), ("About our team", True),
    ("our rewards platform", False), ("Office: Pune", True), ("Office Space Plans", False), ("Rewards & Leave", True), ("Optional Skills & Broad Expertise", True), ("Why join us", True), ("", False)])
def test_job_boundary(spark, line, want):
    assert one(spark, line, sec.is_job_boundary) is want


def test_collect_until_boundary(spark):
    lines = ["Compulsory Skills", "Python", "Qualifications", "degree", "Rewards", "x"]
    df = spark.createDataFrame([(lines, 0, 1), (lines, 0, 0), (["Must have: a, b", "c", "Rewards"], 0, 0)], "l array<string>, c int, p int")
    got = [r.section_text for r in sec.collect_until_boundary(df, "l", "c", "p").collect()]
    assert got == ["python", "python\ndegree", "a, b\nc"]


def test_resume_and_job_plans(spark):
    from hirelake.plans.composed import extract_job_requirements, extract_resume_skills
    lex = spark.createDataFrame([(x, x) for x in ("python", "aws", "aws s3", "c++", "sql", "go")], "alias string, canonical string")
    resume = ("Jane Doe\nSkills\nlanguages: Python, C++\nAws (S3, EC2)\nWork Experience\nJan 2020 - Jan 2022 Acme\n- Wrote SQL and Python services\n"
              "Projects\n* Go crawler\nEducation\n2010 - 2014 SQL course")
    r = extract_resume_skills(spark.createDataFrame([(1, resume)], "doc_id long, text string"), lex, F.lit(TODAY)).first()
    assert r.experience_months == 24
    assert {k: set(v) for k, v in r.skills_by_source.items()} == {
        "skills_section": {"python", "c++", "aws", "aws s3"}, "work_experience": {"sql", "python"}, "projects": {"go"}}
    job = "About us\nWe like go\nRequirements:\n- 3+ years of experience with Python\n- AWS\n  (S3)\nRewards\nsql training"
    j = extract_job_requirements(spark.createDataFrame([(1, job)], "doc_id long, text string"), lex).first()
    assert j.found and j.min_months == 36 and j.min_source == "requirements_section" and set(j.skills) >= {"python", "aws"} and "sql" not in j.skills


def test_deep_parentheses_reach_the_fixed_point(spark):
    text = "a (b (c (d (e (f (g))))))"
    got = one(spark, text, t.expand_parens)
    assert "(" not in got and got.endswith("g") and got == one(spark, got, t.expand_parens)


def test_long_sections_and_long_terms_are_whole(spark):
    body = "\n".join(f"line {i} " + "x" * 50 for i in range(1000))
    df = spark.createDataFrame([("Work Experience\n" + body,)], "text string")
    got = sec.partition_sections(df).select(sec.collect_section("sections", "experience")["section_text"].alias("s")).first().s
    assert got == body and len(got) > 55_000
    lex = spark.createDataFrame([("large scale data base design", "dbd"), ("data", "data")], "alias string, canonical string")
    docs = spark.createDataFrame([(1, "We do large scale data base design daily")], "doc_id long, text string")
    assert {r.skill for r in ex.tag_skills(docs, ["doc_id"], "text", lex).collect()} == {"dbd", "data"}


def test_headings_seen(spark):
    df = spark.createDataFrame([("Projects\na\nEducation\nb\nPROJECTS:\nc",)], "text string")
    got = sec.partition_sections(df).select(sec.collect_section("sections", "projects").alias("s")).first().s
    assert list(got.headings) == ["Projects", "PROJECTS:"] and got.section_text == "a\nc"


@pytest.mark.parametrize("line,caps,fuzzy", [
    ("REQUIRED SKILLS", True, True), ("SQL", False, False), ("- REQUIRED SKILLS", False, False), ("TOP 5 SKILLS", False, False),
    ("Minimum Degree Qualifications", False, True), ("minimum degree qualifications", False, False), ("Required: SQL, Java", False, False), ("", False, False)])
def test_caps_and_fuzzy_headings(spark, line, caps, fuzzy):
    r = spark.createDataFrame([(line,)], "x string").select(sec.caps_heading(F.col("x")).alias("c"), sec.fuzzy_heading(F.col("x")).alias("f")).first()
    assert (r.c, r.f) == (caps, fuzzy)


def test_resume_text_is_cleaned_before_extraction(spark):
    from hirelake.plans.composed import extract_resume_skills
    lex = spark.createDataFrame([("python", "python")], "alias string, canonical string")
    resume = "Skills\nPython\u00a0\n\n\n\nWork Experience\nJan 2020 â€“ Jan 2022 Acme"
    r = extract_resume_skills(spark.createDataFrame([(1, resume)], "doc_id long, text string"), lex, F.lit(TODAY)).first()
    assert list(r.skills) == ["python"] and r.experience_months == 24


def brute_held(text, skill):
    return skill != "" and re.search("(?<![a-z0-9+#])" + re.escape(skill) + "(?![a-z0-9+#])", text) is not None


def test_held_words_match_the_word_rule(spark):
    import random
    rng = random.Random(2)
    bits = ["c", "c++", "c#", "node", ".", "js", " ", "-", "é", "a", "ab", "(", "+", "/", "日"]
    rows = []
    for _ in range(300):
        text = " ".join("".join(rng.choice(bits) for _ in range(rng.randint(0, 30))).split())
        skills = ["".join(rng.choice(bits) for _ in range(rng.randint(1, 4))).strip() for _ in range(8)]
        cut = sorted(rng.sample(range(len(text) + 1), 2)) if text else (0, 0)
        rows.append((text, [*skills, "", text, text[slice(*cut)].strip()]))
    rows += [("", ["c", "."]), ("word " * 30_000 + "node.js .net", ["node.js", ".net", "net", "js .", "word word", "ord"])]
    df = spark.createDataFrame(rows, "text string, skills array<string>")
    for r in df.withColumn("held", ex.held_words(F.col("text"), ex.skill_parts(F.col("skills")))).collect():
        assert list(r.held) == [brute_held(r.text, s) for s in r.skills], (r.text[:80], r.skills)


def test_tagging_shuffles_only_runs_that_may_match(spark):
    docs = spark.createDataFrame([(1, "we like red widget and red hats, c++ too " * 50)], "doc_id int, text string")
    lex = spark.createDataFrame([("red widget", "red widget"), ("c++", "c++"), ("red", "red")], "alias string, canonical string")
    out = ex.tag_skills(docs, ["doc_id"], "text", lex)
    assert {(r.skill, r.pos) for r in out.collect()} == {("red", 7), ("red widget", 8), ("c++", 22)}


def test_long_lines_and_long_words_take_no_stack(spark):
    """Lines of 20,000 title-case words and words of 20,000 dotted parts filled the stack of a task, which ends its executor."""
    from hirelake.plans.composed import extract_resume_skills
    titles, dotted = "Von " * 20_000, "a." * 20_000 + "a-" * 20_000
    lines = [(titles, True), ("1 Ab. \u00c9 " * 9_000 + "!\n", True), (titles + "von", False), (titles + "VoN", False), ("", False), ("12", False)]
    df = spark.createDataFrame(lines, "x string, want boolean").repartition(2)
    assert df.where(sec.is_title(F.col("x")) != F.col("want")).count() == 0
    lex = spark.createDataFrame([(x, x) for x in ("python", "red widget")], "alias string, canonical string")
    docs = spark.createDataFrame([(1, f"{dotted}a red widget")], "doc_id long, text string").repartition(2)
    assert [tuple(r) for r in ex.tag_skills(docs, ["doc_id"], "text", lex).collect()] == [(1, "red widget", 5)]
    resume = f"Jane\n{titles}\nSkills\nPython, red widget\n{dotted}a\nWork Experience\nJan 2020 - Jan 2022 Acme\n{titles}\n- Python and {dotted}a"
    r = extract_resume_skills(spark.createDataFrame([(1, resume)], "doc_id long, text string").repartition(2), lex, F.lit(TODAY)).first()
    assert r.experience_months == 24 and {k: set(v) for k, v in r.skills_by_source.items()} == {
        "skills_section": {"python", "red widget"}, "work_experience": {"python"}, "projects": set()}


def test_tagging_goes_by_the_size_of_the_lexicon(spark, tmp_path):
    """A few terms out of a table above the broadcast threshold: the words of the texts stay where they are."""
    spark.range(60_000).selectExpr("id", "uuid() AS x", "concat('red ', id % 5) AS name").write.parquet(str(tmp_path / "part"))
    lex = spark.read.parquet(str(tmp_path / "part")).select(F.col("name").alias("alias"), F.col("name").alias("canonical")).distinct()
    docs = spark.createDataFrame([(k, f"a red {k} and a red 9") for k in range(8)], "doc_id int, text string")
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, "40k")
        out = ex.tag_skills(docs, ["doc_id"], "text", lex)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and plan.count("BroadcastHashJoin") == 2
        assert sorted(map(tuple, out.collect())) == [(k, f"red {k}", 5) for k in range(5)]
    finally:
        spark.conf.set(key, before)


def test_ranges_cost_one_row_each_and_hot_people_are_bounded(spark):
    """A third of a million ranges of one person, long ones among them, against months counted one by one."""
    import random
    rng = random.Random(1)
    spans = [(1, rng.randint(1950 * 12, 2023 * 12), rng.choice([0, 1, 5, 600])) for _ in range(2000)]
    spans += [(2, 1970 * 12, 600), (2, 2021 * 12, 3), (2, 2021 * 12 + 3, 2), (3, 2030 * 12, 4), (4, 2000 * 12, 0)]
    rows = [(k, dt.date(m // 12, m % 12 + 1, 9), dt.date((m + n) // 12, (m + n) % 12 + 1, 20)) for k, m, n in spans]
    df = spark.createDataFrame(rows, "k int, start_date date, end_date date")
    today, limit = F.lit(TODAY), TODAY.year * 12 + TODAY.month - 1
    covered = {k: {x for kk, m, n in spans if kk == k and m <= limit for x in range(m, min(m + n, limit))} for k in range(1, 5)}
    hot = df.union(df.where("k = 1").crossJoin(spark.range(150)).drop("id"))
    got = {r.k: r.months for r in xp.experience_months(hot, "k", today).collect()}
    assert got == {1: len(covered[1]), 2: len(covered[2]), 3: None, 4: 0}
    assert sum(r.months for r in xp.merge_ranges(hot, "k", today).collect()) == sum(map(len, covered.values()))
    assert xp._swept(hot, "k", today).groupBy("k").count().agg(F.max("count")).first()[0] <= 12 * 80
    packed = df.groupBy("k").agg(F.collect_list(F.struct("start_date", "end_date")).alias("r"))
    inside = {r.k: r.m for r in packed.where("k <> 3").select("k", xp.covered_months(F.col("r"), today).alias("m")).collect()}
    assert {k: inside[k] for k in (1, 2, 4)} == {k: got[k] for k in (1, 2, 4)}


def test_many_mentions_take_linear_time(spark):
    """Ten thousand matches in one text, on one line and on lines of their own, cross-line matches among them."""
    import time

    def frame(n, sep):
        return spark.createDataFrame([(sep.join(f"{i % 9 + 1} years of experience" if i % 3 else f"nice to have: {i % 7 + 1}\nyears experience" for i in range(n)),)], "x string").select(
            F.size(d.find_mentions(F.col("x"))).alias("n"))

    for sep in (" and then ", "\n"):
        assert frame(200, sep).first().n == 200
        took = {}
        for n in (2500, 10_000):
            t0 = time.time()
            assert frame(n, sep).first().n == n
            took[n] = time.time() - t0
        assert took[10_000] < 8 * took[2500] + 2


def brute_mentions(text):
    """The contexts as they are defined, from the whole text before and after each match."""
    out = []
    for m in re.finditer(d.MENTION.replace("(?i)", ""), text, re.I):
        head, tail = text[:m.start()], text[m.end():]
        before, after = head[-50:], tail[:80].split("\n\n")[0]
        window = " ".join([before, m[0], after]).replace("\n", " ")
        if not re.search(d.CUE, window) or re.search(d.NOT_BEFORE, before) or re.search(d.NOT_AFTER, after):
            continue
        lines = [""] + head.split("\n")
        prev = lines[-2].strip(" ")
        line = (prev + " " if 1 <= len(prev) <= 40 else "") + lines[-1] + m[0] + tail.split("\n")[0]
        out.append((m[0].strip(" "), bool(re.search(d.PREFERRED, line))))
    return out


def test_mentions_have_the_context_of_the_whole_text(spark):
    import random
    rng = random.Random(4)
    bits = ["5 years", "3-5 yrs", "two months", "1mo", " ", "\n", "\n\n", "experience", "preferred", "nice to", "have", "last", "ago", "Ideally", "x" * 30, "6\nmonths", "proven", "."]
    rows = [("".join(rng.choice(bits) + rng.choice(["", " "]) for _ in range(rng.randint(1, 60))),) for _ in range(250)]
    df = spark.createDataFrame(rows, "x string").select("x", d.find_mentions(F.col("x")).alias("m"))
    for r in df.collect():
        assert [(x.text, x.preferred) for x in r.m] == [(x, p) for x, p in brute_mentions(r.x)], r.x


def test_join_wrapped_many_lines(spark):
    import random
    rng = random.Random(6)
    bits = ["- Build web-", "services and", "APIs", "Management Skills", "* own it", "Domain Knowledge:", "finance", "a:", "b c:", "Done.", "x y z", "Big Tools", "(in", "2) two", "word-", "end"]
    texts = ["\n".join(rng.choice(bits) for _ in range(rng.randint(1, 200))) for _ in range(150)] + ["\n".join(rng.choice(bits) for _ in range(20_000))]
    df = spark.createDataFrame([(x,) for x in texts], "x string").select("x", sec.join_wrapped(F.split("x", "\n")).alias("y"))
    assert all(list(r.y) == brute_join(r.x.split("\n")) for r in df.collect())


def test_strip_boilerplate_in_the_row(spark):
    import random
    rng, rows = random.Random(8), []
    for k in range(60):
        pages = rng.randint(1, 9)
        lines = [(p, i, rng.choice(["Head", " Head ", f"Page {p}", "", "tail", "x" * 61, f"line {rng.randint(0, 5)}"])) for p in range(pages) for i in range(rng.randint(0, 6))]
        rows.append((k, lines))
    rows += [(100, []), (101, [(p, i, "again") for p in range(40) for i in range(50)])]
    df = spark.createDataFrame(rows, "k int, lines array<struct<page:bigint,line_no:bigint,line:string>>").withColumn("kept", sec.strip_boilerplate(F.col("lines")))
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    for r in df.collect():
        pages = len({x.page for x in r.lines})
        need = max(2, round(pages * 0.5))
        on = {}
        for x in r.lines:
            if 0 < len(x.line.strip()) <= 60:
                on.setdefault(x.line.strip(), set()).add(x.page)
        want = [(x.page, x.line_no, x.line.strip()) for x in r.lines if x.line.strip() and len(on.get(x.line.strip(), ())) < need]
        assert [tuple(x) for x in r.kept] == want
