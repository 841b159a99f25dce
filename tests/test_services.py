"""Payload records, indexing, recommendations, robustness, the worker and the settings."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from pairloom import config
from pairloom.functions import dates, hybrid, records, text
from pairloom.operators import chunking, evidence, indexing, matching, ranking, recommend, robustness, sections, statistics
from pairloom.operators.jobs import claim_order
from pairloom.streaming import worker


def of(spark, schema, payload, column):
    return spark.createDataFrame([(json.dumps(payload),)], "j string").select(records.parsed(F.col("j"), schema).alias("r")).select(column(F.col("r")).alias("v")).first().v


CV = {
    "skills": [{"name": " React ", "confidence": 2, "evidence": "built React apps", "proficiency_level": "7"}, {"name": "react"}, {"name": "x" * 101}, {"name": "Go", "confidence": 0.9, "evidence": "nowhere", "proficiency_level": 11}],
    "experience": [{"title": "Dev", "company": "Acme", "start_date": "03/2020", "end_date": "Hiện tại", "description": " a  b "}, {"title": "", "company": None, "start_date": "2018", "end_date": "2019-06"}],
    "education": [{"degree": "BSc", "school": "U", "start_year": "1890", "end_year": 2012}],
    "projects": [{"name": "P", "technologies": ["Spark", " spark ", "SQL", ""], "description": "d"}],
    "summary": "s" * 2000,
}


def test_profiles_are_brought_to_their_schema(spark):
    n = of(spark, records.CV, CV, lambda r: records.normalized_cv(r, F.lit("Has built  react APPS since")))
    p = n.payload
    assert [(s.name, s.proficiency_level, s.confidence) for s in p.skills] == [("React", 7, 1.0), ("Go", None, 0.3)] and n.warnings == []
    assert [(e.title, e.start_date, e.end_date, e.is_current) for e in p.experience] == [("Dev", "2020-03", None, True), (None, "2018", "2019-06", False)]
    assert p.education[0].start_year is None and p.education[0].end_year == 2012 and p.projects[0].technologies == ["Spark", "SQL"] and len(p.summary) == 1500
    strict = of(spark, records.CV, {"skills": CV["skills"]}, lambda r: records.normalized_cv(r, F.lit("built react apps"), strict=True))
    assert [s.name for s in strict.payload.skills] == ["React"] and strict.warnings == ["EVIDENCE_MISSING:2", "EMPTY_SECTION:experience", "EMPTY_SECTION:education", "EMPTY_SECTION:projects"]


def test_jobs_are_brought_to_their_schema(spark):
    job = {"title": "T" * 200, "required_skills": [{"name": "Go"}, {"name": "go "}], "responsibilities": [f"r{i}" for i in range(25)] + ["r1"], "min_years_experience": 25, "budget": {"min": -1, "max": "20", "currency": "EUR"}}
    n = of(spark, records.JOB, job, records.normalized_job)
    assert len(n.payload.title) == 150 and [s.name for s in n.payload.required_skills] == ["Go"] and len(n.payload.responsibilities) == 20
    assert n.payload.min_years_experience is None and (n.payload.budget.min, n.payload.budget.max) == (None, 20.0) and n.warnings == ["LIMIT_RESPONSIBILITIES_TRIMMED"]


def test_requirements_and_profiles(spark):
    r = of(spark, records.JOB, {"skills": [{"name": "Go", "weight": "2"}], "min_years_experience": "3", "preferences": {"a": "1", "b": None}}, records.requirement)
    assert [(s.name, s.weight) for s in r.required] == [("Go", 2.0)] and r.optional == [] and r.min_years == 3.0 and r.budget is None and r.preferences == {"a": "1"}
    p = of(spark, records.CV, CV | {"expected_budget": {"min": 5}}, lambda x: records.profile(x, "2021-03"))
    assert p.years == pytest.approx(round((12 + 17) / 12, 2), abs=0.09) or p.years == pytest.approx(1.42, abs=0.01)
    assert p.budget.min == 5.0 and len(p.skills) == 4


def test_profile_text(spark):
    got = of(spark, records.CV, CV | {"summary": "Hello \n there", "skills": [{"name": "Go"}, {"name": " Go"}, {"name": "SQL"}]}, records.profile_text)
    assert got == "SUMMARY\n- Hello there\n\nSKILLS\n- Go, SQL\n\nEXPERIENCE\nDev - Acme (03/2020 -> Hiện tại)\n    a b\n (2018 -> 2019-06)\n\nEDUCATION\nBSc - U (1890-2012)\n\nPROJECTS\nP: d [Spark, spark, SQL]"


@pytest.mark.parametrize(("bounds", "want"), [
    ((100.0, 200.0, 120.0, 180.0), 0.6), ((None, None, 1.0, 2.0), 1.0), ((100.0, 200.0, None, None), 1.0), ((100.0, 200.0, 150.0, None), 0.0), ((100.0, 200.0, None, 150.0), 0.5),
    ((100.0, None, 50.0, 90.0), 1.0), ((100.0, None, 50.0, 150.0), 0.0), ((100.0, None, 120.0, None), 0.0), ((None, 200.0, 50.0, 100.0), 1 / 3), ((None, 200.0, None, 100.0), 0.5), ((None, 200.0, 300.0, 400.0), 1.0),
])
def test_budget_by_stated_bounds(spark, bounds, want):
    d = spark.createDataFrame([bounds], "a double, b double, c double, d double")
    assert d.select(hybrid.budget_score(*map(F.col, "abcd")).alias("s")).first().s == pytest.approx(want)


def test_dates_and_texts(spark):
    rows = {"2022-03": "2022-03", "03/2022": "2022-03", "Mar 2022": "2022-03", "Tháng 3/2022": "2022-03", "2022": "2022", "15/03/2022": "2022-03", "13/2022": None, "": None, "2022-13": "2022", "mar, 1999": "1999-03", "2022-2023": "2022", "since 2021/7.": "2021-07"}
    d = spark.createDataFrame(list(rows.items()), "v string, w string")
    assert [(r.v, r.d) for r in d.select("v", dates.normalize_date(F.col("v")).alias("d")).collect()] == list(rows.items())
    long = "\n".join(["a line that goes on", "and on"] * 20_000)
    assert spark.createDataFrame([(long,)], "t string").select(F.length(text.merge_broken_lines(F.col("t"))).alias("n")).first().n == len(long)


def documents(spark):
    part = lambda n, t: {"name": n, "text": t, "heading_raw": n, "ord": 0}
    rows = [("1", "cv", "en", "spark sql", {"skills": part("skills", "spark")}, "{}"), ("2", "jd", "en", "python", {"skills": part("skills", " "), "summary": part("summary", "python")}, "{}")]
    return spark.createDataFrame(rows, "doc_id string, doc_type string, lang string, raw_text string, sections map<string,struct<name:string,text:string,heading_raw:string,ord:int>>, payload string")


def test_index_moves_both_tables(spark, tmp_path):
    index = indexing.Index(spark, str(tmp_path / "i"), chunking.embedder("hash"), "hash")
    index.vectors.create()
    assert index.vectors.current().count() == 0
    added = {(r.doc_id, r.upserted) for r in index.put(documents(spark)).collect()}
    assert added == {("1", 2), ("2", 2)} and {r.doc_id for r in index.payloads.ids("cv").collect()} == {"1"}
    index.put(documents(spark).filter("doc_id = '1'"), version=2)
    assert {(r.version, r.section) for r in index.vectors.point_read("cv", "1").collect()} == {(2, "skills"), (2, "_full")}
    index.remove(spark.createDataFrame([("cv", "1", None)], "doc_type string, doc_id string, version int"))
    assert index.vectors.count("cv") == 0 and index.payloads.get("cv", "1").count() == 0 and index.payloads.count("jd") == 1
    hits = spark.createDataFrame([("jd", "2", 0.5), ("jd", "9", 0.4)], "doc_type string, doc_id string, score double")
    assert [r.doc_id for r in index.with_payloads(hits).collect()] == ["2"]
    assert indexing.index_document(index.vectors, documents(spark), "1", chunking.embedder("hash"), "hash").count() == 1
    with pytest.raises(Exception, match="blank"):
        spark.createDataFrame([(" ",)], "t string").select(indexing.guarded(F.upper)(F.col("t"))).collect()


def test_recommend_with_records_and_keywords(spark):
    hits = spark.createDataFrame([(1, 10, 1, 0.1), (1, 11, 1, 0.2), (1, 12, 1, 0.3)], "query_id long, doc_id long, version int, distance double")
    skill, budget = "array<struct<name:string,weight:double,level:int>>", "struct<min:double,max:double,currency:string>"
    need = spark.createDataFrame([(1, [("Go", 1.0, None)], [], 2.0, None, {})], f"id long, required {skill}, optional {skill}, min_years double, budget {budget}, preferences map<string,string>")
    have = spark.createDataFrame([(10, [], 2.0, None, {}), (11, [("golang", 1.0, None)], 2.0, None, {})], f"id long, skills {skill}, years double, budget {budget}, preferences map<string,string>")
    plain = recommend.recommend(hits, 3, 2).collect()
    assert [(r.doc_id, r.score) for r in plain] == [(10, 0.9), (11, 0.8)]
    best = recommend.recommend(hits, 3, 5, requirements=need, profiles=have)
    assert [(r.doc_id, round(r.score, 6)) for r in best.orderBy("rank").collect()] == [(11, 0.92), (10, 0.66)]
    item = recommend.items(best).filter("rank = 1").first()
    assert item.id == 11 and item.components.skills == 1.0 and item.components.keyword is None and item.section_components == {}
    words = spark.createDataFrame([(1, 10, 9.0), (1, 12, 1.0)], "query_id long, doc_id long, score double")
    fused = {r.doc_id: (r.score, r.keyword) for r in recommend.recommend(hits, 3, 5, keyword=words).collect()}
    assert fused[10] == (1.0, 9.0) and fused[11][1] is None


def test_explanations_fall_back(spark):
    pairs = spark.createDataFrame([(1, "good", "needs go", "knows go"), (2, "bad", "x", "y"), (3, "fail", "x", "y"), (4, "none", "x", "y")], "id long, prompt string, job string, cv string")

    def ask(prompt):
        if prompt == "fail":
            raise TimeoutError
        return {"good": '```json\n{"summary": "fits", "claims": [{"statement": "go", "verdict": "hit", "evidence": "knows go", "source": "cv", "confidence": "0.8"}]}\n```', "bad": "no json", "none": '{"claims": []}'}[prompt]

    got = {r.id: r.explanation for r in recommend.explained(pairs, ask).collect()}
    assert got[1].ready and got[1].summary == "fits" and got[1].claims[0].verdict == "hit"
    assert [got[i].fallback_reason for i in (2, 3, 4)] == ["INVALID_OUTPUT", "TimeoutError", "NO_CLAIMS"] and not any(got[i].ready for i in (2, 3, 4))


def test_counterfactuals_and_grades(spark):
    s = spark.createDataFrame([(1, "summary", "Anna writes code"), (1, "skills", "code"), (2, "summary", "writes prose")], "doc_id long, section string, text string")
    embed = chunking.embedder("hash")
    q = spark.createDataFrame([(9, "summary", "code by Anna")], "doc_id long, section string, text string").select("doc_id", "section", embed(F.col("text")).alias("embedding"))
    r = robustness.counterfactual(s, q, "summary", {"Anna": "Otto"}, embed).first()
    assert r.max_change > 0 and r.mean_change == r.max_change  # document 2 does not change, and is not scored
    g = lambda *x: spark.range(1).select(robustness.grade(*[F.lit(v) for v in x]).alias("g")).first().g
    assert [g(4, 3, 0, 0, 5, 3, 0, 0), g(4, 3, 0, 0, 2, 3, 0, 0), g(4, 2, 0, 0, 0, 3, 0, 0), g(4, 1, 0, 0, 0, 0, 0, 0), g(4, 0, 0, 0, 0, 0, 15, 90), g(0, 0, 0, 0, 0, 0, 23, 100), g(4, 0, 4, 1, 0, 0, 1, 9)] == [3, 2, 2, 1, 1, 2, 0]
    flat = robustness.flat_sections(spark.createDataFrame([(1, "skills", "short"), (1, "summary", "y" * 600)], "doc_id long, section string, text string")).collect()
    assert [(r.section, len(r.text)) for r in flat] == [("summary", 500)]


def test_section_scores_equal_their_definition(spark):
    import random

    rng = random.Random(4)
    rows = [(i * 10 + j, i, n, [rng.gauss(0, 1) for _ in range(5)]) for i in range(12) for j, n in enumerate(("skills", "experience", "summary", "_full", "hobby")[: 2 + i % 4])]
    v = spark.createDataFrame(rows, "id long, doc_id long, section string, embedding array<double>")
    q = v.filter("doc_id < 3")
    pairs = matching.section_pairs(q, v)
    for pairing in ("fixed", "cross"):
        for how in ("mean", "max", "weighted"):
            want = {(r.query_id, r.doc_id): round(r.score, 9) for r in matching.aggregate(matching.components(pairs, pairing), how).collect()}
            assert {(r.query_id, r.doc_id): round(r.score, 9) for r in matching.section_scores(q, v, pairing, how).collect()} == want
            top = matching.section_scores(q, v, pairing, how, k=3)
            assert {(r.query_id, r.doc_id): round(r.score, 9) for r in ranking.ranked(top, 3).collect()}.items() <= want.items()


def test_passages_in_texts(spark):
    t = spark.createDataFrame([(1, "xabcy"), (2, "abab"), (3, None)], "doc_id long, t string")
    p = spark.createDataFrame([(7, "abc"), (8, "ab"), (9, ""), (10, "ab")], "item_id long, e string")
    assert {(r.doc_id, r.item_id) for r in evidence.holding(t, p).collect()} == {(1, 7), (1, 8), (1, 10), (2, 8), (2, 10)}
    assert evidence.holding(t, p.limit(0)).count() == 0


def test_ranks_in_two_levels(spark):
    d = spark.createDataFrame([(float(x),) for x in (5, 1, 1, 9, 9, 9, -3)], "x double")
    assert {(r.x, r.r) for r in statistics.mean_ranks(d, "x", "r").collect()} == {(-3.0, 1.0), (1.0, 2.5), (5.0, 4.0), (9.0, 6.0)}
    j = spark.createDataFrame([(i, "PENDING", 1e9 + 1800.0 * (i % 7), None) for i in range(50)], "id long, status string, created_at double, next_attempt_at double")
    got = [r.id for r in claim_order(j, 2e9).orderBy("place").collect()]
    assert got == sorted(range(50), key=lambda i: (i % 7, i))


def test_worker_runs_jobs_to_their_end(spark, tmp_path):
    index = indexing.Index(spark, str(tmp_path / "i"), chunking.embedder("hash"), "hash")
    jobs = worker.JobTable(spark, str(tmp_path / "j"))
    long = "A text that is long enough to be processed, of some sixty characters."
    ask = lambda *rows: spark.createDataFrame([(t, i, 1, x) for t, i, x in rows], "document_type string, document_id string, version int, text string")
    jobs.request(ask(("cv", "a", long), ("cv", "b", "short"), ("jd", "c", f"broken. {long}")), 100.0)
    jobs.request(ask(("cv", "a", "another")), 101.0)  # there already: nothing changes
    assert jobs.current().count() == 3

    def parse(t):
        part = F.struct(F.lit("summary").alias("name"), t.alias("text"), F.lit("").alias("heading_raw"), F.lit(0).alias("ord"))
        return F.struct(F.lit("{}").alias("payload"), F.create_map(F.lit("summary"), part).alias("sections"), F.when(t.contains("broken"), "MODEL_DOWN").alias("error"))

    w = worker.Worker(spark, jobs, index, parse, attempts=2)
    state = lambda: {r.document_id: (r.status, r.attempt_count) for r in jobs.current().collect()}
    assert w.round(200.0) == 3
    assert state() == {"a": ("READY", 1), "b": ("FAILED", 1), "c": ("PENDING", 1)} and index.vectors.count("cv") == 2
    assert w.round(200.5) == 0 and w.round(202.0) == 1 and state()["c"] == ("FAILED", 2)
    c = jobs.current().filter("document_id = 'c'").first()
    assert c.last_error.startswith("PARSING: MODEL_DOWN") and c.finished_at == 202.0
    jobs.write(jobs.current().withColumn("status", F.when(F.col("document_id") == "a", "PENDING").otherwise(F.col("status"))))
    assert w.round(300.0) == 1 and json.loads(jobs.current().filter("document_id = 'a'").first().warnings) == ["REUSED_INDEX"]
    jobs.write(jobs.current().withColumns({"status": F.lit("PROCESSING"), "updated_at": F.lit(0.0)}))
    w.requeue(1e6)
    assert state() == {"a": ("FAILED", 2), "b": ("PENDING", 1), "c": ("FAILED", 2)}


def test_settings(tmp_path):
    f = tmp_path / "c.yaml"
    f.write_text("# all\nretrieval:\n  top_k: 7  # seven\n  keyword_alpha: 0.25\nmatching:\n  section_weights:\n    skills: 1.0\n  pairing: 'fixed'\nflag: true\n")
    c = config.load(str(f), {"PAIRLOOM_RETRIEVAL__POOL_SIZE": "99", "OTHER": "x"})
    assert c["retrieval"] == {"pool_size": 99, "top_k": 7, "keyword_alpha": 0.25} and c["matching"]["pairing"] == "fixed" and c["flag"] is True
    assert c["matching"]["section_weights"]["skills"] == 1.0 and c["matching"]["section_weights"]["education"] == 0.15 and config.DEFAULTS["retrieval"]["top_k"] == 10
    o = config.database_options({"DATABASE_URL": "postgresql://u:p%40x@host:5433/db"})
    assert o["url"] == "jdbc:postgresql://host:5433/db" and (o["user"], o["password"]) == ("u", "p@x")
    with pytest.raises(KeyError):
        config.database_options({})
    with pytest.raises(ValueError):
        config.parse_yaml("- a")


def test_sections_are_split_again(spark):
    d = spark.createDataFrame([("1", "SKILLS:\nspark, sql.\nEducation\na school.")], "doc_id string, text string")
    assert {r.name for r in sections.split_sections(d).collect()} == {"skills", "education"}
