"""Column functions against hand-computed values."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from pairloom.functions import dates, hybrid, payload, text, vectors

SKILLS = "array<struct<name:string,weight:double,level:int>>"


def one(spark, schema, row, col):
    return spark.createDataFrame([row], schema).select(col.alias("v")).first().v


def many(spark, values, fn, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.o for r in rows.select("i", fn(F.col("v")).alias("o")).orderBy("i").collect()]


def test_skills_are_normalised(spark):
    assert many(spark, ["ReactJS", "  Node.JS ", "Javascript", "Lập trình  web", None], hybrid.normalize_skill) == ["react", "node.js", "js", "web development", ""]


def test_skill_match(spark):
    pairs = [("react", "react", True), ("học máy", "hoc may", True), ("spring", "spring boot", True), ("java", "javascript", False), ("", "x", False), ("ci-cd", "ci", True)]
    got = spark.createDataFrame(pairs, "a string, b string, want boolean").select("want", hybrid.skill_match(F.col("a"), F.col("b")).alias("got")).collect()
    assert all(r.want == r.got for r in got)


def skill_list(*names):
    return [(n, 1.0, None) for n in names]


@pytest.mark.parametrize(("have", "required", "optional", "want"), [
    (("react", "node.js"), ("ReactJS", "Node"), (), 1.0), ((), ("react",), (), 0.0), (("react",), ("react", "vue"), (), 0.5), (("x",), (), (), 1.0),
    (("go",), (), ("golang", "rust"), 0.5), (("react",), ("react",), ("vue",), 0.8), (("react",), ("react", "reactjs"), (), 0.5),
])
def test_skills_score(spark, have, required, optional, want):
    row = (skill_list(*have), skill_list(*required), skill_list(*optional))
    assert one(spark, f"s {SKILLS}, r {SKILLS}, o {SKILLS}", row, hybrid.skills_score(F.col("s"), F.col("r"), F.col("o"))) == pytest.approx(want)


def test_experience_and_budget_scores(spark):
    rows = [(3.0, 3.0, 1.0), (1.5, 3.0, 0.5), (None, 3.0, 0.0), (1.0, None, 1.0), (9.0, 3.0, 1.0), (1.0, 0.0, 1.0)]
    assert all(r.w == r.g for r in spark.createDataFrame(rows, "y double, n double, w double").select("w", hybrid.experience_score(F.col("y"), F.col("n")).alias("g")).collect())
    rows = [(100.0, 200.0, 120.0, 180.0, 0.6), (None, None, 1.0, 2.0, 1.0), (100.0, 200.0, 1000.0, 2000.0, 0.0), (100.0, 100.0, 50.0, 150.0, 1.0)]
    got = spark.createDataFrame(rows, "a double, b double, c double, d double, w double").select("w", hybrid.budget_score(*map(F.col, "abcd")).alias("g")).collect()
    assert [r.g for r in got] == pytest.approx([r.w for r in got])


def test_preferences_score(spark):
    rows = [({"a": "X", "b": "y"}, {"a": "x", "b": "Y"}, 1.0), ({"a": "x", "b": "y"}, {"a": "x"}, 0.5), ({"a": "x"}, {}, 0.0), ({}, {"a": "x"}, 1.0), ({"a": "*"}, {"a": "q"}, 1.0), (None, None, 1.0)]
    got = spark.createDataFrame(rows, "w map<string,string>, o map<string,string>, want double").select("want", hybrid.preferences_score(F.col("w"), F.col("o")).alias("g")).collect()
    assert all(r.want == r.g for r in got)


def test_hybrid_score_clamps_and_scales(spark):
    parts = {k: F.col(k) for k in hybrid.WEIGHTS}
    schema = ", ".join(f"{k} double" for k in hybrid.WEIGHTS)
    assert one(spark, schema, (1.7, 1.0, 1.0, 1.0, 1.0), hybrid.hybrid_score(parts)) == pytest.approx(1.0)
    assert one(spark, schema, (-0.3, 0.0, 0.0, 0.0, 0.0), hybrid.hybrid_score(parts)) == 0
    assert one(spark, schema, (0.5, 0.0, 0.0, 0.0, 0.0), hybrid.hybrid_score(parts, {"semantic": 2.0, "skills": 2.0})) == pytest.approx(0.25)


def test_document_bridge(spark):
    assert many(spark, ["React, Node.js; react"], hybrid.skill_list) == [["react", "node.js"]]
    assert many(spark, ["5 năm kinh nghiệm", "toi thieu 2 nam", "3 yrs or 7 years", "none"], hybrid.years_in) == [5.0, 2.0, 7.0, None]


def test_headings(spark):
    names = {"Kỹ năng": "skills", "SKILLS:": "skills", "Work History": "experience", "Học vấn": "education", "About me": "summary", "Random": None, "technical skills": "skills", "": None}
    assert many(spark, list(names), text.heading_name) == list(names.values())
    lines = {"SKILLS:": True, "Work Done": True, "a sentence that goes on.": False, "ALL CAPS LINE": True, "Version 2 Notes": False, "lower case": False, "x" * 61: False, "One Two Three Four Five Six Seven Eight Nine": False}
    assert many(spark, list(lines), text.is_heading) == list(lines.values())
    assert many(spark, ["Dự án: ", "My Projects:", "…"], text.slug) == ["d_n", "my_projects", "other"]


def test_languages(spark):
    assert many(spark, ["plain English", "Kinh nghiệm làm việc với Python", "a long English sentence with one accent only here: đ" + " word" * 40, ""], text.detect_lang) == ["en", "vi", "mixed", "en"]
    got = many(spark, ["the software engineer and the team", "kinh nghiệm lập trình của người", "kinh nghiệm của software engineer", ""], text.language_shares)
    assert [r.label for r in got] == ["en", "vi", "code_mixed", "en"]


def test_clean_and_merge(spark):
    got = many(spark, ["•  first item​\nPage 3\n\n\n\nnext   line \x01\fend", None, "ﬁne"], text.clean_text)
    assert got == ["- first item\n\nnext line\nend", "", "fine"]
    assert many(spark, ["a line\nthat goes on\nNew one.\nstays", "x\n\ny"], text.merge_broken_lines) == ["a line that goes on\nNew one.\nstays", "x\n\ny"]
    assert many(spark, [[], [0, 0], [50, 40], [500, 600], [900, 0, 0, 0]], text.looks_scanned, "array<bigint>") == [False, True, True, False, True]


def test_accents_and_tokens(spark):
    assert many(spark, ["Đường Nguyễn", None], text.strip_accents) == ["Duong Nguyen", None]
    assert many(spark, ["Học-máy, C++ x_y", None], text.lexical_tokens) == [["học", "máy", "c", "x_y"], []]
    assert many(spark, ["é"], text.normalize) == ["é"]


def test_salvaged_json(spark):
    assert many(spark, ['```json\n{"a": 1}\n```', 'Sure: {"a": 2} done', "none"], text.salvaged_json) == ['{"a": 1}', '{"a": 2}', None]


def test_dates(spark):
    values = ["2022-03", "03/2022", "Mar 2022", "Tháng 3/2022", "2022", "13/2022", None, "2022/3", "since 1999"]
    assert many(spark, values, dates.normalize_date) == ["2022-03", "2022-03", "2022-03", "2022-03", "2022", None, None, "2022-03", "1999"]
    assert many(spark, ["Present", "now", "2020", None], dates.is_current) == [True, True, False, False]
    items = [("2020-01", "2022-01", False), ("2022-06", None, True)]
    kind = "x array<struct<start_date:string,end_date:string,is_current:boolean>>"
    assert one(spark, kind, (items,), dates.experience_years(F.col("x"), "2024-06")) == 4.0
    assert one(spark, kind, ([],), dates.experience_years(F.col("x"), "2024-06")) is None
    assert one(spark, kind, ([("2021-01", "2024-01", False)],), dates.experience_years(F.col("x"), "2024-06")) == 3.0


def test_payload_functions(spark):
    kind = "x array<struct<name:string,weight:string,level:string>>"
    got = one(spark, kind, ([("a", "2", "9"), (" ", "1", "1"), ("b", "-1", "11")],), payload.skill_items(F.col("x")))
    assert [(r.name, r.weight, r.level) for r in got] == [("a", 2.0, 9), ("b", 1.0, None)]
    assert many(spark, ["0.5", "7", "x", None], payload.confidence) == [0.5, 1.0, None, None]
    assert one(spark, "x array<struct<n:string>>", ([("A",), ("a ",), ("b",)],), F.transform(payload.first_wins(F.col("x"), lambda s: s["n"]), lambda s: s["n"])) == ["A", "b"]
    assert one(spark, "t string, e string", ("Built a  Data\nPipeline", "data pipeline"), payload.evidenced(F.col("t"), F.col("e"))) is True
    exp = one(spark, "x array<struct<title:string,company:string,description:string>>", ([("Dev", "Acme", "did things"), (None, "Solo", " "), (None, None, None)],), payload.experience_text(F.col("x")))
    assert exp == "Dev at Acme, did things\nSolo"


def test_claims_are_grounded(spark):
    claims = [("c1", "hit", "Python expert", "cv", "0.9"), ("c2", "hit", "Rust", "cv", "2"), ("c3", "maybe", "Python", None, None), ("c4", "missing", "needs SQL", None, "x"), (" ", "hit", "a", "cv", "1")]
    got = one(spark, f"c {payload.CLAIM}, j string, v string", (claims, "The job needs  SQL", "a python  expert"), payload.grounded_claims(F.col("c"), F.col("j"), F.col("v")))
    assert [(r.verdict, r.evidence, r.source, r.confidence) for r in got] == [("hit", "Python expert", "cv", 0.9), ("unknown", None, None, 1.0), ("unknown", None, None, None), ("missing", "needs SQL", "job", None)]
    reranked = one(spark, "r array<struct<id:string,score:string>>, e array<string>", ([("a", "120"), ("ghost", "1"), ("b", None)], ["a", "b"]), payload.rerank_results(F.col("r"), F.col("e")))
    assert [(r.id, r.score, r.ready) for r in reranked] == [("a", 100, True), ("b", None, False)]


def test_vectors(spark):
    assert one(spark, "a array<float>, b array<float>", ([1.0, 0.0], [1.0, 1.0]), vectors.cosine(F.col("a"), F.col("b"))) == pytest.approx(0.5**0.5)
    assert one(spark, "a array<float>, b array<float>", ([0.0, 0.0], [1.0, 1.0]), vectors.cosine(F.col("a"), F.col("b"))) == 0
    assert many(spark, [-0.5, 0.5, 1.5], vectors.clamp01, "double") == [0, 0.5, 1]


def test_claims_meet_texts_whatever_their_case(spark):
    """Letters whose upper case is longer (ß), that have two lower cases (sigma) or whose lower case is longer (dotted I)."""
    claims = [("c1", "hit", "SCHPFSS ", "either", "1"), ("c2", "hit", "ΣΟΦΟΣ", "cv", "1"), ("c3", "hit", "i\u0307zmir", "cv", "1")]
    got = one(spark, f"c {payload.CLAIM}, j string, v string", (claims, "a job", "Schpfß enung, σοφοσα, \u0130ZMIR"), payload.grounded_claims(F.col("c"), F.col("j"), F.col("v")))
    assert [(r.verdict, r.source) for r in got] == [("hit", "cv")] * 3
