"""Operators, sources and streaming on small tables."""

from __future__ import annotations

import json
import math
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairloom.operators import acl, bm25, chunking, evaluation, jobs, matching, ranking, sections, statistics, store
from pairloom.sources import io
from pairloom.streaming import jobs as machine
from pairloom.streaming import outbox


def scores(spark, rows):
    return spark.createDataFrame(rows, "query_id string, doc_id string, score double")


def test_rank_ties_by_id(spark):
    got = ranking.ranked(scores(spark, [("q", "cv_b", 0.5), ("q", "cv_a", 0.5), ("q", "cv_c", 0.9)])).orderBy("rank").collect()
    assert [r.doc_id for r in got] == ["cv_c", "cv_a", "cv_b"]


def test_fuse(spark):
    sem = scores(spark, [("q", "a", 0.4), ("q", "b", 1.3)])
    assert {r.doc_id: r.score for r in ranking.fuse(sem, None).collect()} == {"a": 0.4, "b": 1.0}
    both = ranking.fuse(scores(spark, [("q", "a", 1.0)]), scores(spark, [("q", "b", 1.0)]))
    assert {r.doc_id: r.score for r in both.collect()} == {"a": 0.5, "b": 0.5}
    s, k = scores(spark, [("q", "a", 1.0), ("q", "b", 0.0)]), scores(spark, [("q", "a", 0.0), ("q", "b", 1.0)])
    assert {r.doc_id: r.score for r in ranking.fuse(s, k, 1.0).collect()} == {"a": 1.0, "b": 0.0}
    assert {r.doc_id: r.score for r in ranking.fuse(s, k, 0.0).collect()} == {"a": 0.0, "b": 1.0}


def test_min_max(spark):
    rows = spark.createDataFrame([("p", 0.0), ("p", 1.0), ("p", 2.0), ("q", 3.0), ("q", 3.0)], "query_id string, score double")
    assert sorted(r.v for r in rows.select(ranking.min_max("score").alias("v")).collect()) == [0, 0.5, 1, 1, 1]


def test_bm25_prefers_the_matching_document(spark):
    texts = ["java developer", "python data science", "graphic design", "marketing writer", "kubernetes deployment engineer"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts, 1)], "doc_id long, text string")
    q = spark.createDataFrame([(1, "kubernetes deployment")], "query_id long, text string")
    grid = ranking.ranked(bm25.bm25_grid(docs, q)).orderBy("rank").collect()
    assert grid[0].doc_id == 5 and len(grid) == 5 and grid[1].score == 0
    n, avgdl = 5, sum(len(t.split()) for t in texts) / 5
    idf = math.log(n - 1 + 0.5) - math.log(1.5)
    assert grid[0].score == pytest.approx(2 * idf * 2.5 / (1 + 1.5 * (0.25 + 0.75 * 3 / avgdl)))
    with pytest.raises(ValueError, match="empty"):
        bm25.bm25(docs.limit(0), q)


def test_chunks(spark):
    d = spark.createDataFrame([(1, "w1 w2 w3 w4 w5 w6"), (2, "short"), (3, ""), (4, None)], "doc_id long, text string")
    got = [(r.doc_id, r.chunk_idx, r.text) for r in chunking.chunks(d, 4, 2).orderBy("doc_id", "chunk_idx").collect()]
    assert got == [(1, 0, "w1 w2 w3 w4"), (1, 1, "w3 w4 w5 w6"), (2, 0, "short")]
    for bad in ((0, 0), (4, 4)):
        with pytest.raises(ValueError):
            chunking.chunk_count(F.lit(1), *bad)


def test_hash_embedding(spark):
    v = chunking.hash_vector("Python python data")
    assert math.isclose(sum(x * x for x in v), 1, rel_tol=1e-6) and not any(chunking.hash_vector(""))
    d = spark.createDataFrame([(1, "Python python data")], "doc_id long, text string")
    dense = d.select(chunking.hash_embed(F.col("text")).alias("v")).first().v
    sparse = {r.bucket: r.value for r in chunking.hash_buckets(d).collect()}
    assert {i: round(x, 5) for i, x in enumerate(dense) if x} == {i: round(x, 5) for i, x in sparse.items()}
    with pytest.raises(ValueError):
        chunking.embedder("unknown")


def vecs(spark, rows):
    return spark.createDataFrame(rows, "id long, doc_id string, section string, embedding array<float>")


def test_section_components_and_aggregates(spark):
    q = vecs(spark, [(1, "jd", "skills", [1.0, 0.0]), (2, "jd", "summary", [0.0, 1.0])])
    c = vecs(spark, [(3, "cv", "skills", [1.0, 0.0]), (4, "cv", "about", [0.0, 1.0]), (5, "cv", "_full", [1.0, 1.0])])
    pairs = matching.section_pairs(q, c)
    part = lambda kind: {r.query_section: round(r.sim, 6) for r in matching.components(pairs, kind).collect()}
    assert part("fixed") == {"skills": 1.0, "summary": 0.0} and part("cross") == {"skills": 1.0, "summary": 1.0}
    parts = spark.createDataFrame([("q", "d", "skills", 0.8), ("q", "d", "summary", 0.2)], "query_doc string, doc_id string, query_section string, sim double")
    value = lambda how: matching.aggregate(parts, how).first().score
    assert value("max") == 0.8 and value("mean") == pytest.approx(0.5) and value("weighted") == pytest.approx(0.68)


def test_metrics(spark):
    run = spark.createDataFrame([("q", d, r) for r, d in enumerate(("d1", "d3", "d2", "d4"), 1)], "query_id string, doc_id string, rank int")
    qrels = spark.createDataFrame([("q", "d1", 3), ("q", "d2", 2), ("q", "d3", 1), ("q", "d4", 0)], "query_id string, doc_id string, grade int")
    m = evaluation.per_query(run, qrels, 2).first()
    assert (m.precision, m.recall, m.rr, m.ap) == (0.5, 0.5, 1.0, pytest.approx(5 / 6)) and 0 < m.ndcg < 1
    perfect = evaluation.per_query(run.withColumn("doc_id", F.when(F.col("rank") == 2, "d2").when(F.col("rank") == 3, "d3").otherwise(F.col("doc_id"))), qrels).first()
    assert perfect.ndcg == pytest.approx(1.0) and perfect.precision == pytest.approx(0.2)


def test_statistics(spark):
    d = spark.createDataFrame([(1.0, 2.0), (2.0, 4.0), (3.0, 3.0), (4.0, 9.0)], "a double, b double")
    assert statistics.spearman(d, "a", "b").first().rho == pytest.approx(0.8)
    w = statistics.wilcoxon(d, "b", "a").first()
    assert (w.n, w.w_plus, w.w_minus, w.w) == (3, 6.0, 0.0, 0.0)
    t = statistics.paired_t(d, "b", "a").first()
    assert t.t == pytest.approx(2.0 / (math.sqrt(14 / 3) / 2), rel=1e-6)
    p = d.limit(1).select(statistics.t_p_value(F.lit(2.776445), F.lit(4.0)).alias("p")).first().p
    assert p == pytest.approx(0.05, abs=1e-5)
    tests = spark.createDataFrame([("a", 0.03), ("b", 0.01), ("c", 0.04)], "name string, p double")
    assert {r.name for r in statistics.holm(tests).filter("significant").collect()} == {"b"}
    assert {r.name for r in statistics.holm(tests, step_down=False).filter("significant").collect()} == {"b", "c"}


def test_sections(spark):
    d = spark.createDataFrame([(1, "Hello there.\nSKILLS\npython, sql\nOther Stuff\nyes.\nSkills:\nmore.\nEducation")], "doc_id long, text string")
    got = [(r.ord, r.name, r.text) for r in sections.split_sections(d).orderBy("ord").collect()]
    assert got == [(0, "preamble", "Hello there."), (1, "skills", "python, sql"), (2, "other_stuff", "yes."), (3, "skills_2", "more."), (4, "education", "")]


def test_access(spark):
    rows = [("a", "cv", "READY", "public", "u1", None), ("b", "cv", "READY", "private", "u9", None), ("c", "jd", "PROCESSING", "public", "u1", None), ("d", "jd", "READY", "unlisted", "u1", None), ("e", "cv", "READY", "public", "u1", "2024-01-01"), ("f", "zz", "READY", "public", "u1", None), ("g", "cv", "READY", "odd", "u1", None)]
    t = spark.createDataFrame(rows, "doc_id string, doc_type string, status string, visibility string, owner_id string, deleted_at string")
    ids = lambda **c: sorted(r.doc_id for r in acl.permitted(t, **c).collect())
    assert ids() == ["a", "g"] and ids(user="u9") == ["a", "b", "g"] and ids(roles=("recruiter",)) == ["a", "d", "g"] and ids(admin=True) == ["a", "b", "d", "g"]
    assert ids(require_ready=False) == ["a", "c", "g"]
    assert [r.doc_id for r in acl.public(t).orderBy("doc_id").collect()] == ["a", "f"]
    assert acl.access_where() is None


def test_ids(spark):
    d = spark.createDataFrame([("cv_1",), ("jd_22",), ("xx_1",), ("cv_1x",)], "doc_id string")
    assert [(r.doc_type, r.number) for r in acl.parsed_ids(d).orderBy("doc_id").collect()] == [("cv", 1), ("jd", 22)]
    v = spark.createDataFrame([("cv:123:v1:skills",), ("jd:9:v42:_full",), ("bad",)], "v string").select(acl.parsed_vector_id(F.col("v")).alias("p")).collect()
    assert [(r.p and tuple(r.p)) for r in v] == [("cv", "123", 1, "skills"), ("jd", "9", 42, "_full"), None]


def vector_rows(spark, rows):
    return spark.createDataFrame(rows, "doc_type string, doc_id string, version int, section string")


def test_store(spark):
    old = vector_rows(spark, [("cv", "a", 1, "skills"), ("cv", "a", 2, "x"), ("cv", "a", 9, "y"), ("cv", "b", 1, "skills")])
    new = vector_rows(spark, [("cv", "a", 2, "skills")])
    assert sorted(map(tuple, store.upsert(old, new).collect())) == [("cv", "a", 2, "skills"), ("cv", "a", 9, "y"), ("cv", "b", 1, "skills")]
    s = store.upsert_stats(old, new).first()
    assert (s.upserted, s.stale, s.leftover) == (1, 1, 1)
    gone = spark.createDataFrame([("cv", "a", 9), ("cv", "b", None)], "doc_type string, doc_id string, version int")
    assert sorted(r.version for r in store.delete(old, gone).collect()) == [1, 2]
    src = spark.createDataFrame([("cv", "a"), ("jd", "n")], "doc_type string, doc_id string")
    assert {(r.doc_id, r.action, r.version) for r in store.reconcile(src, old).collect()} == {("a", "refreshed", 10), ("n", "missing", 1), ("b", "orphan", 1)}


def test_job_batch_views(spark):
    rows = [("a", "READY", 10.0, 10.0, 1, None, 100), ("b", "FAILED", 11.0, 11.0, 3, None, None), ("c", "PENDING", 5.0, 5.0, 0, 999.0, None), ("d", "PENDING", 6.0, 6.0, 0, None, None), ("e", "PROCESSING", 1.0, 1.0, 3, None, None), ("f", "PROCESSING", 1.0, 1.0, 1, None, None)]
    t = spark.createDataFrame(rows, "id string, status string, created_at double, updated_at double, attempt_count int, next_attempt_at double, duration_ms long")
    assert {r.status: r.jobs for r in jobs.count_by_status(t).collect()} == {"PENDING": 2, "PROCESSING": 2, "READY": 1, "FAILED": 1, "CANCELLED": 0}
    assert [r.id for r in jobs.claim_order(t, 500.0).collect()] == ["d"]
    assert {r.id: r.new_status for r in jobs.requeue_stale(t, 1000.0).filter("status = 'PROCESSING'").collect()} == {"e": "FAILED", "f": "PENDING"}
    d = jobs.durations(t).first()
    assert (d.p50, d.p95, d.avg) == (100, 100, 100.0)


def test_state_machine():
    at = lambda kind, t=0.0, **x: {"kind": kind, "at": t, **x}
    s = machine.step(None, at("create", 1))
    assert machine.step(None, at("claim")) is None and s[0] == "PENDING"
    s = machine.step(s, at("claim", 2))
    assert s[:3] == ("PROCESSING", "EXTRACTING", 1)
    again = machine.step(s, at("error", 3))
    assert again[0] == "PENDING" and again[3] == 4.0 and machine.step(again, at("claim", 3.5)) is again
    assert machine.step(s, at("error", 3, error="CV_TEXT_EMPTY"))[0] == "FAILED"
    ready = machine.step(s, at("ready", 5))
    assert ready[0] == "READY" and machine.step(ready, at("create", 6)) is ready
    assert machine.step(machine.step(s, at("error", 3, error="CV_TEXT_EMPTY")), at("retry", 9))[:3] == ("PENDING", "QUEUED", 0)
    assert machine.step(machine.step(None, at("create")), at("cancel"))[0] == "CANCELLED"


def test_outbox(spark):
    rows = [(1, "e1", "cv", "a", "upsert", 1), (2, "e2", "cv", "a", "delete", 1), (3, "e3", "zz", "b", "upsert", 1), (4, "e4", "jd", "c", "upsert", 2000)]
    log = spark.createDataFrame(rows, "line_no long, event_id string, doc_type string, doc_id string, action string, version int")
    assert [r.event_id for r in outbox.since(log, 1, 2).collect()] == ["e2", "e3"]
    assert {r.doc_id: r.action for r in outbox.compacted(log).collect()}["a"] == "delete"
    assert [r.event_id for r in log.filter(outbox.valid()).collect()] == ["e1", "e2"]


def write(path, rows):
    path.write_text("".join(json.dumps(r) + "\n" for r in rows))
    return str(path)


def test_sources_and_guards(spark, tmp_path):
    doc = {"doc_id": "a", "doc_type": "cv", "lang": "en", "raw_text": "x", "sections": {}, "schema_version": "1.0.0"}
    assert io.read_documents(spark, write(tmp_path / "ok.jsonl", [doc])).count() == 1
    for name, rows, reader in (
        ("dup", [doc, doc], io.read_documents), ("type", [doc | {"doc_type": "email"}], io.read_documents), ("label", [{"cv_id": "a", "jd_id": "b", "label": 4}], io.read_pairs),
        ("length", [{"jd_id": "j", "cv_ids": ["a"], "relevance": []}], io.read_queries),
    ):
        with pytest.raises(Exception, match="duplicate|doc_type|label|length"):
            reader(spark, write(tmp_path / f"{name}.jsonl", rows)).collect()
    (tmp_path / "bad.jsonl").write_text("{nope\n")
    with pytest.raises(Exception):
        io.read_documents(spark, str(tmp_path / "bad.jsonl")).collect()


def test_text_folder_and_uploads(spark, tmp_path):
    folder = tmp_path / "docs"
    folder.mkdir()
    (folder / "a.txt").write_text("hello")
    (folder / "b.md").write_text("# hi")
    (folder / "ignore.pdf").write_bytes(b"%PDF-1.4")
    assert [r.doc_id for r in io.read_text_dir(spark, str(folder)).orderBy("doc_id").collect()] == ["a", "b"]
    with zipfile.ZipFile(folder / "c.docx", "w") as z:
        z.writestr("word/document.xml", "<w:p><w:t>para one</w:t></w:p><w:p><w:t>two</w:t></w:p>")
    kinds = {r.path.rsplit("/", 1)[1]: (r.kind, r.text) for r in io.read_uploads(spark, str(folder)).collect()}
    assert kinds["ignore.pdf"] == ("pdf", None) and kinds["c.docx"] == ("docx", "para one\ntwo") and kinds["a.txt"] == ("text", "hello")
    (folder / "a.md").write_text("again")
    with pytest.raises(Exception, match="duplicate stem"):
        io.read_text_dir(spark, str(folder)).collect()


def test_queries_grid_and_reports(spark, tmp_path):
    cvs, jds = spark.createDataFrame([("c1",), ("c2",)], "cv_id string"), spark.createDataFrame([("j",)], "jd_id string")
    q = io.build_queries(spark.createDataFrame([("c1", "j", 2)], "cv_id string, jd_id string, label int"), cvs, jds).first()
    assert (q.cv_ids, q.relevance) == (["c1", "c2"], [2, -1])
    t = spark.createDataFrame([("a_b", 1)], "name string, n int")
    assert io.markdown(t) == "| name | n |\n|---|---|\n| a_b | 1 |\n" and r"a\_b & 1 \\" in io.latex(t)
    io.append_results(t, str(tmp_path / "out"), ["name"])
    io.append_results(t.unionByName(spark.createDataFrame([("c", 2)], "name string, n int")), str(tmp_path / "out"), ["name"])
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_snapshot_store(spark, tmp_path):
    from pairloom.schemas import VECTOR

    s = store.SnapshotStore(spark, str(tmp_path / "vectors"))
    assert s.current().count() == 0
    row = ("cv:a:v1:skills", "cv", "a", 1, "skills", [1.0], "t", "READY", "public", "", "en", "hash", "h")
    assert s.upsert(spark.createDataFrame([row], VECTOR)) == 1 and s.count("cv") == 1 and s.point_read("cv", "a", 1).count() == 1
    s.delete(spark.createDataFrame([("cv", "a", None)], "doc_type string, doc_id string, version int"))
    assert s.count("cv") == 0 and s.versions() == [1, 2]


def test_streams_take_the_whole_log(spark):
    from pairloom.plans import logs

    sf = "/root/testdata/sf0.01"
    e = spark.read.parquet(f"{sf}/events.parquet").orderBy("event_id").collect()
    last = {r.user_id: r.event_type for r in e}
    want = {("cv" if u % 2 == 0 else "jd", f"{'cv' if u % 2 == 0 else 'jd'}_{u}") for u, t in last.items() if t != "error"}
    assert {(r.doc_type, r.doc_id) for r in logs.stream_outbox_apply(spark, sf).collect()} == want
    states = {}
    for r in e:
        command = {"kind": logs.COMMANDS[r.event_type], "at": r.ts.timestamp(), "error": None, "step": "PARSING", "hash": None}
        states[str(r.user_id)] = machine.step(states.get(str(r.user_id)), command)
    want = {k: (s[0], s[2]) for k, s in states.items() if s is not None}
    assert {r.key: (r.status, r.attempts) for r in logs.stream_job_state(spark, sf).collect()} == want


@pytest.mark.parametrize("cells", [1, 40])
def test_matrices_of_a_task_are_bounded(spark, monkeypatch, cells):
    """Queries a few at a time, sections of different number, give what all at once give."""
    rng = np.random.default_rng(3)
    rows = [(i // 3, "abc"[i % 3], rng.normal(size=4).tolist()) for i in range(90) if i % 7]
    v = spark.createDataFrame(rows, "doc_id long, section string, embedding array<double>")
    flat = v.select((F.col("doc_id") * 3 + F.ascii("section")).alias("id"), "embedding")
    make = lambda: [matching.section_scores(v.filter("doc_id % 2 = 0"), v, p, h, k) for p, h, k in (("cross", "mean", 3), ("fixed", "weighted", None), ("cross", "max", 3))] + [matching.similarities(flat.filter("id % 2 = 0"), flat, k) for k in (None, 3)]
    told = lambda dfs: [sorted((r[0], r[1], round(r[2], 9)) for r in d.collect()) for d in dfs]
    want = told(make())
    monkeypatch.setattr(matching, "CELLS", cells)
    assert told(make()) == want


@pytest.mark.parametrize(("block", "held", "cells"), [(20_000, 24_000_000, 4_000_000), (7, 1300, 900), (20_000, 1000, 4_000_000)])
def test_all_candidates_are_ranked_without_shuffling_pairs(spark, monkeypatch, block, held, cells):
    monkeypatch.setattr(matching, "QUERY_BLOCK", block)
    monkeypatch.setattr(matching, "HELD", held)
    monkeypatch.setattr(matching, "CELLS", cells)
    r = np.random.default_rng(4)
    rows = r.integers(-2, 3, (300, 4)).astype(float)  # many ties, vectors without length
    rows[7, 1] = np.nan
    ids = r.permutation(300) * 5
    v = spark.createDataFrame([(int(i), x.tolist()) for i, x in zip(ids, rows, strict=True)], "id long, embedding array<float>").repartition(5)
    got = matching.all_ranked(v.filter("id % 100 = 0"), v)
    tree = got._jdf.queryExecution().executedPlan().toString()
    assert (held < 4 * 300) == ("Window" in tree) == ("Exchange hashpartitioning(query_id" in tree)  # one query's pairs too many for a task
    scores = matching.similarities(v.filter("id % 100 = 0"), v).filter("query_id <> cand_id")
    want = ranking.ranked(scores.select("query_id", F.col("cand_id").alias("doc_id"), F.round("sim", 6).alias("score")))
    key = lambda d: sorted((x.query_id, x["rank"], x.doc_id, str(x.score)) for x in d.collect())
    assert key(got) == key(want) and got.count() == 15 * 299 and got.schema.simpleString() == want.schema.simpleString()
    assert held < 4 * 300 or matching.all_ranked(v.filter("id < 0"), v).count() == matching.all_ranked(v, v.filter("id < 0")).count() == 0


def test_vectors_are_ranked_without_a_window(spark, sf):
    from pairloom.plans import catalogue

    assert "Window" not in catalogue.QUERIES["single_vector_rank"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
