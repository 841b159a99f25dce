"""Structured scores over many pairs: how many rows the plans make, and that the results are whole."""

from __future__ import annotations

import itertools

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from pairloom.functions import hybrid
from pairloom.functions.vectors import rounded
from pairloom.operators import recommend, robustness, staging, structured
from pairloom.operators.ranking import ranked, ranked_near
from pairloom.plans import catalogue, hybrids


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_suppliers_of_equal_brands_are_one_set(spark, sf):
    want = hybrids.wants(spark, sf)
    held, sets = hybrids.ranges(spark, sf)
    brands = {r.doc_id: tuple(r.brands) for r in held.collect()}
    assert {r.set: set() for r in held.collect()}.keys() == {min(d for d in brands if brands[d] == b) for b in set(brands.values())}
    assert hybrids.coverages(want, sets).count() <= want.select("query_id").distinct().count() * len(set(brands.values()))


def test_names_are_normalised_outside_of_lambdas_that_look_for_them(spark):
    rows = spark.createDataFrame([(["ReactJS", "Go"], ["react", "rust", "react"]), (None, ["a"])], "have array<string>, want array<string>")
    df = rows.select(recommend.template(F.col("have"), F.col("want")).alias("t"))
    assert plan(df).count("regexp_replace") <= 8  # four a name, both lists
    assert [(r.t.summary, [c.verdict for c in r.t.claims]) for r in df.collect()] == [("1 of 2 wanted skills", ["hit", "missing"]), ("0 of 1 wanted skills", ["missing"])]


def test_grades_count_alike_suppliers_together(spark, sf):
    want, (_, sets) = hybrids.wants(spark, sf), hybrids.ranges(spark, sf)
    assert hybrids.shared(want, sets).count() == want.join(sets, "brand").count() < want.join(hybrids.offers(spark, sf), "brand").count()


@pytest.mark.parametrize("name", ["budget_overlap", "experience_score"])
def test_rows_of_a_small_file_are_dealt_over_tasks(spark, sf, monkeypatch, name):
    monkeypatch.setattr(staging, "PAIRS", 5)
    df = catalogue.QUERIES[name](spark, sf)
    assert df.rdd.getNumPartitions() > 1
    assert df.count() == spark.read.parquet(f"{sf}/supplier.parquet").count() * spark.read.parquet(f"{sf}/customer.parquet").filter("c_custkey % 100 = 0").count()


def test_equal_wants_and_offers_are_scored_once(spark):
    asked = spark.createDataFrame([(i, (None if i % 2 else "1", "a")) for i in range(20)], "query_id long, want struct<place:string,segment:string>")
    offered = spark.createDataFrame([(i, ("*", None if i % 3 else "A")) for i in range(30)], "doc_id long, offer struct<place:string,segment:string>")
    got = hybrids.preferences(asked, offered)
    assert {(r.query_id, r.doc_id): r.preferences for r in got.collect()} == {(q, d): (0.5 if d % 3 else 1.0) for q in range(20) for d in range(30)}
    assert "map_entries" not in plan(got)


def test_components_of_a_pair_are_one_row_and_not_joined(spark, sf):
    assert plan(hybrids.parts(spark, sf)).count("Join ") == 1


def test_best_by_marks_equal_the_best_of_all(spark):
    rows = spark.range(4000).select((F.col("id") % 3).alias("query_id"), F.col("id").alias("doc_id"), F.when(F.col("id") % 7 != 0, (F.hash("id") % 50) / 300.0).alias("score"))
    few = spark.createDataFrame([(9, 1, 0.5), (9, 2, None)], "query_id long, doc_id long, score double")  # fewer than k
    rows = rows.unionByName(few)
    want = ranked(rows.withColumn("score", F.round("score", 2)), 10)
    key = lambda d: sorted((r.query_id, r["rank"], r.doc_id, r.score) for r in d.collect())
    for share in (1, 4, 100000):
        assert key(ranked_near(rows, 10, 2, share)) == key(want)


@pytest.fixture(scope="module")
def many_sets(spark, sf, tmp_path_factory):
    """The small tables with a brand for every part, so that each supplier's set of brands is another one."""
    folder = tmp_path_factory.mktemp("many_sets")
    for name in ("customer", "supplier", "orders", "lineitem"):
        spark.read.parquet(f"{sf}/{name}.parquet").write.parquet(f"{folder}/{name}.parquet")
    spark.read.parquet(f"{sf}/part.parquet").withColumn("p_brand", F.concat(F.lit("b"), F.col("p_partkey") % 150)).write.parquet(f"{folder}/part.parquet")
    return str(folder)


def small_tiles(monkeypatch):
    monkeypatch.setattr(structured, "TILE", 64)
    monkeypatch.setattr(structured, "CELLS", 2000)


def test_budgets_of_arrays_equal_the_columns(spark):
    ends = [None, 0.0, 1.0, 2.5, 7.0]
    rows = list(itertools.product(ends, repeat=4))
    want = spark.createDataFrame(rows, "a double, b double, c double, d double").select("*", hybrid.budget_score(*[F.col(c) for c in "abcd"]).alias("s")).collect()
    got = structured.budget_scores(*np.array([[np.nan if x is None else x for x in r[:4]] for r in want]).T)
    assert got.tolist() == [r.s for r in want]


def test_ablation_joins_no_pairs_when_all_sets_differ(spark, many_sets, monkeypatch):
    small_tiles(monkeypatch)
    p = hybrids.parts(spark, many_sets)
    df = catalogue.QUERIES["ablation_weights"](spark, many_sets)
    assert "Join" not in plan(df)
    c = ("semantic", "skills", "experience", "budget", "preferences")
    scores = [F.avg(F.round(sum((F.lit(x / sum(w)) * F.col(n) for n, x in zip(c, w, strict=True)), F.lit(0.0)), 6)).alias(k) for k, w in hybrids.ABLATIONS.items()]
    want = {r.query_id: r for r in p.groupBy("query_id").agg(F.count("*").alias("pairs"), *scores).collect()}
    got = df.collect()
    assert len(got) == len(want) * len(hybrids.ABLATIONS) > 0
    assert all(r.pairs == want[r.query_id].pairs and r.mean_score == pytest.approx(want[r.query_id][r.config], abs=2e-9) for r in got)


def same_ten(spark, df, pairs):
    score = F.floor(hybrid.hybrid_score({k: F.col(k) for k in hybrid.WEIGHTS}) * 1e5 + 0.5) / 1e5
    want = ranked(pairs.select("query_id", "doc_id", score.alias("score")), 10)
    key = lambda d: sorted((r.query_id, r["rank"], r.doc_id, r.score) for r in d.select("query_id", "rank", "doc_id", "score").collect())
    assert key(df) == key(want) != []


def test_ten_best_when_all_sets_differ(spark, many_sets, monkeypatch):
    small_tiles(monkeypatch)
    df = catalogue.QUERIES["hybrid_score"](spark, many_sets)
    assert "Join" not in plan(df)
    same_ten(spark, df, hybrids.parts(spark, many_sets))


def test_recommended_when_all_sets_differ(spark, many_sets, monkeypatch):
    small_tiles(monkeypatch)
    df = catalogue.QUERIES["recommend"](spark, many_sets)
    assert "Join" not in plan(df)
    same_ten(spark, df, hybrids.parts(spark, many_sets).filter("doc_id % 10 <> 0 and (doc_id % 4 <> 0 or doc_id % 7 = query_id % 7)"))


def test_grades_meet_no_brands_in_a_join(spark, many_sets, monkeypatch):
    small_tiles(monkeypatch)
    df = catalogue.QUERIES["skill_grades"](spark, many_sets)
    assert "brand" not in plan(df)
    must, want = F.col("weight") >= 2, hybrids.wants(spark, many_sets)
    count = lambda c, name: F.sum(c.cast("int")).alias(name)
    met = want.join(hybrids.offers(spark, many_sets), "brand").groupBy("query_id", "doc_id").agg(count(must, "hit"), count(~must, "opt_hit"))
    years = spark.read.parquet(f"{many_sets}/supplier.parquet").selectExpr("s_suppkey as doc_id", "s_nationkey % 9 as years")
    need = spark.read.parquet(f"{many_sets}/customer.parquet").selectExpr("c_custkey as query_id", "c_nationkey % 7 as need")
    g = robustness.grade(*[F.col(c) for c in ("req", "hit", "opt", "opt_hit", "years", "need")], F.lit(0), F.lit(0)).alias("grade")
    each = met.join(want.groupBy("query_id").agg(count(must, "req"), count(~must, "opt")), "query_id").join(years, "doc_id").join(need, "query_id").select("query_id", g)
    rows = lambda d: sorted((r.query_id, r.grade, r["documents"]) for r in d.collect())
    assert rows(df) == rows(each.groupBy("query_id", "grade").agg(F.count("*").alias("documents"))) != []


def test_rounding_is_that_of_sql_and_not_by_decimal_text(spark):
    df = spark.createDataFrame([(0.0,), (1 / 128,), (0.1234565,), (2 / 3,), (1.0,), (None,)], "x double").select(rounded(F.col("x"), 6).alias("r"))
    assert [r.r for r in df.collect()] == [0.0, 0.007813, np.floor(0.1234565 * 1e6 + 0.5) / 1e6, 0.666667, 1.0, None]


def test_budget_overlap_rounds_by_whole_numbers(spark, sf):
    assert "round(" not in plan(catalogue.QUERIES["budget_overlap"](spark, sf))


def test_experience_is_scored_for_groups_of_equal_years(spark, sf):
    groups = staging.alike(spark.range(40).select("id", (F.col("id") % 3).alias("years")), "id", "years").collect()
    assert len(groups) == 3 and sorted(x for g in groups for x in g["rows"]) == list(range(40))
    assert "explode(rows" in plan(catalogue.QUERIES["experience_score"](spark, sf))


def test_arrays_of_equal_kind_are_bounded_and_keep_null_keys(spark, monkeypatch):
    rows = spark.range(1000).select(F.when(F.col("id") > 0, F.col("id")).alias("id"), F.when(F.col("id") % 50 == 0, F.col("id") % 100).alias("kind"))
    monkeypatch.setattr(staging, "RUN", 64)
    groups = staging.alike(rows, "id", "kind").collect()
    assert max(len(g["rows"]) for g in groups) <= 64
    key = lambda pairs: sorted((-1 if i is None else i, -1 if k is None else k) for i, k in pairs)
    assert key((i, g.kind) for g in groups for i in g["rows"]) == key((r.id, r.kind) for r in rows.collect())


def test_preferences_of_equal_kinds_become_rows_last(spark, sf, tmp_path):
    t = lambda n: spark.read.parquet(f"{sf}/{n}.parquet")
    c, s = t("customer"), t("supplier")
    c.withColumn("c_custkey", F.col("c_custkey") * 10).withColumn("c_nationkey", F.when(F.col("c_custkey") % 3 != 0, F.col("c_nationkey"))).write.parquet(f"{tmp_path}/customer.parquet")
    odd = s.limit(1).withColumn("s_suppkey", F.lit(None).cast("long"))  # a supplier without a number, and one twice
    s.unionByName(odd).unionByName(s.limit(1)).write.parquet(f"{tmp_path}/supplier.parquet")
    df = catalogue.QUERIES["preferences_score"](spark, str(tmp_path))
    assert "Join" in plan(df).split("Generate", 2)[2] and "Join" not in "".join(plan(df).split("Generate", 2)[:2])
    c = duckdb.connect()
    for n in ("customer", "supplier"):
        c.execute(f"create view {n} as select * from '{tmp_path}/{n}.parquet/*.parquet'")
    key = lambda rows: sorted((q, -1 if d is None else d, x) for q, d, x in rows)
    assert key((r.query_id, r.doc_id, r.score) for r in df.collect()) == key(c.execute(f"select query_id, doc_id, score from ({catalogue.ORACLE_SQL['preferences_score']})").fetchall()) != []


def test_preferences_of_every_customer_are_scored(spark, sf):
    c, s = (spark.read.parquet(f"{sf}/{n}.parquet") for n in ("customer", "supplier"))
    df = catalogue.QUERIES["preferences_score"](spark, sf)
    assert df.select("query_id").distinct().count() == c.count() and df.count() == c.count() * s.count()
    view = duckdb.connect()
    for n in ("customer", "supplier"):
        view.execute(f"create view {n} as select * from '{sf}/{n}.parquet'")
    assert sorted(map(tuple, df.select("query_id", "doc_id", "score").collect())) == sorted(view.execute(catalogue.ORACLE_SQL["preferences_score"]).fetchall())


def test_groups_are_dealt_over_no_more_tasks_than_there_are(spark):
    groups = staging.alike(spark.range(400).select("id", (F.col("id") % 4).alias("kind")), "id", "kind")
    assert staging.dealt_groups(groups, 10**8).rdd.getNumPartitions() == groups.count()
