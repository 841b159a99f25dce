"""Containment by rarest words, and resampling whose weights a hash fixes."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairloom.functions.hybrid import skill_match
from pairloom.operators import containment, statistics


def named(spark, names):
    return spark.createDataFrame([(n,) for n in names], "name string")


def test_containment_equals_the_predicate_on_all_pairs(spark):
    r = random.Random(4)
    words = ["a", "b", "c", "d", "é", "e", "x-y", "x", "y"]
    pool = sorted({" ".join(r.choices(words, k=r.randint(1, 4))) for _ in range(120)} | {"", "-", "a a a", "É"})
    left, right = named(spark, pool[::2] + [None]), named(spark, sorted({*pool[1::2], *pool[:5]}))
    want = left.crossJoin(right.select(F.col("name").alias("b"))).filter(skill_match(F.col("name"), F.col("b"))).collect()
    got = containment.matching_skills(left, right).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(got) > 100


def test_a_word_in_every_set_is_nobodys_key(spark):
    """400 names that all hold one word meet only on what else they hold."""
    left = spark.createDataFrame([(f"l{i}", ["hot", f"w{i}", f"v{i % 50}"]) for i in range(400)], "id string, words array<string>")
    right = spark.createDataFrame([(f"r{i}", ["hot", f"w{i}"]) for i in range(400)], "id string, words array<string>")
    met = containment.candidates(left, right)
    assert met.count() <= 900  # all pairs would be 160,000
    assert {(x.a, x.b) for x in containment.containment_join(left, right).collect()} == {(f"l{i}", f"r{i}") for i in range(400)}
    assert containment.containment_join(left.limit(0), right).count() == 0


def test_resampling_by_hash_agrees_with_a_seeded_generator(spark):
    r = np.random.RandomState(1)
    rows = [(g, f"u{i}", float(v)) for g, n in (("a", 400), ("b", 60)) for i, v in enumerate(r.gamma(2.0, 1.0, n))] + [("a", "none", None), ("c", "only", 3.0), ("d", "empty", None)]
    values = spark.createDataFrame(rows, "g string, unit string, v double")
    got = {x.g: x for x in statistics.resampled_ci(values, "g", "unit", "v").collect()}
    want = {x.g: x for x in statistics.bootstrap_ci(values.filter("v is not null and g < 'c'"), "g", "v").collect()}
    for g in "ab":
        width = want[g].high - want[g].low
        assert got[g].mean == pytest.approx(want[g].mean)
        assert abs(got[g].low - want[g].low) < 0.12 * width and abs(got[g].high - want[g].high) < 0.12 * width
    assert (got["c"].low, got["c"].high) == (3.0, 3.0) and got["d"].mean is None and got["d"].low is None
    again = {x.g: x for x in statistics.resampled_ci(values.repartition(7), "g", "unit", "v").collect()}
    assert all(again[g].low == pytest.approx(got[g].low) for g in "abc")


def test_draws_are_poisson(spark):
    n = [x.n for x in spark.range(20_000).select(statistics.draws(F.col("id"), F.lit(7)).alias("n")).collect()]
    assert np.mean(n) == pytest.approx(1, abs=0.03) and np.var(n) == pytest.approx(1, abs=0.06)
