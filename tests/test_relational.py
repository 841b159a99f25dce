"""Tables of a database, written there and read back in ranges, with columns and ids left to the database."""

from __future__ import annotations

import pytest

from pairloom.sources import io

URL = "jdbc:derby:memory:pairloom;create=true"
DRIVER = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}


@pytest.fixture(scope="module")
def people(spark):
    df = spark.range(500).selectExpr("id", "concat('n', id) as name", "cast(id % 7 as int) as grade")
    df.write.jdbc(URL, "people", mode="overwrite", properties=DRIVER)
    return df


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_ranges_cover_the_table(spark, people):
    t = io.read_table(spark, URL, "people", parts=4, **DRIVER)
    assert t.rdd.getNumPartitions() == 4
    sizes = t.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    assert sum(sizes) == 500 and max(sizes) <= 130
    assert sorted((r.id, r.name) for r in t.select("id", "name").collect()) == sorted((r.id, r.name) for r in people.collect())


def test_columns_filters_and_ids_go_to_the_database(spark, people):
    ids = spark.createDataFrame([(3,), (5,), (5,), (999,)], "id long")
    t = io.read_table(spark, URL, "people", ids, columns=["id", "grade"], **DRIVER).filter("grade > 2")
    assert {tuple(r) for r in t.collect()} == {(3, 3), (5, 5)}
    shown = plan(t)
    assert "PushedFilters: [" in shown and "In(id" in shown.replace("ID", "id").replace('"', "") and "name" not in shown.split("ReadSchema")[1].lower()


def test_many_ids_meet_the_table_in_spark(spark, people, monkeypatch):
    monkeypatch.setattr(io, "LISTED", 10)
    ids = spark.range(0, 500, 5).select("id")
    t = io.read_table(spark, URL, "people", ids, parts=3, **DRIVER)
    assert t.count() == 100 and "LeftSemi" in plan(t)


def test_an_empty_table_has_no_ranges(spark, people):
    people.limit(0).write.jdbc(URL, "nobody", mode="overwrite", properties=DRIVER)
    assert io.read_table(spark, URL, "nobody", parts=4, **DRIVER).count() == 0
