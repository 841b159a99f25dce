"""Cells of vectors: the same hits as the scan, with less compared."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairloom.operators import cells, matching, ranking


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [float(x) for x in v]) for i, v in rows], "id long, embedding array<float>")


def top(df, k):
    df = df.select("query_id", F.col("cand_id").alias("doc_id"), F.round("sim", 6).alias("score"))
    return {tuple(x) for x in ranking.ranked(df, k).collect()}


@pytest.mark.parametrize("clusters", [12, 0])
def test_cells_give_what_the_scan_gives(spark, tmp_path, clusters):
    r = np.random.RandomState(clusters)
    heart = r.normal(size=(max(1, clusters), 8)) * 5
    rows = [(i, heart[i % clusters] + r.normal(size=8) * 0.3 if clusters else r.normal(size=8)) for i in range(1500)]
    rows += [(2000 + i, rows[i][1]) for i in range(5)] + [(3000, np.zeros(8)), (3001, None), (3002, rows[0][1] * 7)]
    v = table(spark, rows)
    queries = table(spark, [*rows[:1500:100], (3000, np.zeros(8))])
    cells.CellIndex(spark, str(tmp_path / "i")).write(v, 24)
    found, share = cells.CellIndex(spark, str(tmp_path / "i")).search(queries, 10, slack=2e-6)
    assert top(found, 10) == top(matching.similarities(queries, v.filter("embedding is not null")), 10)
    if clusters:
        assert share < 0.35  # zero vectors ask all cells
    assert cells.CellIndex(spark, str(tmp_path / "i")).cells().agg(F.sum("n")).first()[0] == 1507


def test_empty_and_small_tables(spark, tmp_path):
    none = table(spark, [])
    index = cells.CellIndex(spark, str(tmp_path / "e")).write(none)
    assert index.search(table(spark, [(1, [1, 0])]), 3)[0].count() == 0
    few = table(spark, [(1, [1, 0]), (2, [0, 1])])
    index = cells.CellIndex(spark, str(tmp_path / "f")).write(few)
    assert top(index.search(few, 3)[0], 3) == {(1, 1, 1.0, 1), (1, 2, 0.0, 2), (2, 2, 1.0, 1), (2, 1, 0.0, 2)}
    assert index.search(none, 3)[0].count() == 0
