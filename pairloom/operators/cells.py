"""Exact search over vectors that are stored in cells: cells that cannot hold a hit are not read.

Vectors are stored with unit length, each in the cell of its nearest centre, with its distance from it; a cell knows its radius. By the
triangle inequality no vector of a cell is nearer to a query than the query's distance from the centre less the radius, so once a
query's k nearest in its closest cells are known, all cells beyond them are left out, and within a cell all rows whose distance
from the centre differs too much from the query's. Results are those of the scan; only the work is less, where vectors lie in clusters.

Centres come from a bounded sample (the first ``SAMPLE`` rows by a hash of the id); every row is stored. Vectors without length are in
a cell of their own, which is always read: their cosine is 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.operators.staging import BLOCK

SAMPLE, ROUNDS, NOWHERE = 20_000, 8, -1


def _unit(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    length = np.linalg.norm(m, axis=1)
    return np.divide(m, length[:, None], out=np.zeros_like(m), where=length[:, None] > 0), length > 0


def _matrix(column: pa.Array, rows: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(rows, -1)


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Between unit vectors; small ones from the difference itself would cost a cube, so they carry an error of 1e-7."""
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (a @ b.T)))


def _centres(sample: np.ndarray, cells: int) -> np.ndarray:
    """Means of the sample's vectors that are nearest to each, from an even start; as unit vectors."""
    centres = sample[np.linspace(0, len(sample) - 1, min(cells, len(sample))).astype(int)]
    for _ in range(ROUNDS):
        near = np.argmax(sample @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, sample)
        fresh, some = _unit(sums)
        centres = np.where(some[:, None], fresh, centres)
    return np.unique(centres, axis=0)


class CellIndex:
    """An index in a folder, written once and opened by its path."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def write(self, vectors: DataFrame, cells: int = 64) -> CellIndex:
        """vectors: id, embedding (null ones are left out)."""
        v = vectors.filter("embedding is not null").select("id", "embedding")
        first = v.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("embedding").toArrow().column(0).combine_chunks()
        sample, some = _unit(_matrix(first, len(first))) if len(first) else (np.zeros((0, 1)), np.zeros(0, bool))
        centres = self.spark.sparkContext.broadcast(_centres(sample[some], cells) if some.any() else np.zeros((0, 1)))

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    unit, some = _unit(_matrix(b.column(1), b.num_rows))
                    cell, off = np.full(b.num_rows, NOWHERE, np.int32), np.zeros(b.num_rows)
                    if len(centres.value):
                        d = _distance(unit, centres.value)
                        cell[some], off[some] = np.argmin(d, axis=1)[some], d.min(axis=1)[some]
                    yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(unit), pa.list_(pa.float64())), pa.array(off), pa.array(cell)], ["id", "unit", "off", "cell"])

        placed = v.mapInArrow(place, f"id {dict(v.dtypes)['id']}, unit array<double>, off double, cell int")
        placed.hint("rebalance", "cell").write.partitionBy("cell").parquet(f"{self.path}/rows")
        facts = self._rows(placed.schema).groupBy("cell").agg(F.count("*").alias("n"), F.max("off").alias("radius"))
        table = self.spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(centres.value)] + [(NOWHERE, None)], "cell int, centre array<double>")
        facts.join(F.broadcast(table), "cell", "left").write.parquet(f"{self.path}/cells")
        return self

    def _rows(self, schema: object = None) -> DataFrame:
        return (self.spark.read.schema(schema) if schema else self.spark.read).parquet(f"{self.path}/rows")

    def cells(self) -> DataFrame:
        """cell, n, radius, centre."""
        return self.spark.read.parquet(f"{self.path}/cells")

    def search(self, queries: DataFrame, k: int, slack: float = 0.0) -> tuple[DataFrame, float]:
        """(query_id, cand_id, sim: all that are among a query's k most similar, or within ``slack`` of the k-th; the share of rows that were
        compared, of all pairs). queries: id, embedding. Queries come in blocks of bounded size."""
        facts = self.cells().orderBy("cell").collect()  # one row a cell
        total, blocks, parts, seen = sum(f.n for f in facts), max(1, -(-queries.count() // BLOCK)), [], 0
        for i in range(blocks):
            block = queries.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == i).select("id", "embedding").toArrow()
            if len(block) and facts:
                found, compared = self._block(block, facts, k, slack)
                parts.append(found)
                seen += compared
        kind = dict(queries.dtypes)["id"]
        empty = self.spark.createDataFrame([], f"query_id {kind}, cand_id {kind}, sim double")
        return reduce(DataFrame.unionByName, parts, empty), seen / max(1, total * queries.count())

    def _block(self, block: pa.Table, facts: list, k: int, slack: float) -> tuple[DataFrame, int]:
        ids = block.column("id").combine_chunks()
        q, some = _unit(_matrix(block.column("embedding").combine_chunks(), len(block)))
        names, sizes, radii = [f.cell for f in facts], np.array([f.n for f in facts]), np.array([f.radius for f in facts])
        away = np.stack([np.zeros(len(q)) if f.centre is None else _distance(q, np.array([f.centre]))[:, 0] for f in facts], axis=1)
        near = np.maximum(0.0, away - radii - 1e-6)  # no row of the cell is nearer; the margin is for rounding
        near[:, [f.centre is None for f in facts]] = 0.0
        near[~some] = 0.0
        # First the closest cells, until they hold k rows; then those that could hold a nearer one.
        order = np.argsort(away, axis=1)
        before = np.cumsum(sizes[order], axis=1) - sizes[order]
        first = np.zeros_like(near, bool)
        np.put_along_axis(first, order, before < k, axis=1)
        bar = np.full(len(q), -np.inf)
        best = self._compare(ids, q, away, names, first, k, 0.0, bar).groupBy("query_id").agg(F.slice(F.sort_array(F.collect_list("sim"), False), k, 1).alias("b")).filter("size(b) > 0").toArrow()
        place = {x: j for j, x in enumerate(ids.to_pylist())}
        for name, b in zip(best.column(0).to_pylist(), best.column(1).to_pylist(), strict=True):
            bar[place[name]] = b[0] - slack
        need = 1.0 - near**2 / 2 >= bar[:, None]
        need[:, [f.centre is None for f in facts]] = True
        return self._compare(ids, q, away, names, need, k, slack, bar), int((first * sizes).sum() + (need * sizes).sum())

    def _compare(self, ids: pa.Array, q: np.ndarray, away: np.ndarray, names: list, need: np.ndarray, k: int, slack: float, bar: np.ndarray) -> DataFrame:
        """The k most similar rows of the needed cells, and those within slack of them, for each task's part of a cell."""
        asked = {c: np.nonzero(need[:, j])[0] for j, c in enumerate(names) if need[:, j].any()}
        shared = self.spark.sparkContext.broadcast((ids, q, {c: (who, away[who, names.index(c)]) for c, who in asked.items()}, bar))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, q, asked, bar = shared.value
            for b in batches:
                cells = b.column(3).to_numpy(zero_copy_only=False)
                for cell in np.unique(cells):
                    here = np.nonzero(cells == cell)[0]
                    rows = b.take(pa.array(here))
                    who, off = asked[int(cell)]
                    unit, dist = _matrix(rows.column(1), len(here)), rows.column(2).to_numpy(zero_copy_only=False)
                    least = np.maximum(0.0, np.abs(off[:, None] - dist[None, :]) - 1e-6) if cell != NOWHERE else np.zeros((len(who), len(here)))
                    sims = q[who] @ unit.T
                    sims[1.0 - least**2 / 2 < bar[who][:, None]] = -np.inf
                    edge = np.partition(sims, -min(k, sims.shape[1]), axis=1)[:, -min(k, sims.shape[1])] - slack
                    x, y = np.nonzero((sims >= edge[:, None]) & (sims > -np.inf) & (sims >= bar[who][:, None]))
                    if len(x):
                        yield pa.RecordBatch.from_arrays([ids.take(pa.array(who[x])), rows.column(0).take(pa.array(y)), pa.array(sims[x, y])], ["query_id", "cand_id", "sim"])

        rows = self._rows()
        kind = dict(rows.dtypes)["id"]
        return rows.filter(F.col("cell").isin([int(c) for c in asked])).select("id", "unit", "off", "cell").mapInArrow(run, f"query_id {kind}, cand_id {kind}, sim double")
