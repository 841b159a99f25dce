"""The best k of fused semantic and keyword scores without the pairs of all vectors.

A pair with a keyword score is needed as it is. Of the others of a query only the similarity decides, so a task keeps its k most
similar ones, and the least and greatest scores that scaling needs. Keyword scores come to the candidate's row as one array, so each
batch's matrix against the queries is reduced where it is, and neither side is joined pair by pair.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.operators.staging import BLOCK, staged

Score = Callable[[np.ndarray], np.ndarray]
COLUMNS = ["query_id", "doc_id", "s", "k", "s_hi", "k_hi"]


def _unit(m: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, length, out=np.zeros_like(m), where=length > 0)


class _Task:
    """What one task knows of a block of queries."""

    def __init__(self, ids: list, matrix: np.ndarray, k: int, slack: float, score: Score):
        self.ids, self.matrix, self.k, self.slack, self.score = ids, matrix, k, slack, score
        self.place = {x: j for j, x in enumerate(ids)}
        self.lo, self.hi = np.full((2, len(ids)), np.inf), np.full((2, len(ids)), -np.inf)

    def scores(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """similarities, keyword scores, and where there is which; 0 elsewhere. One row for each query."""
        shape = (len(self.ids), batch.num_rows)
        vectors, names, values = (batch.column(i) for i in (1, 2, 3))
        held, sims = np.asarray(vectors.is_valid().to_numpy(zero_copy_only=False), bool), np.zeros(shape)
        if held.any():
            c = vectors.drop_null().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(int(held.sum()), -1)
            sims[:, held] = self.score(self.matrix @ _unit(c).T)
        words, known = np.zeros(shape), np.zeros(shape, bool)
        for j, (queries, found) in enumerate(zip(names.to_pylist(), values.to_pylist(), strict=True)):
            for query, score in zip(queries or (), found or (), strict=True):
                if (i := self.place.get(query)) is not None:
                    words[i, j], known[i, j] = score, True
        return sims, words, np.broadcast_to(held, shape), known

    def add(self, batch: pa.RecordBatch) -> pa.RecordBatch | None:
        sims, words, held, known = self.scores(batch)
        ranked = held | known
        for i, x in enumerate((sims, words)):
            self.lo[i] = np.minimum(self.lo[i], np.where(ranked, x, np.inf).min(1, initial=np.inf))
            self.hi[i] = np.maximum(self.hi[i], np.where(ranked, x, -np.inf).max(1, initial=-np.inf))
        docs, alone = np.array(batch.column(0).to_pylist()), held & ~known
        free = np.where(alone, sims, -np.inf)
        bar = np.partition(free, -min(self.k, free.shape[1]), axis=1)[:, -min(self.k, free.shape[1])] - self.slack
        by_id = np.argsort(docs, kind="stable")
        smallest = np.zeros_like(alone)
        smallest[:, by_id] = np.cumsum(alone[:, by_id], axis=1) <= self.k  # they win where all else is equal
        rows, columns = np.nonzero(known | alone & ((free >= bar[:, None]) | smallest))
        return self._told(rows, docs[columns].tolist(), sims[rows, columns], words[rows, columns], None) if len(rows) else None

    def ends(self) -> pa.RecordBatch:
        rows = np.nonzero(np.isfinite(self.lo[0]))[0]
        return self._told(rows, [None] * len(rows), self.lo[0][rows], self.lo[1][rows], self.hi[:, rows])

    def _told(self, rows: np.ndarray, docs: list, s: np.ndarray, k: np.ndarray, hi: np.ndarray | None) -> pa.RecordBatch:
        upper = [pa.nulls(len(rows), pa.float64())] * 2 if hi is None else [pa.array(x) for x in hi]
        return pa.RecordBatch.from_arrays([pa.array([self.ids[i] for i in rows]), pa.array(docs) if hi is None else pa.nulls(len(rows)), pa.array(s), pa.array(k), *upper], COLUMNS)


def met(queries: DataFrame, candidates: DataFrame, keyword: DataFrame, k: int, slack: float = 0.0, score: Score = np.asarray) -> DataFrame:
    """query_id, doc_id, s, k, s_lo, s_hi, k_lo, k_hi: the pairs that can be among the best k of any weighted sum of both scores, a
    missing score as 0, with the least and greatest of each over all that either side ranks for the query.

    queries, candidates: id, embedding; keyword: query_id, doc_id, score. ``score`` is a rising function of the cosines. Scores that are
    rounded later may tie what is not yet equal: what lies within ``slack`` of the k-th similarity is kept too. A query without vector
    ranks what it has keyword scores for.
    """
    kinds, spark = dict(keyword.dtypes), candidates.sparkSession
    by_doc = keyword.groupBy(F.col("doc_id").alias("id")).agg(F.collect_list(F.struct("query_id", "score")).alias("kw"))
    rows = candidates.select(F.col("id").cast(kinds["doc_id"]).alias("id"), "embedding").join(by_doc, "id", "full_outer")
    rows = staged(rows.select("id", "embedding", "kw.query_id", F.col("kw.score").alias("found")))
    blocks, schema = max(1, -(-queries.count() // BLOCK)), f"query_id {kinds['query_id']}, doc_id {kinds['doc_id']}, s double, k double, s_hi double, k_hi double"
    asking, parts = queries.select(F.col("id").cast(kinds["query_id"]).alias("id"), "embedding"), []
    for i in range(blocks):
        block = asking.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == i).toArrow()
        ids = block.column("id").to_pylist()
        shared = spark.sparkContext.broadcast((ids, _unit(np.array(block.column("embedding").to_pylist(), np.float64).reshape(len(ids), -1))))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            task = _Task(*shared.value, k, slack, score)
            for b in batches:
                if b.num_rows and (out := task.add(b)) is not None:
                    yield out.cast(wide)
            yield task.ends().cast(wide)

        wide = pa.schema([("query_id", block.schema.field("id").type), ("doc_id", rows.select("id").limit(0).toArrow().schema.field(0).type), *[(c, pa.float64()) for c in COLUMNS[2:]]])
        parts.append(rows.mapInArrow(run, schema))
    zero = F.lit(0.0)
    rest = keyword.join(asking.select(F.col("id").alias("query_id")), "query_id", "left_anti").select("query_id", "doc_id", zero.alias("s"), F.col("score").alias("k"))
    limits = rest.groupBy("query_id").agg(F.lit(None).cast(kinds["doc_id"]).alias("doc_id"), zero.alias("s"), F.min("k").alias("k"), zero.alias("s_hi"), F.max("k").alias("k_hi"))
    none = F.lit(None).cast("double")
    found = staged(reduce(DataFrame.unionByName, [*parts, rest.withColumns({"s_hi": none, "k_hi": none}), limits]))
    ends = found.filter("s_hi is not null").groupBy("query_id").agg(F.min("s").alias("s_lo"), F.max("s_hi").alias("s_hi"), F.min("k").alias("k_lo"), F.max("k_hi").alias("k_hi"))
    return found.filter("s_hi is null").select("query_id", "doc_id", "s", "k").join(ends, "query_id")


def _scaled(c: str) -> Column:
    """0..1 within the query; a constant is 1."""
    lo, hi = F.col(f"{c}_lo"), F.col(f"{c}_hi")
    return F.when(hi - lo <= 0, 1.0).otherwise((F.col(c) - lo) / (hi - lo))


def scaled(alpha: float | Column = 0.5) -> Column:
    """Over ``met``: both scores scaled within the query, then weighed."""
    a = alpha if isinstance(alpha, Column) else F.lit(min(max(alpha, 0.0), 1.0))
    return a * _scaled("s") + (1 - a) * _scaled("k")
