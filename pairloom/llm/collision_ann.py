"""Approximate nearest neighbours by counting collisions on single projections.

An index part is a set of vectors with, for each of ``PROJECTIONS`` random directions, the sorted array of their projected
values. A query opens a window around its own projection in each array, and counts for each vector the windows that it falls
into. A vector at distance r falls into a window of half-width z r / sqrt(dim) with a probability that depends on z alone, so
those within a radius reach a count that strangers miss; what exceeds the threshold is verified by its exact distance.

A window's width follows from the radius in question, and widening it (virtual rehashing) needs no new hash: it grows around
the query in the same sorted arrays. The radius is at first a share of the distance of the k-th neighbour in a sample of the
vectors (at most ``SAMPLE`` rows and ``SAMPLE_NUMBERS`` components, the first by a hash: a documented bound). A query whose k-th
verified neighbour lies within its radius is answered; the others open wider windows, up to the best bound known by then: the
sample's distance or the k-th verified one, within which k vectors are sure to lie. With few more vectors than the sample the
first step is left out; a query that has still not k neighbours opens all windows wholly. Which vectors are verified depends on the query and the vector alone, not on partitions.

Every vector is indexed in the part that its task reads, and every query meets every part, so the search spreads over tasks
without moving the vectors. Queries come in blocks of bounded size, one after the other; each is broadcast, and the best
k of each part are merged per query.

Defined cases: vectors null, zero, of another length than the most common one, or with null or non-finite components
take no part; fewer candidates than k give all of them; ties go to the smaller id; repeated ids are candidates each,
except a query's own id, and ask once, with the first of their vectors in order of components; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from pairloom.llm.common import Workspace, tidied

PROJECTIONS, WIDTH, SURE = 64, 0.5, 1.28  # windows in units of radius / sqrt(dim); deviations of the count that are allowed for
SAMPLE, SAMPLE_NUMBERS, FIRST_RADIUS = 20_000, 2_000_000, 0.85
QUERY_BLOCK, QUERY_NUMBERS, PART_NUMBERS = 20_000, 4_000_000, 2_000_000
RESULT = "query_id long, rank int, vec_id long, score double"


def usable(embedding: str = "embedding") -> Column:
    """Whether a vector takes part: present, finite in every component, and not zero."""
    v = F.col(embedding)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def random_directions(dim: int, many: int, seed: int) -> np.ndarray:
    """Unit directions in columns, orthogonal to one another within each run of ``dim`` of them."""
    rng = np.random.default_rng(seed)
    return np.concatenate([np.linalg.qr(rng.standard_normal((dim, dim)))[0] for _ in range(-(-many // dim))], axis=1)[:, :many]


def threshold(projections: int) -> int:
    """The collisions that a vector within the radius reaches but for a share of one in ten."""
    p = math.erf(WIDTH / math.sqrt(2))
    return max(1, math.floor(projections * p - SURE * math.sqrt(projections * p * (1 - p))))


class SortedProjections:
    """The index of one part."""

    def __init__(self, vectors: np.ndarray, directions: np.ndarray):
        self.vectors, self.directions = vectors, directions
        p = (vectors @ directions).T
        self.order = np.argsort(p, axis=1, kind="stable").astype(np.int32)
        self.values = np.take_along_axis(p, self.order, axis=1)

    def windows(self, queries: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each query and direction, where the window begins and ends in the sorted array."""
        at, width = queries @ self.directions, (WIDTH * radius / math.sqrt(self.vectors.shape[1]))[:, None]
        sides = [np.stack([np.searchsorted(v, x, side) for v, x in zip(self.values, edge.T, strict=True)], axis=1) for edge, side in ((at - width, "left"), (at + width, "right"))]
        return sides[0], sides[1]

    def collided(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """The places that fall into at least the threshold's number of one query's windows."""
        hits = np.concatenate([self.order[j, a:b] for j, (a, b) in enumerate(zip(lo.tolist(), hi.tolist(), strict=True))])
        return np.flatnonzero(np.bincount(hits, minlength=len(self.vectors)) >= threshold(len(self.order)))


def _distances(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    d = vectors - query
    return np.sqrt((d * d).sum(axis=1))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _bounds(sample, k: int):
    """vec_id, embedding, bound: the distance of the k-th neighbour in the sample, infinite where that has fewer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors = sample.value
        for b in batches:
            out = []
            for i, q in zip(b.column(0).to_pylist(), _matrix(b.column(1), vectors.shape[1]), strict=True):
                d = _distances(vectors, q)[ids != i]
                out.append(float(np.partition(d, k - 1)[k - 1]) if len(d) >= k else math.inf)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.float64())], ["vec_id", "embedding", "bound"])

    return run


def _search(queries, k: int, projections: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q_ids, q_vectors, radius = queries.value
        dim = q_vectors.shape[1]
        directions = random_directions(dim, projections, seed)

        def part(ids: np.ndarray, vectors: np.ndarray) -> pa.RecordBatch:
            index = SortedProjections(vectors, directions)
            out: tuple[list, list, list] = ([], [], [])
            for at in range(0, len(q_ids), 1000):
                rows = slice(at, at + 1000)
                for qid, q, lo, hi in zip(q_ids[rows].tolist(), q_vectors[rows], *index.windows(q_vectors[rows], radius[rows]), strict=True):
                    places = index.collided(lo, hi)
                    places = places[ids[places] != qid]
                    d = _distances(vectors[places], q)
                    best = np.lexsort((ids[places], d))[:k]
                    for column, x in zip(out, (np.full(len(best), qid, np.int64), ids[places[best]], d[best]), strict=True):
                        column.append(x)
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], ["query_id", "vec_id", "score"])

        ids, vectors, rows = [], [], 0
        for b in batches:
            ids.append(b.column(0).to_numpy())
            vectors.append(_matrix(b.column(1), dim))
            rows += b.num_rows
            if rows * dim >= PART_NUMBERS:
                yield part(np.concatenate(ids), np.concatenate(vectors))
                ids, vectors, rows = [], [], 0
        if rows:
            yield part(np.concatenate(ids), np.concatenate(vectors))

    return run


def nearest(vectors: DataFrame, is_query: Column, k: int = 10, projections: int = PROJECTIONS, seed: int = 11) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k nearest found by Euclidean distance in double precision."""
    spark, work = vectors.sparkSession, Workspace(vectors.sparkSession)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).filter(usable() & F.col("vec_id").isNotNull())
    dims = rows.groupBy(F.size("embedding").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    if dims is None:
        return spark.createDataFrame([], RESULT)
    rows, dim = rows.filter(F.size("embedding") == dims.dim), dims.dim
    asked = rows.filter(is_query).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    many = asked.count()
    if not many:
        return spark.createDataFrame([], RESULT)

    def shared(*columns: np.ndarray):
        return spark.sparkContext.broadcast(columns)

    size = max(k + 1, min(SAMPLE, SAMPLE_NUMBERS // dim))
    some = rows.orderBy(F.xxhash64("vec_id", "embedding", F.lit(seed)), "vec_id").limit(size).toArrow()
    sample = shared(some.column("vec_id").to_numpy(), _matrix(some.column("embedding").combine_chunks(), dim))
    blocks = -(-many // max(1, min(QUERY_BLOCK, QUERY_NUMBERS // dim)))
    wide, found = dims["count"] > 2 * size, []

    def search(ids: np.ndarray, q: np.ndarray, radius: np.ndarray) -> DataFrame:
        every = rows.mapInArrow(tidied(_search(shared(ids, q, radius), k, projections, seed)), "query_id long, vec_id long, score double")
        rank = F.row_number().over(W.partitionBy("query_id").orderBy("score", "vec_id"))
        every = every.withColumn("rank", rank.cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
        return work.table(every)

    for i in range(blocks):
        mine = asked if blocks == 1 else asked.filter(F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(blocks)) == i)
        block = mine.mapInArrow(tidied(_bounds(sample, k)), "vec_id long, embedding array<double>, bound double").toArrow()
        ids, q, bound = block.column("vec_id").to_numpy(), _matrix(block.column("embedding").combine_chunks(), dim), block.column("bound").to_numpy()
        for step in ("first", "bound", "all")[0 if wide else 1 :]:
            if not len(ids):
                break
            radius = {"first": FIRST_RADIUS * bound, "bound": bound, "all": np.full(len(ids), math.inf)}[step]
            got = search(ids, q, radius)
            kth = {r.query_id: r.score for r in got.filter(F.col("rank") == k).select("query_id", "score").collect()}
            reached = np.array([kth.get(x, math.inf) for x in ids.tolist()])
            done = {"first": reached <= radius, "bound": np.isfinite(reached), "all": np.ones(len(ids), bool)}[step]
            if done.all():
                found.append(got)
            else:
                answered = spark.createDataFrame([(x,) for x in ids[done].tolist()], "answered long")
                found.append(got.join(F.broadcast(answered), F.col("query_id") == F.col("answered"), "left_semi"))
            ids, q, bound = ids[~done], q[~done], np.minimum(bound, reached)[~done]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out
