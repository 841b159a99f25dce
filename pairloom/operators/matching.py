"""Vector matching: similarities of query blocks with candidate rows, section pairing and aggregation.

``section_pairs``, ``components`` and ``aggregate`` are the definition, pair by pair. ``section_scores`` gives the same scores with
the sections of a document side by side, so that a task reduces a block of queries against its documents to one score for each
pair of documents, or to its best k, before anything is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from pairloom.operators.staging import PAIRS, maybe_broadcast, staged

#: Weights of the canonical sections, any other section's weight.
SECTION_WEIGHTS = {"skills": 0.40, "experience": 0.35, "education": 0.15, "summary": 0.10}
OTHER_WEIGHT = 0.1
QUERY_BLOCK = 20_000
#: Cells of a matrix of similarities that a task holds at once; a batch of candidates meets so many queries at a time.
CELLS = 4_000_000
#: Pairs that a task of ``all_ranked`` holds at four bytes each, and rows of the batches that it returns.
HELD, OUT = 24_000_000, 50_000


def similarities(queries: DataFrame, candidates: DataFrame, k: int | None = None) -> DataFrame:
    """query_id, cand_id, sim (cosine; 0 for a vector without length) of tables (id, embedding).

    Queries come in blocks of bounded size; a block is broadcast as one matrix, and each task multiplies it with its
    Arrow batches. With k, a task keeps its best k of each query, ties by id, so that little is shuffled afterwards.
    """
    spark, cells = candidates.sparkSession, CELLS
    n = queries.count()
    blocks = max(1, -(-n // QUERY_BLOCK))
    parts = []
    for i in range(blocks):
        block = (queries if blocks == 1 else queries.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == i)).select("id", "embedding").toArrow()
        ids = block.column("id").to_numpy()
        q = np.array(block.column("embedding").to_pylist(), np.float64).reshape(len(ids), -1)
        length = np.linalg.norm(q, axis=1, keepdims=True)
        shared = spark.sparkContext.broadcast((ids, np.divide(q, length, out=np.zeros_like(q), where=length > 0)))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, q = shared.value
            for b in batches:
                if not b.num_rows or not len(ids):
                    continue
                c = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(b.num_rows, -1)
                length = np.linalg.norm(c, axis=1, keepdims=True)
                c = np.divide(c, length, out=np.zeros_like(c), where=length > 0)
                cand, step = b.column(0).to_numpy(zero_copy_only=False), max(1, cells // b.num_rows)
                for at in range(0, len(ids), step):
                    names, sims = ids[at : at + step], q[at : at + step] @ c.T
                    if k and k < len(cand):
                        order = np.lexsort((np.broadcast_to(cand, sims.shape), -np.round(sims, 9)), axis=1)[:, :k]
                        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(names, k)), pa.array(cand[order].ravel()), pa.array(np.take_along_axis(sims, order, 1).ravel())], ["query_id", "cand_id", "sim"])
                    else:
                        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(names, len(cand))), pa.array(np.tile(cand, len(names))), pa.array(sims.ravel())], ["query_id", "cand_id", "sim"])

        id_type = dict(candidates.dtypes)["id"]
        parts.append(candidates.select("id", "embedding").mapInArrow(run, f"query_id {id_type}, cand_id {id_type}, sim double"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def all_ranked(queries: DataFrame, candidates: DataFrame) -> DataFrame:
    """query_id, doc_id, score, rank of tables (id, embedding): for each query every candidate but itself, by falling cosine of six digits,
    ties by id.

    Pairs are neither shuffled nor sorted by Spark, whose files would grow with their number: a nested loop leads all candidates past each
    task, which has a few queries, holds their scores as whole numbers and ranks one query after the other. So the candidates are
    read once for every ``HELD`` pairs. Where a single query has too many candidates for that, Spark sorts the pairs.
    """
    from pairloom.operators.ranking import DIGITS, ranked

    spark, n, held_at_most, cells, out_rows = candidates.sparkSession, candidates.count(), HELD, CELLS, OUT
    if n > held_at_most // 4:
        return ranked(similarities(queries, candidates).filter("query_id <> cand_id").select("query_id", F.col("cand_id").alias("doc_id"), F.round("sim", DIGITS).alias("score")))
    id_type, unit, nan = dict(candidates.dtypes)["id"], 10.0**DIGITS, 2 * 10**DIGITS  # nan comes first, as in a sort
    schema = f"query_id {id_type}, doc_id {id_type}, score double, rank int"
    cores, blocks, parts = spark.sparkContext.defaultParallelism, max(1, -(-queries.count() // QUERY_BLOCK)), []
    for i in range(blocks):
        block = (queries if blocks == 1 else queries.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == i)).select("id", "embedding").toArrow()
        if not block.num_rows:
            continue
        ids, q = block.column("id").to_numpy(), np.array(block.column("embedding").to_pylist(), np.float64).reshape(block.num_rows, -1)
        length = np.linalg.norm(q, axis=1, keepdims=True)
        shared = spark.sparkContext.broadcast((ids, np.divide(q, length, out=np.zeros_like(q), where=length > 0)))
        few = max(1, held_at_most // max(1, n))
        tasks = max(-(-len(ids) // few), min(cores, -(-len(ids) * n // PAIRS)), 1)
        tasks = min(-(-tasks // cores) * cores, max(1, len(ids))) if tasks > cores else tasks  # no round of tasks leaves cores idle

        def run(batches: Iterator[pa.RecordBatch], shared=shared, tasks=tasks) -> Iterator[pa.RecordBatch]:
            ids, q = shared.value
            found: dict[int, list] = {}  # of each share of the queries: its scores, the candidates, how many there are by now
            for b in batches:
                shares = b.column(2).to_numpy()
                for share in np.unique(shares).tolist():
                    rows = b if (shares == share).all() else b.filter(pa.array(shares == share))
                    mine = q[share::tasks]
                    if share not in found:
                        found[share] = [np.empty((len(mine), n), np.int32), [], 0]
                    scores, names, at = found[share]
                    c = rows.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(rows.num_rows, -1)
                    length = np.linalg.norm(c, axis=1, keepdims=True)
                    c = np.divide(c, length, out=np.zeros_like(c), where=length > 0)
                    step = max(1, cells // max(1, len(mine)))
                    for a in range(0, len(c), step):
                        x = mine @ c[a : a + step].T * unit
                        x += np.copysign(0.5, x)
                        scores[:, at + a : at + a + x.shape[1]] = np.where(np.isnan(x), nan, x)  # cut to whole numbers
                    names.append(rows.column(0).to_numpy(zero_copy_only=False).copy())  # a view would keep the batch, vectors and all
                    found[share][2] = at + len(c)
            for share, (scores, names, at) in found.items():
                if at != n:
                    raise RuntimeError(f"{at} of {n} candidates met a task's queries")
                cand = np.concatenate(names)
                order = np.argsort(cand, kind="stable")
                cand = cand[order]
                place = np.arange(n)
                for own, row in zip(ids[share::tasks], scores, strict=True):
                    keys = ((nan - row[order].astype(np.int64) << 32) | place)[cand != own]
                    keys.sort()
                    for a in range(0, len(keys), out_rows):
                        some = keys[a : a + out_rows]
                        whole = nan - (some >> 32)
                        score, rank = np.where(whole == nan, np.nan, whole / unit), np.arange(a + 1, a + 1 + len(some), dtype=np.int32)
                        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(own, len(some))), pa.array(cand[some & 0xFFFFFFFF]), pa.array(score), pa.array(rank)], ["query_id", "doc_id", "score", "rank"])

        # One partition of candidates is led past partitions of one share each, so that a share meets all of them in one task.
        met = candidates.select("id", "embedding").coalesce(1).hint("shuffle_replicate_nl").crossJoin(spark.range(0, tasks, 1, tasks).select(F.col("id").alias("share")))
        parts.append(met.mapInArrow(run, schema))
    return _united(parts, spark, schema)


def section_pairs(queries: DataFrame, candidates: DataFrame) -> DataFrame:
    """query_doc, query_section, doc_id, section, sim of tables (id, doc_id, section, embedding)."""
    sims = similarities(queries, candidates)
    q = queries.select(F.col("id").alias("query_id"), F.col("doc_id").alias("query_doc"), F.col("section").alias("query_section"))
    c = candidates.select(F.col("id").alias("cand_id"), "doc_id", "section")
    return sims.join(q, "query_id").join(c, "cand_id").select("query_doc", "query_section", "doc_id", "section", "sim")


def components(pairs: DataFrame, pairing: str = "cross", full: str = "_full") -> DataFrame:
    """query_doc, doc_id, query_section, sim: the best candidate section for each query section, or the one of the same
    name (0 where the candidate lacks it). Keyed by the query's sections, so not symmetric."""
    some = pairs.filter((F.col("section") != full) & (F.col("query_section") != full))
    if pairing == "fixed":
        value = F.coalesce(F.max(F.when(F.col("section") == F.col("query_section"), F.col("sim"))), F.lit(0.0))
    elif pairing == "cross":
        value = F.max("sim")
    else:
        raise ValueError(f"unknown pairing {pairing!r}")
    return some.groupBy("query_doc", "doc_id", "query_section").agg(value.alias("sim"))


def aggregate(parts: DataFrame, how: str = "mean", weights: dict[str, float] | None = None) -> DataFrame:
    """query_id, doc_id, score from section components: max, mean, or weighted by section over the sections present."""
    weights = weights or SECTION_WEIGHTS
    if how == "max":
        value = F.max("sim")
    elif how == "weighted":
        table = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
        w = F.coalesce(table[F.lower("query_section")], F.lit(OTHER_WEIGHT))
        value = F.when(F.sum(w) <= 0, F.avg("sim")).otherwise(F.sum(w * F.col("sim")) / F.sum(w))
    else:
        value = F.avg("sim")
    return parts.groupBy(F.col("query_doc").alias("query_id"), "doc_id").agg(value.alias("score"))


def pool(hits: DataFrame, size: int) -> DataFrame:
    """query_id, doc_id, distance, version from the nearest vectors (query_id, doc_id, version, distance): three times the
    pool is fetched, then each document keeps its closest vector; the pool is not cut again."""
    near = hits.withColumn("nth", F.row_number().over(W.partitionBy("query_id").orderBy(F.col("distance").isNull(), "distance", "doc_id"))).filter(F.col("nth") <= 3 * size)
    best = near.groupBy("query_id", "doc_id").agg(F.min("distance").alias("distance"), F.min_by("version", "distance").alias("version"))
    return best.withColumn("pos", F.row_number().over(W.partitionBy("query_id").orderBy(F.col("distance").isNull(), "distance", "doc_id")))


def latest(vectors: DataFrame) -> DataFrame:
    """Only the rows of each document's highest version."""
    top = F.max("version").over(W.partitionBy("doc_type", "doc_id"))
    return vectors.withColumn("__top", top).filter(F.col("version") == F.col("__top")).drop("__top")


def by_document(vectors: DataFrame) -> DataFrame:
    """doc_id, sections, vectors: a document's rows (doc_id, section, embedding) in one, in the order of the sections' names."""
    side = F.array_sort(F.collect_list(F.struct("section", "embedding")))
    return vectors.groupBy("doc_id").agg(side.alias("s")).select("doc_id", F.col("s.section").alias("sections"), F.col("s.embedding").alias("vectors"))


def _flat(batch_vectors: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The rows of a list of lists of vectors, unit length, and where each list begins."""
    starts = np.concatenate([[0], np.cumsum(batch_vectors.value_lengths().to_numpy(zero_copy_only=False))])
    rows = batch_vectors.flatten()
    v = rows.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), -1)
    length = np.linalg.norm(v, axis=1, keepdims=True)
    return np.divide(v, length, out=np.zeros_like(v), where=length > 0), starts


def _asking(queries: DataFrame, key: str = "doc_id"):
    """Blocks of queries, as (ids, sections, unit vectors, starts)."""
    spark, docs = queries.sparkSession, by_document(queries)
    blocks = max(1, -(-docs.count() // QUERY_BLOCK))
    for i in range(blocks):
        block = (docs if blocks == 1 else docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(blocks)) == i)).orderBy("doc_id").toArrow()
        if not block.num_rows:
            continue
        ids, names = block.column("doc_id").to_pylist(), [x for row in block.column("sections").to_pylist() for x in row]
        v, starts = _flat(block.column("vectors").combine_chunks())
        yield spark.sparkContext.broadcast((ids, names, v, starts))


def _united(parts: list[DataFrame], spark, schema: str) -> DataFrame:
    out = parts[0] if parts else spark.createDataFrame([], schema)
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def section_scores(
    queries: DataFrame, candidates: DataFrame, pairing: str = "cross", how: str = "mean", k: int | None = None, pool: DataFrame | None = None, weights: dict[str, float] | None = None, full: str = "_full"
) -> DataFrame:
    """query_id, doc_id, score of tables (doc_id, section, embedding), as ``aggregate(components(...))`` has them. With k a task keeps
    the best k of each query; with a pool (query_id, doc_id) only its pairs are scored."""
    if pairing not in ("fixed", "cross"):
        raise ValueError(f"unknown pairing {pairing!r}")
    weights, spark, cells = weights or SECTION_WEIGHTS, candidates.sparkSession, CELLS
    docs, id_type = by_document(candidates.filter(F.col("section") != full)), dict(candidates.dtypes)["doc_id"]
    some = pool is not None
    if some:
        asked = pool.groupBy("doc_id").agg(F.collect_set("query_id").alias("asked"))
        docs = docs.join(maybe_broadcast(staged(asked), 512), "doc_id")
    schema = f"query_id {id_type}, doc_id {id_type}, score double"

    def reduced(sims: np.ndarray, starts: np.ndarray, q_names: list[str], q_starts: np.ndarray, c_names: list[str]) -> np.ndarray:
        """Scores of queries (rows) and documents (columns) out of the sims of their sections."""
        if pairing == "fixed":
            same = np.array(q_names, object)[:, None] == np.array(c_names, object)[None, :]
            sims = np.where(same, sims, -np.inf)
        best = np.maximum.reduceat(sims, starts[:-1], axis=1)
        best = np.where(np.isneginf(best), 0.0, best)
        if how == "max":
            return np.maximum.reduceat(best, q_starts[:-1], axis=0)
        w = np.array([weights.get(x.lower(), OTHER_WEIGHT) if how == "weighted" else 1.0 for x in q_names])
        total = np.add.reduceat(w, q_starts[:-1])
        plain, many = np.add.reduceat(best, q_starts[:-1], axis=0), np.diff(q_starts)[:, None]
        weighed = total[:, None] > 0
        return np.where(weighed, np.add.reduceat(best * w[:, None], q_starts[:-1], axis=0) / np.where(weighed, total[:, None], 1.0), plain / many)

    def run_with(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, names, q, q_starts = shared.value
            place = {x: i for i, x in enumerate(ids)}
            for b in batches:
                if not b.num_rows:
                    continue
                c, starts = _flat(b.column(2))
                c_names, cand = [x for row in b.column(1).to_pylist() for x in row], b.column(0).to_pylist()
                if some:
                    out: tuple[list, list, list] = ([], [], [])
                    for j, asked in enumerate(b.column(3).to_pylist()):
                        a, z = starts[j : j + 2]
                        for i in sorted(place[x] for x in asked if x in place):
                            y, x = q_starts[i : i + 2]
                            score = reduced(q[y:x] @ c[a:z].T, np.array([0, z - a]), names[y:x], np.array([0, x - y]), c_names[a:z])
                            for column, value in zip(out, (ids[i], cand[j], float(score[0, 0])), strict=True):
                                column.append(value)
                    yield pa.RecordBatch.from_pydict({"query_id": out[0], "doc_id": out[1], "score": out[2]}, schema=pa.schema([("query_id", b.schema.field(0).type), ("doc_id", b.schema.field(0).type), ("score", pa.float64())]))
                    continue
                most = max(1, cells // max(1, len(c)))  # sections of queries at a time, whole queries each
                at = 0
                while at < len(ids):
                    to = max(at + 1, int(np.searchsorted(q_starts, q_starts[at] + most, "right")) - 1)
                    y, x = q_starts[at], q_starts[to]
                    scores = reduced(q[y:x] @ c.T, starts, names[y:x], q_starts[at : to + 1] - y, c_names)
                    yield from _best(scores, ids[at:to], b.column(0), k)
                    at = to

        return run

    parts = [docs.mapInArrow(run_with(shared), schema) for shared in _asking(queries.filter(F.col("section") != full))]
    return _united(parts, spark, schema)


def _best(scores: np.ndarray, ids: list, cand: pa.Array, k: int | None) -> Iterator[pa.RecordBatch]:
    """Rows of a matrix of queries and candidates: all of them, or each query's best k, ties by id."""
    names, n = ["query_id", "doc_id", "score"], scores.shape[1]
    if k and k < n:
        tie = np.argsort(np.argsort(cand.to_numpy(zero_copy_only=False)))
        order = np.lexsort((np.broadcast_to(tie, scores.shape), -np.round(scores, 6)), axis=1)[:, :k]
        flat = pa.array(order.ravel())
        yield pa.RecordBatch.from_arrays([pa.array(ids, cand.type).take(pa.array(np.repeat(np.arange(len(ids)), k))), cand.take(flat), pa.array(np.take_along_axis(scores, order, 1).ravel())], names)
    else:
        yield pa.RecordBatch.from_arrays([pa.array(ids, cand.type).take(pa.array(np.repeat(np.arange(len(ids)), n))), cand.take(pa.array(np.tile(np.arange(n), len(ids)))), pa.array(scores.ravel())], names)


def most_similar(queries: DataFrame, candidates: DataFrame, k: int | None = None) -> DataFrame:
    """query_id, doc_id, score: the largest cosine between any vector of a query and any of a document, over tables
    (doc_id, section, embedding). A task takes the maximum over its documents' vectors, so pairs of vectors are never written."""
    spark, id_type = candidates.sparkSession, dict(candidates.dtypes)["doc_id"]
    docs, schema = by_document(candidates), f"query_id {id_type}, doc_id {id_type}, score double"

    def run_with(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, _, q, q_starts = shared.value
            for whole in batches:
                for at in range(0, whole.num_rows, 500):
                    b = whole.slice(at, 500)
                    c, starts = _flat(b.column(2))
                    best = np.maximum.reduceat(np.maximum.reduceat(q @ c.T, starts[:-1], axis=1), q_starts[:-1], axis=0)
                    yield from _best(best, ids, b.column(0), k)

        return run

    return _united([docs.mapInArrow(run_with(shared), schema) for shared in _asking(queries)], spark, schema)


def two_stage(queries: DataFrame, candidates: DataFrame, size: int, k: int, coarse: str = "summary", pairing: str = "cross", how: str = "weighted") -> DataFrame:
    """query_id, doc_id, score, rank: the ``size`` documents whose coarse section is most similar, ranked by all sections. Only the
    pairs of the coarse stage reach the fine one."""
    from pairloom.operators.ranking import ranked

    only = lambda d: d.filter(F.col("section") == coarse)
    rough = most_similar(only(queries), only(candidates), size).withColumn("score", F.round("score", 6))
    head = staged(ranked(rough, size).select("query_id", "doc_id"))
    fine = section_scores(queries, candidates, pairing, how, pool=head)
    return ranked(fine.withColumn("score", F.round("score", 6)), k)
