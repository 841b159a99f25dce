"""BM25 over postings in blocks with their greatest impact: blocks that cannot hold a hit are not read.

A posting's impact is what BM25 makes of term frequency and length, so it is known before any query. A term that more than ``BLOCK``
documents hold has its postings cut by levels of impact, and a level into pieces by a hash of the document; a rarer term is one block.
A query's terms stand in falling order of what they can add. A document whose first term in that order is t scores at most the impact
of its posting in t, times the weight, and all that the later terms can add; so once the k-th best of some documents is known, a
block whose greatest impact stays below that mark is left out, and every document that may win still lies in a block that is read.
Those documents alone are scored, with all their terms. Results are those of scoring every pair; terms of negative weight add at most 0.

Null and empty texts hold no term and are never found; repeated rows need distinct ids; an empty corpus is refused, as for ``bm25``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from pairloom.functions.text import lexical_tokens
from pairloom.operators.bm25 import K1, SLICE, B, _spread, asking, counted, idf_table, matrix
from pairloom.operators.staging import maybe_broadcast, staged

BLOCK, LEVELS = 128, 16
PLACE = ["term", "level", "piece"]


class BlockIndex:
    """An index in a folder, written once and opened by its path."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def write(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> BlockIndex:
        counted(docs, id_col, text_col).write.parquet(f"{self.path}/docs")
        rows = self._read("docs")
        size = rows.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl")).first()
        if not size.n:
            raise ValueError("an empty corpus cannot be ranked")
        impact = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / (size.avgdl or 0.0)))
        posts = _spread(rows).select("doc_id", "term", "tf", impact.alias("impact"))
        idf_table(posts, size.n).write.parquet(f"{self.path}/terms")
        common = self._read("terms").filter(F.col("df") > BLOCK).select("term", F.ceil(F.col("df") / (BLOCK * LEVELS)).alias("pieces"))
        placed = posts.join(maybe_broadcast(common, 64), "term", "left").select(
            "term",
            F.when(F.col("pieces").isNull(), 0).otherwise(F.floor(F.col("impact") * LEVELS)).cast("int").alias("level"),
            F.when(F.col("pieces").isNull(), 0).otherwise(F.pmod(F.xxhash64("doc_id"), "pieces")).cast("int").alias("piece"),
            F.struct("doc_id", "impact").alias("p"),
        )
        blocks = placed.groupBy(PLACE).agg(F.max("p.impact").alias("top"), F.count("*").alias("n"), F.collect_list("p").alias("posts"))
        blocks.sortWithinPartitions(*PLACE).write.parquet(f"{self.path}/blocks")
        return self

    def search(self, queries: DataFrame, k: int, slack: float = 0.0, query_id: str = "query_id", text: str = "text") -> tuple[DataFrame, float]:
        """(query_id, doc_id, score of all pairs that are among a query's k best, or within ``slack`` of the k-th; the share of the blocks of
        the queries' terms that were read)."""
        terms = queries.select(F.col(query_id).alias("query_id"), F.explode(lexical_tokens(F.col(text))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))
        terms = staged(terms.join(self._read("terms").select("term", "idf"), "term").select("query_id", "term", (F.col("times") * F.col("idf")).alias("w")))
        # The heads of blocks: their postings stay unread.
        heads = staged(self._read("blocks").select(*PLACE, "top", "n").join(maybe_broadcast(terms.select("term").distinct(), 32), "term", "left_semi"))
        tops = heads.groupBy("term").agg(F.max("top").alias("most"), F.max_by(F.struct("level", "piece"), F.struct(F.col("n") >= k, "top", "n")).alias("seed"))
        adds = F.greatest(F.col("w"), F.lit(0.0)) * F.col("most")
        later = W.partitionBy("query_id").orderBy(F.desc("adds"), "term").rowsBetween(1, W.unboundedFollowing)
        asked = terms.join(tops, "term").withColumn("adds", adds).withColumn("rest", F.coalesce(F.sum("adds").over(later), F.lit(0.0)))
        asked = staged(asked.select("query_id", "term", "w", "rest", "seed.level", "seed.piece"))

        seeds = self._scored(self._found(asked.select("query_id", *PLACE)).select("query_id", "doc_id").distinct(), asked)
        best = F.slice(F.sort_array(F.collect_list("score"), False), k, 1)
        first = W.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
        marks = seeds.withColumn("i", F.row_number().over(first)).filter(F.col("i") <= k).groupBy("query_id").agg(F.get(best, F.lit(0)).alias("mark"))
        # With fewer than k documents so far there is no mark, and all blocks are read.
        bar = F.coalesce(F.col("mark") - F.lit(slack) - F.abs("mark") * 1e-9, F.lit(float("-inf")))
        asked = staged(asked.drop("level", "piece").join(marks, "query_id", "left").withColumn("bar", bar).drop("mark"))
        within = lambda x: F.greatest(F.col("w"), F.lit(0.0)) * F.col(x) + F.col("rest") >= F.col("bar")
        met = heads.join(maybe_broadcast(asked, 96), "term")
        need = staged(met.filter(within("top")).select("query_id", *PLACE, "w", "rest", "bar"))
        pairs = self._found(need).filter(within("impact")).select("query_id", "doc_id").distinct()
        bars = staged(asked.select("query_id", "bar").distinct())
        hits = self._scored(pairs, asked).join(maybe_broadcast(bars, 32), "query_id").filter(F.col("score") >= F.col("bar"))
        return hits.select("query_id", "doc_id", "score"), need.count() / max(1, met.count())

    def _found(self, places: DataFrame) -> DataFrame:
        """The postings of blocks that queries ask for."""
        found = self._read("blocks").select(*PLACE, "posts").join(maybe_broadcast(places, 128), PLACE)
        return found.withColumn("p", F.explode("posts")).select("*", "p.doc_id", "p.impact").drop("posts", "p")

    def _scored(self, pairs: DataFrame, asked: DataFrame) -> DataFrame:
        """query_id, doc_id, score of the given distinct pairs, from all terms of the documents among them. Documents meet their queries once,
        with what they hold of the queries' terms as numbers; no pair meets a term in a join."""
        rows, pairs = self._read("docs"), staged(pairs)
        avgdl, kinds = rows.agg(F.avg("dl").alias("avgdl")).first().avgdl or 0.0, dict(pairs.dtypes)
        parts, schema = [], f"query_id {kinds['query_id']}, doc_id {kinds['doc_id']}, score double"
        for mine, shared in asking(asked.select("query_id", "term", "w")):

            def known(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
                place = shared.value[1]
                for whole in batches:
                    for start in range(0, whole.num_rows, SLICE):
                        b = whole.slice(start, SLICE)
                        entries, sizes = b.column(2).flatten(), b.column(2).value_lengths().to_numpy()
                        at = np.fromiter((place.get(t, -1) for t in entries.field("term").to_pylist()), np.int32, len(entries))
                        held, doc = at >= 0, np.repeat(np.arange(b.num_rows), sizes)
                        ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(doc[held], minlength=b.num_rows))]).astype(np.int32))
                        tf = pa.array(entries.field("tf").to_numpy()[held])
                        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.ListArray.from_arrays(ends, pa.array(at[held])), pa.ListArray.from_arrays(ends, tf)], ["doc_id", "dl", "at", "tf"])

            def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
                names, _, ends, who, w = shared.value
                for whole in batches:
                    for start in range(0, whole.num_rows, SLICE):
                        b = whole.slice(start, SLICE)
                        doc = np.repeat(np.arange(b.num_rows), b.column(2).value_lengths().to_numpy())
                        at, tf = b.column(2).flatten().to_numpy().astype(np.int64), b.column(3).flatten().to_numpy().astype(np.float64)
                        scores, met = matrix(doc, at, tf, b.column(1).to_numpy(zero_copy_only=False).astype(np.float64), ends, who, w, len(names), avgdl)
                        d, q = np.repeat(np.arange(b.num_rows), b.column(4).value_lengths().to_numpy()), pc.fill_null(pc.index_in(b.column(4).flatten(), value_set=names), -1).to_numpy()
                        kept = (q >= 0) & met[d, q]  # a query of unknown terms has no number
                        d, q = d[kept], q[kept]
                        yield pa.RecordBatch.from_arrays([names.take(pa.array(q)), b.column(0).take(pa.array(d)), pa.array(scores[d, q])], ["query_id", "doc_id", "score"])

            held = rows.select("doc_id", "dl", "terms").mapInArrow(known, f"doc_id {kinds['doc_id']}, dl int, at array<int>, tf array<long>")
            met = held.join(pairs.filter(mine).groupBy("doc_id").agg(F.collect_list("query_id").alias("who")), "doc_id")
            parts.append(met.select("doc_id", "dl", "at", "tf", "who").mapInArrow(run, schema))
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], schema)
