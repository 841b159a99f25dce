"""Lexical ranking: BM25 and TF-IDF over postings."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.functions.text import TOKEN, lexical_tokens, lowered
from pairloom.operators.staging import BROADCAST_BYTES, against_all, maybe_broadcast, staged

K1, B, EPSILON = 1.5, 0.75, 0.25
#: Texts whose tokens a task holds at once.
SLICE = 500


def counted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, dl (null for null text, which the mean length leaves out), terms: array<struct<term, tf>>, in one pass over Arrow batches of
    texts: nothing is shuffled, and no token becomes a row."""
    t = docs.select(F.col(id_col).alias("doc_id"), lowered(F.col(text_col)).alias("text"))
    find = re.compile(TOKEN).findall

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                b = whole.slice(at, SLICE)
                sizes, ends, terms, times = [], [0], [], []
                for text in b.column(1).to_pylist():
                    found = find(text) if text else []
                    n = Counter(found)
                    sizes.append(None if text is None else len(found))
                    terms += n.keys()
                    times += n.values()
                    ends.append(len(terms))
                entries = pa.StructArray.from_arrays([pa.array(terms, pa.string()), pa.array(times, pa.int64())], ["term", "tf"])
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int32()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), entries)], ["doc_id", "dl", "terms"])

    return t.mapInArrow(run, f"doc_id {t.dtypes[0][1]}, dl int, terms array<struct<term:string,tf:bigint>>")


def postings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, term, tf, dl. The counts are staged, for statistics and scores both read them."""
    return _spread(staged(counted(docs, id_col, text_col)))


def _spread(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", "dl", F.explode("terms").alias("t")).select("doc_id", "t.term", "t.tf", "dl")


def idf_table(posts: DataFrame, n: int) -> DataFrame:
    """term, df, idf: where the raw value is negative, a share of the mean over all terms stands in. The mean is summed over document
    frequencies, of which there are few: one long sum over millions of terms, most of them alike, errs by its roundings."""
    raw = F.log(F.lit(float(n)) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    df = posts.groupBy("term").agg(F.count("*").alias("df"))
    alike = df.groupBy("df").agg(F.count("*").alias("n"))
    mean = alike.agg((F.sum(raw * F.col("n")) / F.sum("n")).alias("mean"))  # one row
    return df.withColumn("raw", raw).crossJoin(F.broadcast(mean)).select("term", "df", F.when(F.col("raw") < 0, F.col("mean") * EPSILON).otherwise(F.col("raw")).alias("idf"))


def _weighed(docs: DataFrame, queries: DataFrame, doc_id: str, query_id: str, text: str) -> tuple[DataFrame, DataFrame, float]:
    """(counts of the documents, the queries' terms with times and idf, mean length); both tables are staged."""
    rows = staged(counted(docs, doc_id, text))
    size = rows.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl")).first()
    if not size.n:
        raise ValueError("an empty corpus cannot be ranked")
    asked = queries.select(F.col(query_id).alias("query_id"), F.explode(lexical_tokens(F.col(text))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))
    return rows, staged(asked.join(idf_table(_spread(rows), size.n).select("term", "idf"), "term")), size.avgdl or 0.0


def bm25(docs: DataFrame, queries: DataFrame, doc_id: str = "doc_id", query_id: str = "query_id", text: str = "text") -> DataFrame:
    """query_id, doc_id, score of every pair that shares a term; a query's repeated terms count as often.

    Texts are cut into tokens once, into a staged table, from which the statistics and the postings come. The queries'
    weighted terms meet the postings where they are while they are few, and no postings but matching ones are shuffled.
    """
    return _scored(*_weighed(docs, queries, doc_id, query_id, text))


def _scored(rows: DataFrame, asked: DataFrame, avgdl: float) -> DataFrame:
    tf, norm = F.col("tf"), K1 * (1 - B + B * F.col("dl") / avgdl)
    weight = F.col("times") * F.col("idf") * tf * (K1 + 1) / (tf + norm)
    return _spread(rows).join(maybe_broadcast(asked, 96), "term").groupBy("query_id", "doc_id").agg(F.sum(weight).alias("score"))


def asking(asked: DataFrame) -> Iterator[tuple[Column, Broadcast]]:
    """Blocks of queries (query_id, term, w): what picks a block's queries, and their ids, the numbers of their terms, where each term's
    postings end, whose they are, and weights."""
    blocks = max(1, -(-asked.count() * 96 // BROADCAST_BYTES))
    for i in range(blocks):
        mine = F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i
        block = asked.filter(mine).orderBy("term").select("query_id", "term", "w").toArrow().combine_chunks()
        if not len(block):
            continue
        ids = block.column("query_id").combine_chunks().dictionary_encode()
        terms = block.column("term").combine_chunks().dictionary_encode()  # in order, so each term's postings are one run
        ends = np.concatenate([[0], np.cumsum(np.bincount(terms.indices.to_numpy(), minlength=len(terms.dictionary)))])
        yield mine, asked.sparkSession.sparkContext.broadcast((ids.dictionary, {t: j for j, t in enumerate(terms.dictionary.to_pylist())}, ends, ids.indices.to_numpy().astype(np.int64), block.column("w").to_numpy()))


def bm25_best(docs: DataFrame, queries: DataFrame, k: int, slack: float = 0.0, doc_id: str = "doc_id", query_id: str = "query_id", text: str = "text") -> DataFrame:
    """The pairs of ``bm25`` that can be among a query's k best, or within ``slack`` of the k-th (for scores that are rounded later).

    A task adds up the scores of a slice of documents for a block of queries, whose terms it has as postings, and keeps the k best; a
    pair of query and document is never a row unless it may win. Queries come in blocks of bounded size.
    """
    rows, asked, avgdl = _weighed(docs, queries, doc_id, query_id, text)
    spark, kind_q, kind_d, parts = docs.sparkSession, dict(asked.dtypes)["query_id"], dict(rows.dtypes)["doc_id"], []
    for _, shared in asking(asked.select("query_id", "term", (F.col("times") * F.col("idf")).alias("w"))):

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            names, place, ends, who, w = shared.value
            for whole in batches:
                for at in range(0, whole.num_rows, SLICE):
                    b = whole.slice(at, SLICE)
                    d, q, s = _best_of(b, place, ends, who, w, len(names), k, slack, avgdl)
                    if len(d):
                        yield pa.RecordBatch.from_arrays([names.take(pa.array(q)), b.column(0).take(pa.array(d)), pa.array(s)], ["query_id", "doc_id", "score"])

        parts.append(rows.select("doc_id", "dl", "terms").mapInArrow(run, f"query_id {kind_q}, doc_id {kind_d}, score double"))
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], f"query_id {kind_q}, doc_id {kind_d}, score double")


def matrix(doc: np.ndarray, at: np.ndarray, tf: np.ndarray, lengths: np.ndarray, ends: np.ndarray, who: np.ndarray, w: np.ndarray, queries: int, avgdl: float) -> tuple[np.ndarray, np.ndarray]:
    """Scores of documents (rows) and queries out of the documents' postings (row, number of the term, tf), and which share a term."""
    impact = tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[doc] / avgdl))
    many = ends[at + 1] - ends[at]
    # every posting of every term found: its place in the block's table, its cell in the matrix of documents and queries
    each = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(ends[at], many)
    cell = np.repeat(doc, many) * queries + who[each]
    scores = np.bincount(cell, np.repeat(impact, many) * w[each], len(lengths) * queries).reshape(len(lengths), queries)
    met = np.bincount(cell, minlength=len(lengths) * queries).reshape(scores.shape) > 0
    scores[~met] = -np.inf
    return scores, met


def _best_of(b: pa.RecordBatch, place: dict[str, int], ends: np.ndarray, who: np.ndarray, w: np.ndarray, queries: int, k: int, slack: float, avgdl: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, queries and scores of a slice's best pairs."""
    lists, lengths = b.column(2), b.column(1).to_numpy(zero_copy_only=False).astype(np.float64)
    sizes, entries = lists.value_lengths().to_numpy(), lists.flatten()
    at = np.fromiter((place.get(t, -1) for t in entries.field("term").to_pylist()), np.int64, len(entries))
    doc, tf = np.repeat(np.arange(b.num_rows), sizes)[at >= 0], entries.field("tf").to_numpy()[at >= 0].astype(np.float64)
    at = at[at >= 0]
    scores, met = matrix(doc, at, tf, lengths, ends, who, w, queries, avgdl)
    n = min(k, b.num_rows)
    bar = np.partition(scores, b.num_rows - n, axis=0)[b.num_rows - n] - slack
    d, q = np.nonzero(met & (scores >= bar))
    return d, q, scores[d, q]


def bm25_grid(docs: DataFrame, queries: DataFrame, doc_id: str = "doc_id", query_id: str = "query_id", text: str = "text") -> DataFrame:
    """Every query with every document, pairs that share no term at score 0."""
    grid = against_all(docs.select(F.col(doc_id).alias("doc_id")), queries.select(F.col(query_id).alias("query_id")), "query_id")
    return grid.join(bm25(docs, queries, doc_id, query_id, text), ["query_id", "doc_id"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))


def tfidf(docs: DataFrame, queries: DataFrame, doc_id: str = "doc_id", query_id: str = "query_id", text: str = "text", stop_words: tuple[str, ...] = (), max_features: int | None = None) -> DataFrame:
    """Cosine of sublinear TF-IDF vectors (smoothed idf) of documents and queries, fitted on the documents. Stop words are no
    features; with ``max_features`` only so many terms are, the most frequent in the corpus, ties by term."""
    rows = staged(counted(docs, doc_id, text))
    n, posts = rows.count(), _spread(rows)
    posts = posts.filter(~F.col("term").isin(*stop_words)) if stop_words else posts
    idf = posts.groupBy("term").agg((F.log((1 + F.lit(float(n))) / (1 + F.count("*"))) + 1).alias("idf"), F.sum("tf").alias("all"))
    idf = idf.orderBy(F.desc("all"), "term").limit(max_features) if max_features else idf
    idf = maybe_broadcast(staged(idf.select("term", "idf")), 64)
    w = posts.join(idf, "term").select("doc_id", "term", ((1 + F.log("tf")) * F.col("idf")).alias("w"))
    lengths = w.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    asked = staged(postings(queries, query_id, text).withColumnRenamed("doc_id", "query_id").join(idf, "term").select("query_id", "term", ((1 + F.log("tf")) * F.col("idf")).alias("qw")))
    asked_norm = asked.groupBy("query_id").agg(F.sqrt(F.sum(F.col("qw") * F.col("qw"))).alias("qnorm"))
    dots = w.join(maybe_broadcast(asked, 64), "term").groupBy("query_id", "doc_id").agg(F.sum(F.col("w") * F.col("qw")).alias("dot"))
    return dots.join(lengths, "doc_id").join(asked_norm, "query_id").select("query_id", "doc_id", (F.col("dot") / (F.col("norm") * F.col("qnorm"))).alias("score"))
