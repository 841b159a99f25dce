"""Word windows, hashed embeddings and maximal similarity of window sets."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.functions.text import plain_tokens, words

SIZE, OVERLAP, DIM = 64, 16, 256
_TOKEN = re.compile("[a-z0-9]+")


def chunk_count(n: Column, size: int = SIZE, overlap: int = OVERLAP) -> Column:
    if size <= 0 or not 0 <= overlap < size:
        raise ValueError("a window is positive and longer than its overlap")
    return F.when(n == 0, 0).when(n <= size, 1).otherwise(F.ceil((n - size) / (size - overlap)) + 1).cast("int")


def chunks(docs: DataFrame, size: int = SIZE, overlap: int = OVERLAP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, chunk_idx, text: windows of words, the last one at the end of the text. A text without words has none."""
    d = docs.select(F.col(id_col).alias("doc_id"), words(F.col(text_col)).alias("w")).withColumn("n", chunk_count(F.size("w"), size, overlap)).filter("n > 0")
    d = d.select("doc_id", "w", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("chunk_idx"))
    return d.select("doc_id", "chunk_idx", F.array_join(F.slice("w", F.col("chunk_idx") * (size - overlap) + 1, size), " ").alias("text"))


@lru_cache(maxsize=1 << 16)
def _crc(token: str) -> int:
    return zlib.crc32(token.encode())


def _hashed(text: str | None, dim: int) -> np.ndarray:
    counts = Counter(_TOKEN.findall((text or "").lower()))
    v = np.bincount([_crc(t) % dim for t in counts], 1 + np.log(np.fromiter(counts.values(), np.float64, len(counts))), dim) if counts else np.zeros(dim)
    n = np.sqrt(v @ v)
    return (v / n if n else v).astype(np.float32)


def hash_vector(text: str | None, dim: int = DIM) -> list[float]:
    """Buckets of crc32 over a-z0-9 tokens, 1 + ln(count), unit length; no token gives the zero vector."""
    return _hashed(text, dim).tolist()


def hash_embed(text: Column, dim: int = DIM) -> Column:
    @F.pandas_udf("array<float>")
    def udf(s: pd.Series) -> pd.Series:
        return pd.Series([_hashed(t, dim) for t in s], dtype=object)

    return udf(text)


def hash_buckets(docs: DataFrame, dim: int = DIM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, bucket, value of the same embedding in sparse form, by built-in functions alone."""
    t = docs.select(F.col(id_col).alias("doc_id"), F.explode(plain_tokens(F.col(text_col))).alias("token"))
    b = t.groupBy("doc_id", "token").agg(F.count("*").alias("c")).groupBy("doc_id", (F.crc32("token") % dim).cast("int").alias("bucket")).agg(F.sum(1 + F.log("c")).alias("v"))
    n = b.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"))
    return b.join(n, "doc_id").select("doc_id", "bucket", (F.col("v") / F.col("norm")).alias("value"))


def embedder(name: str, dim: int = DIM, load: Callable[[], Callable[[list[str]], np.ndarray]] | None = None) -> Callable[[Column], Column]:
    """A column function by name: ``hash``, or a model that ``load`` builds once for each Python worker."""
    if name in ("hash", "mock"):
        return lambda c: hash_embed(c, dim)
    if load is None:
        raise ValueError(f"embedder {name!r} needs a loader")

    def model(c: Column) -> Column:
        @F.pandas_udf("array<float>")
        def udf(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            encode = load()
            for s in parts:
                yield pd.Series(list(np.asarray(encode(s.fillna("").tolist()), np.float32)))

        return udf(c)

    return model


def max_similarity(queries: DataFrame, candidates: DataFrame, k: int | None = None) -> DataFrame:
    """query_id, doc_id, score: the largest cosine between any window of a query and any window of a document.

    queries and candidates: doc_id, chunk_idx, embedding. A document's windows come together once and the maximum is taken
    there, so pairs of windows are never written; with k a task keeps each query's best k.
    """
    from pairloom.operators.matching import most_similar

    side = lambda d: d.select("doc_id", F.col("chunk_idx").alias("section"), "embedding")
    return most_similar(side(queries), side(candidates), k)
