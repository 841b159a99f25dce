"""What several operators of this subpackage share: words, shared-folder tables, size-checked broadcasts."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.operators.staging import BROADCAST_BYTES, remove_at_exit, shared_folder

#: Words of a text, as the contracts define them; ``bytes.split()`` cuts at exactly these six characters.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"

_CACHE_LIMIT = 1 << 18
_word_ids: dict[bytes, int] = {}


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int = 2000) -> Iterator[None]:
    """Arrow batches of few rows while a table is written, for texts are long and both sides of a worker hold a batch."""
    key, conf = "spark.sql.execution.arrow.maxRecordsPerBatch", spark.conf
    before = conf.get(key, None)
    conf.set(key, str(min(rows, int(before)) if before and int(before) > 0 else rows))
    try:
        yield
    finally:
        conf.unset(key) if before is None else conf.set(key, before)


class Workspace:
    """Tables written under the shared folder: they cut lineage, survive lost executors and can be dropped early. What is left goes
    when the driver ends."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root, self._n = spark, shared_folder(spark), 0

    def table(self, df: DataFrame) -> DataFrame:
        self._n += 1
        path = f"{self.root}/t{self._n}"
        with small_batches(self.spark):
            df.write.parquet(path)
        if self._n == 1:
            remove_at_exit(self.spark, self.root)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._pairloom_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for t in tables:
            path = jvm.org.apache.hadoop.fs.Path(t._pairloom_path)
            path.getFileSystem(conf).delete(path, True)


def maybe_broadcast(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """Broadcast hint only when the counted rows fit the bound; otherwise the join shuffles."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


def fold_of(doc_id: str | Column, k: int) -> Column:
    """crc32 of the id's decimal text, modulo k."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(col.cast("string")) % F.lit(k)


def word_hashes(text: str | None) -> np.ndarray:
    """64-bit ids of the words of a text, A-Z folded; a bounded per-process cache spares rehashing."""
    if not text:
        return np.empty(0, np.uint64)
    words = text.encode().lower().split()
    ids = _word_ids
    try:
        return np.fromiter(map(ids.__getitem__, words), np.uint64, len(words))
    except KeyError:
        if len(ids) > _CACHE_LIMIT:
            ids.clear()
        for w in words:
            if w not in ids:
                ids[w] = xxhash.xxh3_64_intdigest(w)
        return np.fromiter(map(ids.__getitem__, words), np.uint64, len(words))


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct hashes of a text's n-word shingles; of the whole sequence where it is shorter."""
    w = word_hashes(text)
    if not len(w):
        return w
    n = min(n, len(w))
    m = len(w) - n + 1
    h = np.full(m, 0x9E3779B97F4A7C15 * n & 0xFFFFFFFFFFFFFFFF, np.uint64)
    for i in range(n):
        h = mix64(h + w[i : i + m])
    return np.unique(h)


def tidied(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The function, which gives memory back to the system when a task ends: workers live on, and would keep the most that any
    task has needed."""

    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # a C library without this call keeps what it has
                ctypes.CDLL(None).malloc_trim(0)

    return inner


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """One Arrow batch in, at most one out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows and (out := fn(b)) is not None and out.num_rows:
                yield out

    return df.mapInArrow(run, schema)


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of few rows, so that lists of their words stay small."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str | None]:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns that a text operator reads, so the scan prunes the rest."""
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
