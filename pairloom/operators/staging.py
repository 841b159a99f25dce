"""Intermediate tables in the shared folder, and broadcasts behind a check of size."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only when a count has shown that it holds no more than so many bytes; queries come in blocks of so many rows.
BROADCAST_BYTES, BLOCK = 32 << 20, 20_000
#: Pairs that a task makes, about, where rows meet many partners.
PAIRS = 2_000_000
#: Rows of a group of ``alike``, and rows of one kind in it, about; keys of an array at most, for a task holds all pairs of two arrays.
GROUP, OF_A_KIND, RUN = 4096, 128, 256


def shared_folder(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``. Only a master that runs in one process may do without that setting."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    found = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not root and found.isDefined():
        root = found.get()
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.gettempdir()
    return f"{root.rstrip('/')}/pairloom-{uuid.uuid4().hex}"


def remove_at_exit(spark: SparkSession, folder: str) -> None:
    """The folder, which exists by now, goes when the driver ends; results may be read until then."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)


def staged(df: DataFrame) -> DataFrame:
    """The rows as a written table: what several steps read is computed once, and lost executors cost no lineage."""
    spark, folder = df.sparkSession, shared_folder(df.sparkSession)
    df.write.parquet(f"{folder}/t")
    remove_at_exit(spark, folder)
    return spark.read.schema(df.schema).parquet(f"{folder}/t")


def maybe_broadcast(df: DataFrame, row_bytes: int) -> DataFrame:
    """With a broadcast hint if the counted rows fit the bound; otherwise the join shuffles."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df


def dealt(rows: DataFrame, partners: int, *keys: str) -> DataFrame:
    """Narrow rows, each of which will meet so many partners, over as many tasks as their pairs need (by keys, if any): a small file is
    one task, whatever it is joined with."""
    tasks = -(-rows.count() * partners // PAIRS)
    return rows.repartition(tasks, *keys) if tasks > 1 else rows


def alike(rows: DataFrame, key: str, *kind: str) -> DataFrame:
    """kind, rows: the keys of so many rows of equal kind, as one array. What depends on the kind alone is worked out once for an array,
    and pairs of it are written in long runs, which files keep small."""
    n, kinds = rows.select(F.count("*"), F.count_distinct(F.struct(*kind))).first()
    groups = max(1, n // min(GROUP, OF_A_KIND * max(1, kinds)))
    keys = F.transform(F.collect_list(F.struct(key)), lambda x: x[key])  # a list of the keys alone leaves out nulls
    found = rows.groupBy(F.pmod(F.xxhash64(key), F.lit(groups)).alias("__group"), *kind).agg(keys.alias("rows"))
    starts = F.sequence(F.lit(1), F.size("rows"), F.lit(RUN))
    return found.select(*kind, F.explode(F.transform(starts, lambda i: F.slice("rows", i, RUN))).alias("rows"))


def dealt_groups(groups: DataFrame, partners: int) -> DataFrame:
    """Groups of ``alike``, over as many tasks as the pairs of their rows need, but no more than there are groups."""
    n, rows = groups.select(F.count("*"), F.coalesce(F.sum(F.size("rows")), F.lit(0))).first()
    tasks = min(n, -(-rows * partners // PAIRS))
    return groups.repartition(tasks) if tasks > 1 else groups


def against_all(rows: DataFrame, asking: DataFrame, key: str) -> DataFrame:
    """Every row with every asking row, which come in blocks of at most about ``BLOCK`` rows."""
    blocks = max(1, -(-asking.count() // BLOCK))
    out = None
    for i in range(blocks):
        block = asking if blocks == 1 else asking.filter(F.pmod(F.xxhash64(key), F.lit(blocks)) == i)
        part = rows.crossJoin(F.broadcast(block))
        out = part if out is None else out.unionByName(part)
    return out
