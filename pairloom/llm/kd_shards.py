"""Shards of near-equal bytes by a k-d tree over metadata.

A node that stands for k shards is split at the weighted k//2-of-k quantile (the median, for even k) along its widest
dimension, until each leaf is one shard. All nodes of a level are split together: the quantile is found by descending
the bits of a row's key, 15 at a time, with a histogram of bytes for each node, so that no node's rows ever meet in one
task and nothing but the tree's cuts is sent anywhere.

A row's key in a dimension is its coordinate (20 bits), then 20 bits of the hash of its text and 20 of that of its id. So
rows with equal metadata, be it a third of all, are split where balance needs it; copies lie beside each other there.
Numbers, dates and times have their place between the least and the greatest as coordinate, all other types their hash (a
category's order does not matter), and nulls and NaN the lowest.

Defined results: a null or empty text has one byte and the checksum 0. Rows equal in id and text are one point of their joint
weight and stay together; copies under different ids may part. Without rows there is nothing in any shard; shards may be
empty where there are more of them than rows. Other columns are not read; ``assign`` replaces a column ``shard``.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, NumericType, TimestampNTZType, TimestampType
from pyspark.sql.window import Window as W

from pairloom.llm.common import Workspace, maybe_broadcast

DIMS = ("lang", "source", "n_chars")
COORD, TIE, STEP = 20, 40, 15
#: Rows that one task numbers at once.
RUN = 4096


def _bits(value: Column, digits: int = 5) -> Column:
    """20 bits, or four for each digit, of a hash that SQL engines share."""
    return F.conv(F.substring(F.md5(value), 1, digits), 16, 10).cast("long")


def _coordinate(docs: DataFrame, dim: str, ends: dict) -> Column:
    c, kind = F.col(f"`{dim}`"), docs.schema[dim].dataType
    if not isinstance(kind, (NumericType, DateType, TimestampType, TimestampNTZType)):
        return F.coalesce(_bits(c.cast("string").cast("binary")), F.lit(0))
    lo, hi = ends[dim]
    if lo is None or lo == hi:
        return F.lit(0).cast("long")
    x = F.least(F.greatest(_number(docs, dim), F.lit(lo)), F.lit(hi))
    return F.coalesce(F.when(~F.isnan(x), F.floor((x - lo) / (hi - lo) * ((1 << COORD) - 1))), F.lit(0)).cast("long")


def _number(docs: DataFrame, dim: str) -> Column:
    c = F.col(f"`{dim}`")
    return (c.cast("timestamp") if isinstance(docs.schema[dim].dataType, (DateType, TimestampNTZType)) else c).cast("double")


def _ends(docs: DataFrame, dims: Sequence[str]) -> dict[str, tuple]:
    """Least and greatest finite value of each number dimension: one row for the driver."""
    held = [d for d in dims if isinstance(docs.schema[d].dataType, (NumericType, DateType, TimestampType, TimestampNTZType))]
    if not held:
        return {}
    finite = {d: F.when(F.abs(_number(docs, d)) < float("inf"), _number(docs, d)) for d in held}
    row = docs.agg(*[f(finite[d]).alias(f"{d}:{n}") for d in held for n, f in (("lo", F.min), ("hi", F.max))]).first()
    return {d: (row[f"{d}:lo"], row[f"{d}:hi"]) for d in held}


def _located(docs: DataFrame, dims: Sequence[str], ends: dict, id_col: str, text_col: str) -> dict[str, Column]:
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    tie = F.shiftleft(_bits(text.cast("binary")), 20).bitwiseOR(_bits(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).cast("binary")))
    return {"__at": F.array(*[_coordinate(docs, d, ends) for d in dims]), "__tie": tie}


def _key() -> Column:
    return F.shiftleft(F.element_at("__at", F.col("__dim")), TIE).bitwiseOR(F.col("__tie"))


def _half(k: str = "__k") -> Column:
    return F.floor(F.col(k) / 2).cast("int")


@dataclass
class Shards:
    """A tree of cuts and the rows that made it."""

    #: doc_id, size, text_crc32, shard and the columns of their place, without texts.
    rows: DataFrame
    #: One table for each level: __node, __dim, __limit (keys below it go left).
    cuts: list[DataFrame]
    count: int
    total: int
    dims: tuple[str, ...]
    ends: dict
    columns: tuple[str, str]

    def assign(self, docs: DataFrame) -> DataFrame:
        """The documents, all columns, with the number of their shard."""
        out = docs.drop("shard").withColumns(_located(docs, self.dims, self.ends, *self.columns)).withColumns({"__node": F.lit(0), "__k": F.lit(self.count)})
        for cut in self.cuts:
            out = _descend(out, cut, self.count)
        return out.withColumnRenamed("__node", "shard").drop("__at", "__tie", "__k")

    def write(self, docs: DataFrame, folder: str, files: int = 1) -> None:
        """The documents as one folder for each shard, of so many files."""
        part = F.pmod(F.xxhash64(*[f"`{c}`" for c in self.columns]), F.lit(files))
        self.assign(docs).repartition(self.count * files, "shard", part).write.partitionBy("shard").parquet(folder)

    def slots(self) -> DataFrame:
        """The rows with ``slot``, gapless from 0 within their shard, in the order of a hash: counted by ranges of that hash, so
        that no task numbers more than a range."""
        bits = min(31, (self.total // (self.count * RUN)).bit_length())
        rows = self.rows.withColumn("__h", _bits(F.col("__tie").cast("string").cast("binary"), 8))
        rows = rows.withColumn("__range", F.shiftright("__h", 32 - bits))
        before = W.partitionBy("shard").orderBy("__range").rowsBetween(W.unboundedPreceding, -1)
        ahead = rows.groupBy("shard", "__range").agg(F.count("*").alias("__n")).select("shard", "__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__ahead"))
        within = F.row_number().over(W.partitionBy("shard", "__range").orderBy("__h", "doc_id", "text_crc32", "size")) - 1
        return rows.withColumn("__in", within).join(maybe_broadcast(ahead, self.count << bits, 24), ["shard", "__range"]).withColumn("slot", F.col("__in") + F.col("__ahead"))


def _descend(rows: DataFrame, cut: DataFrame, shards: int) -> DataFrame:
    """One level down: rows of a node that the level cuts go to its left or right child."""
    rest = [c for c in rows.columns if c not in ("__node", "__k")]
    left = _key() < F.col("__limit")
    node = F.when(F.col("__limit").isNull() | left, F.col("__node")).otherwise(F.col("__node") + _half())
    k = F.when(F.col("__limit").isNull(), F.col("__k")).when(left, _half()).otherwise(F.col("__k") - _half())
    return rows.join(maybe_broadcast(cut, shards, 32), "__node", "left").select(*rest, node.alias("__node"), k.alias("__k"))


def _cuts(rows: DataFrame, dims: int, shards: int, work: Workspace) -> DataFrame:
    """Where each node of more than one shard is cut."""
    open_ = rows.filter("__k > 1")
    extent = F.array(*[F.max(F.col("__at")[i]) - F.min(F.col("__at")[i]) for i in range(dims)])
    nodes = open_.groupBy("__node", "__k").agg(F.sum("size").alias("__w"), extent.alias("__e"))
    target = F.expr("(__w div __k) * (__k div 2) + ((__w % __k) * (__k div 2)) div __k")
    cut = nodes.select("__node", F.array_position("__e", F.array_max("__e")).cast("int").alias("__dim"), target.alias("__target"), F.lit(0).cast("long").alias("__prefix"), F.lit(0).cast("long").alias("__below"))
    mask, same = (1 << STEP) - 1, ["__node", "__dim", "__target"]
    for shift in range(COORD + TIE - STEP, -1, -STEP):
        cut = work.table(cut)
        inside = open_.join(maybe_broadcast(cut, shards, 48), "__node").withColumn("__key", _key()).filter(F.shiftright("__key", shift + STEP) == F.col("__prefix"))
        sums = inside.groupBy(*same, "__prefix", "__below", F.shiftright("__key", shift).bitwiseAND(F.lit(mask)).alias("__b")).agg(F.sum("size").alias("__own"))
        through = F.col("__below") + F.sum("__own").over(W.partitionBy("__node").orderBy("__b"))
        reached = sums.withColumn("__through", through).filter("__through >= __target").groupBy(*same, "__prefix").agg(F.min(F.struct("__b", (F.col("__through") - F.col("__own")).alias("below"), "__own")).alias("__r"))
        cut = reached.select(*same, F.shiftleft("__prefix", STEP).bitwiseOR(F.col("__r.__b")).alias("__prefix"), F.col("__r.below").alias("__below"), F.col("__r.__own").alias("__own"))
    nearer = (2 * (F.col("__target") - F.col("__below")) >= F.col("__own")).cast("long")  # the row that the cut falls in
    return work.table(cut.select("__node", "__dim", (F.col("__prefix") + nearer).alias("__limit")))


def shard(docs: DataFrame, count: int | None = None, target_bytes: int | None = None, dims: Sequence[str] = DIMS, id_col: str = "doc_id", text_col: str = "text") -> Shards:
    """Cut the documents into ``count`` shards, or as many as hold ``target_bytes`` each."""
    if (count is None) == (target_bytes is None) or (count or target_bytes) < 1:
        raise ValueError("either a number of shards or their bytes")
    work, ends = Workspace(docs.sparkSession), _ends(docs, dims)
    text = F.col(f"`{text_col}`").cast("string")
    facts = {"size": F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1, "text_crc32": F.crc32(F.coalesce(text, F.lit("")).cast("binary")).cast("long")}
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), *[c.alias(n) for n, c in (facts | _located(docs, dims, ends, id_col, text_col)).items()])
    rows = work.table(rows.withColumns({"__node": F.lit(0), "__k": F.lit(count or 0)}))
    total, weight = rows.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    if count is None:
        count = max(1, -(-weight // target_bytes))
        rows = rows.withColumn("__k", F.lit(count))
    cuts = []
    for _ in range((count - 1).bit_length()):
        cuts.append(_cuts(rows, len(dims), count, work))
        rows = work.table(_descend(rows, cuts[-1], count))
    return Shards(rows.withColumnRenamed("__node", "shard"), cuts, count, total, tuple(dims), ends, (id_col, text_col))
