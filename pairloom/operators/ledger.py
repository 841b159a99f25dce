"""A table as a log of commits over immutable layers, merged when it is read.

A commit adds one layer: rows, and cuts that say which older rows are gone (a key and a range of versions). Nothing that is
stored is rewritten: a row counts if no younger layer cuts it. Each commit is a numbered entry that lists all layers; the entry is put
only where its number is not yet taken, so of two writers one wins and the other looks again. What a change has read is
guarded by bucket: a commit that touched one of the same buckets meanwhile makes it a ``Conflict``, and ``transact`` runs it
anew; changes that read nothing, and changes of other buckets, are only renumbered. Readers keep the layers of their snapshot
until ``prune`` takes them.

Entries need a file system with an atomic way to create a name: a hard link on local and mounted ones, a rename that refuses
an existing target elsewhere (as HDFS has it).
"""

from __future__ import annotations

import contextlib
import json
import os
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.operators.staging import BROADCAST_BYTES

BUCKETS = 16
#: Layers that a reader merges at most before they are compacted; a layer joins its elders when it is at least so many parts of them.
MOST, PART = 8, 4
LOW, HIGH = -(2**31), 2**31 - 1
Cuts = DataFrame | Callable[[DataFrame], DataFrame]


class Conflict(RuntimeError):
    """Another commit has changed what this one is based on."""


@dataclass(frozen=True)
class Layer:
    folder: str
    seq: int
    rows: int
    cuts: int
    buckets: tuple[int, ...]


@dataclass(frozen=True)
class Snapshot:
    """The state after commit ``seq``. changed: buckets of that commit; done: the last batch of each writer that numbers them."""

    seq: int = 0
    layers: tuple[Layer, ...] = ()
    changed: tuple[int, ...] = ()
    done: dict[str, int] = field(default_factory=dict)


class Ledger:
    """Subclasses name the schema, the key columns and the version column."""

    schema: str
    key: tuple[str, ...] = ("doc_type", "doc_id")
    version = "version"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    # ---- entries

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _entry(self, seq: int) -> str:
        return f"{self.path}/commits/{seq:012d}.json"

    def versions(self) -> list[int]:
        """Numbers of the commits whose snapshots can be read."""
        fs, p = self._fs(f"{self.path}/commits")
        if not fs.exists(p):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(p)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def snapshot(self, seq: int | None = None) -> Snapshot:
        """Of that commit, or of the last one."""
        if seq is None:
            seq = (self.versions() or [0])[-1]
        if not seq:
            return Snapshot()
        fs, p = self._fs(self._entry(seq))
        stream = fs.open(p)
        try:
            found = json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()
        layers = tuple(Layer(**{**x, "buckets": tuple(x["buckets"])}) for x in found["layers"])
        return Snapshot(found["seq"], layers, tuple(found["changed"]), found["done"])

    def _put(self, entry: Snapshot) -> bool:
        """Whether the entry is in place now; not if its number was taken."""
        text, draft = json.dumps(asdict(entry)), f"{self.path}/commits/draft-{uuid.uuid4().hex}"
        fs, target = self._fs(self._entry(entry.seq))
        if fs.getScheme() == "file":
            name, draft = target.toUri().getPath(), self._fs(draft)[1].toUri().getPath()
            os.makedirs(os.path.dirname(name), exist_ok=True)
            with open(draft, "w") as f:
                f.write(text)
            try:
                os.link(draft, name)
            except FileExistsError:
                return False
            finally:
                os.unlink(draft)
            return True
        source = self._fs(draft)[1]
        out = fs.create(source, False)
        out.write(bytearray(text.encode()))
        out.close()
        if not fs.exists(target) and fs.rename(source, target):
            return True
        fs.delete(source, False)
        return False

    # ---- layers

    def _bucket(self):
        return F.pmod(F.xxhash64(*[F.col(c).cast("string") for c in self.key]), F.lit(BUCKETS)).cast("int")

    def _names(self) -> list[str]:
        return [c.split()[0] for c in self.schema.split(", ")]

    def _aligned(self, rows: DataFrame) -> DataFrame:
        kinds = dict(c.split(maxsplit=1) for c in self.schema.split(", "))
        return rows.select(*[(F.col(c) if c in rows.columns else F.lit(None)).cast(k).alias(c) for c, k in kinds.items()])

    def _cut_schema(self) -> str:
        return ", ".join([f"{c} string" for c in self.key] + ["lo int", "hi int"])

    def _write(self, rows: DataFrame | None, cuts: Cuts | None) -> Layer:
        """A layer that no entry names yet. Cuts may be made from the rows as they were written."""
        folder, n_rows, n_cuts, buckets = f"{self.path}/data/{uuid.uuid4().hex}", 0, 0, set()

        def put(df: DataFrame, part: str) -> int:
            out = df.withColumn("__bucket", self._bucket()).hint("rebalance", "__bucket")
            out.write.partitionBy("__bucket").parquet(f"{folder}/{part}")
            found = self.spark.read.schema("__bucket int").parquet(f"{folder}/{part}").groupBy("__bucket").count().collect()
            buckets.update(r["__bucket"] for r in found)
            return sum(r["count"] for r in found)

        if rows is not None:
            n_rows = put(self._aligned(rows), "rows")
        if callable(cuts):
            cuts = cuts(self._stored(folder))
        if cuts is not None:
            n_cuts = put(cuts.select(*[F.col(c).cast("string").alias(c) for c in self.key], "lo", "hi"), "cuts")
        return Layer(folder, 0, n_rows, n_cuts, tuple(sorted(buckets)))

    def _stored(self, folder: str) -> DataFrame:
        return self.spark.read.schema(f"{self.schema}, __bucket int").parquet(f"{folder}/rows")

    def _merged(self, layers: tuple[Layer, ...], only: int | None = None) -> DataFrame:
        """Rows of the layers that no younger one of them cuts; of one bucket, if that is given."""
        here = lambda df: df if only is None else df.filter(F.col("__bucket") == only)
        held = [here(self._stored(x.folder)).withColumn("__seq", F.lit(x.seq)) for x in layers if x.rows]
        if not held:
            return self.spark.createDataFrame([], self.schema)
        rows, oldest = reduce(DataFrame.unionByName, held), min(x.seq for x in layers if x.rows)
        young = [x for x in layers if x.cuts and x.seq > oldest]
        if young:
            cuts = reduce(DataFrame.unionByName, [here(self.spark.read.schema(f"{self._cut_schema()}, __bucket int").parquet(f"{x.folder}/cuts")).withColumn("__by", F.lit(x.seq)) for x in young])
            names = {c: f"__k{i}" for i, c in enumerate(self.key)}
            cuts = cuts.select(*[F.col(c).alias(k) for c, k in names.items()], "lo", "hi", "__by")
            if sum(x.cuts for x in young) * 64 <= BROADCAST_BYTES:
                cuts = F.broadcast(cuts)
            same = reduce(lambda a, b: a & b, [F.col(c).cast("string") == F.col(k) for c, k in names.items()])
            version = F.coalesce(F.col(self.version), F.lit(0))
            rows = rows.join(cuts, same & (F.col("__by") > F.col("__seq")) & version.between(F.col("lo"), F.col("hi")), "left_anti")
        return rows.select(*self._names())

    def read(self, at: Snapshot | None = None) -> DataFrame:
        return self._merged((at or self.snapshot()).layers)

    def added(self, seq: int) -> DataFrame:
        """The rows that a commit brought."""
        new = [x for x in self.snapshot(seq).layers if x.seq == seq and x.rows]
        return self._stored(new[0].folder).select(*self._names()) if new else self.spark.createDataFrame([], self.schema)

    # ---- changes

    def commit(self, rows: DataFrame | None = None, cuts: Cuts | None = None, base: Snapshot | None = None, once: tuple[str, int] | None = None, replace: bool = False) -> int:
        """Add a layer; its number. base: the snapshot that the rows were made from, if any (then no rows and no cuts are no commit: 0). once: writer and number of a batch; a batch
        that is there already is not added again. replace: nothing older stays."""
        repeated = lambda s: once is not None and s.done.get(once[0], -1) >= once[1]
        if repeated(head := self.snapshot()):
            return head.seq
        layer, seen = self._write(rows, cuts), base.seq if base else None
        if base is not None and not layer.rows and not layer.cuts:
            self._drop(layer.folder)
            return 0
        while True:
            head = self.snapshot()
            try:
                if repeated(head):
                    raise Conflict
                if seen is not None:
                    for n in range(seen + 1, head.seq + 1):
                        if set(self.snapshot(n).changed) & set(layer.buckets):
                            raise Conflict(f"commit {n} changed the same buckets")
                    seen = head.seq
            except Exception as e:  # also an entry that was pruned meanwhile: what it changed cannot be known
                self._drop(layer.folder)
                if repeated(head):
                    return head.seq
                raise e if isinstance(e, Conflict) else Conflict(str(e)) from e
            seq = head.seq + 1
            mine = Layer(layer.folder, seq, layer.rows, layer.cuts, layer.buckets)
            kept = () if replace else head.layers
            changed = tuple(sorted({*layer.buckets, *(b for x in head.layers for b in x.buckets if replace)}))
            if self._put(Snapshot(seq, (*kept, mine), changed, head.done | ({once[0]: once[1]} if once else {}))):
                return seq

    def transact(self, change: Callable[[DataFrame], tuple[DataFrame | None, Cuts | None]], tries: int = 20) -> int:
        """A change made from what the table holds, again and again until nobody was faster."""
        for _ in range(tries):
            base = self.snapshot()
            with contextlib.suppress(Conflict):
                return self.commit(*change(self.read(base)), base=base)
        raise Conflict(f"given up after {tries} tries")

    def compact(self, most: int = MOST) -> bool:
        """Merge the youngest layers, with all elders that they have grown to a part of; beyond ``most`` layers only. The rest is not
        touched. Whether it was done: not, if another one has merged the same layers meanwhile."""
        head = self.snapshot()
        if len(head.layers) <= most:
            return False
        weight = lambda x: x.rows + x.cuts
        take = 2
        while take < len(head.layers) and PART * sum(map(weight, head.layers[-take:])) >= weight(head.layers[-take - 1]):
            take += 1
        old, young = head.layers[:-take], head.layers[-take:]
        cuts = [self.spark.read.schema(f"{self._cut_schema()}, __bucket int").parquet(f"{x.folder}/cuts") for x in young if x.cuts] if old else []
        new = self._write(self._merged(young), reduce(DataFrame.unionByName, cuts).distinct() if cuts else None)
        merged = Layer(new.folder, young[-1].seq, new.rows, new.cuts, new.buckets)
        while True:
            head = self.snapshot()
            if head.layers[len(old) : len(old) + take] != young:
                self._drop(new.folder)
                return False
            if self._put(Snapshot(head.seq + 1, (*head.layers[: len(old)], merged, *head.layers[len(old) + take :]), (), head.done)):
                return True

    def _drop(self, folder: str) -> None:
        fs, p = self._fs(folder)
        fs.delete(p, True)

    def prune(self, keep: int = 2) -> None:
        """Drop all but the last so many snapshots, and the layers that only they hold."""
        found = self.versions()
        gone, kept = [self.snapshot(n) for n in found[:-keep]], [self.snapshot(n) for n in found[-keep:]]
        for folder in {x.folder for s in gone for x in s.layers} - {x.folder for s in kept for x in s.layers}:
            self._drop(folder)
        for s in gone:
            self._drop(self._entry(s.seq))

    # ---- by key

    def point_read(self, kind: str, name: str, version: int | None = None) -> DataFrame:
        """Rows of one key, from its bucket alone."""
        at = self.spark.range(1).select(F.pmod(F.xxhash64(F.lit(kind), F.lit(name)), F.lit(BUCKETS)).cast("int")).first()[0]
        rows = self._merged(self.snapshot().layers, at).filter((F.col(self.key[0]) == kind) & (F.col(self.key[1]) == name))
        return rows.filter(F.col(self.version) == version) if version is not None else rows
