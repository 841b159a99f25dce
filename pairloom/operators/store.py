"""Changes of the vector table: as plans over tables, and as layers of a ledger that is merged when it is read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.operators.ledger import HIGH, LOW, Ledger
from pairloom.schemas import VECTOR

KEY = ["doc_type", "doc_id"]


def upsert(stored: DataFrame, new: DataFrame) -> DataFrame:
    """The stored rows without lower versions of the new documents and without the new version's own rows, plus the new
    rows. Versions above the new one stay."""
    touched = new.groupBy(*KEY).agg(F.max("version").alias("new_version"))
    kept = stored.join(touched, KEY, "left").filter(F.col("new_version").isNull() | (F.col("version") > F.col("new_version"))).drop("new_version")
    return kept.unionByName(new, allowMissingColumns=True)


def upsert_stats(stored: DataFrame, new: DataFrame) -> DataFrame:
    """One row for each document: upserted, stale (rows of lower versions), leftover (sections that the version no longer has)."""
    touched = new.groupBy(*KEY).agg(F.max("version").alias("new_version"), F.count("*").alias("upserted"))
    old = stored.join(touched.select(*KEY, "new_version"), KEY)
    stale = old.groupBy(*KEY).agg(F.sum((F.col("version") < F.col("new_version")).cast("long")).alias("stale"))
    same = old.filter(F.col("version") == F.col("new_version")).join(new.select(*KEY, "section"), [*KEY, "section"], "left_anti").groupBy(*KEY).agg(F.count("*").alias("leftover"))
    zero = F.lit(0).cast("long")
    return touched.join(stale, KEY, "left").join(same, KEY, "left").select(*KEY, "upserted", F.coalesce("stale", zero).alias("stale"), F.coalesce("leftover", zero).alias("leftover"))


def delete(stored: DataFrame, gone: DataFrame) -> DataFrame:
    """Without the documents of ``gone`` (doc_type, doc_id, version or null for all versions)."""
    whole = gone.filter("version is null").select(*KEY).distinct()
    some = gone.filter("version is not null").select(*KEY, "version").distinct()
    return stored.join(whole, KEY, "left_anti").join(some, [*KEY, "version"], "left_anti")


def reconcile(source: DataFrame, stored: DataFrame) -> DataFrame:
    """doc_type, doc_id, action, version of what must be done: source documents missing from the store (version 1), refreshed
    (next version), and stored ones whose source is gone (orphan). source: doc_type, doc_id."""
    have = stored.groupBy(*KEY).agg(F.max("version").alias("version"))
    both = source.select(*KEY).distinct().withColumn("s", F.lit(True)).join(have, KEY, "full_outer")
    action = F.when(F.col("s").isNull(), "orphan").when(F.col("version").isNull(), "missing").otherwise("refreshed")
    version = F.when(F.col("s").isNull(), F.col("version")).otherwise(F.coalesce("version", F.lit(0)) + 1)
    return both.select(*KEY, action.alias("action"), version.cast("int").alias("version"))


def needs_index(documents: DataFrame, stored: DataFrame, model: str) -> DataFrame:
    """Documents without vectors, or with any of another embedding model."""
    models = stored.groupBy(*KEY).agg(F.collect_set("embedding_model").alias("models"))
    return documents.join(models, KEY, "left").filter(F.col("models").isNull() | (F.col("models") != F.array(F.lit(model)))).select(*KEY)


def indexed(stored: DataFrame, payloads: DataFrame) -> DataFrame:
    """doc_type, doc_id, version whose vectors are all READY and whose payload exists."""
    ready = stored.groupBy(*KEY, "version").agg(F.bool_and(F.col("status") == "READY").alias("ready")).filter("ready")
    return ready.join(payloads, [*KEY, "version"], "left_semi").select(*KEY, "version")


def remaining(queries: DataFrame, done: DataFrame, on: list[str]) -> DataFrame:
    return queries.join(done.select(*on).distinct(), on, "left_anti")


def upsert_cuts(rows: DataFrame) -> DataFrame:
    """What new rows end: versions up to the greatest new one of each document."""
    return rows.groupBy(*KEY).agg(F.max("version").alias("hi")).select(*KEY, F.lit(LOW).alias("lo"), "hi")


def delete_cuts(gone: DataFrame) -> DataFrame:
    """What goes with the documents of ``gone`` (doc_type, doc_id, version or null for all versions)."""
    v = F.col("version").cast("int")
    return gone.select(*KEY, F.coalesce(v, F.lit(LOW)).alias("lo"), F.coalesce(v, F.lit(HIGH)).alias("hi"))


class SnapshotStore(Ledger):
    """The vector table. A store is opened by its path, whether it exists or not; ``create`` writes an empty one. Each change adds
    a layer and returns its number."""

    schema = VECTOR

    def current(self) -> DataFrame:
        return self.read()

    def write(self, df: DataFrame) -> int:
        """These rows and nothing else."""
        return self.commit(df, replace=True)

    def create(self) -> None:
        """An empty snapshot, where there is none yet."""
        if not self.versions():
            self.commit()

    def upsert(self, new: DataFrame, once: tuple[str, int] | None = None) -> int:
        return self.commit(new, upsert_cuts, once=once)

    def upsert_all(self, rows: DataFrame) -> int:
        """Rows of several versions of a document, which replace their own versions only."""
        own = lambda r: r.select(*KEY, F.col("version").alias("lo"), F.col("version").alias("hi")).distinct()
        return self.commit(rows, own)

    def delete(self, gone: DataFrame) -> int:
        return self.commit(cuts=delete_cuts(gone))

    def apply(self, new: DataFrame, gone: DataFrame, once: tuple[str, int] | None = None) -> int:
        """Deletes, and upserts after them, in one commit."""
        return self.commit(new, lambda rows: upsert_cuts(rows).unionByName(delete_cuts(gone)), once=once)

    def count(self, doc_type: str) -> int:
        return self.current().filter(F.col("doc_type") == doc_type).count()
