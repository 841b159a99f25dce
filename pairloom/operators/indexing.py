"""Indexing a corpus: its sections are embedded in one pass, and the vector table and the payload table move in step."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.operators.acl import vector_id
from pairloom.operators.sections import section_texts
from pairloom.operators.store import KEY, SnapshotStore
from pairloom.schemas import PAYLOAD, VECTOR

Embedder = Callable[[Column], Column]


def guarded(embed: Embedder) -> Embedder:
    """The embedder, for texts that must say something: a blank one is an error and not a vector."""

    def run(text: Column) -> Column:
        blank = F.coalesce(F.trim(text), F.lit("")) == ""
        return embed(F.when(blank, F.raise_error(F.lit("a blank text cannot be embedded"))).otherwise(text))

    return run


def embed_corpus(docs: DataFrame, embed: Embedder, model: str, version: int | Column = 1) -> DataFrame:
    """Rows of the vector table for documents (doc_id, doc_type, lang, raw_text, sections, and where there are such columns
    version, status, visibility, owner_id): one for each non-blank section and one for the whole text."""
    given = lambda name, default: F.col(name) if name in docs.columns else default
    facts = docs.select(
        "doc_id", "doc_type", F.col("lang").alias("language"), given("version", version if isinstance(version, Column) else F.lit(version)).cast("int").alias("version"),
        F.coalesce(given("status", F.lit("READY")), F.lit("READY")).alias("status"), F.coalesce(given("visibility", F.lit("public")), F.lit("public")).alias("visibility"), F.coalesce(given("owner_id", F.lit("")), F.lit("")).alias("owner_id"),
    )
    rows = section_texts(docs).join(facts, "doc_id")
    rows = rows.withColumns({"embedding": guarded(embed)(F.col("text")), "embedding_model": F.lit(model), "content_hash": F.sha2("text", 256), "vector_id": vector_id(F.col("doc_type"), F.col("doc_id"), F.col("version"), F.col("section"))})
    return rows.select(*[c.split()[0] for c in VECTOR.split(", ")])


def index_corpus(store: SnapshotStore, docs: DataFrame, embed: Embedder, model: str, version: int = 1, limit: int | None = None, clear: bool = False) -> DataFrame:
    """Embed documents and put them into the store, all in one commit; with ``clear`` the store holds nothing else afterwards,
    with ``limit`` only the first so many by id are indexed. Returns what was added to each document."""
    docs = docs.orderBy("doc_id").limit(limit) if limit else docs
    rows = embed_corpus(docs, embed, model, version)
    if clear:
        store.write(rows)
    else:
        store.upsert(rows)
    done = docs.select(*KEY).distinct()
    return store.current().join(done, KEY, "left_semi").groupBy(*KEY, "version").agg(F.count("*").alias("upserted"))


def index_document(store: SnapshotStore, docs: DataFrame, doc_id: str, embed: Embedder, model: str, version: int = 1) -> DataFrame:
    """The same for one document of a table."""
    return index_corpus(store, docs.filter(F.col("doc_id") == doc_id), embed, model, version)


class PayloadStore(SnapshotStore):
    """Extracted payloads by document and version, in a ledger like the vectors."""

    schema = PAYLOAD

    def get(self, doc_type: str, doc_id: str) -> DataFrame:
        return self.point_read(doc_type, doc_id)

    def ids(self, doc_type: str) -> DataFrame:
        return self.current().filter(F.col("doc_type") == doc_type).select("doc_id").distinct()


class Index:
    """The two tables of a service. Vectors come first and go last, so that a payload never stands without them."""

    def __init__(self, spark: SparkSession, path: str, embed: Embedder, model: str):
        self.vectors, self.payloads = SnapshotStore(spark, f"{path}/vectors"), PayloadStore(spark, f"{path}/payloads")
        self.embed, self.model = embed, model

    def put(self, docs: DataFrame, version: int = 1) -> DataFrame:
        """Index documents (with a column payload, JSON) and keep their payloads; returns what was added."""
        added = index_corpus(self.vectors, docs, self.embed, self.model, version)
        self.payloads.upsert(docs.select("doc_type", "doc_id", F.lit(version).alias("version"), "payload"))
        return added

    def remove(self, gone: DataFrame) -> None:
        """Documents (doc_type, doc_id, version or null for all) leave both tables."""
        self.payloads.delete(gone)
        self.vectors.delete(gone)

    def with_payloads(self, hits: DataFrame) -> DataFrame:
        """Hits (doc_type, doc_id, ...) that have a payload, with it."""
        return hits.join(self.payloads.current().select(*KEY, "payload"), KEY)
