"""A corpus pipeline in five stages; each is written and read again before the next one starts.

toxic documents go, one document of each near-duplicate class stays, personal data is masked, sources are mixed to
target weights, and the result is packed into sequences.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.llm import mixing, packing, parity_join, pii, toxicity
from pairloom.llm.common import Workspace, fold_of, read


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that score below the threshold of a lexicon learned from the labels' training rows."""
    lexicon = toxicity.learn(docs, read(spark, sf_dir, "labels"), fold_of("doc_id", 3) != 1)
    return toxicity.keep_clean(docs, lexicon)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of a Jaccard of 0.8 or more over five-word shingles."""
    return parity_join.one_of_each(docs)


def masked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a tag in the place of each span of personal data; n_chars follows the text."""
    return pii.mask(docs).withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars")))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mix of sources takes them."""
    return mixing.mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces in sequences of 2,048 tokens."""
    pieces = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").cast("long").alias("ids_crc32"), "sequence_id", "offset")


STAGES = [("toxicity", toxic_out), ("ngram_jaccard_join", one_of_each), ("pii", masked), ("mixing", mixed), ("packing", packed)]

#: Learned weights, sketches and hashed draws have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    work, docs = Workspace(spark), read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = work.table(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
