"""Mixing sources to target weights, with DataFrame functions only.

Each source's words form one stream, its documents in a pseudorandom order, cut into blocks of fixed length. Targets
share the total by weight and stop at a multiple of the source's size; the excess is reshared among the others. Every
output shard draws its slots' sources from the multinomial distribution of the block quotas; what the draws miss of a
quota is settled in one last shard, and draws beyond it are void, so that each source gets exactly its quota. The i-th
slot of a source is mapped by a pseudorandom permutation of the source's block indexes, another one for each pass, and
slots meet blocks by index. No source exceeds its passes, so no block, and no document, is taken more often than that.

Streams are laid out in two levels (buckets by hash, so many that each holds a few thousand documents at most, then documents
within a bucket), so a hot source is not one task. Draws find their source by a join on cells of the range of quotas, where a
large source has many cells and small ones share one; of the sources, only their number and total reach the driver. Windows
over all sources see one row for each.

Defined cases: a null or empty text has size 0 and nothing of it is taken; a null source is a source of its own, last
in order; repeated rows are mixed each on its own, those without an id as well; documents of one id and text are laid out in any
order, which changes nothing; very long texts fill many blocks; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from pairloom.llm.common import WORD_PATTERN, Workspace, maybe_broadcast

WEIGHTS = (5.0, 2.0, 1.0)
BLOCK_WORDS, SHARD_SLOTS, MOST_PASSES = 64, 16_384, 3
BUCKET_ROWS, LEAST_BUCKETS, CELLS, ROUNDS = 4096, 64, 1 << 16, 16


@dataclass
class Mix:
    """documents: doc_id, text_id, size, source_no, source_size, target, start. blocks: source_no, block, doc_id, start, at, length.
    slots: shard, source_no, nth, pass_no, block. All lazy over small staged tables."""

    documents: DataFrame
    blocks: DataFrame
    slots: DataFrame

    def placements(self) -> DataFrame:
        """One row for each document part in each slot: which words (from ``at``, ``length`` of them) go to which shard."""
        return self.slots.join(self.blocks, ["source_no", "block"])

    def taken(self) -> DataFrame:
        """documents with ``taken``: the words taken of each, repeats counted."""
        uses = self.slots.groupBy("source_no", "block").agg(F.count("*").alias("uses"))
        got = self.blocks.join(uses, ["source_no", "block"]).groupBy("source_no", "start").agg(F.sum(F.col("length") * F.col("uses")).alias("got"))
        full = self.documents.filter("size > 0").join(got, ["source_no", "start"], "left").withColumn("taken", F.coalesce("got", F.lit(0).cast("long")))
        none = self.documents.filter("size = 0").withColumn("taken", F.lit(0).cast("long"))
        return full.drop("got").unionByName(none)


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(f"`{text}`"), F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, passes: int = MOST_PASSES) -> DataFrame:
    """source, source_no, source_size, weight, target of sources (source, source_size): one row each, so windows are small.

    In order of cap over weight, the first source whose cap reaches the level that all before it leave fixes the level.
    """
    ordered, everything = W.orderBy(F.asc_nulls_last("source")), W.partitionBy(F.lit(1))
    cyc = F.array(*[F.lit(float(w)) for w in weights])
    s = sizes.withColumn("source_no", F.row_number().over(ordered)).withColumn("weight", F.element_at(cyc, (F.col("source_no") - 1) % len(weights) + 1))
    s = s.withColumn("cap", F.col("source_size") * float(passes)).withColumn("ratio", F.col("cap") / F.col("weight"))
    before = W.orderBy("ratio", "source_no").rowsBetween(W.unboundedPreceding, -1)
    rest = F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    level = rest / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    s = s.withColumn("level", F.greatest(level, F.lit(0.0)))
    found = F.min(F.when(F.col("ratio") >= F.col("level"), F.struct("ratio", "source_no", "level")))
    s = s.withColumn("found", found.over(everything)["level"])
    return s.select("source", "source_no", "source_size", "weight", F.least("cap", F.coalesce(F.col("weight") * F.col("found"), F.col("cap"))).alias("target"))


def permuted(index: Column, n: Column, *key: Column) -> Column:
    """The image of an index under a pseudorandom permutation of 0..n-1 that depends on the key (swap-or-not rounds)."""
    rounds = F.transform(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), lambda r: F.struct(r.alias("r"), F.pmod(F.xxhash64(*key, r), n).alias("k")))

    def step(x: Column, s: Column) -> Column:
        y = F.pmod(s["k"] - x + n, n)
        return F.when(F.xxhash64(*key, s["r"], F.greatest(x, y), F.lit("swap")).bitwiseAND(F.lit(1)) == 1, y).otherwise(x)

    return F.aggregate(rounds, index, step)


def mix(
    docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS, seed: int = 17, text_col: str = "text"
) -> Mix:
    """Lay out the mix of documents (doc_id, source, text)."""
    spark: SparkSession = docs.sparkSession
    work = Workspace(spark)
    sized = work.table(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col(f"`{text_col}`").cast("string")).alias("text_id"), F.col("source").cast("string").alias("source"), word_count(text_col).alias("size")))
    sources = work.table(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights))
    n_blocks = F.ceil(F.col("source_size") / block_words).cast("long")
    quota = F.when(F.col("source_size") > 0, F.least(n_blocks * MOST_PASSES, F.round(F.col("target") * n_blocks / F.col("source_size")))).otherwise(0).cast("long")
    upto = W.orderBy("source_no").rowsBetween(W.unboundedPreceding, 0)
    quotas = sources.select("source_no", n_blocks.alias("n"), quota.alias("quota")).withColumn("hi", F.sum("quota").over(upto))
    quotas = work.table(quotas.withColumn("lo", F.col("hi") - F.col("quota")))
    buckets = max(LEAST_BUCKETS, -(-sized.count() // BUCKET_ROWS))

    # layout of each source's stream
    named = sources.withColumnRenamed("source", "of")
    keyed = sized.join(maybe_broadcast(named, named.count(), 128), F.col("source").eqNullSafe(F.col("of"))).select("doc_id", "text_id", "size", "source_no", "source_size", "target")
    keyed = keyed.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text_id", F.lit(seed)), F.lit(buckets)).cast("int"))
    ahead = W.partitionBy("source_no").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = keyed.groupBy("source_no", "bucket").agg(F.sum("size").alias("all")).select("source_no", "bucket", F.coalesce(F.sum("all").over(ahead), F.lit(0)).alias("offset"))
    within = W.partitionBy("source_no", "bucket").orderBy("doc_id", "text_id", "size").rowsBetween(W.unboundedPreceding, -1)
    placed = keyed.withColumn("inner", F.coalesce(F.sum("size").over(within), F.lit(0))).join(offsets, ["source_no", "bucket"])
    documents = work.table(placed.select("doc_id", "text_id", "size", "source_no", "source_size", "target", (F.col("offset") + F.col("inner")).alias("start")))
    length = F.lit(block_words).cast("long")
    first, last = F.floor(F.col("start") / length), F.floor((F.col("start") + F.col("size") - 1) / length)
    parts = documents.filter("size > 0").select("source_no", "doc_id", "start", "size", F.explode(F.sequence(first, last)).alias("block"))
    begin, end = F.greatest("start", F.col("block") * length), F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * length)
    blocks = parts.select("source_no", "block", "doc_id", "start", (begin - F.col("start")).alias("at"), (end - begin).alias("length"))

    # draws
    total = quotas.agg(F.sum("quota")).first()[0]
    if not total:
        return Mix(documents, blocks, spark.createDataFrame([], "shard long, source_no int, nth long, pass_no long, block long"))
    wide = max(1, total // CELLS)
    cells = quotas.filter("quota > 0").withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") / wide), F.floor((F.col("hi") - 1) / wide))))
    shards = -(-total // shard_slots)
    slots = spark.range(shards * shard_slots).select(F.col("id").alias("slot"), F.floor(F.col("id") / shard_slots).cast("long").alias("shard"))
    slots = slots.withColumn("u", F.pmod(F.xxhash64(F.lit(seed), F.lit("draw"), "slot"), F.lit(total).cast("long"))).withColumn("cell", F.floor(F.col("u") / wide))
    within = F.col("u").between(F.col("lo"), F.col("hi") - 1)
    slots = slots.join(maybe_broadcast(cells, cells.count(), 64), "cell").filter(within).select("slot", "shard", "source_no", "n", "quota")
    counts = work.table(slots.groupBy("shard", "source_no").agg(F.count("*").alias("drawn")))
    sofar = W.partitionBy("source_no").orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    prefix = counts.withColumn("before", F.coalesce(F.sum("drawn").over(sofar), F.lit(0)))
    rank = F.row_number().over(W.partitionBy("shard", "source_no").orderBy("slot"))
    drawn = slots.withColumn("rank", rank).join(prefix, ["shard", "source_no"]).select("shard", "source_no", (F.col("before") + F.col("rank") - 1).alias("nth"), "n", "quota")
    drawn = drawn.filter("nth < quota").drop("quota")
    missing = quotas.join(counts.groupBy("source_no").agg(F.sum("drawn").alias("drawn")), "source_no", "left").withColumn("drawn", F.coalesce("drawn", F.lit(0)))
    settled = missing.filter("drawn < quota").select(F.lit(shards).cast("long").alias("shard"), "source_no", F.explode(F.sequence(F.col("drawn"), F.col("quota") - 1)).alias("nth"), "n")
    every = drawn.unionByName(settled).withColumn("pass_no", F.floor(F.col("nth") / F.col("n")).cast("long"))
    block = permuted(F.pmod(F.col("nth"), F.col("n")), F.col("n"), F.lit(seed), F.col("source_no"), F.col("pass_no"))
    return Mix(documents, blocks, every.select("shard", "source_no", "nth", "pass_no", block.alias("block")))


def mixed_documents(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, seed: int = 17) -> DataFrame:
    """The documents, all columns kept, each as often as the mix takes its words: taken over size, rounded up or down by a
    hash of its id and text so that sums come out right; at most as often as there are passes. Rows without words stay once;
    rows that are the same document are each emitted as often as the one of which most is taken."""
    m = mix(docs, weights, seed=seed).taken()
    even = F.pmod(F.xxhash64("doc_id", "text_id", F.lit(seed), F.lit("round")), F.lit(1 << 20)) / float(1 << 20)
    copies = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size") + even)).otherwise(1).cast("int")
    by_id = m.select(F.col("doc_id").alias("its_id"), F.col("text_id").alias("its_text"), copies.alias("copies")).groupBy("its_id", "its_text").agg(F.max("copies").alias("copies")).filter("copies > 0")
    held = docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64(F.col("text").cast("string")).alias("text_id"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    joined = held.join(by_id, F.col("id").eqNullSafe(F.col("its_id")) & (F.col("text_id") == F.col("its_text")))
    return joined.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
