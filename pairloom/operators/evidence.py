"""Which passages stand in which texts, all passages in one pass over each text."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.operators.staging import BLOCK

#: Passages of a block hold at most so many characters, for an automaton takes some hundred bytes for each.
BLOCK_CHARS = 4_000_000


def holding(texts: DataFrame, passages: DataFrame) -> DataFrame:
    """doc_id, item_id of every text (doc_id, t) that holds a passage (item_id, e) whole. Empty passages are nowhere. Passages come in
    blocks of bounded size; a block is an automaton that each task runs over its texts."""
    asked = passages.filter(F.col("e") != "").select(F.col("item_id").cast("long").alias("item_id"), "e")
    size = asked.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("e")), F.lit(0)).alias("chars")).first()
    blocks, out = max(1, -(-size.n // BLOCK), -(-size.chars // BLOCK_CHARS)), None
    schema = f"doc_id {dict(texts.dtypes)['doc_id']}, item_id long"
    for i in range(blocks):
        rows = (asked if blocks == 1 else asked.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == i)).toArrow().to_pylist()
        items: dict[str, list[int]] = {}
        for r in rows:
            items.setdefault(r["e"], []).append(r["item_id"])

        def run(batches: Iterator[pa.RecordBatch], items=items) -> Iterator[pa.RecordBatch]:
            machine = ahocorasick.Automaton()
            for e in items:
                machine.add_word(e, e)
            if items:
                machine.make_automaton()
            for b in batches:
                ids, found, there = b.column(0), [], []
                for k, t in enumerate(b.column(1).to_pylist() if items else ()):
                    for e in {e for _, e in machine.iter(t or "")}:
                        found += items[e]
                        there += [k] * len(items[e])
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(there, pa.int64())), pa.array(found, pa.int64())], ["doc_id", "item_id"])

        part = texts.select("doc_id", "t").mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out
