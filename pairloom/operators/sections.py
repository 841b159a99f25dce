"""Splitting texts into named sections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from pairloom.functions.text import heading_name, is_heading, slug, strip

LINE_BREAK = r"\r\n|[\n\r\x0b\f\x1c-\x1e\x85\u2028\u2029]"


def split_sections(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ord, name, heading, text: a heading line opens a section; what stands before the first is the preamble.
    Blank bodies are kept under a heading and dropped without one; a name that repeats gets _2, _3, ..."""
    lines = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(F.split(F.col(text_col), LINE_BREAK, -1)).alias("pos", "line"))
    lines = lines.withColumn("head", (F.trim("line") != "") & is_heading(F.col("line")))
    running = W.partitionBy("doc_id").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    lines = lines.withColumn("ord", F.sum(F.col("head").cast("int")).over(running))
    body = F.array_sort(F.collect_list(F.when(~F.col("head"), F.struct("pos", "line"))))
    s = lines.groupBy("doc_id", "ord").agg(F.max(F.when(F.col("head"), F.col("line"))).alias("heading"), strip(F.array_join(F.transform(body, lambda x: x["line"]), "\n")).alias("text"))
    s = s.filter((F.col("ord") > 0) | (F.col("text") != ""))
    base = F.when(F.col("ord") == 0, "preamble").otherwise(F.coalesce(heading_name(F.col("heading")), slug(F.col("heading"))))
    s = s.withColumn("base", base)
    nth = F.row_number().over(W.partitionBy("doc_id", "base").orderBy("ord"))
    s = s.withColumn("nth", nth)
    name = F.when(F.col("nth") == 1, F.col("base")).otherwise(F.concat_ws("_", "base", F.col("nth").cast("string")))
    return s.select("doc_id", F.col("ord").cast("int").alias("ord"), name.alias("name"), F.coalesce(strip(F.col("heading")), F.lit("")).alias("heading"), "text")


def section_texts(docs: DataFrame) -> DataFrame:
    """doc_id, section, text: non-blank sections, stripped, and the whole text as ``_full`` (docs: doc_id, raw_text, sections map)."""
    some = docs.select("doc_id", F.explode("sections").alias("section", "s")).select("doc_id", "section", strip(F.col("s.text")).alias("text"))
    full = docs.select("doc_id", F.lit("_full").alias("section"), strip(F.col("raw_text")).alias("text"))
    return some.unionByName(full).filter("text <> ''")


def resplit(docs: DataFrame) -> DataFrame:
    """The documents (doc_id, raw_text, ...) with their sections made anew from the raw text: a map by name; no section gives an empty one."""
    parts = split_sections(docs, "doc_id", "raw_text")
    entry = F.struct("name", F.struct("name", "text", F.col("heading").alias("heading_raw"), "ord"))
    maps = parts.groupBy("doc_id").agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("sections"))
    empty = F.create_map().cast("map<string,struct<name:string,text:string,heading_raw:string,ord:int>>")
    return docs.drop("sections").join(maps, "doc_id", "left").withColumn("sections", F.coalesce("sections", empty))
