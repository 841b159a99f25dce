"""How far the sources of a language diverge in their words, with equal count columns evaluated once.

A term's counts in the sources of its language are a sparse vector. Terms with the same vector add the same to every pair of
sources, so each pair is evaluated once for each distinct vector and multiplied by the number of its terms; only the ranking
of single terms goes back to the terms. The divergence of a pair over all terms is put together from what needs evaluation:
the terms that neither source has, all alike; the counts of either source against zero, alike for equal counts; and, for the
vectors that hold both, the difference that this makes.

All arithmetic is exact: shares in parts of a billion from decimals, everything else in whole 64-bit numbers.

Defined results: null text, language and source are empty texts. A (language, source) group without terms takes part with its
smoothed shares; in a language without kept terms every pair has the value 0 and there are no terms. Repeated rows are documents of
their own. A language with one source has no pairs. Texts are read whole; other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from pairloom.llm.common import Workspace, maybe_broadcast, sliced, tidied

_TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
#: Documents of a language that a term must be in; terms listed of a group; terms that a task counts before it hands them on.
LEAST_DOCS, TOP, HELD = 10, 10, 400_000


def tallies(docs: DataFrame) -> DataFrame:
    """lang, source, term, n, docs: occurrences and documents, summed within the tasks. docs: lang, source, text."""

    def told(counts: dict) -> pa.RecordBatch:
        rows = [(lang, source, term, n, held[1][term]) for (lang, source), held in counts.items() for term, n in held[0].items()]
        counts.clear()
        kinds = {"lang": pa.string(), "source": pa.string(), "term": pa.string(), "n": pa.int64(), "docs": pa.int64()}
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds.values())], names=list(kinds))

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, size = defaultdict(lambda: (Counter(), Counter())), 0
        for b in sliced(batches):
            for lang, source, text in zip(*[b.column(i).to_pylist() for i in range(3)], strict=True):
                found = _TERM.findall(text.encode().lower().decode())
                n, documents = counts[lang, source]
                size -= len(n)
                n.update(found)
                documents.update(set(found))
                size += len(n)
                if size > HELD:
                    yield told(counts)
                    size = 0
        yield told(counts)

    return docs.mapInArrow(run, "lang string, source string, term string, n long, docs long")


def share(count: Column, base: Column) -> Column:
    """1 + floor(10^9 (count + 2) / base), in decimals, for the product outgrows 64 bits."""
    return F.lit(1).cast("long") + F.call_function("div", F.lit(1_000_000_000).cast("decimal(10,0)") * (count.cast("decimal(18,0)") + 2), base.cast("decimal(38,0)"))


def gap(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)); shares are at most 10^9 + 1, so the square fits."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """lang, source, part, item, value, rank. Part ``pair``: the other sources of the language, by divergence; part ``term``: the
    ``top`` terms that the source has more of than its language, by their part in the divergence from it."""
    work = Workspace(docs.sparkSession)
    blank = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    docs = docs.select(blank(lang_col).alias("lang"), blank(source_col).alias("source"), blank(text_col).alias("text"))

    # One exchange by (lang, term) serves both sums; within the tasks the counts are summed already.
    cells = tallies(docs).repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    vector = F.sort_array(F.collect_list(F.struct("source", "n"))).alias("vec")
    terms = cells.groupBy("lang", "term").agg(vector, F.sum("n").alias("total"), F.sum("docs").alias("docs")).filter(F.col("docs") >= least_docs)
    terms = work.table(terms.drop("docs"))

    sums = terms.select("lang", F.explode("vec").alias("c")).groupBy("lang", F.col("c.source").alias("source")).agg(F.sum("c.n").alias("n"))
    langs = terms.groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("n_lang"))
    zero = F.lit(0).cast("long")
    groups = docs.select("lang", "source").distinct().join(sums, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.select("lang", "source", F.coalesce("v", zero).alias("v"), (F.coalesce("n", zero) + 2 * F.coalesce("v", zero)).alias("base"), (F.coalesce("n_lang", zero) + 2 * F.coalesce("v", zero)).alias("base_lang"))
    groups = work.table(groups.withColumn("p0", F.when(F.col("v") > 0, share(zero, F.col("base"))).otherwise(zero)))
    n_groups = groups.count()
    small = lambda df: maybe_broadcast(df, n_groups, 128)

    firsts = terms.withColumn("r", F.row_number().over(W.partitionBy("lang", "vec").orderBy("term"))).filter(F.col("r") <= top)
    firsts = firsts.groupBy("lang", "vec").agg(F.collect_list("term").alias("firsts"))
    vectors = terms.groupBy("lang", "vec").agg(F.count("*").alias("m"), F.first("total").alias("total")).join(firsts, ["lang", "vec"])
    vectors = work.table(vectors.withColumn("vid", F.monotonically_increasing_id()))
    entries = vectors.select("vid", "lang", "m", "total", F.explode("vec").alias("c")).select("vid", "lang", "m", "total", F.col("c.source").alias("source"), F.col("c.n").alias("n"))
    entries = work.table(entries.join(small(groups), ["lang", "source"]).withColumn("p", share(F.col("n"), F.col("base"))))

    # What is left of the pairs after the terms that neither has: first each source's counts against zeros, ...
    other = groups.select("lang", F.col("source").alias("other"), F.col("p0").alias("q0"))
    alone = entries.groupBy("lang", "source", "p", "p0").agg(F.sum("m").alias("m")).join(small(other), "lang").filter("source <> other")
    alone = alone.select("lang", F.least("source", "other").alias("a"), F.greatest("source", "other").alias("b"), (F.col("m") * (gap(F.col("p"), F.col("q0")) - gap(F.col("p0"), F.col("q0")))).alias("value"))
    # ... then what vectors that hold both add to that.
    both = entries.groupBy("vid", "lang", "m").agg(F.sort_array(F.collect_list(F.struct("source", "p", "p0"))).alias("es"))
    both = both.select("lang", "m", "es", F.posexplode("es").alias("i", "x")).select("lang", "m", "x", F.explode(F.expr("slice(es, i + 2, size(es))")).alias("y"))
    xp, x0, yp, y0 = (F.col(c) for c in ("x.p", "x.p0", "y.p", "y.p0"))
    both = both.select("lang", F.col("x.source").alias("a"), F.col("y.source").alias("b"), (F.col("m") * (gap(xp, yp) - gap(xp, y0) - gap(x0, yp) + gap(x0, y0))).alias("value"))
    added = alone.unionByName(both).groupBy("lang", "a", "b").agg(F.sum("value").alias("added"))

    pairs = groups.select("lang", "v", F.col("source").alias("a"), "p0").join(small(other), "lang").filter("a < other")
    base = F.when(F.col("v") > 0, F.col("v") * gap(F.col("p0"), F.col("q0"))).otherwise(zero)
    pairs = pairs.select("lang", "a", F.col("other").alias("b"), base.alias("base")).join(added, ["lang", "a", "b"], "left")
    pairs = pairs.withColumn("value", F.col("base") + F.coalesce("added", zero))
    ways = F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))
    pairs = pairs.select("lang", F.explode(ways).alias("w"), "value").select("lang", "w.source", F.lit("pair").alias("part"), "w.item", "value")

    marked = entries.withColumn("q", share(F.col("total"), F.col("base_lang"))).filter("p > q").select("vid", "lang", "source", gap(F.col("p"), F.col("q")).alias("value"))
    marked = marked.join(vectors.select("vid", "firsts"), "vid").select("lang", "source", F.lit("term").alias("part"), F.explode("firsts").alias("item"), "value")

    place = F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return pairs.withColumn("rank", place).unionByName(marked.withColumn("rank", place).filter(F.col("rank") <= top)).withColumn("rank", F.col("rank").cast("int"))
