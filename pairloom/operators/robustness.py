"""What changes when texts change: counterfactual sections, texts without accents, slices of queries; and graded labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.functions.text import strip_accents
from pairloom.operators import matching
from pairloom.operators.evaluation import table

#: Shares and least words of the grades; weights and bounds of the score of a flat text.
GRADE_SHARES, WORD_SHARES, LEAST_COMMON = (0.75, 0.45, 0.20), (0.35, 0.22, 0.12), 15
SECTION_SHARE, LEAST_CHARS, MOST_CHARS = 0.6, 10, 500


def perturbed(sections: DataFrame, name: str, swaps: dict[str, str]) -> DataFrame:
    """Sections (doc_id, section, text) in which words of one section are swapped for others, in the order given."""
    text = F.col("text")
    for old, new in swaps.items():
        text = F.replace(text, F.lit(old), F.lit(new))
    return sections.withColumn("text", F.when(F.col("section") == name, text).otherwise(F.col("text")))


def score_change(before: DataFrame, after: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """One row: mean and largest absolute change of scores (query_id, doc_id, score), and the share that changes by less than the tolerance."""
    both = before.select("query_id", "doc_id", F.col("score").alias("a")).join(after.select("query_id", "doc_id", F.col("score").alias("b")), ["query_id", "doc_id"], "full_outer")
    d = F.abs(F.coalesce("a", F.lit(0.0)) - F.coalesce("b", F.lit(0.0)))
    return both.agg(F.avg(d).alias("mean_change"), F.max(d).alias("max_change"), F.avg((d < tolerance).cast("double")).alias("unchanged"))


def counterfactual(sections: DataFrame, queries: DataFrame, name: str, swaps: dict[str, str], embed, how: str = "weighted", tolerance: float = 0.01) -> DataFrame:
    """``score_change`` of candidates (doc_id, section, text) against queries (doc_id, section, embedding) when a section's words are
    swapped. Only documents whose text changes are embedded again and scored twice."""
    new = perturbed(sections, name, swaps)
    touched = new.withColumnRenamed("text", "new").join(sections, ["doc_id", "section"]).filter("new <> text").select("doc_id").distinct()
    score = lambda s: matching.section_scores(queries, s.join(touched, "doc_id", "left_semi").select("doc_id", "section", embed(F.col("text")).alias("embedding")), "cross", how)
    return score_change(score(sections), score(new), tolerance)


def unaccented(docs: DataFrame, col: str = "text") -> DataFrame:
    return docs.withColumn(col, strip_accents(F.col(col)))


def relative_change(before: DataFrame, after: DataFrame, by: str, value: str) -> DataFrame:
    """by, before, after, change: the change of a value relative to what it was, null where that was 0."""
    both = before.select(by, F.col(value).alias("before")).join(after.select(by, F.col(value).alias("after")), by)
    return both.withColumn("change", F.when(F.col("before") != 0, (F.col("after") - F.col("before")) / F.col("before")))


def by_slice(metrics: DataFrame, slices: DataFrame) -> DataFrame:
    """Mean metrics of the queries of each slice (query_id, slice)."""
    return table(metrics.join(slices, "query_id"), ("slice",))


def grade(required: Column, hit: Column, optional: Column, optional_hit: Column, years: Column, needed: Column, common: Column, words: Column) -> Column:
    """0 to 3 out of counts: required skills and hits, optional skills and hits, common words and the job's words. Without any skills
    the words decide. Too few years, where both sides state them, keep a pair from the best grade."""
    every = required + optional
    share = F.when(required > 0, hit / required).otherwise(1.0)
    whole = (hit + 0.5 * optional_hit) / F.greatest(every, F.lit(1))
    best = F.greatest(share, whole)
    short = F.coalesce((years > 0) & (needed > 0) & (years < needed), F.lit(False))
    by_words = common / F.greatest(words, F.lit(1))
    high, middle, low = GRADE_SHARES
    return (
        F.when(every == 0, F.when(by_words >= WORD_SHARES[0], 3).when(by_words >= WORD_SHARES[1], 2).when(by_words >= WORD_SHARES[2], 1).otherwise(0))
        .when((best >= high) & ~short, 3).when(best >= middle, 2).when((best >= low) | (common >= LEAST_COMMON), 1).otherwise(0)
    )


def flat_score(sims: DataFrame, dense: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """query_id, doc_id, score of whole queries against sections (query_id, doc_id, section, sim): the weighted mean of the named
    sections, and the dense score (query_id, doc_id, score) for the rest of it, or alone where no named section is there."""
    weights = weights or matching.SECTION_WEIGHTS
    w = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])[F.col("section")]
    named = sims.withColumn("w", w).filter("w is not null").groupBy("query_id", "doc_id").agg((F.sum(F.col("w") * F.col("sim")) / F.sum("w")).alias("s"))
    both = dense.join(named, ["query_id", "doc_id"], "left")
    return both.select("query_id", "doc_id", (SECTION_SHARE * F.coalesce("s", "score") + (1 - SECTION_SHARE) * F.col("score")).alias("score"))


def flat_sections(sections: DataFrame) -> DataFrame:
    """Sections (doc_id, section, text) that say something, cut to what is embedded of them."""
    return sections.filter(F.length(F.trim("text")) > LEAST_CHARS).withColumn("text", F.left("text", F.lit(MOST_CHARS)))


def asking(docs: DataFrame, order: str, most: int, text: str = "text", skills: str = "skills") -> DataFrame:
    """The first so many documents, in the source's order, that have enough text and any skill."""
    return docs.filter((F.length(F.trim(text)) > 80) & (F.size(skills) > 0)).orderBy(order).limit(most)
