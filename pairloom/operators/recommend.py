"""From nearest vectors to recommendations: a pool, a score, the access policy, the best k; and what explains them."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.functions import hybrid
from pairloom.functions.payload import CLAIM, grounded_claims
from pairloom.functions.text import salvaged_json
from pairloom.functions.vectors import clamp01
from pairloom.operators import acl, matching
from pairloom.operators.ranking import fuse, ranked

PARTS = ("semantic", "skills", "experience", "budget", "preferences")
#: Most explained rows of a ranking, most claims of an explanation.
MOST_EXPLAINED, MOST_CLAIMS = 50, 12


def structured_parts(pairs: DataFrame, requirements: DataFrame, profiles: DataFrame) -> DataFrame:
    """The five components of pairs (query_id, doc_id, score) out of requirements (id, required, optional, min_years, budget,
    preferences) and profiles (id, skills, years, budget, preferences); pairs without either record drop out."""
    known = lambda d: d.filter(F.coalesce(F.trim(F.col("id").cast("string")), F.lit("")) != "")
    r = known(requirements).select(F.col("id").alias("query_id"), F.struct(*[c for c in requirements.columns if c != "id"]).alias("r"))
    p = known(profiles).select(F.col("id").alias("doc_id"), F.struct(*[c for c in profiles.columns if c != "id"]).alias("p"))
    j = pairs.join(r, "query_id").join(p, "doc_id")
    return j.select(
        "query_id", "doc_id", clamp01(F.col("score")).alias("semantic"), hybrid.skills_score(F.col("p.skills"), F.col("r.required"), F.col("r.optional")).alias("skills"),
        hybrid.experience_score(F.col("p.years"), F.col("r.min_years")).alias("experience"), hybrid.budget_score(F.col("r.budget.min"), F.col("r.budget.max"), F.col("p.budget.min"), F.col("p.budget.max")).alias("budget"),
        hybrid.preferences_score(F.col("r.preferences"), F.col("p.preferences")).alias("preferences"),
    )


def rank_records(pairs: DataFrame, requirements: DataFrame, profiles: DataFrame, k: int | None = None, weights: dict[str, float] | None = None) -> DataFrame:
    """query_id, doc_id, the components, score and rank of pairs by their records."""
    parts = structured_parts(pairs, requirements, profiles)
    return ranked(parts.withColumn("score", F.round(hybrid.hybrid_score({c: F.col(c) for c in PARTS}, weights), 6)), k)


def recommend(hits: DataFrame, size: int, k: int, rows: DataFrame | None = None, requirements: DataFrame | None = None, profiles: DataFrame | None = None, keyword: DataFrame | None = None, alpha: float = 0.5, **context) -> DataFrame:
    """query_id, doc_id, components, score, rank: the nearest vectors (query_id, doc_id, version, distance) give a pool, which is
    scored by similarity alone or with the records, fused with keyword scores where there are any, cut to what the caller may see
    (rows: an access table; context: the caller), and then to the best k."""
    found = matching.pool(hits, size).select("query_id", "doc_id", (1 - F.col("distance")).alias("score"))
    if requirements is not None and profiles is not None:
        scored = structured_parts(found, requirements, profiles).withColumn("score", hybrid.hybrid_score({c: F.col(c) for c in PARTS}))
    else:
        empty = {c: F.lit(None).cast("double") for c in PARTS[1:]}
        scored = found.withColumn("semantic", clamp01(F.col("score"))).withColumns(empty).withColumn("score", F.col("semantic"))
    if keyword is not None:
        mine = keyword.join(scored.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_semi")
        fused = fuse(scored.select("query_id", "doc_id", "score"), mine, alpha)
        scored = scored.drop("score").join(fused, ["query_id", "doc_id"]).join(mine.select("query_id", "doc_id", F.col("score").alias("keyword")), ["query_id", "doc_id"], "left")
    else:
        scored = scored.withColumn("keyword", F.lit(None).cast("double"))
    if rows is not None:
        scored = acl.gate(scored, rows, **context)
    return ranked(scored.withColumn("score", F.round("score", 6)), k)


def items(recommendations: DataFrame, sections: DataFrame | None = None) -> DataFrame:
    """query_id, rank, id, score, components (one struct) and the similarities of sections (query_id, doc_id, section, sim) as a map."""
    out = recommendations.select("query_id", "rank", F.col("doc_id").alias("id"), "score", F.struct(*PARTS, "keyword").alias("components"))
    if sections is None:
        return out.withColumn("section_components", F.create_map().cast("map<string,double>"))
    maps = sections.groupBy("query_id", F.col("doc_id").alias("id")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("section", "sim")))).alias("section_components"))
    return out.join(maps, ["query_id", "id"], "left")


def template(skills: Column, wanted: Column) -> Column:
    """struct<summary, claims> without any model: which of the wanted names the candidate has."""
    named = lambda c: F.transform(F.coalesce(c, F.array().cast("array<string>")), hybrid.normalize_skill)
    # A lambda's variable is evaluated once a row; a column that a lambda looks into would be evaluated for each element.
    once = lambda value, use: F.transform(F.array(value), use)[0]

    def claim(x: Column, have: Column) -> Column:
        hit = F.array_contains(have, x)
        return F.struct(x.alias("statement"), F.when(hit, "hit").otherwise("missing").alias("verdict"), x.alias("evidence"), F.when(hit, "cv").otherwise("job").alias("source"), F.lit(1.0).alias("confidence"))

    def told(claims: Column) -> Column:
        hits = F.size(F.filter(claims, lambda c: c["verdict"] == "hit"))
        return F.struct(F.concat(hits.cast("string"), F.lit(" of "), F.size(claims).cast("string"), F.lit(" wanted skills")).alias("summary"), claims.alias("claims"))

    both = F.struct(named(skills).alias("have"), F.slice(F.array_distinct(named(wanted)), 1, MOST_CLAIMS).alias("want"))
    return once(both, lambda p: once(F.transform(p["want"], lambda x: claim(x, p["have"])), told))


def replies(prompt: Column, ask: Callable[[str], str]) -> Column:
    """struct<reply, failure> of an external model, asked row by row in batches; a call that fails costs its row alone."""

    @F.pandas_udf("reply string, failure string")
    def udf(s: pd.Series) -> pd.DataFrame:
        out = []
        for p in s:
            try:
                out.append((ask(p), None))
            except Exception as e:
                out.append((None, getattr(e, "code", None) or type(e).__name__))
        return pd.DataFrame(out, columns=["reply", "failure"])

    return udf(prompt)


def explained(pairs: DataFrame, ask: Callable[[str], str]) -> DataFrame:
    """pairs (with prompt, job, cv) and ``explanation``: ready, summary, claims grounded in the two texts, and why not where it is not ready."""
    p = pairs.withColumn("__r", replies(F.col("prompt"), ask))
    p = p.withColumn("__j", F.from_json(salvaged_json(F.col("__r.reply")), f"summary string, claims {CLAIM}"))
    p = p.withColumn("__c", F.slice(grounded_claims(F.coalesce("__j.claims", F.array().cast(CLAIM)), F.col("job"), F.col("cv")), 1, MOST_CLAIMS))
    ready = F.size("__c") > 0
    why = F.when(~ready, F.coalesce(F.col("__r.failure"), F.when(F.col("__j").isNull(), "INVALID_OUTPUT"), F.lit("NO_CLAIMS")))
    return p.withColumn("explanation", F.struct(ready.alias("ready"), F.when(ready, F.col("__j.summary")).alias("summary"), F.col("__c").alias("claims"), why.alias("fallback_reason"))).drop("__r", "__j", "__c")


def attach(ranking: DataFrame, payloads: DataFrame, n: int, explain: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The ranking with ``explanation`` for its first n rows of each query (at most MOST_EXPLAINED) that have a payload (doc_id, payload);
    the others have null. Only those rows are given to ``explain``, which adds the column."""
    n = min(max(n, 0), MOST_EXPLAINED)
    head = explain(ranking.filter(F.col("rank") <= n).select("query_id", "doc_id").join(payloads, "doc_id"))
    return ranking.join(head.select("query_id", "doc_id", "explanation"), ["query_id", "doc_id"], "left")
