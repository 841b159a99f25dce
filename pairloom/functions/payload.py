"""Functions over extracted payloads (nested records and JSON)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pairloom.functions.text import case_folded, squeezed, strip
from pairloom.functions.vectors import clamp01

# The most entries of each list in a payload.
LIMITS = {"skills": 50, "experience": 20, "education": 10, "projects": 20}


def as_float(value: Column) -> Column:
    """A number out of a text, or null."""
    return F.trim(value.cast("string")).try_cast("double")


def confidence(value: Column) -> Column:
    n = as_float(value)
    return F.when(n.isNotNull(), clamp01(n))


def names(items: Column) -> Column:
    """Non-blank names of array<struct<name,...>>, comma-joined."""
    return F.array_join(F.filter(F.transform(items, lambda x: strip(x["name"])), lambda n: F.coalesce(n != "", F.lit(False))), ", ")


def skill_items(items: Column) -> Column:
    """array<struct<name,weight,level>> out of array<struct<name,weight:string,level:string>>: blank names dropped, weights
    positive or 1, levels 1 to 10 or null."""

    def one(x: Column) -> Column:
        w, lv = as_float(x["weight"]), x["level"].try_cast("int")
        return F.struct(strip(x["name"]).alias("name"), F.when(w > 0, w).otherwise(1.0).alias("weight"), F.when(lv.between(1, 10), lv).alias("level"))

    return F.filter(F.transform(items, one), lambda x: F.coalesce(x["name"] != "", F.lit(False)))


def budget_range(low: Column, high: Column, currency: Column | None = None) -> Column:
    cur = F.nullif(F.trim(currency), F.lit("")) if currency is not None else F.lit(None).cast("string")
    return F.when(low.isNotNull() | high.isNotNull(), F.struct(as_float(low).alias("min"), as_float(high).alias("max"), cur.alias("currency")))


def first_wins(items: Column, key) -> Column:
    """Entries whose key (case and outer blanks aside) no earlier entry has."""
    keys = F.transform(items, lambda x: F.lower(strip(key(x))))
    return F.transform(F.filter(F.transform(items, lambda x, i: F.struct(x.alias("x"), (F.array_position(keys, F.get(keys, i)) == i + 1).alias("new"))), lambda t: F.coalesce(t["new"], F.lit(False))), lambda t: t["x"])


def clamped(items: Column, kind: str) -> tuple[Column, Column]:
    """(the list cut to its limit, a warning or null)."""
    n = LIMITS[kind]
    return F.slice(items, 1, n), F.when(F.size(items) > n, F.lit(f"LIMIT_{kind.upper()}_TRIMMED"))


def warnings(*some: Column) -> Column:
    return F.to_json(F.array_compact(F.array(*some)))


def evidenced(text: Column, evidence: Column) -> Column:
    """Whether a non-blank evidence stands in a text, white space and case aside."""
    return F.coalesce((squeezed(evidence) != "") & F.contains(squeezed(text), squeezed(evidence)), F.lit(False))


def checked_confidence(text: Column, evidence: Column, value: Column, strict: bool = False) -> Column:
    """An entry without evidence in its text has its confidence cut to 0.3, or becomes null if strict."""
    ok = evidenced(text, evidence)
    return F.when(ok, value).otherwise(F.lit(None) if strict else F.least(value, F.lit(0.3)))


def joined(sep: str, *parts: Column) -> Column:
    """The non-blank parts with a separator."""
    return F.concat_ws(sep, *[F.nullif(strip(F.coalesce(p, F.lit(""))), F.lit("")) for p in parts])


def experience_text(items: Column) -> Column:
    lines = F.transform(items, lambda x: joined(", ", joined(" at ", x["title"], x["company"]), x["description"]))
    return F.array_join(F.filter(lines, lambda s: s != ""), "\n")


def projects_text(items: Column) -> Column:
    techs = lambda x: F.array_join(F.filter(F.transform(x["technologies"], strip), lambda t: t != ""), ", ")
    lines = F.transform(items, lambda x: joined(": ", joined(" — ", x["name"], techs(x)), x["description"]))
    return F.array_join(F.filter(lines, lambda s: s != ""), "\n")


def education_text(items: Column) -> Column:
    return F.array_join(F.filter(F.transform(items, lambda x: joined(", ", x["degree"], x["school"])), lambda s: s != ""), "\n")


def cv_sections(skills: Column, experience: Column, projects: Column, education: Column, summary: Column) -> Column:
    """array<struct<name,text>> of the non-blank sections, in their fixed order."""
    every = [("skills", names(skills)), ("experience", experience_text(experience)), ("projects", projects_text(projects)), ("education", education_text(education)), ("summary", strip(F.coalesce(summary, F.lit(""))))]
    return F.filter(F.array(*[F.struct(F.lit(n).alias("name"), F.coalesce(t, F.lit("")).alias("text")) for n, t in every]), lambda s: s["text"] != "")


def jd_sections(required: Column, optional: Column, responsibilities: Column, summary: Column, title: Column) -> Column:
    duties = F.array_join(F.filter(F.transform(responsibilities, strip), lambda s: s != ""), "\n")
    about = F.coalesce(F.nullif(strip(F.coalesce(summary, F.lit(""))), F.lit("")), strip(F.coalesce(title, F.lit(""))))
    every = [("skills", names(required)), ("optional_skills", names(optional)), ("responsibilities", duties), ("summary", about)]
    return F.filter(F.array(*[F.struct(F.lit(n).alias("name"), F.coalesce(t, F.lit("")).alias("text")) for n, t in every]), lambda s: s["text"] != "")


def raw_text(sections: Column, summary: Column, title: Column, doc_id: Column) -> Column:
    """The sections' texts with blank lines between, else summary, title or id."""
    text = strip(F.array_join(F.transform(sections, lambda s: s["text"]), "\n\n"))
    blank = lambda c: F.nullif(strip(F.coalesce(c, F.lit(""))), F.lit(""))
    return F.coalesce(F.nullif(text, F.lit("")), blank(summary), blank(title), doc_id)


CLAIM = "array<struct<statement:string,verdict:string,evidence:string,source:string,confidence:string>>"


def grounded_claims(claims: Column, job: Column, cv: Column) -> Column:
    """Claims whose evidence stands in the source they name (or in either); all others become unknown and lose it."""
    hay = lambda c: case_folded(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))
    inside = lambda text, e: F.coalesce(F.contains(hay(text), F.trim(hay(e))), F.lit(False))

    def one(x: Column) -> Column:
        verdict = F.when(x["verdict"].isin("hit", "missing"), x["verdict"]).otherwise("unknown")
        evidence = F.nullif(F.left(F.trim(F.coalesce(x["evidence"], F.lit(""))), F.lit(500)), F.lit(""))
        named = F.when(x["source"].isin("job", "cv"), x["source"])
        source = F.coalesce(named, F.when(inside(job, evidence), "job").when(inside(cv, evidence), "cv"))
        there = F.when(named == "job", inside(job, evidence)).when(named == "cv", inside(cv, evidence)).otherwise(inside(job, evidence) | inside(cv, evidence))
        good = (verdict != "unknown") & evidence.isNotNull() & there
        return F.struct(F.left(F.trim(x["statement"]), F.lit(400)).alias("statement"), F.when(good, verdict).otherwise("unknown").alias("verdict"), F.when(good, evidence).alias("evidence"), F.when(good, source).alias("source"), confidence(x["confidence"]).alias("confidence"))

    return F.transform(F.filter(claims, lambda x: F.coalesce(F.trim(x["statement"]) != "", F.lit(False))), one)


def rerank_results(results: Column, expected: Column) -> Column:
    """array<struct<id,score,ready>> of expected ids: whole scores within 0..100, null where there is none."""

    def one(x: Column) -> Column:
        given = F.trim(x["score"]).try_cast("double").cast("int")
        n = F.when(given.isNotNull(), F.greatest(F.lit(0), F.least(F.lit(100), given)))
        return F.struct(F.trim(x["id"]).alias("id"), n.alias("score"), n.isNotNull().alias("ready"))

    return F.filter(F.transform(results, one), lambda x: F.array_contains(expected, x["id"]))
