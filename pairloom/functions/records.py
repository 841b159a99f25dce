"""Payloads as a model extracts them, brought to their schema; the records that scoring reads; and texts out of records.

Payloads are JSON. They are parsed into loose structs whose leaves are texts, for models write numbers as texts and texts as
numbers, and each rule is a Column expression over those.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pairloom.functions import dates
from pairloom.functions.payload import as_float, budget_range, clamped, confidence, evidenced, first_wins, skill_items
from pairloom.functions.text import strip

#: Longest texts of payload fields, most technologies of a project and responsibilities of a job, most years asked for.
LONGEST = {"name": 100, "title": 150, "evidence": 200, "description": 1000, "summary": 1500, "job_summary": 3000, "responsibility": 200, "currency": 10, "id": 100, "text": 100_000}
MOST_TECHNOLOGIES, MOST_RESPONSIBILITIES, MOST_YEARS = 30, 20, 20
VISIBILITIES = ("public", "private", "unlisted")

_RANGE = "struct<min:string,max:string,currency:string>"
_SKILL = "struct<name:string,weight:string,level:string,proficiency_level:string,confidence:string,evidence:string>"
_WORK = "struct<title:string,company:string,start_date:string,end_date:string,is_current:string,description:string,confidence:string>"
_SCHOOL = "struct<degree:string,school:string,start_year:string,end_year:string,description:string,confidence:string>"
_PROJECT = "struct<name:string,technologies:array<string>,description:string,confidence:string>"
CV = (
    f"struct<skills:array<{_SKILL}>,experience:array<{_WORK}>,education:array<{_SCHOOL}>,projects:array<{_PROJECT}>,summary:string,"
    f"years_experience:string,budget:{_RANGE},expected_budget:{_RANGE},preferences:map<string,string>>"
)
JOB = (
    f"struct<title:string,summary:string,required_skills:array<{_SKILL}>,optional_skills:array<{_SKILL}>,skills:array<{_SKILL}>,responsibilities:array<string>,"
    f"min_years_experience:string,budget:{_RANGE},preferences:map<string,string>>"
)


def parsed(json: Column, schema: str) -> Column:
    """The loose struct of a payload; what does not parse is null."""
    return F.from_json(json, schema)


def cut(text: Column, kind: str) -> Column:
    """A field's text without outer blanks, at most as long as its kind may be; null where nothing is left."""
    return F.nullif(F.left(strip(F.coalesce(text, F.lit(""))), F.lit(LONGEST[kind])), F.lit(""))


def squeezed_text(text: Column) -> Column:
    """White space as single blanks; null where nothing is left."""
    return F.nullif(strip(F.regexp_replace(text, r"\s+", " ")), F.lit(""))


def preferences(given: Column) -> Column:
    """The entries that have a value."""
    return F.coalesce(F.map_filter(given, lambda _, v: v.isNotNull()), F.create_map().cast("map<string,string>"))


def _list(items: Column, kind: str) -> Column:
    return F.coalesce(F.filter(items, lambda x: x.isNotNull()), F.array().cast(kind))


def _empty(items: Column, name: str) -> Column:
    return F.when(F.size(items) == 0, F.lit(f"EMPTY_SECTION:{name}"))


def _named_skills(items: Column, levels: bool) -> Column:
    """Skills with a name that is not too long; levels 1 to 10, confidences 0 to 1, short evidence."""

    def one(x: Column) -> Column:
        level = F.when(F.trim(x["proficiency_level"]).rlike("^[0-9]+$"), F.trim(x["proficiency_level"]).try_cast("int"))
        more = [F.when(level.between(1, 10), level).alias("proficiency_level")] if levels else []
        return F.struct(strip(F.coalesce(x["name"], F.lit(""))).alias("name"), *more, confidence(x["confidence"]).alias("confidence"), cut(x["evidence"], "evidence").alias("evidence"))

    good = F.transform(_list(items, f"array<{_SKILL}>"), one)
    return F.filter(good, lambda x: (x["name"] != "") & (F.length(x["name"]) <= LONGEST["name"]))


def normalized_cv(raw: Column, full_text: Column, strict: bool = False) -> Column:
    """struct<payload, warnings> of a loose CV. Skills need evidence in the full text: without, their confidence falls to at most 0.3, or
    they go if strict. Lists are cut to their limits; what is empty, cut or dropped leaves a warning."""
    named = _named_skills(raw["skills"], True)
    proven = F.transform(named, lambda x: F.struct(x.alias("x"), evidenced(full_text, x["evidence"]).alias("ok")))
    if strict:
        checked = F.transform(F.filter(proven, lambda p: p["ok"]), lambda p: p["x"])
        lost = F.size(named) - F.size(checked)
        missing = F.when(lost > 0, F.concat(F.lit("EVIDENCE_MISSING:"), lost.cast("string")))
    else:
        lower = lambda p: F.when(p["ok"], p["x"]["confidence"]).otherwise(F.least(F.coalesce(p["x"]["confidence"], F.lit(0.3)), F.lit(0.3)))
        checked = F.transform(proven, lambda p: p["x"].withField("confidence", lower(p)))
        missing = F.lit(None).cast("string")
    skills, w_skills = clamped(first_wins(checked, lambda x: x["name"]), "skills")

    def work(x: Column) -> Column:
        current = F.coalesce(F.lower(F.trim(x["is_current"])).isin("true", "1"), F.lit(False)) | dates.is_current(x["end_date"])
        return F.struct(
            cut(x["title"], "title").alias("title"), cut(x["company"], "title").alias("company"), dates.normalize_date(x["start_date"]).alias("start_date"), F.when(~current, dates.normalize_date(x["end_date"])).alias("end_date"),
            current.alias("is_current"), cut(x["description"], "description").alias("description"), confidence(x["confidence"]).alias("confidence"),
        )

    def school(x: Column) -> Column:
        years = [dates.to_year(x[c]).alias(c) for c in ("start_year", "end_year")]
        return F.struct(cut(x["degree"], "title").alias("degree"), cut(x["school"], "title").alias("school"), *years, cut(x["description"], "description").alias("description"), confidence(x["confidence"]).alias("confidence"))

    def project(x: Column) -> Column:
        techs = F.filter(F.transform(_list(x["technologies"], "array<string>"), strip), lambda t: t != "")
        return F.struct(cut(x["name"], "title").alias("name"), F.slice(first_wins(techs, lambda t: t), 1, MOST_TECHNOLOGIES).alias("technologies"), cut(x["description"], "description").alias("description"), confidence(x["confidence"]).alias("confidence"))

    lists = {"experience": F.transform(_list(raw["experience"], f"array<{_WORK}>"), work), "education": F.transform(_list(raw["education"], f"array<{_SCHOOL}>"), school), "projects": F.transform(_list(raw["projects"], f"array<{_PROJECT}>"), project)}
    found, notes = {"skills": skills}, [_empty(named, "skills"), missing, w_skills]
    for name, items in lists.items():
        found[name], warning = clamped(items, name)
        notes += [_empty(items, name), warning]
    payload = F.struct(*[v.alias(k) for k, v in found.items()], cut(raw["summary"], "summary").alias("summary"))
    return F.struct(payload.alias("payload"), F.array_compact(F.array(*notes)).alias("warnings"))


def normalized_job(raw: Column) -> Column:
    """struct<payload, warnings> of a loose job description."""

    def skills(items: Column, kind: str) -> tuple[Column, Column]:
        once = first_wins(_named_skills(items, False), lambda x: x["name"])
        kept, warning = clamped(once, "skills")
        return kept, F.when(warning.isNotNull(), F.lit(f"LIMIT_{kind.upper()}_TRIMMED"))

    (required, w1), (optional, w2) = skills(raw["required_skills"], "required_skills"), skills(raw["optional_skills"], "optional_skills")
    duties = first_wins(F.filter(F.transform(_list(raw["responsibilities"], "array<string>"), lambda x: cut(x, "responsibility")), lambda x: x.isNotNull()), lambda x: x)
    w3 = F.when(F.size(duties) > MOST_RESPONSIBILITIES, F.lit("LIMIT_RESPONSIBILITIES_TRIMMED"))
    years = as_float(raw["min_years_experience"]).cast("int")
    bound = lambda c: F.when(as_float(c) >= 0, as_float(c))
    budget = F.when(raw["budget"].isNotNull(), F.struct(bound(raw["budget"]["min"]).alias("min"), bound(raw["budget"]["max"]).alias("max"), cut(raw["budget"]["currency"], "currency").alias("currency")))
    payload = F.struct(
        cut(raw["title"], "title").alias("title"), cut(raw["summary"], "job_summary").alias("summary"), required.alias("required_skills"), optional.alias("optional_skills"),
        F.slice(duties, 1, MOST_RESPONSIBILITIES).alias("responsibilities"), F.when(years.between(0, MOST_YEARS), years).alias("min_years_experience"), budget.alias("budget"),
    )
    return F.struct(payload.alias("payload"), F.array_compact(F.array(w1, w2, w3)).alias("warnings"))


def _first_full(*lists: Column) -> Column:
    out = F.array().cast("array<struct<name:string,weight:double,level:int>>")
    for x in reversed(lists):
        out = F.when(F.size(x) > 0, skill_items(x)).otherwise(out)
    return out


def requirement(raw: Column) -> Column:
    """What a job asks for: required skills (or, without any, its skills), optional ones, years, budget, preferences."""
    return F.struct(
        _first_full(raw["required_skills"], raw["skills"]).alias("required"), _first_full(raw["optional_skills"]).alias("optional"), as_float(raw["min_years_experience"]).alias("min_years"),
        budget_range(raw["budget"]["min"], raw["budget"]["max"], raw["budget"]["currency"]).alias("budget"), preferences(raw["preferences"]).alias("preferences"),
    )


def profile(raw: Column, now: str) -> Column:
    """What a candidate offers: skills, years (stated, or added up from the work), budget (or expected budget), preferences."""
    items = F.transform(raw["experience"], lambda x: F.struct(x["start_date"].alias("start_date"), x["end_date"].alias("end_date"), F.coalesce(F.lower(x["is_current"]) == "true", F.lit(False)).alias("is_current")))
    spans = F.filter(items, lambda x: x["is_current"] | x["end_date"].isNotNull())
    own = budget_range(raw["budget"]["min"], raw["budget"]["max"], raw["budget"]["currency"])
    expected = budget_range(raw["expected_budget"]["min"], raw["expected_budget"]["max"], raw["expected_budget"]["currency"])
    return F.struct(
        _first_full(raw["skills"]).alias("skills"), F.coalesce(as_float(raw["years_experience"]), dates.experience_years(spans, now)).alias("years"),
        F.when(raw["budget"].isNotNull(), own).otherwise(expected).alias("budget"), preferences(raw["preferences"]).alias("preferences"),
    )


def job_input_error(doc_type: Column, doc_id: Column, version: Column, visibility: Column, text: Column, has_file: Column) -> Column:
    """Why a request to process a document is refused, or null."""
    kind, long = F.lower(F.trim(F.coalesce(doc_type, F.lit("")))), F.length(F.trim(F.coalesce(text, F.lit("")))) >= 10
    return (
        F.when(~kind.isin("cv", "jd"), "DOCUMENT_TYPE_INVALID")
        .when(~F.length(F.trim(F.coalesce(doc_id, F.lit("")))).between(1, LONGEST["id"]), "DOCUMENT_ID_INVALID")
        .when(~F.coalesce(version.between(1, 1000), F.lit(False)), "VERSION_INVALID")
        .when(visibility.isNotNull() & ~F.lower(F.trim(visibility)).isin(*VISIBILITIES), "VISIBILITY_INVALID")
        .when((kind == "jd") & has_file, "JD_FILE_NOT_ALLOWED")
        .when((kind == "jd") & ~long, "JD_TEXT_REQUIRED")
        .when((kind == "cv") & ~has_file & ~long, "CV_SOURCE_REQUIRED")
    )


def years_span(start: Column, end: Column, arrow: str) -> Column:
    """Two ends with a sign between, in brackets; an empty text where neither is there."""
    a, z = (F.coalesce(F.trim(c), F.lit("")) for c in (start, end))
    return F.when((a != "") | (z != ""), F.concat(F.lit(" ("), a, F.lit(arrow), z, F.lit(")"))).otherwise("")


def headed(blocks: dict[str, Column]) -> Column:
    """Blocks with a body below their heads, blank lines between."""
    return F.concat_ws("\n\n", *[F.when(F.coalesce(body, F.lit("")) != "", F.concat(F.lit(f"{head}\n"), body)) for head, body in blocks.items()])


def _lines(items: Column) -> Column:
    return F.array_join(F.filter(items, lambda s: F.coalesce(s != "", F.lit(False))), "\n")


def profile_text(raw: Column) -> Column:
    """A profile as text: a head over each part that has something, works and schools on lines of their own."""
    dash = lambda *p: F.concat_ws(" - ", *[squeezed_text(x) for x in p])
    names = F.array_distinct(F.filter(F.transform(raw["skills"], lambda x: strip(x["name"])), lambda n: F.coalesce(n != "", F.lit(False))))

    def work(x: Column) -> Column:
        head, about = dash(x["title"], x["company"]), squeezed_text(x["description"])
        lone = head == ""
        first = F.concat(F.when(lone, F.coalesce(about, F.lit(""))).otherwise(head), years_span(x["start_date"], x["end_date"], " -> "))
        return F.when(~lone & about.isNotNull(), F.concat(first, F.lit("\n    "), about)).otherwise(first)

    def project(x: Column) -> Column:
        techs = F.array_join(F.array_distinct(F.filter(F.transform(x["technologies"], strip), lambda t: F.coalesce(t != "", F.lit(False)))), ", ")
        head = F.concat_ws(": ", squeezed_text(x["name"]), squeezed_text(x["description"]))
        return F.concat_ws(" ", F.nullif(head, F.lit("")), F.when(F.coalesce(techs, F.lit("")) != "", F.concat(F.lit("["), techs, F.lit("]"))))

    bullet = lambda c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit("- "), c))
    return headed({
        "SUMMARY": bullet(squeezed_text(raw["summary"])), "SKILLS": bullet(F.array_join(names, ", ")), "EXPERIENCE": _lines(F.transform(raw["experience"], work)),
        "EDUCATION": _lines(F.transform(raw["education"], lambda x: F.concat(dash(x["degree"], x["school"]), years_span(x["start_year"], x["end_year"], "-")))), "PROJECTS": _lines(F.transform(raw["projects"], project)),
    })
