"""Access policy as predicates that filter before any ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.schemas import DOC_TYPES

OPEN_JOBS = ("OPEN", "IN_PROGRESS")
UNLISTED_ROLES = ("recruiter", "admin")


def allowed(user: str | None = None, roles: tuple[str, ...] = (), admin: bool = False, require_ready: bool = True, allowed_roles: tuple[str, ...] = UNLISTED_ROLES) -> Column:
    """Whether a row (status, visibility, owner_id, deleted_at) may be shown to a caller; an unknown visibility may."""
    mine = F.coalesce(F.col("owner_id") == F.lit(user), F.lit(False)) if user else F.lit(False)
    by_role = bool(set(roles) & set(allowed_roles))
    seen = F.when(F.col("deleted_at").isNotNull(), False)
    if require_ready:
        seen = seen.when(F.coalesce(F.col("status"), F.lit("")) != "READY", False)
    return seen.when(F.col("visibility") == "private", F.lit(admin) | mine).when(F.col("visibility") == "unlisted", F.lit(admin) | mine | F.lit(by_role)).otherwise(True)


def permitted(rows: DataFrame, **context) -> DataFrame:
    return rows.filter(F.col("doc_type").isin(*DOC_TYPES) & allowed(**context))


def public(rows: DataFrame) -> DataFrame:
    return rows.filter((F.col("status") == "READY") & F.col("deleted_at").isNull() & (F.col("visibility") == "public"))


def access_where(visibility: tuple[str, ...] = (), owner: str | None = None, status: str | None = None) -> Column | None:
    """A filter on stored metadata: visible or owned, and of a status; None where nothing restricts."""
    sides = ([F.col("visibility").isin(*visibility)] if visibility else []) + ([F.col("owner_id") == owner] if owner else [])
    out = (sides[0] | sides[1]) if len(sides) == 2 else sides[0] if sides else None
    if status:
        out = (F.col("status") == status) if out is None else out & (F.col("status") == status)
    return out


def gate(recommendations: DataFrame, rows: DataFrame, **context) -> DataFrame:
    """Recommendations whose document the policy admits."""
    return recommendations.join(permitted(rows, **context).select("doc_id"), "doc_id", "left_semi")


def parsed_ids(ids: DataFrame, col: str = "doc_id") -> DataFrame:
    """doc_id, doc_type, number of well-formed ids (cv_7, jd_12); others go."""
    kind, number = F.regexp_extract(col, r"^(cv|jd)_(\d+)$", 1), F.regexp_extract(col, r"^(cv|jd)_(\d+)$", 2)
    return ids.filter(kind != "").select(F.col(col).alias("doc_id"), kind.alias("doc_type"), number.cast("long").alias("number"))


def vector_id(doc_type: Column, doc_id: Column, version: Column, section: Column) -> Column:
    return F.concat_ws(":", doc_type, doc_id, F.concat(F.lit("v"), version.cast("string")), section)


def parsed_vector_id(vid: Column) -> Column:
    """struct(doc_type, doc_id, version, section), or null where the id is malformed."""
    p = F.split(vid, ":", 4)
    ok = (F.size(p) == 4) & F.get(p, F.lit(0)).isin(*DOC_TYPES) & F.get(p, F.lit(2)).rlike(r"^v\d+$")
    return F.when(ok, F.struct(F.get(p, F.lit(0)).alias("doc_type"), F.get(p, F.lit(1)).alias("doc_id"), F.substring(F.get(p, F.lit(2)), 2, 9).cast("int").alias("version"), F.get(p, F.lit(3)).alias("section")))


def job_acl(jobs: DataFrame) -> DataFrame:
    """ACL rows of jobs (id, status, owner_id, visibility, deleted_at): open ones are READY."""
    status = F.when(F.upper("status").isin(*OPEN_JOBS), "READY").otherwise(F.coalesce(F.lower("status"), F.lit("unknown")))
    return jobs.select(F.concat(F.lit("jd_"), F.col("id").cast("string")).alias("doc_id"), F.lit("jd").alias("doc_type"), status.alias("status"), F.coalesce("visibility", F.lit("public")).alias("visibility"), "owner_id", F.col("deleted_at").cast("string").alias("deleted_at"))


def profile_acl(profiles: DataFrame) -> DataFrame:
    return profiles.select(F.concat(F.lit("cv_"), F.col("id").cast("string")).alias("doc_id"), F.lit("cv").alias("doc_type"), F.lit("READY").alias("status"), F.coalesce("visibility", F.lit("public")).alias("visibility"), "owner_id", F.col("deleted_at").cast("string").alias("deleted_at"))
