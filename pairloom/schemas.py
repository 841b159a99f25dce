"""Schemas of the records that the engine reads and writes, as DDL texts, which need no session."""

from __future__ import annotations

SECTION = "name string, text string, heading_raw string, ord int"
DOCUMENT = "doc_id string, doc_type string, lang string, raw_text string, sections map<string, struct<name:string,text:string,heading_raw:string,ord:int>>, schema_version string"
PAIR = "cv_id string, jd_id string, label int"
QUERY = "jd_id string, cv_ids array<string>, relevance array<int>"
VECTOR = (
    "vector_id string, doc_type string, doc_id string, version int, section string, embedding array<float>, text string, status string, "
    "visibility string, owner_id string, language string, embedding_model string, content_hash string"
)
PAYLOAD = "doc_type string, doc_id string, version int, payload string"
QRELS = "direction string, query_id string, doc_id string, grade int"
RUN = "query_id string, doc_id string, score double, rank int"
ACL = "doc_id string, doc_type string, status string, visibility string, owner_id string, deleted_at string, version int"
EVENT = "event_id string, doc_type string, doc_id string, action string, version int, created_at double, language string, status string, owner_id string, visibility string, line_no long"
JOB = (
    "id string, document_type string, document_id string, version int, status string, step string, attempt_count int, next_attempt_at double, last_error string, "
    "content_hash string, source_kind string, source_ref string, text string, title string, owner_id string, visibility string, warnings string, "
    "created_at double, updated_at double, started_at double, finished_at double, duration_ms long"
)
SKILL = "struct<name:string,weight:double,level:int>"
BUDGET = "struct<min:double,max:double,currency:string>"
REQUIREMENT = (f"id string, required array<{SKILL}>, optional array<{SKILL}>, min_years double, budget {BUDGET}, preferences map<string,string>")
PROFILE = (f"id string, skills array<{SKILL}>, years double, budget {BUDGET}, preferences map<string,string>")
SCHEMA_VERSION = "1.0.0"
DOC_TYPES, LANGUAGES = ("cv", "jd"), ("vi", "en", "mixed")
