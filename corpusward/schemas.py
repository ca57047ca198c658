"""Table schemas; readers never infer."""

from __future__ import annotations

PRINCIPALS = "user_id BIGINT, username STRING, groups ARRAY<STRING>, created_at TIMESTAMP"

DOCUMENTS = (
    "source_type STRING, filename STRING, filepath STRING, version INT, "
    "is_active BOOLEAN, created_at TIMESTAMP"
)

CHUNKS = (
    "source_type STRING, filename STRING, version INT, chunk_index INT, "
    "text STRING, allowed_groups ARRAY<STRING>"
)

INDEX = (
    "chunk_key BIGINT, allowed_groups ARRAY<STRING>, tokens ARRAY<INT>, "
    "weights ARRAY<DOUBLE>, dense ARRAY<DOUBLE>"
)

ANSWER_CACHE = (
    "entry_id BIGINT, query_text STRING, response_text STRING, allowed_groups ARRAY<STRING>, "
    "chunk_groups ARRAY<ARRAY<STRING>>, files ARRAY<STRING>, dense ARRAY<DOUBLE>, created_at TIMESTAMP"
)

RETRIEVED = (
    "ARRAY<STRUCT<chunk_id: BIGINT, filename: STRING, source_type: STRING, "
    "allowed_groups: ARRAY<STRING>, rerank_score: DOUBLE>>"
)

AUDIT_LOGS = (
    "user_id BIGINT, query STRING, response STRING, served_from STRING, "
    f"retrieved_chunks {RETRIEVED}, ts TIMESTAMP"
)

DLQ = (
    "filepath STRING, source_type STRING, error_message STRING, retry_count INT, "
    "status STRING, created_at TIMESTAMP"
)

MESSAGES = "user STRING, text STRING, ts STRING"

CLAIMS = (
    "preferred_username STRING, email STRING, sub STRING, groups ARRAY<STRING>, "
    "realm_access STRUCT<roles: ARRAY<STRING>>, roles ARRAY<STRING>"
)
