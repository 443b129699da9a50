"""Schemas of the engine's tables, and the version they are at."""

VERSION = 6

REPORT = (
    "cited array<int>, invalid array<int>, coverage double, n_sources int, source_map map<string,string>, source_id_map map<string,bigint>, "
    "confirmed array<int>, misattributed array<int>, degraded boolean, source_excerpts map<string,string>, source_contexts map<string,string>, "
    "source_chunk_ids map<string,array<bigint>>, uncited array<string>"
)

TABLES = {
    "notebooks": "id bigint, name string, created_at timestamp, updated_at timestamp",
    "sources": "id bigint, notebook_id bigint, kind string, title string, origin string, sha256 string, added_at timestamp",
    "chunks": "id bigint, source_id bigint, seq int, text string, context string, embedding array<float>",
    "notes": "id bigint, notebook_id bigint, title string, body string, created_at timestamp",
    "studio_outputs": "id bigint, notebook_id bigint, kind string, body string, citation_report string, created_at timestamp",
    "messages": "id bigint, notebook_id bigint, role string, body string, citation_report string, created_at timestamp",
    "settings": "key string, value string",
}
