"""Limits and stable error codes."""

# fixed values: published limits and defaults
MAX_SOURCE_BYTES = 10 * 1024 * 1024
MAX_QUESTION_CHARS = 2000
MAX_NAME_CHARS = 200
MAX_TITLE_CHARS = 500
MAX_CONTEXT_CHARS = 200
CHUNK_TOKENS = 512
CHUNK_OVERLAP = 64
TOP_K = 8
URL_TIMEOUT_SECONDS = 15
URL_MAX_REDIRECTS = 3
MAX_CHUNKS_PER_NOTEBOOK = 50_000
EMBED_BATCH = 16
SOURCE_TEXT_TOKENS = 1000
LEAST_SOURCE_TOKENS = 64
HISTORY_MESSAGES = 6
HISTORY_TOKENS_EACH = 160
HISTORY_TOKENS_TOTAL = 400
OVERVIEW_TOKENS = 2800
OVERVIEW_CHUNKS_PER_SOURCE = 3
SUGGESTION_TOKENS = 1600
SUBSTRING_POOL = 2000
RRF_K = 60

ERROR_CODES = frozenset(
    {
        "VALIDATION_REQUIRED_FIELD_MISSING", "VALIDATION_FIELD_FORMAT_INVALID", "VALIDATION_INTEGER_OVERFLOW",
        "NOTEBOOK_NOT_FOUND", "NOTEBOOK_EMPTY", "NOTE_NOT_FOUND", "CHUNK_NOT_FOUND", "SOURCE_NOT_FOUND", "SOURCE_ALREADY_EXISTS",
        "EMBEDDING_INVALID", "STUDIO_KIND_INVALID", "SYSTEM_DB_LOCKED", "SYSTEM_SERVICE_UNAVAILABLE", "SYSTEM_EMBED_DISABLED",
        "SYSTEM_LLM_TIMEOUT", "SYSTEM_LLM_HTTP_ERROR", "SYSTEM_LLM_BAD_RESPONSE", "INGEST_UNSUPPORTED_FORMAT", "INGEST_FILE_TOO_LARGE", "INGEST_EMPTY",
        "INGEST_FETCH_FAILED", "INGEST_URL_BLOCKED", "INGEST_PARSE_FAILED", "INGEST_PDF_SUPPORT_MISSING", "INGEST_CHUNK_LIMIT",
    }
)


class EngineError(ValueError):
    """A failure with one of the stable codes."""

    def __init__(self, code: str, message: str):
        super().__init__(f"{code}: {message}")
        self.code = code
