"""Files to sources: kind by suffix, bytes to text, digest, and error codes in place of failures."""

from __future__ import annotations

import io
import os.path
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..limits import MAX_SOURCE_BYTES, EngineError
from .fetch import fetch
from .html import html_text

# fixed values: kinds by suffix
KINDS = {".txt": "txt", ".md": "md", ".markdown": "md", ".html": "html", ".htm": "html", ".pdf": "pdf"}


def kind_of(path: Column) -> Column:
    """Kind by the path's last suffix, or null."""
    suffix = F.lower(F.regexp_extract(path, r"(\.[^./\\]*)$", 1))
    out = F.lit(None).cast("string")
    for s, kind in KINDS.items():
        out = F.when(suffix == s, F.lit(kind)).otherwise(out)
    return out


def charset_of(content_type: Column) -> Column:
    """The charset parameter of a content type, or null."""
    found = F.regexp_extract(content_type, r"(?i)(?:^|;)\s*charset\s*=\s*[\"']?([^;\"'\s]+)", 1)
    return F.when(found != "", found)


def decoded(data: bytes, charset: str | None = None) -> str:
    """Text by the declared charset, a UTF-16 mark, UTF-8, then cp932; UTF-8 with replacements at last."""
    marked = ["utf-16"] if data.startswith((b"\xff\xfe", b"\xfe\xff")) else []
    for name in filter(None, (charset, *marked, "utf-8-sig", "cp932")):
        try:
            return data.decode(name)
        except (UnicodeDecodeError, LookupError):
            pass
    return data.decode("utf-8", "replace")


def pdf_text(data: bytes) -> tuple[str, str | None]:
    """(text, error): pages that can be read, a blank line apart."""
    try:
        from pypdf import PdfReader
    except ImportError:
        return "", "INGEST_PDF_SUPPORT_MISSING"
    try:
        pages = list(PdfReader(io.BytesIO(data)).pages)
    except Exception:
        return "", "INGEST_PARSE_FAILED"
    texts = []
    for page in pages:
        try:
            texts.append((page.extract_text() or "").strip())
        except Exception:  # one bad page leaves the others
            texts.append("")
    return "\n\n".join(filter(None, texts)), None


def extracted(kind: str | None, name: str, data: bytes, charset: str | None = None) -> tuple[str, str, str | None]:
    """(title, text, error) of one source."""
    title, text, error = name, "", None
    if kind is None:
        return title, "", "INGEST_UNSUPPORTED_FORMAT"
    if len(data) > MAX_SOURCE_BYTES:
        return title, "", "INGEST_FILE_TOO_LARGE"
    if kind == "pdf":
        text, error = pdf_text(data)
    elif kind == "html":
        found, text = html_text(decoded(data, charset))
        title = found or name
    else:
        text = decoded(data, charset)
    text = text.replace("\0", "").strip()
    return title, text, error or (None if text else "INGEST_EMPTY")


@F.pandas_udf(T.StructType([T.StructField(c, T.StringType()) for c in ("title", "text", "error")]))
def extract(kind: pd.Series, name: pd.Series, data: pd.Series, charset: pd.Series) -> pd.DataFrame:
    rows = [extracted(k, os.path.basename(n), bytes(d), c) for k, n, d, c in zip(kind, name, data, charset)]
    return pd.DataFrame(rows, columns=["title", "text", "error"])


def from_bytes(raw: DataFrame) -> DataFrame:
    """(origin, kind, title, text, sha256, error) from (origin, kind, content, charset); digest of the raw bytes."""
    made = raw.withColumn("x", extract("kind", "origin", "content", "charset"))
    return made.select("origin", "kind", "x.title", "x.text", F.sha2("content", 256).alias("sha256"), "x.error")


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """All files under a path. A file too large is reported, never loaded."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    large = files.filter(F.col("length") > MAX_SOURCE_BYTES).select(
        F.col("path").alias("origin"), kind_of(F.col("path")).alias("kind"), F.element_at(F.split("path", "/"), -1).alias("title"),
        F.lit("").alias("text"), F.lit(None).cast("string").alias("sha256"), F.lit("INGEST_FILE_TOO_LARGE").alias("error"),
    )
    small = files.filter(F.col("length") <= MAX_SOURCE_BYTES)
    raw = small.select(F.col("path").alias("origin"), kind_of(F.col("path")).alias("kind"), "content", F.lit(None).cast("string").alias("charset"))
    return from_bytes(raw).unionByName(large)


def from_pages(pages: DataFrame) -> DataFrame:
    """Sources from fetched pages (url, html): kind ``url``, titled by the page or its address."""
    raw = pages.select(F.col("url").alias("origin"), F.lit("html").alias("kind"), F.encode("html", "UTF-8").alias("content"), F.lit("utf-8").alias("charset"))
    made = from_bytes(raw).withColumn("titled", F.col("title") != F.element_at(F.split("origin", "/"), -1))
    return made.withColumn("title", F.when(F.col("titled"), F.col("title")).otherwise(F.col("origin"))).withColumn("kind", F.lit("url")).drop("titled")


def read_urls(urls: DataFrame, get: Callable[[str], tuple[bytes, str, str]] = fetch) -> DataFrame:
    """Sources from web addresses (url): fetched under guard, read by what came, kind ``url``.

    A page that can't be had is a row with its error code. ``get`` gives body, content type and final address.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for url in frame["url"]:
                try:
                    body, content_type, final = get(url or "")
                    rows.append((final, body, content_type, None))
                except EngineError as e:
                    rows.append((url, b"", "", e.code))
            yield pd.DataFrame(rows, columns=["origin", "content", "content_type", "failed"])

    got = urls.select("url").mapInPandas(run, "origin string, content binary, content_type string, failed string")
    kind, charset = content_kind(F.col("content_type"), F.col("content")), charset_of(F.col("content_type"))
    made = got.withColumn("x", extract(kind, F.coalesce("origin", F.lit("")), F.col("content"), F.coalesce(charset, F.lit(""))))
    own = F.when(F.col("x.title") != F.element_at(F.split("origin", "/"), -1), F.col("x.title"))
    ok = F.col("failed").isNull()
    return made.select(
        "origin", F.lit("url").alias("kind"), F.coalesce(own, F.col("origin")).alias("title"), F.when(ok, F.col("x.text")).otherwise("").alias("text"),
        F.when(ok, F.sha2("content", 256)).alias("sha256"), F.coalesce("failed", "x.error").alias("error"),
    )


def content_kind(content_type: Column, body: Column) -> Column:
    """Kind of a fetched body by its type or first bytes."""
    low, text = F.lower(F.coalesce(content_type, F.lit(""))), F.decode(F.substring(body, 1, 256), "ISO-8859-1")
    begins = F.substring(X.strip(text), 1, 4)
    return F.when(low.contains("pdf") | (begins == "%PDF"), "pdf").when(low.contains("html") | begins.startswith("<"), "html").otherwise("txt")
