"""Language-model and embedding backends: protocols, a deterministic offline one, and an HTTP one."""

from __future__ import annotations

import hashlib
import http.client
import json
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..limits import EMBED_BATCH, EngineError

MOST_REPLY_BYTES = 32 * 1024 * 1024
TEMPERATURE = 0.2
CHAT_SECONDS, EMBED_SECONDS, HEALTH_SECONDS = 180, 60, 3


class ChatBackend(Protocol):
    def chat(self, messages: list[dict[str, str]]) -> str: ...


class EmbedBackend(Protocol):
    def embed(self, texts: list[str]) -> list[list[float]]: ...


class OfflineBackend:
    """Answers with the sources it is given and embeds by hashed words; needs no network."""

    def __init__(self, width: int = 16):
        self.width = width

    def chat(self, messages: list[dict[str, str]]) -> str:
        block = messages[-1]["content"]
        first = block.partition("<<<SOURCE S1\n")[2].partition("\n>>>")[0].splitlines()
        return f"{first[0]} [S1]" if first else "Not in the source."

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            v = [0.0] * self.width
            for word in text.lower().split():
                h = hashlib.sha256(word.encode()).digest()
                v[h[0] % self.width] += 1.0 if h[1] & 1 else -1.0
            out.append(v)
        return out


@contextmanager
def failures_named(where: str) -> Iterator[None]:
    """Whatever goes wrong between here and an endpoint, under its stable code."""
    try:
        yield
    except EngineError:
        raise
    except urllib.error.HTTPError as e:
        raise EngineError("SYSTEM_LLM_HTTP_ERROR", f"{where}: status {e.code}") from e
    except (OSError, ValueError, http.client.HTTPException) as e:  # ValueError: an address that is none
        late = isinstance(e, TimeoutError) or isinstance(getattr(e, "reason", None), TimeoutError)
        raise EngineError("SYSTEM_LLM_TIMEOUT" if late else "SYSTEM_SERVICE_UNAVAILABLE", f"{where}: {e}") from e


def bad_reply(what: str) -> EngineError:
    return EngineError("SYSTEM_LLM_BAD_RESPONSE", what)


def field(reply: object, *path: str | int) -> object:
    """What a reply holds at a path, or None."""
    for step in path:
        try:
            reply = reply[step]  # type: ignore[index]
        except (KeyError, IndexError, TypeError):
            return None
    return reply


class HttpBackend:
    """Any endpoint that speaks the common chat-completions and embeddings protocol."""

    def __init__(self, url: str, chat_model: str = "", embed_model: str = ""):
        self.url, self.chat_model, self.embed_model = url.rstrip("/"), chat_model, embed_model.strip()

    def _lines(self, path: str, body: dict | None, seconds: float) -> Iterator[bytes]:
        """A reply's content type, then its lines, up to the size that is taken."""
        left = MOST_REPLY_BYTES
        with failures_named(self.url + path):
            data = None if body is None else json.dumps(body).encode()
            request = urllib.request.Request(self.url + path, data, {"Content-Type": "application/json"})
            with urllib.request.urlopen(request, timeout=seconds) as reply:
                yield (reply.headers.get("Content-Type") or "").encode()
                while line := reply.readline(left + 1):
                    left -= len(line)
                    if left < 0:
                        raise bad_reply(f"more than {MOST_REPLY_BYTES} bytes")
                    yield line

    def _object(self, path: str, body: dict, seconds: float) -> dict:
        _, *lines = self._lines(path, body, seconds)
        try:
            found = json.loads(b"".join(lines).decode("utf-8", "replace"))
        except ValueError as e:
            raise bad_reply("no JSON") from e
        if not isinstance(found, dict):
            raise bad_reply("no JSON object")
        return found

    def _talk(self, messages: list[dict[str, str]], stream: bool) -> dict:
        return {"model": self.chat_model, "messages": messages, "temperature": TEMPERATURE, "stream": stream}

    def chat(self, messages: list[dict[str, str]]) -> str:
        content = field(self._object("/chat/completions", self._talk(messages, False), CHAT_SECONDS), "choices", 0, "message", "content")
        if content is None:
            raise bad_reply("no message")
        return str(content)

    def chat_stream(self, messages: list[dict[str, str]]) -> Iterator[str]:
        """Pieces of an answer as they come; broken ones are left out, a reported error ends it."""
        lines = self._lines("/chat/completions", self._talk(messages, True), CHAT_SECONDS)
        next(lines)
        for line in lines:
            event, _, data = line.decode("utf-8", "replace").strip().partition(":")
            if event != "data":
                continue
            if data.strip() == "[DONE]":
                return
            try:
                piece = json.loads(data)
            except ValueError:
                continue
            if isinstance(piece, dict) and "error" in piece:
                raise bad_reply(str(piece["error"])[:200])
            if delta := field(piece, "choices", 0, "delta", "content"):
                yield str(delta)

    def embed(self, texts: list[str]) -> list[list[float]]:
        if not self.embed_model:
            raise EngineError("SYSTEM_EMBED_DISABLED", "no embedding model is set")
        reply = self._object("/embeddings", {"model": self.embed_model, "input": texts}, EMBED_SECONDS)
        try:
            rows = {int(row.get("index", 0)) * len(texts) + i: row["embedding"] for i, row in enumerate(reply["data"])}
            vectors = [[float(x) for x in rows[k]] for k in sorted(rows)]
        except (AttributeError, KeyError, OverflowError, TypeError, ValueError) as e:
            raise bad_reply("no vectors") from e
        if len(vectors) != len(texts) or len(set(map(len, vectors))) > 1:
            raise bad_reply("the vectors don't fit the texts")
        return vectors

    def available(self) -> bool:
        """Whether the endpoint lists its models as JSON."""
        try:
            return b"json" in next(self._lines("/models", None, HEALTH_SECONDS))
        except EngineError:
            return False


def query_vectors(questions: DataFrame, make: Callable[[], EmbedBackend], model: str, indexed_with: str | None) -> DataFrame:
    """``questions`` (query_id, query, ..) with ``vector``, null where the lexical way must do.

    That is where no model is set, where the index was made with another model, whose vectors compare
    with nothing, and where the backend fails.
    """
    if not model.strip() or (indexed_with or "").strip() not in ("", model.strip()):
        return questions.withColumn("vector", F.lit(None).cast("array<float>"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        backend = make()
        for frame in frames:
            vectors = []
            for query in frame["query"]:
                try:
                    vectors += backend.embed([query or ""])
                except EngineError:
                    vectors.append(None)
            yield pd.DataFrame({"query_id": frame["query_id"], "vector": vectors})

    kind = questions.schema["query_id"].dataType.simpleString()
    made = questions.select("query_id", "query").mapInPandas(run, f"query_id {kind}, vector array<float>")
    return questions.join(made, "query_id", "left")


def embed_chunks(chunks: DataFrame, make: Callable[[], EmbedBackend], batch: int = EMBED_BATCH, force: bool = False) -> DataFrame:
    """``chunks`` (id, context, text, embedding) with vectors where they lack one, or all with ``force``.

    A batch that fails leaves its chunks without a vector; all vectors of a task have one length.
    """
    from ..operators.chunking import embedding_input

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        backend, width = make(), None
        for frame in frames:
            for at in range(0, len(frame), batch):
                some = frame.iloc[at : at + batch].copy()
                try:
                    vectors = backend.embed(some["input"].tolist())
                    width = width or len(vectors[0])
                    some["embedding"] = [v if len(v) == width and width else None for v in vectors]
                except EngineError:
                    some["embedding"] = None
                yield some[["id", "embedding"]]

    wanted = chunks if force else chunks.filter(F.col("embedding").isNull())
    made = wanted.select("id", embedding_input(F.col("context"), F.col("text")).alias("input")).mapInPandas(run, "id long, embedding array<float>")
    joined = chunks.join(made.withColumnRenamed("embedding", "_new"), "id", "left")
    return joined.withColumn("embedding", F.coalesce("_new", "embedding")).select(*chunks.columns)
