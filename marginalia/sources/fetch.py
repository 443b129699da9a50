"""Guarded fetching of public web pages: every hop is resolved, checked and pinned."""

from __future__ import annotations

import http.client
import ipaddress
import socket
import ssl
from urllib.parse import urljoin, urlsplit

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..limits import MAX_SOURCE_BYTES, URL_MAX_REDIRECTS, URL_TIMEOUT_SECONDS, EngineError

REDIRECTS = frozenset((301, 302, 303, 307, 308))


def is_public(address: str) -> bool:
    """Whether an IP address literal is one that may be fetched."""
    try:
        ip = ipaddress.ip_address(address)
    except ValueError:  # also addresses with a zone, which are local
        return False
    return not any((ip.is_private, ip.is_loopback, ip.is_link_local, ip.is_reserved, ip.is_multicast, ip.is_unspecified))


@F.udf(T.BooleanType())
def is_public_address(address: str | None) -> bool | None:
    return None if address is None else is_public(address)


def resolve(host: str) -> str:
    """The first address of a host all of whose addresses are public."""
    try:
        found = [info[4][0] for info in socket.getaddrinfo(host, None)]
    except socket.gaierror as e:
        raise EngineError("INGEST_FETCH_FAILED", f"can't resolve {host}") from e
    if bad := [a for a in found if not is_public(str(a))]:
        raise EngineError("INGEST_URL_BLOCKED", f"{host} is at {bad[0]}")
    if not found:
        raise EngineError("INGEST_FETCH_FAILED", f"{host} has no address")
    return str(found[0])


def checked_url(url: str) -> tuple[str, str, int, str]:
    """(scheme, host, port, target) of a URL that may be fetched."""
    try:
        parts = urlsplit(url)
        port = parts.port or (443 if parts.scheme == "https" else 80)
    except ValueError as e:
        raise EngineError("INGEST_URL_BLOCKED", f"no address: {url}") from e
    if parts.scheme not in ("http", "https") or not parts.hostname:
        raise EngineError("INGEST_URL_BLOCKED", f"not a web address: {url}")
    target = (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
    return parts.scheme, parts.hostname, port, target


def _get(scheme: str, host: str, port: int, target: str, address: str) -> tuple[int, dict[str, str], bytes]:
    raw = socket.create_connection((address, port), URL_TIMEOUT_SECONDS)
    if scheme == "https":
        raw = ssl.create_default_context().wrap_socket(raw, server_hostname=host)
    connection = http.client.HTTPConnection(host, port, timeout=URL_TIMEOUT_SECONDS)
    connection.sock = raw
    try:
        connection.request("GET", target, headers={"Host": host, "User-Agent": "notebook-ingest"})
        reply = connection.getresponse()
        return reply.status, {k.lower(): v for k, v in reply.getheaders()}, reply.read(MAX_SOURCE_BYTES + 1)
    finally:
        connection.close()


def fetch(url: str) -> tuple[bytes, str, str]:
    """(body, content type, final URL); redirects are followed as far as allowed, each checked anew."""
    seen: set[str] = set()
    for _ in range(URL_MAX_REDIRECTS + 1):
        if url in seen:
            raise EngineError("INGEST_FETCH_FAILED", "redirects go round in a circle")
        seen.add(url)
        scheme, host, port, target = checked_url(url)
        try:
            status, headers, body = _get(scheme, host, port, target, resolve(host))
        except EngineError:
            raise
        except (OSError, ValueError, http.client.HTTPException) as e:
            raise EngineError("INGEST_FETCH_FAILED", str(e)) from e
        if status in REDIRECTS and headers.get("location"):
            url = urljoin(url, headers["location"])
            continue
        if status >= 400:
            raise EngineError("INGEST_FETCH_FAILED", f"status {status}")
        if len(body) > MAX_SOURCE_BYTES:
            raise EngineError("INGEST_FILE_TOO_LARGE", url)
        return body, headers.get("content-type", ""), url
    raise EngineError("INGEST_FETCH_FAILED", "too many redirects")
