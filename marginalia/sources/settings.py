"""Settings: environment over a JSON file over defaults."""

from __future__ import annotations

import json
import os
from pathlib import Path

PREFIX = "MARGINALIA_"
DEFAULTS = {"llm_url": "http://127.0.0.1:11434/v1", "llm_model": "", "embed_model": "", "lang": "en", "multi_query": "0", "embed_batch": "16", "data_dir": "", "debug": ""}


def from_file(path: str | Path) -> dict[str, str]:
    """Plain values of a JSON object as text; anything else is left out."""
    try:
        found = json.loads(Path(path).read_text("utf-8"))
    except (OSError, ValueError):
        return {}
    if not isinstance(found, dict):
        return {}
    return {k: str(v) for k, v in found.items() if isinstance(v, (str, int, float)) and not isinstance(v, bool)}


def setting(name: str, path: str | Path | None = None) -> str:
    if value := os.environ.get(PREFIX + name.upper(), ""):
        return value
    return (from_file(path).get(name, "") if path else "") or DEFAULTS.get(name, "")


def flag(name: str, path: str | Path | None = None) -> bool:
    return setting(name, path).strip().lower() in ("1", "true", "yes", "on")


def number(name: str, least: int = 1, path: str | Path | None = None) -> int:
    try:
        return max(least, int(setting(name, path)))
    except ValueError:
        return int(DEFAULTS[name])
