"""Typed configuration in a TOML file; unknown keys are errors."""

from __future__ import annotations

import json
import tomllib
from typing import Any

from pyspark.sql import SparkSession

from pagewright.errors import EngineError
from pagewright.sources.files import Store

# Keys and their types.
TYPES: dict[str, type] = {
    "search.limit": int,
    "embed.base_url": str,
    "embed.model": str,
    "embed.dimensions": int,
    "embed.api_key": str,
    "embed.provider": str,
    "embed.cache_dir": str,
    "rerank.provider": str,
    "rerank.model": str,
    "rerank.top_k": int,
}
#: What each key is for.
ABOUT = {
    "search.limit": "how many hits a search returns if it doesn't say",
    "embed.base_url": "where requests for vectors go",
    "embed.model": "which model makes vectors",
    "embed.dimensions": "how long these vectors are",
    "embed.api_key": "what authorizes requests for vectors",
    "embed.provider": "who makes vectors: a service or a local model",
    "embed.cache_dir": "where local models are kept",
    "rerank.provider": "who reranks hits",
    "rerank.model": "which model reranks hits",
    "rerank.top_k": "how many hits are reranked",
}


def typed(key: str, value: Any) -> Any:
    """The value in the key's type; text is converted."""
    if key not in TYPES:
        raise EngineError("E_CONFIG", f"unknown key: {key}")
    kind = TYPES[key]
    if kind is int and isinstance(value, str):
        try:
            value = int(value)
        except ValueError:
            raise EngineError("E_CONFIG", f"{key} must be a whole number") from None
    if not isinstance(value, kind) or isinstance(value, bool) or kind is int and value < 0:
        raise EngineError("E_CONFIG", f"{key} has the wrong type")
    return value


def parse(text: str) -> dict[str, Any]:
    try:
        found = tomllib.loads(text)
    except tomllib.TOMLDecodeError as e:
        raise EngineError("E_CONFIG", f"malformed configuration: {e}") from None
    out = {}
    for section, values in found.items():
        if not isinstance(values, dict):
            raise EngineError("E_CONFIG", f"unknown key: {section}")
        for k, v in values.items():
            out[f"{section}.{k}"] = typed(f"{section}.{k}", v)
    return out


def dump(values: dict[str, Any]) -> str:
    sections: dict[str, list[str]] = {}
    for key in sorted(values):
        section, name = key.split(".")
        sections.setdefault(section, []).append(f"{name} = {json.dumps(values[key], ensure_ascii=False)}")
    return "\n".join(f"[{s}]\n" + "\n".join(rows) + "\n" for s, rows in sections.items())


class Config:
    def __init__(self, spark: SparkSession, home: str):
        self.files, self.path = Store(spark), f"{home.rstrip('/')}/config.toml"

    def load(self) -> dict[str, Any]:
        return parse(self.files.read(self.path)) if self.files.exists(self.path) else {}

    def get(self, key: str) -> Any:
        if key not in TYPES:
            raise EngineError("E_CONFIG", f"unknown key: {key}")
        return self.load().get(key)

    def set(self, key: str, value: Any) -> Any:
        values = self.load() | {key: typed(key, value)}
        self.files.write(self.path, dump(values))
        return values[key]

    def show(self) -> list[dict[str, Any]]:
        """All keys with their type, meaning and value; a key for requests is shown as set or not."""
        values = self.load()
        return [{"key": k, "type": TYPES[k].__name__, "about": ABOUT[k], "value": "set" if k == "embed.api_key" and k in values else values.get(k)} for k in sorted(TYPES)]
