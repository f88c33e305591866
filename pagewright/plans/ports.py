"""What can be plugged in: embedders and rerankers."""

from __future__ import annotations

import hashlib
import json
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pagewright.arrow import arrow_map
from pagewright.errors import EngineError

# Dimensions of embedding models by name.
MODEL_DIMENSIONS = {
    "AllMiniLML6V2": 384,
    "AllMiniLML6V2Q": 384,
    "AllMiniLML12V2": 384,
    "AllMiniLML12V2Q": 384,
    "BGEBaseENV15": 768,
    "BGEBaseENV15Q": 768,
    "BGESmallENV15": 384,
    "BGESmallENV15Q": 384,
    "BGELargeENV15": 1024,
    "BGELargeENV15Q": 1024,
    "NomicEmbedTextV1": 768,
    "NomicEmbedTextV15": 768,
    "NomicEmbedTextV15Q": 768,
    "ParaphraseMLMiniLML12V2": 384,
    "ParaphraseMLMiniLML12V2Q": 384,
    "ParaphraseMLMpnetBaseV2": 768,
    "MxbaiEmbedLargeV1": 1024,
    "MxbaiEmbedLargeV1Q": 1024,
    "GTEBaseENV15": 768,
    "GTEBaseENV15Q": 768,
    "GTELargeENV15": 1024,
    "GTELargeENV15Q": 1024,
}


@dataclass(frozen=True)
class Embedder:
    """``embed`` maps texts to vectors of ``dimensions`` numbers; it runs on executors, so it must be picklable."""

    provider: str
    model: str
    dimensions: int
    embed: Callable[[list[str]], list[list[float]]]
    normalization: str = "l2"
    truncation: str = "none"
    chunking: str = "segment"

    def fingerprint(self) -> str:
        about = {k: v for k, v in asdict(self).items() if k != "embed"}
        return hashlib.sha256(json.dumps(about, sort_keys=True).encode()).hexdigest()

    def apply(self, segments: DataFrame, keys: tuple[str, ...] = ("segment_id", "doc_id")) -> DataFrame:
        """The keys and embedding of segments with a body."""
        embed, dims = self.embed, self.dimensions

        def make():
            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
                for b in batches:
                    got = embed(b.column(len(keys)).to_pylist())
                    if any(len(v) != dims for v in got):
                        raise EngineError("E_EMBED_FAIL", f"the embedder doesn't give {dims} dimensions")
                    yield dict(zip(keys, b.columns, strict=False)) | {"embedding": [[float(x) for x in v] for v in got]}

            return run

        return arrow_map(segments.select(*keys, "body"), make, f"{segments.select(*keys)._jdf.schema().toDDL()}, embedding array<float>")


def hashed(dimensions: int = 64) -> Embedder:
    """A deterministic embedder for tests: repeated bytes of a digest, scaled to unit length."""

    def embed(texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            raw = np.resize(np.frombuffer(hashlib.sha256(t.encode()).digest(), np.uint8), dimensions) / 127.5 - 1.0
            out.append((raw / (np.linalg.norm(raw) or 1.0)).tolist())
        return out

    return Embedder("stub", "hash", dimensions, embed)


def zeros(dimensions: int = 64) -> Embedder:
    return Embedder("stub", "zero", dimensions, lambda texts: [[0.0] * dimensions for _ in texts])


def post_to(url: str, key: str | None = None, timeout_s: float = 30.0) -> Callable[[dict], dict]:
    """Sends requests for embeddings as JSON to a service; whatever goes wrong is E_EMBED_FAIL."""

    def post(body: dict) -> dict:
        headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {key}"} if key else {})
        request = urllib.request.Request(f"{url.rstrip('/')}/embeddings", json.dumps(body).encode(), headers)
        try:
            with urllib.request.urlopen(request, timeout=timeout_s) as reply:
                return json.loads(reply.read())
        except (OSError, ValueError) as e:
            raise EngineError("E_EMBED_FAIL", f"the embedding service failed: {e}") from None

    return post


def over_http(post: Callable[[dict], dict], model: str, dimensions: int) -> Embedder:
    """An embedder behind a service: ``post`` sends a request body and returns the reply, whose data are ordered by index."""

    def embed(texts: list[str]) -> list[list[float]]:
        reply = post({"model": model, "input": texts})
        try:
            found = [r["embedding"] for r in sorted(reply["data"], key=lambda r: r["index"])]
        except (KeyError, TypeError) as e:
            raise EngineError("E_EMBED_FAIL", f"the embedding service's reply lacks {e}") from None
        if len(found) != len(texts) or any(len(v) != dimensions for v in found):
            raise EngineError("E_EMBED_FAIL", f"the embedding service didn't give {len(texts)} vectors of {dimensions} dimensions")
        return found

    return Embedder("http", model, dimensions, embed)


def by_model(name: str, embed: Callable[[list[str]], list[list[float]]]) -> Embedder:
    if name not in MODEL_DIMENSIONS:
        raise EngineError("E_INVALID_INPUT", f"unknown embedding model: {name}")
    return Embedder("local", name, MODEL_DIMENSIONS[name], embed)


#: A reranker maps a query, texts and a count to (index, score), best first.
Reranker = Callable[[str, list[str], int], list[tuple[int, float]]]


def lexical(query: str, docs: list[str], top_n: int) -> list[tuple[int, float]]:
    """Scores texts by the share of the query's words in them."""
    words = set(query.lower().split())
    scores = [(len(words & set(d.lower().split())) / max(1, len(words)), -i) for i, d in enumerate(docs)]
    return [(-i, s) for s, i in sorted(scores, reverse=True)[:top_n]]
