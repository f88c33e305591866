"""Machine-readable descriptions of the operations, and a search over them."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field


@dataclass(frozen=True)
class Param:
    name: str
    type: str
    description: str
    required: bool = False
    default: object = None


@dataclass(frozen=True)
class Operation:
    name: str
    description: str
    returns: str
    params: tuple[Param, ...] = ()
    example: dict = field(default_factory=dict)


def _call(op: str, **params) -> dict:
    return {"type": "call", "op": op, "params": params}


_ID = Param("id", "string", "Document id or exact title", True)
OPERATIONS = (
    Operation("add", "Add a single file", "{ doc_id, status, title, segments, changed }", (Param("path", "string", "Path of the file", True),), _call("add", path="/docs/readme.md")),
    Operation("doctor", "Run health checks", "{ checks[], healthy }", (), _call("doctor")),
    Operation("enrich", "Derive title, summary and tags of a document", "{ doc_id, title, summary_length, tags[] }", (_ID,), _call("enrich", id="doc_1")),
    Operation("explain", "Explain the rank of a search result", "{ result_id, query, doc_id, block_idx, block_kind, retrieval_trace }", (Param("result_id", "string", "Id of a result", True),), _call("explain", result_id="res_1")),
    Operation("ingest", "Add all supported files under directories", "{ added, ready, failed, failures[] }", (Param("dirs", "string[]", "Directories", True), Param("max_files", "integer", "Files at most")), _call("ingest", dirs=["/docs"])),
    Operation("list", "List documents", "{ documents[], truncated }", (Param("limit", "integer", "Documents at most", default=100),), _call("list", limit=20)),
    Operation("read", "Read a document", "{ doc_id, title, state, content }", (_ID,), _call("read", id="doc_1")),
    Operation("reindex", "Rebuild the full-text index", "{ index, status, documents, segments, generation }", (), _call("reindex")),
    Operation("remove", "Remove a document", "{ doc_id, previous_state }", (_ID,), _call("remove", id="doc_1")),
    Operation("search", "Search documents by words, with the blocks around hits", "{ query, mode, fts_generation, hits[] }", (Param("query", "string", "Query text", True), Param("limit", "integer", "Hits at most", default=10), Param("expand", "boolean", "Return the blocks around hits", default=False)), _call("search", query="error handling", limit=5)),
)

# What a term's match adds to an operation's score.
EXACT_NAME, IN_NAME, IN_DESCRIPTION, IN_PARAM, IN_PARAM_DESCRIPTION, IN_RETURNS = 100, 50, 10, 20, 5, 5


def _score(op: Operation, term: str) -> int:
    name = EXACT_NAME if op.name == term else IN_NAME if term in op.name else 0
    params = sum(IN_PARAM * (term in p.name.lower()) + IN_PARAM_DESCRIPTION * (term in p.description.lower()) for p in op.params)
    return name + IN_DESCRIPTION * (term in op.description.lower()) + params + IN_RETURNS * (term in op.returns.lower())


def search(query: str, limit: int = 10) -> list[dict]:
    """Operations that every term of the query matches, best first; all for an empty query."""
    terms = query.lower().split()
    scored = [(op, [_score(op, t) for t in terms]) for op in OPERATIONS]
    found = [(sum(s) if terms else 1, op) for op, s in scored if all(s)]
    found.sort(key=lambda x: (-x[0], x[1].name))
    return [asdict(op) | {"score": s} for s, op in found[:limit]]


def json_schema(op: Operation) -> dict:
    """The operation's parameters as a JSON schema."""
    kinds = {"string": {"type": "string"}, "integer": {"type": "integer", "minimum": 0}, "boolean": {"type": "boolean"}, "string[]": {"type": "array", "items": {"type": "string"}}}
    return {"type": "object", "properties": {p.name: kinds[p.type] | {"description": p.description} for p in op.params}, "required": [p.name for p in op.params if p.required], "additionalProperties": False}


def capabilities() -> dict:
    from pagewright.operators.parse import PARSERS

    return {"operations": [op.name for op in OPERATIONS], "parsers": sorted(PARSERS), "search_modes": ["bm25", "vector", "hybrid"], "formats": ["txt", "md", "markdown", "pdf", "json"]}
