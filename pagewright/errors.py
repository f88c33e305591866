"""Typed errors with stable codes and process exit codes."""

from __future__ import annotations

# Stable code -> exit code.
EXIT_CODES = {
    "E_PARSE_PDF": 10,
    "E_PARSE_MD": 10,
    "E_PARSE_EXTERNAL": 10,
    "E_INVALID_IR": 10,
    "E_STORE_CORRUPT": 20,
    "E_INDEX_BUILD_FTS": 11,
    "E_INDEX_BUILD_VEC": 11,
    "E_EMBED_FAIL": 10,
    "E_ENRICH_FAIL": 10,
    "E_TAXONOMY_CYCLE": 1,
    "E_LOCK_BUSY": 21,
    "E_MCP": 1,
    "E_SCHEMA_MIGRATION": 20,
    "E_GENERATION_CONFLICT": 11,
    "E_RERANK_FAIL": 12,
    "E_FINGERPRINT_MISMATCH": 11,
    "E_IO": 1,
    "E_NOT_FOUND": 12,
    "E_INVALID_INPUT": 2,
    "E_CONFIG": 2,
    "E_SEARCH_FAILED": 12,
    "E_EXECUTION_LIMIT": 2,
    "E_DSL_ERROR": 2,
}


class EngineError(Exception):
    """An error of the engine; ``code`` is stable, ``exit_code`` follows from it."""

    def __init__(self, code: str, message: str):
        if code not in EXIT_CODES:
            raise ValueError(f"unknown error code {code}")
        super().__init__(message)
        self.code, self.message = code, message

    @property
    def exit_code(self) -> int:
        return EXIT_CODES[self.code]


def invalid(message: str) -> EngineError:
    return EngineError("E_INVALID_INPUT", message)


def not_found(what: str) -> EngineError:
    return EngineError("E_NOT_FOUND", f"not found: {what}")
