"""Parsers: bytes or texts to documents with a graph of blocks.

Every parser gives rows of the same shape, so that sources of different formats unite:
title, canonical_text, blocks (kind, span in bytes, text), losses, error. Plain text is all column
expressions; formats that nest are read by Arrow functions.
"""

from __future__ import annotations

import json
import os
import re
import subprocess
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.arrow import arrow_map
from pagewright.functions import text as tx

BLOCK = "struct<kind:string,span_start:bigint,span_end:bigint,text:string>"
LOSS = "struct<kind:string,span_start:bigint,span_end:bigint,message:string>"
PARSED = f"title string, canonical_text string, blocks array<{BLOCK}>, losses array<{LOSS}>, error_code string, error string"

# Fixed values.
KINDS = ("PARAGRAPH", "HEADING", "LIST_ITEM", "TABLE_CELL", "CODE", "CAPTION", "FOOTNOTE")
LABEL_KINDS = {
    "section_header": "HEADING",
    "paragraph": "PARAGRAPH",
    "text": "PARAGRAPH",
    "list_item": "LIST_ITEM",
    "caption": "CAPTION",
    "figure_caption": "CAPTION",
    "table_caption": "CAPTION",
    "footnote": "FOOTNOTE",
    "code": "CODE",
    "table": "TABLE_CELL",
}
PDF_BYTES, PDF_TEXT, TITLE_BYTES = 10_000, 100, 200


def paragraphs(df: DataFrame, keys: list[str], text: Column, separator: str = "\n\n") -> DataFrame:
    """One row per non-blank part of ``text``: keys, block_idx, span_start, span_end, body.

    Parts are trimmed, spans are the trimmed bytes. The running offset is a window over the parts of
    one row of keys.
    """
    width = len(separator.encode())
    parts = F.split(text, re.escape(separator), -1)
    exploded = df.select(*keys, F.posexplode(parts).alias("pos", "part"))
    w = Window.partitionBy(*keys).orderBy("pos")
    at = F.coalesce(F.sum(F.octet_length("part") + width).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = exploded.select(*keys, "pos", at.cast("bigint").alias("at"), tx.leading_bytes(F.col("part")).alias("lead"), tx.trim(F.col("part")).alias("body")).where("body <> ''")
    first = (F.col("at") + F.col("lead")).cast("bigint")
    return spans.select(*keys, (F.row_number().over(w) - 1).cast("bigint").alias("block_idx"), first.alias("span_start"), (first + F.octet_length("body")).alias("span_end"), "body")


def plain_blocks(data: bytes) -> dict:
    """A document of plain text: paragraphs divided by blank lines."""
    text = data.decode("utf-8")
    blocks, at = [], 0
    for part in text.split("\n\n"):
        body = part.strip()
        if body:
            start = at + len(part[: len(part) - len(part.lstrip())].encode())
            blocks.append(("PARAGRAPH", start, start + len(body.encode()), body))
        at += len(part.encode()) + 2
    return {"title": next((x.strip() for x in text.splitlines() if x.strip()), None), "canonical_text": text, "blocks": blocks, "losses": []}


# Markdown.

_FENCE = re.compile(r"^( {0,3})(`{3,}|~{3,})(.*)$")
_ATX = re.compile(r"^ {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
_SETEXT = re.compile(r"^ {0,3}(=+|-+)[ \t]*$")
_RULE = re.compile(r"^ {0,3}([-*_])(?:[ \t]*\1){2,}[ \t]*$")
_ITEM = re.compile(r"^( {0,3})([-+*]|\d{1,9}[.)])(?:[ \t]+(.*)|[ \t]*)$")
_DEFINITION = re.compile(r"^ {0,3}\[((?:[^\[\]\\]|\\.)+)\]:[ \t]*(?:<[^>]*>|\S+)(?:[ \t]+(?:\"[^\"]*\"|'[^']*'|\([^)]*\)))?[ \t]*$")
_SHORTCUT = re.compile(r"!?\[((?:[^\[\]\\]|\\.)+)\](?:\[\])?")
_HTML = re.compile(r"^ {0,3}<(?:[a-zA-Z!/?])")
_INLINE = (
    (re.compile(r"!\[([^\]]*)\]\([^)]*\)"), r"\1"),
    (re.compile(r"\[([^\]]*)\](?:\([^)]*\)|\[[^\]]*\])"), r"\1"),
    (re.compile(r"<((?:https?|mailto):[^>\s]+)>"), r"\1"),
    (re.compile(r"</?[a-zA-Z][^>]*>"), ""),
    (re.compile(r"(\*\*\*|___)(?=\S)(.+?)(?<=\S)\1", re.DOTALL), r"\2"),
    (re.compile(r"(\*\*|__)(?=\S)(.+?)(?<=\S)\1", re.DOTALL), r"\2"),
    (re.compile(r"\*(?=\S)(.+?)(?<=\S)\*", re.DOTALL), r"\1"),
    (re.compile(r"(?<!\w)_(?=\S)(.+?)(?<=\S)_(?!\w)", re.DOTALL), r"\1"),
    (re.compile(r"~~(?=\S)(.+?)(?<=\S)~~", re.DOTALL), r"\1"),
)
_CODE = re.compile(r"(`+)(?!`)(.+?)(?<!`)\1(?!`)", re.DOTALL)
_ESCAPE = re.compile(r"\\([!-/:-@\[-`{-~])")


def without_front_matter(text: str) -> str:
    """The text behind a closed front matter; the whole text if there is none."""
    m = re.match(r"---\r?\n", text)
    if not m:
        return text
    close = re.compile(r"\n---(?:\r?\n|\Z)").search(text, m.end() - 1)
    return text[close.end() :] if close else text


def label_of(text: str) -> str:
    """A reference's label as it is compared: without regard to case and white space."""
    return " ".join(text.split()).casefold()


def inline_text(source: str, labels: frozenset[str] | set[str] = frozenset()) -> str:
    """Text and code of inline Markdown, breaks as line ends; nothing behind an emphasis is lost.

    ``labels`` are those that a link in brackets alone may refer to.
    """
    kept: list[str] = []

    def keep(x: str) -> str:
        kept.append(x)
        return f"\0{len(kept) - 1}\0"

    out = _CODE.sub(lambda m: keep(m[2].strip() if m[2].strip() else m[2]), source)
    out = _ESCAPE.sub(lambda m: keep(m[1]), out)
    for n, (pattern, by) in enumerate(_INLINE):
        if n == 2 and labels:  # behind links that name their target, before what is in angle brackets
            out = _SHORTCUT.sub(lambda m: m[1] if label_of(m[1]) in labels else m[0], out)
        out = pattern.sub(by, out)
    out = re.sub(r"(?: {2,}|\\)\n", "\n", out)
    return re.sub("\0(\\d+)\0", lambda m: kept[int(m[1])], out)


def scan_markdown(text: str) -> list[tuple[str, str]]:
    """(kind, text) of headings, paragraphs, code blocks and list items, in order.

    Items may hold paragraphs, code and items; each is a block of its own. Definitions of
    references are no blocks.
    """
    out: list[tuple[str, str]] = []
    open_: list[str] = []
    kind = "PARAGRAPH"
    #: Where the contents of the list items begin that are open, outermost first.
    offsets: list[int] = []
    lines = text.splitlines()
    labels = {label_of(m[1]) for m in map(_DEFINITION.match, lines) if m}

    def close() -> None:
        nonlocal open_, kind
        body = inline_text("\n".join(x.strip() for x in open_), labels).strip()
        if body:
            out.append((kind, body))
        open_, kind = [], "PARAGRAPH"

    def inside(line: str, at: int) -> str:
        """A line without the spaces that put it into an item."""
        return line[min(at, len(line) - len(line.lstrip(" "))) :]

    i = 0
    while i < len(lines):
        line = lines[i]
        if line.strip():
            lead = len(line) - len(line.lstrip(" "))
            holders = [o for o in offsets if o <= lead]
            inner = inside(line, holders[-1] if holders else 0)
            begins = _FENCE.match(inner) or _ATX.match(inner) or _ITEM.match(inner) or _RULE.match(inner) or inner.lstrip().startswith(">")
            if len(holders) == len(offsets) or not open_ or begins:
                offsets, line = holders, inner
            else:  # a paragraph in an item goes on without its spaces
                line = line.lstrip(" ")
        fence = _FENCE.match(line)
        if fence and not (fence[2][0] == "`" and "`" in fence[3]):
            close()
            end = re.compile(rf"^ {{0,3}}{re.escape(fence[2][0])}{{{len(fence[2])},}}[ \t]*$")
            body = []
            i += 1
            at = offsets[-1] if offsets else 0
            while i < len(lines) and not end.match(inside(lines[i], at)):
                body.append(inside(lines[i], at))
                i += 1
            if "\n".join(body).strip():
                out.append(("CODE", "\n".join(body)))
            i += 1
            continue
        heading, item = _ATX.match(line), _ITEM.match(line)
        while line.startswith(">") or re.match(r" {1,3}>", line):
            line = line.lstrip(" ")[1:].removeprefix(" ")
            heading, item = _ATX.match(line), _ITEM.match(line)
        if not line.strip():
            close()
        elif heading:
            close()
            open_, kind = [heading[2] or ""], "HEADING"
            close()
        elif open_ and kind == "PARAGRAPH" and _SETEXT.match(line):
            kind = "HEADING"
            close()
        elif _RULE.match(line):
            close()
        elif not open_ and _DEFINITION.match(line):
            pass
        elif item and (item[3] or not open_):
            close()
            before = offsets[-1] if offsets else 0
            offsets.append(before + (item.start(3) if item[3] else item.end(2) + 1))
            content = item[3] or ""
            if _FENCE.match(content) or _ATX.match(content) or _ITEM.match(content):
                lines[i] = " " * offsets[-1] + content
                continue
            open_, kind = [content], "LIST_ITEM"
        elif not open_ and re.match(r"(?: {4}|\t)", line):
            body = []
            while i < len(lines) and (re.match(r"(?: {4}|\t)", lines[i]) or not lines[i].strip()):
                body.append(re.sub(r"^(?: {4}|\t)", "", lines[i]))
                i += 1
            out.append(("CODE", "\n".join(body).rstrip("\n")))
            continue
        elif not open_ and _HTML.match(line) and not line.lstrip().startswith(("<http", "<mailto")):
            while i < len(lines) and lines[i].strip():
                i += 1
            continue
        else:
            open_.append(line)
        i += 1
    close()
    return out


def laid_out(blocks: list[tuple[str, str]]) -> tuple[str, list[tuple[str, int, int, str]]]:
    """Canonical text of blocks, divided by blank lines, and the blocks with their byte spans."""
    out, at = [], 0
    for kind, text in blocks:
        size = len(text.encode())
        out.append((kind, at, at + size, text))
        at += size + 2
    return "\n\n".join(t for _, t in blocks), out


def markdown_blocks(data: bytes) -> dict:
    """A document of Markdown. Its title is the first top-level heading, else the first line that isn't blank."""
    raw = data.decode("utf-8")
    body = without_front_matter(raw)
    text, blocks = laid_out(scan_markdown(body))
    title = next((inline_text(m[2] or "").strip() for m in map(_ATX.match, raw.splitlines()) if m and len(m[1]) == 1), None)
    title = title or next((x.strip() for x in raw.splitlines() if x.strip()), None)
    return {"title": title, "canonical_text": text if blocks else body, "blocks": blocks, "losses": []}


# Structured exports.


def table_text(data: dict) -> str:
    """A grid of cells as lines of cells divided by bars; cells outside the grid are left out."""
    rows, columns = int(data.get("num_rows") or 0), int(data.get("num_cols") or 0)
    grid = [[""] * columns for _ in range(rows)]
    for cell in data.get("table_cells") or []:
        r, c = int(cell.get("row_index") or 0), int(cell.get("col_index") or 0)
        if r < rows and c < columns:
            grid[r][c] = cell.get("text") or ""
    return "\n".join(" | ".join(row) for row in grid) if rows and columns else ""


def cut_bytes(text: str, limit: int) -> str:
    return text.encode()[:limit].decode("utf-8", "ignore")


def structured_blocks(data: bytes) -> dict:
    """A document of a structured PDF export: texts, tables and pictures in the order of its body tree."""
    doc = json.loads(data)
    if not isinstance(doc, dict) or doc.get("schema_name", "DoclingDocument") != "DoclingDocument":
        raise ValueError("not a structured document")
    lists = {k: doc.get(k) or [] for k in ("texts", "tables", "pictures", "groups")}
    found: list[tuple[str, str]] = []
    losses: list[tuple[str, None, None, str]] = []

    def visit(node: dict) -> None:
        ref = re.fullmatch(r"#/(texts|tables|pictures|groups)/(\d+)", node.get("$ref") or node.get("cref") or "")
        if ref:
            items = lists[ref[1]]
            if int(ref[2]) >= len(items):
                return
            item = items[int(ref[2])]
            if ref[1] == "texts":
                body = (item.get("text") or "").strip()
                if body:
                    found.append((LABEL_KINDS.get(item.get("label") or "", "PARAGRAPH"), body))
            elif ref[1] == "tables":
                body = table_text(item.get("data") or {})
                if (item.get("data") or {}).get("table_cells") and body.replace("|", "").strip():
                    found.append(("TABLE_CELL", body.strip()))
                else:
                    losses.append(("TABLE", None, None, "table without text"))
            elif ref[1] == "pictures":
                losses.append(("IMAGE", None, None, "picture without text"))
            if ref[1] == "groups":
                node = item
            else:
                return
        for child in node.get("children") or []:
            visit(child)

    visit(doc.get("body") or {})
    text, blocks = laid_out(found)
    title = doc.get("name") or next((t for k, t in found if k == "HEADING"), None) or next((t for _, t in found), None)
    return {"title": cut_bytes(title, TITLE_BYTES) if title else None, "canonical_text": text, "blocks": blocks, "losses": losses}


def pdf_blocks(extract: Callable[[bytes], str]) -> Callable[[bytes], dict]:
    """A parser of PDF bytes that takes their text from ``extract``; long files with little text lose images."""

    def parse(data: bytes) -> dict:
        out = plain_blocks(extract(data).encode())
        out["title"] = cut_bytes(out["title"], TITLE_BYTES) if out["title"] else None
        if len(data) > PDF_BYTES and len(out["canonical_text"].encode()) < PDF_TEXT:
            out["losses"] = [("IMAGE", None, None, "little text for its size: pages may be images")]
        return out

    return parse


def external(command: list[str], suffix: str = ".pdf", timeout_s: float = 600.0) -> Callable[[bytes], dict]:
    """A parser that runs a converter: ``command --to json --output FOLDER FILE`` leaves a structured export in the folder."""

    def parse(data: bytes) -> dict:
        with tempfile.TemporaryDirectory() as folder:
            source = os.path.join(folder, f"source{suffix}")
            with open(source, "wb") as f:
                f.write(data)
            out = os.path.join(folder, "out")
            os.mkdir(out)
            done = subprocess.run([*command, "--to", "json", "--output", out, source], capture_output=True, timeout=timeout_s)
            if done.returncode:
                raise RuntimeError(f"the converter ended with {done.returncode}: {done.stderr[-200:].decode('utf-8', 'replace')}")
            found = sorted(x for x in os.listdir(out) if x.endswith(".json"))
            if not found:
                raise RuntimeError("the converter left no export")
            with open(os.path.join(out, found[0]), "rb") as f:
                exported = f.read()
        if json.loads(exported).get("schema_name") != "DoclingDocument":
            raise ValueError("not a structured document")
        return structured_blocks(exported)

    return parse


def no_pdf(data: bytes) -> str:
    raise RuntimeError("no PDF extractor is configured")


#: name -> (version, parser, error code). ``register`` adds others.
PARSERS: dict[str, tuple[int, Callable[[bytes], dict], str]] = {
    "plain": (1, plain_blocks, "E_PARSE_MD"),
    "markdown": (1, markdown_blocks, "E_PARSE_MD"),
    "pdf": (1, pdf_blocks(no_pdf), "E_PARSE_PDF"),
    "docling": (1, structured_blocks, "E_PARSE_EXTERNAL"),
}
EXTENSIONS = {"txt": "plain", "md": "markdown", "markdown": "markdown", "pdf": "pdf", "json": "docling"}


def register(name: str, parser: Callable[[bytes], dict], version: int = 1, code: str = "E_PARSE_EXTERNAL") -> None:
    """Add or replace a parser; it takes bytes and returns title, canonical_text, blocks and losses."""
    PARSERS[name] = (version, parser, code)


def parser_of(path: Column, name: str = "auto") -> Column:
    """The parser for a file: ``name``, or by extension."""
    if name != "auto":
        return F.lit(name)
    ext = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    return F.coalesce(*(F.when(ext == e, F.lit(p)) for e, p in EXTENSIONS.items()), F.lit("plain"))


def parsed(files: DataFrame, content: str = "content", parser: str = "parser") -> DataFrame:
    """Columns of ``files`` and those of PARSED. A file that fails becomes a row with an error, not a failed task."""
    from pagewright.operators.graph import problem_of

    names = [f.name for f in files.schema]
    table = dict(PARSERS)

    def make():
        def one(data: bytes | None, name: str) -> dict:
            empty = {"title": None, "canonical_text": None, "blocks": [], "losses": []}
            if name not in table:
                return empty | {"error_code": "E_INVALID_INPUT", "error": f"unknown parser: {name}"}
            _, parse, code = table[name]
            try:
                got = parse(data or b"")
            except Exception as e:  # any failure of a parser is the file's
                return empty | {"error_code": code, "error": f"{type(e).__name__}: {e}"}
            wrong = problem_of(len((got["canonical_text"] or "").encode()), [(b[1], b[2]) for b in got["blocks"]])
            if wrong:
                return empty | {"error_code": "E_INVALID_IR", "error": wrong}
            return got | {"error_code": None, "error": None}

        def as_dict(fields: tuple[str, ...], rows: list[tuple]) -> list[dict]:
            return [dict(zip(fields, r, strict=True)) for r in rows]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
            for b in batches:
                got = [one(d, p) for d, p in zip(b.column(names.index(content)).to_pylist(), b.column(names.index(parser)).to_pylist(), strict=True)]
                for g in got:
                    g["blocks"] = as_dict(("kind", "span_start", "span_end", "text"), g["blocks"])
                    g["losses"] = as_dict(("kind", "span_start", "span_end", "message"), g["losses"])
                yield {n: b.column(i) for i, n in enumerate(names)} | {c: [g[c] for g in got] for c in ("title", "canonical_text", "blocks", "losses", "error_code", "error")}

        return run

    return arrow_map(files, make, f"{files._jdf.schema().toDDL()}, {PARSED}")
