"""WARC archives: a writer with revisit records, and a reader that salvages damaged files.

Records are built by SQL expressions, compressed as one gzip member each, and written through
Spark's own text sink, so that archives can lie in any store Spark writes to. The reader checks every record (version line, headers,
length, end, block digest). Where a check fails it searches on for the next version line or gzip
member that passes all of them, and logs the bytes between as a quarantined gap.
"""

from __future__ import annotations

import gzip
import hashlib
import logging
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm.common import arrow_map, column, cut, prepare, texts

#: Payloads of fewer bytes are always stored.
LEAST_BYTES = 100
DATE = "2024-01-01T00:00:00Z"
CRLF = "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_VERSION = re.compile(rb"WARC/1\.[01]\r\n")
_MEMBER = b"\x1f\x8b\x08"
#: Compressed bytes inflated at once, at first and later in a member.
FIRST_STEP, STEP = 1 << 11, 1 << 16
#: Bytes of payloads in one batch of rows.
BATCH = 4 << 20
#: Rows of a table up to which it is broadcast.
SMALL = 500_000
_log = logging.getLogger(__name__)


@dataclass
class Record:
    offset: int
    length: int
    headers: dict[str, str]
    payload: bytes


@dataclass
class Gap:
    offset: int
    length: int
    reason: str


@dataclass
class Salvaged:
    records: list[Record] = field(default_factory=list)
    gaps: list[Gap] = field(default_factory=list)


class Damaged(Exception):
    pass


def parse_record(data: bytes, at: int) -> Record:
    """The record at ``at``, if it passes all checks."""
    m = _VERSION.match(data, at)
    if not m:
        raise Damaged("no version line")
    end = data.find(b"\r\n\r\n", m.end() - 2)
    if end < 0:
        raise Damaged("headers do not end")
    headers = {}
    for line in data[m.end() : end].split(b"\r\n") if end > m.end() else []:
        name, colon, value = line.partition(b":")
        if not colon or not name:
            raise Damaged("malformed header")
        try:
            headers[name.decode("ascii").lower()] = value.strip().decode("utf-8")
        except UnicodeDecodeError:
            raise Damaged("malformed header") from None
    size = headers.get("content-length", "")
    if not (size.isascii() and size.isdigit()) or "warc-type" not in headers:
        raise Damaged("no length or type")
    start, stop = end + 4, end + 4 + int(size)
    if data[stop : stop + 4] != b"\r\n\r\n":
        raise Damaged("record does not end where its length says")
    block = data[start:stop]
    kind, _, digest = headers.get("warc-block-digest", "").partition(":")
    if kind == "sha256" and hashlib.sha256(block).hexdigest() != digest:
        raise Damaged("block digest differs")
    payload = block.partition(b"\r\n\r\n")[2] if headers.get("content-type", "").startswith("application/http") else block
    return Record(at, stop + 4 - at, headers, payload)


def salvage_plain(data: bytes, base: int = 0) -> Iterator[Record | Gap]:
    """Records of uncompressed bytes, and the gaps between them; offsets are shifted by ``base``."""
    at, lost, reason = 0, -1, ""
    while at < len(data):
        try:
            record = parse_record(data, at)
        except Damaged as e:
            if lost < 0:
                lost, reason = at, str(e)
            m = _VERSION.search(data, at + 1)
            at = m.start() if m else len(data)
            continue
        if lost >= 0:
            yield Gap(base + lost, at - lost, reason)
            lost = -1
        at += record.length
        record.offset += base
        yield record
    if lost >= 0:
        yield Gap(base + lost, len(data) - lost, reason)


def inflated(data: bytes, at: int) -> tuple[bytes, int, str]:
    """What the member at ``at`` inflates to, as far as it does, the bytes it takes, and what is wrong with it.

    A damaged member takes no bytes: where it ends isn't known.
    """
    inflate, plain, view, why = zlib.decompressobj(31), [], memoryview(data), "member does not end"
    k, step = at, FIRST_STEP
    while k < len(data):
        # A member is taken from a copy of the state before, so that what a failing step has put out isn't lost.
        before = inflate.copy() if step == STEP else None
        try:
            plain.append(inflate.decompress(view[k : k + step]))
        except zlib.error as e:
            why = f"member fails: {e}"
            break
        if inflate.eof:
            return b"".join(plain), min(k + step, len(data)) - len(inflate.unused_data) - at, ""
        k, step = k + step, min(2 * step, STEP)
        if k - at > STEP and not any(plain):
            why = "member puts out nothing"
            break
    if not why.startswith("member fails"):
        return b"".join(plain), 0, why
    if before is None:
        before, plain, k = zlib.decompressobj(31), [], at
    try:
        for i in range(k, min(k + STEP, len(data))):
            plain.append(before.decompress(view[i : i + 1]))
    except zlib.error:
        pass
    return b"".join(plain), 0, why


def salvage_gzip(data: bytes) -> Iterator[Record | Gap]:
    """Records of gzip members, also of damaged ones as far as they inflate. Empty members are skipped.

    Offset and length of a record are those of its member. A gap inside a whole member is logged
    with the member's offset and length and its place among the inflated bytes; of a damaged
    member the bytes up to the next member that is whole or holds records are a gap.
    """
    at, lost, reason = 0, -1, ""
    while at < len(data):
        plain, size, why = inflated(data, at) if data.startswith(_MEMBER, at) else (b"", 0, "no gzip member")
        found = list(salvage_plain(plain))
        records, gaps = [r for r in found if isinstance(r, Record)], [g for g in found if isinstance(g, Gap)]
        if records or size and not plain:
            if lost >= 0:
                yield Gap(lost, at - lost, reason)
                lost = -1
        if size and (records or not plain):
            yield from (Record(at, size, r.headers, r.payload) for r in records)
            yield from (Gap(at, size, f"{g.reason}, at {g.offset} of the inflated bytes, {g.length} long") for g in gaps)
            at += size
            continue
        if lost < 0:
            lost, reason = at, gaps[0].reason if size else why
        after = data.find(_MEMBER, at + 1)
        after = len(data) if after < 0 else after
        yield from (Record(at, after - at, r.headers, r.payload) for r in records)
        at = after
    if lost >= 0:
        yield Gap(lost, len(data) - lost, reason)


def salvaged(data: bytes) -> Iterator[Record | Gap]:
    """All whole records of an archive, and the byte gaps between them, one by one."""
    plain, member = _VERSION.search(data), data.find(_MEMBER)
    return salvage_gzip(data) if data.startswith(_MEMBER) or member >= 0 and (not plain or member < plain.start()) else salvage_plain(data)


def salvage(data: bytes) -> Salvaged:
    """The same, gathered."""
    out = Salvaged()
    for x in salvaged(data):
        (out.records if isinstance(x, Record) else out.gaps).append(x)
    return out


def _headers(pairs: list[tuple[str, Column]]) -> Column:
    """Header lines; a pair whose value is null has none."""
    return F.concat(F.lit("WARC/1.1" + CRLF), *(F.coalesce(F.concat(F.lit(f"{n}: "), v.cast("string"), F.lit(CRLF)), F.lit("")) for n, v in pairs), F.lit(CRLF))


def records(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", *, least_bytes: int = LEAST_BYTES, date: str = DATE, broadcast: int = SMALL) -> DataFrame:
    """(record): one WARC record as text for each row, without its last line end.

    Of payloads that are equal by SHA-256 and have ``least_bytes`` or more bytes, the one with the
    smallest id is a response, the others are revisits of it. Rows equal in id and payload are
    responses or revisits alike; a null id is never the smallest unless all are null.
    """
    text = F.coalesce(F.col(f"`{html_col}`").cast("string"), F.lit(""))
    pages = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.regexp_replace(F.col(f"`{url_col}`").cast("string"), r"[\x00-\x20\x7f]", "%20").alias("url"), text.alias("html"), F.octet_length(text).cast("long").alias("bytes"), F.sha2(text.cast("binary"), 256).alias("digest"))
    # Only digests that occur again matter. Payloads never meet by digest, so an error page that a third of all urls return is no one task's.
    first = pages.where(F.col("bytes") >= least_bytes).groupBy(F.col("digest").alias("digest2")).agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    first = cut(first, "first")
    if first.count() <= broadcast:
        pages = pages.join(F.broadcast(first), F.col("digest") == F.col("digest2"), "left")
    else:
        marked = pages.select("id", F.col("digest")).distinct().join(first, F.col("digest") == F.col("digest2")).select(F.col("id").alias("id3"), F.col("digest").alias("digest3"), "first")
        pages = pages.join(cut(marked, "marked"), F.col("id").eqNullSafe(F.col("id3")) & (F.col("digest") == F.col("digest3")), "left")
    revisit = F.coalesce(F.col("first") != F.coalesce("id", F.col("first") - 1), F.lit(False))
    http = F.concat(F.lit("HTTP/1.1 200 OK" + CRLF + "Content-Type: text/html; charset=utf-8" + CRLF + "Content-Length: "), F.col("bytes").cast("string"), F.lit(CRLF + CRLF))
    block = F.concat(http, F.when(revisit, F.lit("")).otherwise(F.col("html")))

    def name(key: Column) -> Column:
        h = F.sha2(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(":"), F.col("digest")), 256)
        return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))), F.lit(">"))

    pairs = [
        ("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        ("WARC-Record-ID", name(F.col("id"))),
        ("WARC-Date", F.lit(date)),
        ("WARC-Target-URI", F.col("url")),
        ("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        ("WARC-Block-Digest", F.concat(F.lit("sha256:"), F.sha2(block.cast("binary"), 256))),
        ("WARC-Profile", F.when(revisit, F.lit(PROFILE))),
        ("WARC-Refers-To", F.when(revisit, name(F.col("first")))),
        ("X-Refers-To-Page-Id", F.when(revisit, F.col("first"))),
        ("X-Page-Id", F.col("id")),
        ("X-Payload-Length", F.col("bytes")),
        ("Content-Type", F.lit("application/http; msgtype=response")),
        ("Content-Length", F.octet_length(block)),
    ]
    return pages.select(F.concat(_headers(pairs), block, F.lit(CRLF)).alias("record"))


_EMPTY = gzip.compress(b"", 1, mtime=0)


def member(record: bytes) -> bytes:
    """A gzip member, or two of which the second is empty, that ends with a zero byte.

    The last four bytes are the size, so that those of a member of fewer than 16 MB end with zero.
    """
    out = gzip.compress(record, 1, mtime=0)
    return out if out.endswith(b"\0") else out + _EMPTY


def write_archives(df: DataFrame, path: str, *, records_per_file: int = 2000, **named: str | int) -> None:
    """Write a record for each row of ``df`` into gzip archives under ``path``. See ``records``.

    The text sink writes the bytes of a row as they are and a line end behind each. The line end is
    the zero byte that every member ends with, so the files are nothing but members.
    """
    prepare(df.sparkSession)

    def make():
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
            for b in batches:
                yield {"member": [member(r + b"\r\n")[:-1] for r in texts(b, "record")]}

        return run

    members = arrow_map(records(df, **named), make, "member binary").select(F.col("member").cast("string"))
    members.write.option("lineSep", "\0").option("maxRecordsPerFile", records_per_file).text(path)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(path, offset, length, kind, reason, headers, payload) of the archives, plain or gzip, under ``path``.

    ``kind`` is record or gap; a gap's ``reason`` is the first check that failed there, and each gap
    goes to the executor's log, too. Header names are in lower case. An archive is read whole by one
    task, in time that grows with its size, and must be smaller than 2 GB, the most that Spark's
    reader of binary files takes; a gzip member is inflated whole. Larger archives are to be cut
    into files at any byte: what the cut breaks in two is a gap.
    """
    prepare(spark)

    def make():
        names = ("offset", "length", "kind", "reason", "headers", "payload")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
            for b in batches:
                for name, data in zip(column(b, "path").to_pylist(), column(b, "content"), strict=True):
                    rows, size = [], 0
                    for x in salvaged(data.as_py()):
                        if isinstance(x, Gap):
                            _log.warning("quarantined %d bytes at %d of %s: %s", x.length, x.offset, name, x.reason)
                            rows.append((x.offset, x.length, "gap", x.reason, [], None))
                        else:
                            rows.append((x.offset, x.length, "record", None, list(x.headers.items()), x.payload))
                            size += len(x.payload) + 1000
                        if size > BATCH:
                            yield {"path": [name] * len(rows)} | dict(zip(names, map(list, zip(*rows, strict=True)), strict=True))
                            rows, size = [], 0
                    if rows:
                        yield {"path": [name] * len(rows)} | dict(zip(names, map(list, zip(*rows, strict=True)), strict=True))

        return run

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return arrow_map(files, make, "path string, offset long, length long, kind string, reason string, headers map<string,string>, payload binary")
