"""String, byte and identity functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The characters of Unicode's White_Space property, as a regular expression class.
SPACE = r"[\t\n\x0b\f\r \x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
#: What separates search terms.
SEPARATOR = r"[^\p{IsAlphabetic}\p{N}]+"
#: Terms of so many bytes or more aren't indexed.
LONG_TERM = 40


def trim(text: Column) -> Column:
    """Without white space at both ends, by Unicode's definition. The expression tries every place of a text, so only texts with such an end meet it."""
    ends = F.concat(F.left(text, F.lit(1)), F.right(text, F.lit(1)))
    return F.when(ends.rlike(SPACE), F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")).otherwise(text)


def leading_bytes(text: Column) -> Column:
    """Bytes of white space before the first other character."""
    return F.octet_length(text) - F.octet_length(F.regexp_replace(text, f"^{SPACE}+", ""))


def lines(text: Column) -> Column:
    """Lines without their ends; a last empty line isn't one."""
    parts = F.split(F.regexp_replace(text, "\r\n", "\n"), "\n", -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def first_line(text: Column) -> Column:
    """The first line that isn't blank, trimmed; null if there is none."""
    return F.try_element_at(F.filter(F.transform(lines(text), trim), lambda x: x != ""), F.lit(1))


def terms(text: Column) -> Column:
    """Search terms in order: runs of letters and digits, not overlong ones, in lower case."""
    return F.transform(F.filter(F.split(text, SEPARATOR), lambda t: (t != "") & (F.octet_length(t) < LONG_TERM)), F.lower)


def content_id(prefix: str, content: Column) -> Column:
    """An identity derived from content: ``<prefix>_<sha-256>``."""
    return F.concat(F.lit(f"{prefix}_"), F.sha2(content.cast("binary"), 256))


def derived_id(prefix: str, *parts: Column, digits: int = 64) -> Column:
    """An identity derived from parts joined by colons, cut to ``digits`` hex digits."""
    return F.concat(F.lit(f"{prefix}_"), F.substring(F.sha2(F.concat_ws(":", *(p.cast("string") for p in parts)).cast("binary"), 256), 1, digits))


def byte_prefix(text: Column, limit: int) -> Column:
    """The longest prefix of whole characters that has at most ``limit`` bytes."""
    head = F.substring(text.cast("binary"), 1, limit)
    # An unfinished last character is a lead byte followed by fewer bytes than it announces.
    whole = F.when(F.is_valid_utf8(head.cast("string")), head.cast("string"))
    shorter = [F.substring(text.cast("binary"), 1, limit - k).cast("string") for k in (1, 2, 3)]
    cut = F.coalesce(whole, *(F.when(F.is_valid_utf8(x), x) for x in shorter), F.lit(""))
    return F.when(F.octet_length(text) <= limit, text).otherwise(cut)


def snippet(body: Column, limit: int = 200) -> Column:
    """At most ``limit`` bytes: cut at the last space before, with dots."""
    head = byte_prefix(body, limit)
    at_space = F.when(F.instr(head, " ") > 0, F.regexp_extract(head, r"(?s)^(.*) ", 1)).otherwise(head)
    return F.when(F.octet_length(body) <= limit, body).otherwise(F.concat(at_space, F.lit("...")))


# Half-open byte spans.


def span_length(start: Column, end: Column) -> Column:
    return end - start


def span_is_empty(start: Column, end: Column) -> Column:
    return start == end


def span_contains(start: Column, end: Column, a: Column, z: Column) -> Column:
    """Whether [start, end) holds all of [a, z); equal spans do."""
    return (start <= a) & (z <= end)


def span_overlaps(start: Column, end: Column, a: Column, z: Column) -> Column:
    """Whether the spans share a byte; adjacent ones don't."""
    return (start < z) & (a < end)


def slice_bytes(text: Column, start: Column, end: Column) -> Column:
    """The bytes [start, end) of a text, as text."""
    return F.substring(text.cast("binary"), (start + 1).cast("int"), (end - start).cast("int")).cast("string")
