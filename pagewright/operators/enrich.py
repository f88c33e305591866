"""Heuristic metadata of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.functions import text as tx

SUMMARY_CHARS = 500


def heading(line: Column) -> Column:
    """The heading of a trimmed line that starts with a hash, maybe empty; null for other lines."""
    return F.when(line.startswith("#"), tx.trim(F.regexp_replace(line, "^#+", "")))


def title(text: Column) -> Column:
    """The first line that isn't blank, without a heading's hashes unless it is all hashes."""
    first = tx.first_line(text)
    h = heading(first)
    return F.when(h != "", h).otherwise(first)


def summary(text: Column) -> Column:
    """The first characters; null for an empty text."""
    return F.when(F.octet_length(text) > 0, F.substring(text, 1, SUMMARY_CHARS))


def tags(text: Column) -> Column:
    """Headings in lower case, each once, as they first come."""
    found = F.transform(tx.lines(text), lambda x: F.lower(heading(tx.trim(x))))
    return F.array_distinct(F.filter(found, lambda x: x.isNotNull() & (x != "")))


def enrich(docs: DataFrame, text: str = "canonical_text", key: str = "doc_id") -> DataFrame:
    """(doc_id, title, summary, tags, provider, content_hash) of each document."""
    t = F.col(text)
    return docs.select(key, title(t).alias("title"), summary(t).alias("summary"), tags(t).alias("tags"), F.lit("heuristic").alias("provider"), F.sha2(t.cast("binary"), 256).alias("content_hash"))
