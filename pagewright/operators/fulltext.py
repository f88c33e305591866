"""The inverted index and BM25 over segments."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.arrow import arrow_map
from pagewright.functions import text as tx

K1, B = 1.2, 0.75
#: Tokens that are turned into postings at once, and hits that are unpacked at once.
BLOCK = 1_000_000
#: Bytes from which a term's packed hits go their own way to a task, so that no task gets all of a frequent term.
APART = 65_536
#: Bytes of packed postings that a task holds at most before it compresses and sends them.
BOXED = 1 << 26
HIT = "struct<no:bigint,seg_index:int,positions:array<int>>"


def tokens(segments: DataFrame, key: str = "segment_id", body: str = "body") -> DataFrame:
    """(segment_id, position, term)."""
    return segments.select(key, F.posexplode(tx.terms(F.col(body))).alias("position", "term"))


def postings(segments: DataFrame, key: str = "segment_id", body: str = "body") -> DataFrame:
    """(term, segment_id, tf, positions).

    All tokens of a segment stand in one row, so the map side already aggregates them to one row per
    segment and distinct term; only those are shuffled.
    """
    grouped = tokens(segments, key, body).groupBy("term", key).agg(F.array_sort(F.collect_list("position")).alias("positions"))
    return grouped.select("term", key, F.size("positions").alias("tf"), "positions")


def _varints(values: np.ndarray, firsts: np.ndarray) -> pa.Array:
    """Numbers in 7 bits a byte, least first, as one binary value for each group; ``firsts`` has where groups begin."""
    v = values.astype(np.uint64)
    size = np.ones(len(v), np.int64)
    for k in range(1, 10):
        more = v >= np.uint64(1 << 7 * k)
        if not more.any():
            break
        size += more
    ends = np.cumsum(size)
    starts = ends - size
    out = np.empty(ends[-1], np.uint8)
    for k in range(size.max()):
        m = np.flatnonzero(size > k)
        out[starts[m] + k] = ((v[m] >> np.uint64(7 * k)) & np.uint64(127)).astype(np.uint8) | ((size[m] > k + 1).astype(np.uint8) << 7)
    offsets = np.append(starts[firsts], ends[-1]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(firsts), [None, pa.py_buffer(offsets), pa.py_buffer(out)])


def _numbers(packed: pa.Array) -> np.ndarray:
    """All numbers that _varints() packed into some binary values, in order."""
    at = np.frombuffer(packed.buffers()[1], np.int32)[packed.offset : packed.offset + len(packed) + 1]
    data = np.frombuffer(packed.buffers()[2], np.uint8)[at[0] : at[-1]]
    ends = np.flatnonzero(data < 128)
    starts = np.append(0, ends[:-1] + 1)
    size = ends - starts + 1
    out = np.zeros(len(ends), np.int64)
    for k in range(size.max()):
        m = np.flatnonzero(size > k)
        out[m] |= (data[starts[m] + k].astype(np.int64) & 127) << (7 * k)
    return out


def _sums(steps: np.ndarray, firsts: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Running sums that begin anew at ``firsts``, over groups of ``n``."""
    total = np.cumsum(steps)
    return total - np.repeat(total[firsts] - steps[firsts], n)


def _steps(values: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    out = np.diff(values, prepend=0)
    out[firsts] = values[firsts]
    return out


def packed(segments: DataFrame, body: str = "body") -> DataFrame:
    """Postings of segments (batch, no, seg_index, body), packed: a row for each term, batch and block of up to about BLOCK tokens.

    All tokens of a segment stand in one row, so a task turns its rows into postings without a shuffle.
    What is dealt out by term later are these rows, of about four bytes a posting.
    """

    def flushed(batch: int, held: list) -> dict:
        nos, segs, words = zip(*held, strict=True)
        terms = pa.concat_arrays([w.flatten() for w in words])
        sizes = np.concatenate([pc.list_value_length(w).to_numpy(zero_copy_only=False) for w in words]).astype(np.int64)
        no, seg = np.concatenate(nos), np.concatenate(segs)
        by = np.lexsort((seg, no))
        rank = np.empty(len(by), np.int64)
        rank[by] = np.arange(len(by))
        coded = terms.dictionary_encode()
        names = coded.dictionary
        alphabetical = pc.sort_indices(names.cast(pa.binary())).to_numpy()
        place = np.empty(len(names), np.int64)
        place[alphabetical] = np.arange(len(names))
        key = place[coded.indices.to_numpy()] * len(by) + np.repeat(rank, sizes)
        position = np.arange(len(key)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        order = np.argsort(key, kind="stable")
        key, position = key[order], position[order]
        hit = np.flatnonzero(np.diff(key, prepend=-1))
        term, row = np.divmod(key[hit], len(by))
        first = np.flatnonzero(np.diff(term, prepend=-1))
        docs = no[by][row]
        return {
            "term": names.take(pa.array(alphabetical)), "batch": pa.array(np.full(len(first), batch)), "base": pa.array(docs[first]), "n": pa.array(np.diff(np.append(first, len(hit))).astype(np.int32)), "docs": _varints(_steps(docs, first), first),
            "segs": _varints(seg[by][row], first), "tfs": _varints(np.diff(np.append(hit, len(key))), first), "places": _varints(_steps(position, hit), hit[first]),
        }

    def make():
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
            held: dict[int, list] = {}
            n: dict[int, int] = {}
            for whole in batches:
                for at in range(0, whole.num_rows, 2_000):
                    part = whole.slice(at, 2_000)
                    own = pc.unique(part.column(0)).to_pylist()
                    for batch in own:
                        b = part if len(own) == 1 else part.filter(pc.equal(part.column(0), batch))
                        held.setdefault(batch, []).append((b.column(1).to_numpy(), b.column(2).to_numpy(), b.column(3)))
                        n[batch] = n.get(batch, 0) + len(b.column(3).flatten())
                    for batch in [k for k in n if n[k] >= BLOCK] or (list(n) if sum(n.values()) >= 2 * BLOCK else []):
                        yield flushed(batch, held.pop(batch))
                        n.pop(batch)
            for batch in [k for k in n if n[k]]:
                yield flushed(batch, held.pop(batch))

        return run

    rows = segments.where(F.col(body).isNotNull()).select("batch", "no", F.col("seg_index").cast("bigint"), tx.terms(F.col(body)).alias("words"))
    return arrow_map(rows, make, "term string, batch bigint, base bigint, n int, docs binary, segs binary, tfs binary, places binary")


def dealt(rows: DataFrame) -> DataFrame:
    """Packed postings dealt out by term and sorted; large rows of one term go to several tasks.

    Shuffled are not rows, most of which are of rare terms and small, but compressed blocks of the rows
    that a task has for one of as many buckets as there are shuffle partitions.
    """
    buckets = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    columns = rows.columns
    bucket = F.pmod(F.hash("term", F.when(F.octet_length("docs") > APART, F.col("base"))), F.lit(buckets))

    def boxed():
        def flushed(held: list[pa.RecordBatch]) -> dict:
            whole = pa.Table.from_batches(held).combine_chunks()
            own = whole.column(0).to_numpy()
            order = np.argsort(own, kind="stable")
            first = np.flatnonzero(np.diff(own[order], prepend=-1))
            whole = whole.take(pa.array(order)).drop_columns(whole.column_names[0])
            blocks = []
            for at, n in zip(first.tolist(), np.diff(np.append(first, len(order))).tolist(), strict=True):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, whole.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
                    writer.write_table(whole.slice(at, n).combine_chunks())
                blocks.append(sink.getvalue().to_pybytes())
            return {"bucket": pa.array(own[order][first]), "block": blocks}

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
            held, size = [], 0
            for b in batches:
                if not b.num_rows:
                    continue
                held.append(b)
                size += b.nbytes
                if size >= min(BOXED, max(BOXED // 8, buckets << 15)):
                    yield flushed(held)
                    held, size = [], 0
            if held:
                yield flushed(held)

        return run

    def opened():
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
            for b in batches:
                for block in b.column(0):
                    for part in pa.ipc.open_stream(block.as_buffer()):
                        yield dict(zip(columns, part.columns, strict=True))

        return run

    blocks = arrow_map(rows.select(bucket.alias("bucket"), *columns), boxed, "bucket int, block binary").repartition("bucket")
    return arrow_map(blocks.select("block"), opened, rows._jdf.schema().toDDL()).sortWithinPartitions("term", "batch", "base")


def unpacked(rows: DataFrame) -> DataFrame:
    """(term, batch, hits) of packed postings; a hit is a segment's document number and place in it, and the term's positions."""
    places = pa.list_(pa.int32())
    hit = pa.struct([("no", pa.int64()), ("seg_index", pa.int32()), ("positions", places)])

    def make():
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
            for whole in batches:
                ends = np.cumsum(whole.column(2).to_numpy())
                at = 0
                while at < whole.num_rows:
                    upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BLOCK, "right")))
                    b = whole.slice(at, upto - at)
                    at = upto
                    n = b.column(2).to_numpy().astype(np.int64)
                    first = np.cumsum(n) - n
                    no, seg, tf = _sums(_numbers(b.column(3)), first, n), _numbers(b.column(4)), _numbers(b.column(5))
                    opens = np.cumsum(tf) - tf
                    position = _sums(_numbers(b.column(6)), opens, tf).astype(np.int32)
                    inner = pa.ListArray.from_arrays(pa.array(np.append(opens, len(position)).astype(np.int32)), pa.array(position))
                    found = pa.StructArray.from_arrays([pa.array(no), pa.array(seg.astype(np.int32)), inner.cast(places)], fields=list(hit))
                    yield {"term": b.column(0), "batch": b.column(1), "hits": pa.ListArray.from_arrays(pa.array(np.append(first, len(no)).astype(np.int32)), found)}

        return run

    return arrow_map(rows.select("term", "batch", "n", "docs", "segs", "tfs", "places"), make, f"term string, batch bigint, hits array<{HIT}>")


def term_counts(segments: DataFrame, key: str = "segment_id", body: str = "body") -> DataFrame:
    """(term, segment_id, tf) with map-side aggregation; what scoring needs of the postings."""
    return tokens(segments, key, body).groupBy("term", key).agg(F.count("*").cast("int").alias("tf"))


def lengths(segments: DataFrame, key: str = "segment_id", body: str = "body") -> DataFrame:
    """(segment_id, doc_len) of the segments that have a body; one without terms has length 0."""
    return segments.where(F.col(body).isNotNull()).select(key, F.size(tx.terms(F.col(body))).cast("bigint").alias("doc_len"))


def term_stats(counts: DataFrame) -> DataFrame:
    """(term, df): segments that hold the term."""
    return counts.groupBy("term").agg(F.count("*").alias("df"))


def corpus_stats(lens: DataFrame) -> DataFrame:
    """One row (n_segments, avg_len)."""
    return lens.agg(F.count("*").alias("n_segments"), F.avg("doc_len").alias("avg_len"))


def idf(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def weight(tf: Column, doc_len: Column, avg_len: Column) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * doc_len / avg_len))


def query_terms(queries: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(query_id, term, times): the terms of each query and how often each stands there."""
    return queries.select(F.col(id_col).alias("query_id"), F.explode(tx.terms(F.col(text_col))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))


def bm25(counts: DataFrame, lens: DataFrame, stats: DataFrame, wanted: DataFrame, key: str = "segment_id") -> DataFrame:
    """(query_id, segment_id, bm25_score) of all segments with a term of the query.

    ``wanted`` is (query_id, term, times). The terms are joined to the postings first, so what is
    scored are only their postings; document frequencies come from the same rows.
    """
    of_terms = counts.join(wanted.select("term").distinct(), "term", "left_semi")
    df = of_terms.groupBy("term").agg(F.count("*").alias("df"))
    one = stats.select(F.col("n_segments").alias("n"), F.col("avg_len"))
    scored = of_terms.join(df, "term").join(lens, key).crossJoin(F.broadcast(one))
    part = scored.select("term", key, (idf(F.col("n"), F.col("df")) * weight(F.col("tf"), F.col("doc_len"), F.col("avg_len"))).alias("part"))
    return part.join(wanted, "term").groupBy("query_id", key).agg(F.sum(F.col("part") * F.col("times")).alias("bm25_score"))


def top(scores: DataFrame, k: int, score: str, key: str = "segment_id", rank: str = "rank", query: str = "query_id") -> DataFrame:
    """The ``k`` best rows of each query with their 1-based rank; ties go to the smaller key."""
    w = Window.partitionBy(query).orderBy(F.desc(score), key)
    return scores.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def top_one(scores: DataFrame, k: int, score: str, key: str = "segment_id", rank: str = "rank") -> DataFrame:
    """``top`` for a single query: each task keeps ``k`` rows, only those meet."""
    best = scores.orderBy(F.desc(score), key).limit(k)
    return best.withColumn(rank, F.row_number().over(Window.orderBy(F.desc(score), key)))
