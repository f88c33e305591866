"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Items are cut into overlapping word n-grams, short ones into shorter n-grams. In scripts that are
written without spaces each character counts as a word. One pass over all documents reads their words and
keeps those documents that hold any of the n-grams, as word numbers. From these it is counted how
many documents hold each n-gram; an n-gram much more frequent than its item's others is no seed.
The seeds are then joined with the n-grams of the numbered documents, and each window around the
hits of one item is aligned with the item, so that edited and paraphrased copies score by what
they still share.

Items go to the executors in blocks of a bounded size, each block against all documents, so the
benchmark may be of any size; documents are never shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm.common import arrow_map, column, cut, drop, keyed, prepare, texts

#: Words of items in one block; what is broadcast is at most a few hundred bytes a word.
BLOCK_WORDS = 200_000
#: A seed's document count may be so many times the median of its item's seeds.
RARE = 8
GAP = 1.0
#: Letters of scripts without spaces between words: Thai, Lao, Burmese, Khmer, kana and Han.
_SINGLE = "\u0e01-\u0e5b\u0e81-\u0edf\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
_WORD = re.compile(rf"[{_SINGLE}]|[^\W{_SINGLE}]+")


def words_of(text: bytes) -> list[str]:
    """Lower-cased words; punctuation and white space only separate."""
    return _WORD.findall(text.decode("utf-8", "replace").lower())


def seed_size(words: int, n: int) -> int:
    """Words of the seeds of an item of so many words: ``n``, or half of the item if that is less, so that an edit leaves some whole."""
    return min(n, max(1, words // 2))


class Items:
    """A block of items: word numbers, and their n-grams as one sorted array of codes."""

    def __init__(self, items: list[tuple[int, list[str]]], n: int):
        self.ids = [i for i, _ in items]
        self.vocabulary: dict[str, int] = {}
        self.words = [np.array([self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words], np.int64) for _, words in items]
        self.sizes = np.array([len(w) for w in self.words])
        seeds = [seed_size(len(w), n) for w in self.words]
        #: Sizes of n-grams that some item has.
        self.n = sorted(set(seeds))
        codes, owner, at = [], [], []
        for k, (w, size) in enumerate(zip(self.words, seeds, strict=True)):
            c = self.grams(w, size)
            codes.append(c)
            owner.append(np.full(len(c), k))
            at.append(np.arange(len(c)))
        codes, owner, at = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (codes, owner, at))
        order = np.lexsort((at, owner, codes))
        self.codes, self.owner, self.at = codes[order], owner[order], at[order]

    @staticmethod
    def grams(w: np.ndarray, n: int) -> np.ndarray:
        """Code of the ``n``-gram at each word, -1 where one of its words is in no item.

        Codes are mixed into 62 bits; equal n-grams have equal codes, and the alignment decides.
        """
        size = max(0, len(w) - n + 1)
        code, known = np.full(size, n, np.uint64), np.ones(size, bool)
        for k in range(n):
            part = w[k : k + size]
            known &= part >= 0
            code = (code ^ part.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            code ^= code >> np.uint64(29)
        return np.where(known, (code >> np.uint64(2)).astype(np.int64), -1)

    def numbers(self, words: list[str]) -> np.ndarray:
        get = self.vocabulary.get
        return np.fromiter((get(w, -1) for w in words), np.int64, len(words))

    def hits(self, w: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Word positions of ``w`` whose n-gram is in sorted ``codes``, and the index there."""
        where, which = [], []
        for n in self.n if len(codes) else ():
            got = self.grams(w, n)
            at = np.flatnonzero(got >= 0)
            k = np.minimum(np.searchsorted(codes, got[at]), len(codes) - 1)
            same = codes[k] == got[at]
            where.append(at[same])
            which.append(k[same])
        return (np.concatenate(where), np.concatenate(which)) if where else (np.empty(0, np.int64),) * 2


def align(a: np.ndarray, b: np.ndarray) -> tuple[float, int, int]:
    """Best local alignment of item ``a`` with ``b``: score, and the first and end position in ``b``.

    Smith-Waterman with +1 for a match, -1 for a mismatch and ``GAP`` a gapped word. The row-wise
    gap is a running maximum; the start of the best path is carried along.
    """
    m = len(b)
    score, start = np.zeros(m + 1), np.arange(m + 1)
    best = (0.0, 0, 0)
    step = GAP * np.arange(m + 1)
    for x in a:
        up, diag = score - GAP, score[:-1] + np.where(b == x, 1.0, -1.0)
        new, begin = up.copy(), start.copy()
        better = diag >= new[1:]
        new[1:][better], begin[1:][better] = diag[better], start[:-1][better]
        fresh = new <= 0
        new[fresh], begin[fresh] = 0.0, np.flatnonzero(fresh)
        run = np.maximum.accumulate(new + step)
        source = np.maximum.accumulate(np.where(new + step >= run, np.arange(m + 1), 0))
        score, start = np.maximum(run - step, 0.0), begin[source]
        k = int(score.argmax())
        if score[k] > best[0]:
            best = (float(score[k]), int(start[k]), k)
    return best


def windows(at: np.ndarray, offset: np.ndarray, size: int, length: int) -> list[tuple[int, int]]:
    """Stretches of a document where hits place an item of ``size`` words, with room for edits."""
    pad = size // 2 + 2
    lo, hi = at - offset - pad, at - offset + size + pad
    order = np.argsort(lo, kind="stable")
    lo, hi = lo[order], np.maximum.accumulate(hi[order])
    new = np.flatnonzero(np.r_[True, lo[1:] > hi[:-1]])
    return [(max(0, int(lo[s])), min(length, int(hi[e - 1]))) for s, e in zip(new, np.r_[new[1:], len(lo)], strict=True)]


def _number_maker(block: Broadcast):
    def make():
        items: Items = block.value
        codes = np.unique(items.codes)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
            for b in batches:
                rows, numbered = [], []
                for row, t in enumerate(texts(b)):
                    w = items.numbers(words_of(t))
                    if len(items.hits(w, codes)[0]):
                        rows.append(row)
                        numbered.append(w.astype(np.int32).tobytes())
                yield {c: column(b, c).take(pa.array(rows, pa.int64())) for c in ("doc_id", "tie")} | {"words": numbered}

        return run

    return make


def numbers_in(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    """The word numbers of each row that the numbering pass kept."""
    return (np.frombuffer(w, np.int32).astype(np.int64) for w in column(batch, "words").to_pylist())


def _count_maker(block: Broadcast):
    def make():
        items: Items = block.value
        codes = np.unique(items.codes)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
            seen = np.zeros(len(codes), np.int64)
            for b in batches:
                for w in numbers_in(b):
                    seen[np.unique(items.hits(w, codes)[1])] += 1
            some = np.flatnonzero(seen)
            yield {"code": codes[some], "df": seen[some]}

        return run

    return make


def _match_maker(block: Broadcast, least: float):
    def make():
        items, rare = block.value
        codes, owner, offset = items.codes[rare], items.owner[rare], items.at[rare]
        unique, first = np.unique(codes, return_index=True)
        last = np.r_[first[1:], len(codes)]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
            for b in batches:
                out: tuple[list, ...] = [], [], [], [], []
                for row, w in enumerate(numbers_in(b)):
                    at, k = items.hits(w, unique)
                    if not len(at):
                        continue
                    each = last[k] - first[k]
                    where = np.repeat(at, each)
                    seed = np.repeat(first[k], each) + np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
                    order = np.argsort(owner[seed], kind="stable")
                    where, seed = where[order], seed[order]
                    starts = np.flatnonzero(np.r_[True, np.diff(owner[seed]) > 0])
                    for s, e in zip(starts, np.r_[starts[1:], len(seed)], strict=True):
                        k = int(owner[seed[s]])
                        size = int(items.sizes[k])
                        found = max(
                            ((*align(items.words[k], w[lo:hi]), lo) for lo, hi in windows(where[s:e], offset[seed[s:e]], size, len(w))),
                            key=lambda x: x[0],
                        )
                        if found[0] >= least * size:
                            for to, x in zip(out, (row, items.ids[k], found[0] / size, found[3] + found[1], found[3] + found[2]), strict=True):
                                to.append(x)
                yield {c: column(b, c).take(pa.array(out[0], pa.int64())) for c in ("doc_id", "tie")} | dict(zip(("item_id", "score", "first_word", "end_word"), out[1:], strict=True))

        return run

    return make


def contaminated(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", *, n: int = 3, least: float = 0.5) -> DataFrame:
    """(doc_id, tie, item_id, score, first_word, end_word): documents that hold an item or an edited copy of it.

    ``score`` is the alignment's score over the item's words, 1.0 for a whole copy; rows reach
    ``least``. Word positions are those of the best copy in the document. A copy is found if it
    shares a seed with the item: ``n`` words in a row, or half of the item's words if that is less.
    Null texts hold nothing, items without words match nothing. Repeated documents and items give
    repeated rows. An empty table gives no rows.
    """
    spark = df.sparkSession
    prepare(spark)
    docs = keyed(df, id_col, text_col)
    found = None
    for items in blocks(keyed(benchmark, item_col, item_text_col), n):
        block = spark.sparkContext.broadcast(items)
        numbered = cut(arrow_map(docs, _number_maker(block), "doc_id long, tie long, words binary"), "numbered")
        counts = arrow_map(numbered, _count_maker(block), "code long, df long").groupBy("code").agg(F.sum("df").alias("df")).collect()  # at most BLOCK_WORDS rows
        rare = rare_seeds(items, {r["code"]: r["df"] for r in counts})
        seeds = spark.sparkContext.broadcast((items, rare))
        part = cut(arrow_map(numbered, _match_maker(seeds, least), "doc_id long, tie long, item_id long, score double, first_word long, end_word long"), "contaminated")
        drop(numbered)
        block.unpersist()
        seeds.unpersist()
        found = part if found is None else found.unionByName(part)
    return spark.createDataFrame([], "doc_id long, tie long, item_id long, score double, first_word long, end_word long") if found is None else found


def rare_seeds(items: Items, df: dict[int, int]) -> np.ndarray:
    """Which n-grams are seeds: those found at most ``RARE`` times as often as their item's median."""
    seen = np.array([df.get(c, 0) for c in items.codes.tolist()], np.int64)
    rare = np.zeros(len(seen), bool)
    order = np.argsort(items.owner, kind="stable")
    starts = np.flatnonzero(np.r_[True, np.diff(items.owner[order]) > 0]) if len(order) else []
    for s, e in zip(starts, np.r_[starts[1:], len(order)] if len(order) else [], strict=True):
        own = order[s:e]
        there = seen[own][seen[own] > 0]
        if len(there):
            rare[own] = seen[own] <= RARE * np.median(there)
    return np.flatnonzero(rare)


def blocks(benchmark: DataFrame, n: int) -> Iterator[Items]:
    """The benchmark's items in blocks of about ``BLOCK_WORDS`` words."""
    block, size = [], 0
    for r in benchmark.toLocalIterator():
        words = words_of((r["text"] or "").encode())
        if words:
            block.append((r["doc_id"], words))
            size += len(words)
        if size >= BLOCK_WORDS:
            yield Items(block, n)
            block, size = [], 0
    if block:
        yield Items(block, n)
