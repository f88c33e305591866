"""Best-fit packing of tokenized documents into fixed-length sequences.

The plan works on the histogram of piece lengths, which has at most ``capacity`` entries however
large the corpus is. Exact-complement hashing comes first: for the gap a long piece leaves, look
up a single length, then a pair, then a triple of lengths that sum exactly to it, and consume the
combination as often as the counts allow. What is left goes best-fit, longest first. The pieces
themselves never meet, nor are they sorted or shuffled: each is numbered by its task among the
task's pieces of its length, sums over tasks make that a rank, and the plan maps (length, rank) to
a sequence and an offset.
"""

from __future__ import annotations

import json
import os
import re
import string
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagewright.llm.common import arrow_map, column, cut, keep, kept, keyed, prepare, small, texts

#: Words in each of the two generations of a worker's cache, and the length from which a word isn't kept.
CACHE, LONG = 500_000, 100
#: New words that the tokenizer gets at once, and words whose ids are put in place at once.
TOGETHER, PLACED = 200, 1_000_000
#: Where splitting at white space could differ from the tokenizer's own view of the whole text.
_WHOLE = "<\\||[\x1c-\x1f\x85\u180e\u200b\u2060\ufeff]"
#: Steps that are known to cut a normalized word of Latin letters and ASCII marks behind them where the one ends and the others begin, and such a word.
_NORMALIZER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
_CUTS = [
    {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
]
_LETTERS, _MARKS = re.compile("[a-z\xb5\xdf-\xf6\xf8-\u024f]*"), string.punctuation


def _byte_level() -> dict[int, str]:
    """The characters that stand for bytes in a byte-level vocabulary."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(x for x in range(256) if x not in own)}


class WordEncoder:
    """Token ids of texts under a tokenizer that drops white space.

    A tokenizer that splits at white space and normalizes no further than within a word gives each
    word the same ids wherever it stands, so ids are kept by word, and looked up once for each word
    of a batch. Where the tokenizer's steps are known, a new word of letters and marks behind them
    gets the ids of these two, which the tokenizer's model gives without the other steps. Texts with
    special tokens or with unusual separators go to the tokenizer as a whole.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        steps = json.loads(self.tokenizer.to_str())
        known = (steps["normalizer"] or {}).get("normalizers") == _NORMALIZER and (steps["pre_tokenizer"] or {}).get("pretokenizers") == _CUTS
        self.parted = known and steps["model"]["type"] == "BPE" and not steps["model"]["dropout"]
        self.bytes = _byte_level()
        #: Words met lately, and those met before the younger generation began; their letters and marks.
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {"": b""}

    def _encode(self, words: list[str]) -> Iterator[bytes]:
        """Ids of words, many at a time in one text: where a token stands tells its word."""
        for k in range(0, len(words), TOGETHER):
            part = words[k : k + TOGETHER]
            got = self.tokenizer.encode(" ".join(part), add_special_tokens=False)
            ids = np.array(got.ids, "<u4").tobytes()
            starts = np.cumsum([0, *(len(w) + 1 for w in part)])
            at = np.fromiter((first for first, _ in got.offsets), np.int64, len(got.ids))
            cut = (4 * np.searchsorted(at, starts)).tolist()
            yield from (ids[a:z] for a, z in zip(cut, cut[1:], strict=False))

    def _new(self, words: list[str]) -> dict[str, bytes]:
        """Ids of words that aren't kept."""
        if not self.parted:
            return dict(zip(words, self._encode(words), strict=True))
        if len(self.parts) > CACHE:
            self.parts = {"": b""}
        out, rest, parts, tokenize = {}, [], self.parts, self.tokenizer.model.tokenize
        for k in range(0, len(words), TOGETHER):
            own = words[k : k + TOGETHER]
            for w, n in zip(own, self.tokenizer.normalizer.normalize_str(" ".join(own)).split(" "), strict=True):
                letters = n.rstrip(_MARKS)
                marks = n[len(letters) :]
                if letters not in parts or marks not in parts:
                    if len(n) >= LONG or not _LETTERS.fullmatch(letters):
                        rest.append(w)
                        continue
                    for part in (letters, marks):
                        if part not in parts:
                            found = tokenize(part if part.isascii() else part.encode().decode("latin-1").translate(self.bytes))
                            parts[part] = b"".join([x.id.to_bytes(4, "little") for x in found])
                out[w] = parts[letters] + parts[marks]
        out.update(zip(rest, self._encode(rest), strict=True))
        return out

    def __call__(self, batch: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each with ``end_id`` behind it, and where each text's ids end."""
        whole = np.flatnonzero(pc.match_substring_regex(batch, _WHOLE).to_numpy(zero_copy_only=False))
        asked = batch.take(pa.array(whole)).to_pylist()
        if len(whole):
            batch = pc.if_else(pc.match_substring_regex(batch, _WHOLE), "", batch)
        split = pc.utf8_split_whitespace(batch)
        coded = split.flatten().dictionary_encode()
        words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()  # far faster than to_pylist()
        if len(self.young) > CACHE:
            self.old, self.young = self.young, {}
        young, old = self.young, self.old
        young[""] = b""  # what stands before and behind outer white space
        ids = list(map(young.get, words))
        lacking = [k for k, x in enumerate(ids) if x is None]
        new = self._new([words[k] for k in lacking if words[k] not in old])
        for k in lacking:
            w = words[k]
            ids[k] = new[w] if w in new else old[w]
            if len(w) < LONG:
                young[w] = ids[k]
        rest = [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch(asked, add_special_tokens=False)]
        ids += [int(end_id).to_bytes(4, "little"), *rest]
        # A text's words, then itself if it was encoded as a whole, then the end.
        ends = np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64))
        order = np.argsort(np.append(whole, np.arange(len(ends))), kind="stable")
        more = np.append(len(words) + 1 + np.arange(len(whole)), np.full(len(ends), len(words)))[order]
        placed = np.insert(coded.indices.to_numpy().astype(np.int64), np.append(ends[whole], ends)[order], more)
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        first = np.cumsum(size) - size
        pool = np.frombuffer(b"".join(ids), "<u4")
        out = []
        for k in range(0, len(placed), PLACED):
            own = placed[k : k + PLACED]
            n = size[own]
            out.append(pool[np.repeat(first[own] - (np.cumsum(n) - n), n) + np.arange(n.sum())])
        upto = np.append(0, np.cumsum(size[placed]))
        count = np.bincount(whole, minlength=len(ends)) + 1
        return (np.concatenate(out) if out else pool[:0]), upto[ends + np.cumsum(count)]


def _strings(batch: pa.RecordBatch) -> pa.Array:
    """The texts of a batch; null becomes empty, and what isn't UTF-8 is replaced."""
    found = column(batch, "text").cast(pa.string()).fill_null("")
    try:
        found.validate(full=True)
    except pa.ArrowInvalid:
        found = pa.array([t.decode("utf-8", "replace") for t in texts(batch)], pa.string())
    return found


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int, end_id: int) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, block, nth): the cut documents of ``docs`` (doc_id, text).

    ``block`` is the task that cut the document, ``nth`` counts its pieces of that length.
    """
    def make():
        encoder = kept(("encoder", tokenizer_path), lambda: WordEncoder(tokenizer_path))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
            block, counts = TaskContext.get().partitionId(), [0] * (capacity + 1)
            for b in batches:
                out: tuple[list, ...] = [], [], [], [], []
                rows = []
                ids, ends = encoder(_strings(b), end_id)
                ends = ends.tolist()
                for i, (first, last) in enumerate(zip([0, *ends], ends)):
                    for k, start in enumerate(range(0, last - first, capacity)):
                        part = ids[first + start : min(first + start + capacity, last)]
                        n = len(part)
                        rows.append(i)
                        for to, x in zip(out, (k, start, n, zlib.crc32(part), counts[n]), strict=True):
                            to.append(x)
                        counts[n] += 1
                yield {"doc_id": column(b, "doc_id").take(pa.array(rows, pa.int64())), "block": [block] * len(rows)} | dict(zip(("piece", "start", "length", "ids_crc32", "nth"), out, strict=True))

        return run

    return arrow_map(docs, make, "doc_id long, piece int, start long, length long, ids_crc32 long, block int, nth long")


class Lengths:
    """Counts of lengths, with lookups of single, pair and triple sums among those still there."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.count = np.zeros(capacity + 1, np.int64)
        for length, n in counts.items():
            self.count[length] = n

    def single(self, gap: int) -> tuple[int, ...] | None:
        return (gap,) if self.count[gap] else None

    def pair(self, gap: int) -> tuple[int, ...] | None:
        """The pair with the longest member that sums to ``gap``."""
        half = np.arange(gap - 1, (gap - 1) // 2, -1)
        there = (self.count[half] > 0) & (self.count[gap - half] > (half * 2 == gap))
        k = int(there.argmax()) if len(there) else 0
        return (int(half[k]), int(gap - half[k])) if len(there) and there[k] else None

    def triple(self, gap: int) -> tuple[int, ...] | None:
        """The triple with the longest first member that sums to ``gap``."""
        for a in np.flatnonzero(self.count[: gap - 1])[::-1].tolist():
            if 3 * a < gap:
                return None
            self.count[a] -= 1
            rest = self.pair(gap - a)
            self.count[a] += 1
            if rest:
                return (a, *rest)
        return None

    def take(self, pattern: tuple[int, ...]) -> int:
        """Consume ``pattern`` as often as the counts allow."""
        need = {x: pattern.count(x) for x in pattern}
        times = min(int(self.count[x]) // n for x, n in need.items())
        for x, n in need.items():
            self.count[x] -= n * times
        return times


def plan(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence, how many such sequences) for all pieces of the histogram ``counts``."""
    have, out = Lengths(counts, capacity), []
    if have.count[capacity]:
        out.append(((capacity,), have.take((capacity,))))
    for length in range(capacity - 1, 0, -1):
        gap = capacity - length
        for find in (have.single, have.pair, have.triple):
            while have.count[length]:
                have.count[length] -= 1
                fill = find(gap)
                have.count[length] += 1
                if not fill or not (times := have.take((length, *fill))):
                    break
                out.append(((length, *fill), times))
    return out + best_fit({int(k): int(have.count[k]) for k in np.flatnonzero(have.count)}, capacity)


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit, longest first, on counts: equal sequences are filled together."""
    bins: dict[tuple[int, tuple[int, ...]], int] = {}
    order: list[tuple[int, tuple[int, ...]]] = []

    def add(gap: int, pattern: tuple[int, ...], times: int) -> None:
        if (gap, pattern) not in bins:
            insort(order, (gap, pattern))
        bins[gap, pattern] = bins.get((gap, pattern), 0) + times

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            k = bisect_left(order, (length, ()))
            if k == len(order):
                each = min(left, capacity // length)
                times = left // each
                add(capacity - each * length, (length,) * each, times)
                left -= each * times
                continue
            gap, pattern = order[k]
            times = min(left, bins[gap, pattern])
            bins[gap, pattern] -= times
            if not bins[gap, pattern]:
                del bins[gap, pattern]
                order.pop(k)
            add(gap - length, (*pattern, length), times)
            left -= times
    return [(pattern, times) for (_, pattern), times in bins.items()]


class Slots:
    """Maps (length, rank among the pieces of that length) to (sequence, offset)."""

    def __init__(self, planned: list[tuple[tuple[int, ...], int]], capacity: int):
        rows = []
        base = 0
        for pattern, times in planned:
            offsets = np.r_[0, np.cumsum(pattern)[:-1]]
            for length in dict.fromkeys(pattern):
                at = [int(o) for o, x in zip(offsets, pattern, strict=True) if x == length]
                rows.append((length, base, times * len(at), at))
            base += times
        rows.sort(key=lambda r: r[0])
        self.first = np.searchsorted([r[0] for r in rows], np.arange(capacity + 2))
        self.base = np.array([r[1] for r in rows], np.int64)
        size = np.array([r[2] for r in rows], np.int64)
        self.before = np.cumsum(size) - size
        self.each = np.array([len(r[3]) for r in rows], np.int64)
        self.at = np.cumsum(self.each) - self.each
        self.offsets = np.array([o for r in rows for o in r[3]], np.int64)

    def __call__(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        place = self.before[self.first[length]] + rank
        row = np.searchsorted(self.before, place, "right") - 1
        local = place - self.before[row]
        return self.base[row] + local // self.each[row], self.offsets[self.at[row] + local % self.each[row]]


def pack(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", *, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null texts count as empty and give one piece, the end id alone. Only documents of more than
    ``capacity`` ids are cut. Repeated rows and null ids are packed like any other row. An empty
    table gives no rows.
    """
    spark = df.sparkSession
    prepare(spark)
    cut_up = cut(pieces(keyed(df, id_col, text_col), tokenizer_path, capacity, end_id), "pieces")
    counts = cut_up.groupBy("length", "block").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    counts = cut(counts.select(F.col("length").alias("length2"), F.col("block").alias("block2"), "n", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before")), "counts")
    total = {r["length2"]: r["n"] for r in counts.groupBy("length2").agg(F.sum("n").alias("n")).collect()}  # at most capacity rows
    slots = spark.sparkContext.broadcast(Slots(plan(total, capacity), capacity))

    def make():
        keep(("encoder", tokenizer_path))
        placed = slots.value

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
            for b in batches:
                length, rank = (column(b, c).to_numpy() for c in ("length", "rank"))
                sequence, at = placed(length, rank)
                yield {c: column(b, c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")} | {"sequence_id": sequence, "offset": at}

        return run

    ranked = cut_up.join(small(counts), (F.col("length") == F.col("length2")) & (F.col("block") == F.col("block2"))).withColumn("rank", F.col("before") + F.col("nth"))
    return arrow_map(ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank"), make, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
