"""Quality rules on repetition inside a text, by suffix arrays.

Words are symbols. A suffix array over the words of many texts gives, from its longest common
prefixes, the longest repeat that starts at each word; those that no longer repeat contains on the
left are the maximal repeated substrings. Their spans are united. A text fails if the united spans
cover too much of it, or if one repeat is too long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pagewright.llm.common import arrow_map, column, keyed, prepare, texts

#: Words of a repeat that counts; the share of a text's characters that repeats may cover; the characters of the longest.
LEAST_WORDS = 4
MOST_COVERED = 0.4
LONGEST = 1_000
#: Words that are sorted at once; a longer text is sorted alone, and without keeping ranks if it is twice as long.
CHUNK = 300_000
SYMBOLS = b"#*$%&|<>"
SPACE = b" \t\n\v\f\r"


def suffix_ranks(symbols: np.ndarray, keep: bool = True) -> tuple[np.ndarray, list[np.ndarray]]:
    """The suffix array, and the ranks of all prefixes of 1, 2, 4, ... symbols, or only of the last. Ends count as smallest."""
    n = len(symbols)
    bits = int(n + 1).bit_length()
    levels = [np.unique(symbols, return_inverse=True)[1].astype(np.int64)]
    where = np.arange(n)
    depth = 1
    while True:
        rank = levels[-1]
        low = np.zeros(n, np.int64)
        low[: n - depth] = rank[depth:] + 1
        if 3 * bits <= 62:
            key = (rank << np.int64(2 * bits)) | (low << np.int64(bits)) | where
            key.sort()
            rows, pair = key & np.int64((1 << bits) - 1), key >> np.int64(bits)
        else:
            rows = np.lexsort((low, rank))
            pair = (rank[rows] << np.int64(bits)) | low[rows]
        new = np.r_[True, pair[1:] != pair[:-1]]
        if new.all():
            return rows, levels
        to = np.empty(n, np.int64)
        to[rows] = np.cumsum(new) - 1
        levels = [*levels, to] if keep else [to]
        depth *= 2


# Primes below 2^31, so that products of two residues fit 64 bits.
PRIMES = (2_147_483_647, 2_147_483_629)


class Stretches:
    """Compares stretches of symbols by residues of polynomials modulo two primes, in memory that grows with the symbols only."""

    def __init__(self, symbols: np.ndarray, seed: int = 1):
        n, rng = len(symbols), np.random.default_rng(seed)
        self.parts = []
        for prime in PRIMES:
            base, power = int(rng.integers(1 << 20, prime)), np.ones(n + 1, np.int64)
            size = 1
            while size <= n:  # powers of the base, twice as many each time
                more = min(size, n + 1 - size)
                power[size : size + more] = power[:more] * pow(base, size, prime) % prime
                size *= 2
            sums = np.zeros(n + 1, np.int64)
            np.cumsum((symbols + 1) % prime * power[:n] % prime, out=sums[1:])
            self.parts.append((prime, power, sums % prime))

    def equal(self, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether the stretches of ``size`` symbols at ``a`` and ``b`` (a <= b) are the same."""
        out = np.ones(len(a), bool)
        for prime, power, sums in self.parts:
            out &= (sums[a + size] - sums[a]) % prime * power[b - a] % prime == (sums[b + size] - sums[b]) % prime
        return out


def shared_prefixes(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffix array, and the length that each of its rows but the first shares with the row before."""
    n = len(symbols)
    rows, levels = suffix_ranks(symbols, keep=n <= 2 * CHUNK)
    lcp = np.zeros(n - 1, np.int64)
    if n <= 2 * CHUNK:
        a, b = rows[:-1].copy(), rows[1:].copy()
        for k in range(len(levels) - 1, -1, -1):
            inside = (a < n) & (b < n)
            same = inside.copy()
            same[inside] = levels[k][a[inside]] == levels[k][b[inside]]
            step = same.astype(np.int64) << k
            lcp += step
            a += step
            b += step
        return rows, lcp
    # All ranks of a long text would take too much memory: find the lengths bit by bit instead.
    stretches = Stretches(symbols)
    a, b = np.minimum(rows[:-1], rows[1:]), np.maximum(rows[:-1], rows[1:])
    for k in range(int(n).bit_length() - 1, -1, -1):
        longer = lcp + (1 << k)
        inside = np.flatnonzero(b + longer <= n)
        same = inside[stretches.equal(a[inside], b[inside], longer[inside])]
        lcp[same] = longer[same]
    return rows, lcp


def longest_repeats(symbols: np.ndarray) -> np.ndarray:
    """For each position the length of the longest string that starts there and somewhere else."""
    n = len(symbols)
    if n < 2:
        return np.zeros(n, np.int64)
    rows, lcp = shared_prefixes(symbols)
    out = np.zeros(n, np.int64)
    out[rows[:-1]] = lcp
    out[rows[1:]] = np.maximum(out[rows[1:]], lcp)
    return out


def covered(first: np.ndarray, end: np.ndarray, n: int) -> np.ndarray:
    """Which of ``n`` positions lie in the union of the spans [first, end)."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, first, 1)
    np.add.at(change, end, -1)
    return np.cumsum(change[:-1]) > 0


def base_counts(text: bytes, words: list[bytes]) -> tuple[int, int, int]:
    """word_chars, n_symbols and n_dup_lines of a text."""
    chars = len(b"".join(words).decode("utf-8", "replace"))
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    lines = [x for x in text.split(b"\n") if x.strip(SPACE)]
    return chars, symbols, len(lines) - len(set(lines))


def measure(batch: list[bytes]) -> dict[str, list]:
    """Base counts and repeat measures of texts."""
    words = [t.split() for t in batch]
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "repeat_covered", "longest_repeat")
    out: dict[str, list] = {c: [] for c in names}
    for t, w in zip(batch, words, strict=True):
        chars, symbols, lines = base_counts(t, w)
        for c, v in zip(names, (len(w), chars, symbols, lines), strict=False):
            out[c].append(v)
    at = 0
    while at < len(words):
        hi, size = at + 1, len(words[at])
        while hi < len(words) and size + len(words[hi]) <= CHUNK:
            size += len(words[hi])
            hi += 1
        repeats(words[at:hi], out)
        at = hi
    return out


def repeats(texts_: list[list[bytes]], out: dict[str, list]) -> None:
    """Append the repeat measures of texts that are sorted together; repeats between texts don't count."""
    number: dict[bytes, int] = {}
    ends = -1
    symbols, lengths = [], []
    for k, words in enumerate(texts_):
        # Words of different texts differ, so that no string repeats in another text.
        number.clear()
        base = ends + 1
        symbols.append(np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words)) + base)
        ends = base + len(number)
        symbols.append(np.array([ends], np.int64))
        lengths.append(np.fromiter((len(w.decode("utf-8", "replace")) for w in words), np.int64, len(words)))
    longest = longest_repeats(np.concatenate(symbols)) if symbols else np.empty(0, np.int64)
    at = 0
    for size in lengths:
        n = len(size)
        r = longest[at : at + n]
        at += n + 1
        i = np.arange(n)
        three = np.flatnonzero(r >= 3)
        out["n_repeat_words"].append(int(covered(three, three + 3, n).sum()))
        # Left-maximal: the repeat one word earlier doesn't hold this one.
        maximal = np.flatnonzero((r >= LEAST_WORDS) & (r >= np.r_[0, r[:-1]])) if n else i
        chars = np.r_[0, np.cumsum(size)]
        span = covered(maximal, maximal + r[maximal], n)
        out["repeat_covered"].append(float(size[span].sum() / max(1, chars[-1])))
        out["longest_repeat"].append(int((chars[maximal + r[maximal]] - chars[maximal]).max(initial=0)))


def rules(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, most_covered: float = MOST_COVERED, longest: int = LONGEST) -> DataFrame:
    """Counts, repeat measures and verdicts for every row.

    Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept,
    repeat_covered (share of word characters in maximal repeats) and longest_repeat (characters).
    A null text has no words and so fails. Ids may be null, rows may repeat. An empty table gives
    no rows.
    """
    prepare(df.sparkSession)

    def make():
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
            for b in batches:
                got = measure(texts(b))
                n, again = np.array(got["n_words"], np.int64), np.array(got["n_repeat_words"], np.int64)
                failed = (n < 50) | (100 * again > 50 * n)
                good = (np.array(got["repeat_covered"]) <= most_covered) & (np.array(got["longest_repeat"]) <= longest)
                yield got | {"doc_id": column(b, "doc_id"), "base_failed": failed, "kept": ~failed & good}

        return run

    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, repeat_covered double, longest_repeat long"
    return arrow_map(keyed(df, id_col, text_col), make, schema)
