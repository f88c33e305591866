"""Exact substring deduplication with run-length compressed Burrows-Wheeler indexes.

A byte goes if a string of ``length`` bytes that covers it also starts earlier. Equal strings of
that length have the same least n-gram hash (their minimizer), so every start of a text belongs to
one minimizer, and starts of one minimizer that stand in a row form a piece. The steps are:

1. Pieces are found in each text and named by minimizer and by a hash of their bytes. Of equal
   pieces only the earliest goes on; the others wait for what the index says of it. A piece that has
   no equal, of a minimizer that no other piece has, cannot repeat.
2. The bytes of the other distinct pieces are brought together by minimizer.
3. There a run-length index is built: of the stretches whose strings' hashes occur again, once each,
   and a second time if they occur again as a whole. All are streamed through it backwards, which
   gives each start its matching statistic: the length of its longest match elsewhere (as far as it
   matters) and the place of it. Starts that match long enough fall into classes of equal strings;
   all but the earliest of each class are marked.
4. The answers for pieces with equals return to these, and all marks to their documents, which cut
   out the covered bytes.

Hashes route and filter; what is marked is what the index matched. Within a task's batch equal
pieces are set aside at once, and pieces of a minimizer that is frequent there are dealt out by
their hash. Where very many distinct pieces have one minimizer, as around a passage in a third of
all documents, they are dealt out string by string instead.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.llm.common import arrow_map, column, cut, drop, keyed, prepare, small, texts

#: Bytes of the n-grams whose hashes name pieces. Shorter ones bring together more pieces that share nothing longer.
GRAM = 40
#: Starts in one piece, at most, and in a stretch of pieces that stand in a row and have nothing but equals.
PIECE, STRETCH = 64, 512
#: Different pieces of a minimizer in one batch from which it counts as frequent.
FREQUENT = 8
#: An index is built once so many bytes of pieces are there.
CHUNK = 450_000
#: Distinct pieces of one minimizer from which its strings are dealt out one by one.
CROWD = 400
_ODD = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2^64."""
    if len(_POWERS.get("up", ())) < n:
        size = max(n, 1 << 16)
        for name, base in (("up", _ODD), ("down", pow(_ODD, -1, 1 << 64))):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            _POWERS[name] = np.multiply.accumulate(x)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    return h


class Hashes:
    """Hashes of any stretches of a text, from prefix sums of a polynomial modulo 2^64."""

    def __init__(self, text: bytes):
        self.n = len(text)
        up, self.down = _powers(self.n + 1)
        self.sums = np.zeros(self.n + 1, np.uint64)
        np.cumsum((np.frombuffer(text, np.uint8).astype(np.uint64) + np.uint64(1)) * up[: self.n], out=self.sums[1:])

    def grams(self, k: int = GRAM) -> np.ndarray:
        """Hash of the ``k`` bytes at each position."""
        return _mixed((self.sums[k:] - self.sums[:-k]) * self.down[: self.n - k + 1])

    def of(self, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mixed((self.sums[end] - self.sums[first]) * self.down[first] + (end - first).astype(np.uint64) * np.uint64(0x94D049BB133111EB))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` neighbours."""
    size = 1
    while 2 * size <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (width - size)], x[width - size :]) if width > size else x


def pieces_of(text: bytes, length: int) -> tuple[np.ndarray, ...]:
    """Minimizer, hash of the bytes, first start, number of starts, and whether starts may repeat inside, of each piece.

    The text has ``length`` or more bytes. Equal strings at two starts of one piece have their
    leftmost minimizer at two places, so the piece goes on behind the first of them.
    """
    hashes = Hashes(text)
    h = hashes.grams()
    least = sliding_min(h, length - GRAM + 1)
    goes_on = least[1:] == least[:-1]
    first = np.flatnonzero(np.r_[True, ~goes_on])
    size = np.diff(np.r_[first, len(least)])
    if size.max() > PIECE:  # repetitive text: cut long pieces
        parts = -(-size // PIECE)
        step = (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)) * PIECE
        first, end = np.repeat(first, parts) + step, np.repeat(first + size, parts)
        size = np.minimum(PIECE, end - first)
    inside = np.zeros(len(first), bool)
    inside[np.searchsorted(first, np.flatnonzero(goes_on & (h[: len(least) - 1] == least[:-1])), "right") - 1] = True
    return least[first].view(np.int64), hashes.of(first, first + size + length - 1).view(np.int64), first, size, inside


class RunIndex:
    """Run-length Burrows-Wheeler index of a few byte strings.

    Of each run of equal symbols it keeps where the run begins, where its first row maps to, the
    text position of its last row (the sample), and how many symbols the row its first row maps to
    shares with the row before that one, up to ``length``. That is all: rows inside a run follow
    from its beginning, and so do their matches. The index grows with the runs, not with the text.
    """

    def __init__(self, strings: list[bytes], length: int, twice: np.ndarray | None = None):
        """``twice`` says which strings are there a second time; these stand just behind the first."""
        self.length = length
        times = np.ones(len(strings), np.int64) if twice is None else 1 + twice.astype(np.int64)
        # A second copy's suffixes follow the first's, so each string is sorted once.
        size = np.fromiter(map(len, strings), np.int64, len(strings))
        starts = np.cumsum(size + 1) - size - 1
        once = sort_suffixes(_symbols(strings, starts + size))
        owner = np.searchsorted(starts, once, "right") - 1
        string = np.repeat((np.cumsum(times) - times)[owner], times[owner])
        offset = np.repeat(once - starts[owner], times[owner])
        string[1:] += (string[1:] == string[:-1]) & (offset[1:] == offset[:-1])
        self.size = np.repeat(size, times)
        self.starts = np.cumsum(self.size + 1) - self.size - 1
        rows = self.starts[string] + offset
        text = _symbols([x for x, n in zip(strings, times.tolist(), strict=True) for _ in range(n)], self.starts + self.size)
        self.n = len(text)
        bwt = text[rows - 1]
        self.run = np.flatnonzero(np.r_[True, bwt[1:] != bwt[:-1]]).astype(np.int32)
        run_size = np.diff(np.r_[self.run, len(text)])
        by = np.argsort(bwt[self.run], kind="stable")
        self.target = np.empty(len(by), np.int32)
        self.target[by] = np.cumsum(run_size[by]) - run_size[by]
        self.sample = rows[self.run + run_size - 1].astype(np.int32)
        # What the first row of a run maps to comes just behind what the last row of this run maps to.
        self.before = np.empty(len(by), np.int32)
        self.before[by] = np.r_[by[-1], by[:-1]]
        own, other = rows[self.target], (self.sample[self.before] - 1) % self.n
        self.shared = common_prefix(text, own, other, length).astype(np.int32)
        self.shared[self.target == 0] = 0

    def nbytes(self) -> int:
        """Bytes that grow with the text's runs."""
        return sum(x.nbytes for x in (self.run, self.target, self.sample, self.before, self.shared))

    def stream(self) -> Iterator[tuple[np.ndarray, ...]]:
        """(string, start in it, row, length of the match, its text position) of all starts, one step of all strings at a time.

        Strings are streamed together, from their ends backwards. The match is the one of the row
        before. A step inside a run makes it one symbol longer and moves it one place; at the
        beginning of a run, the sample at the end of another run has it. Only while it streams is there
        a table of each row's run, which saves a search for each start.
        """
        run_of = np.repeat(np.arange(len(self.run), dtype=np.int32), np.diff(np.r_[self.run, self.n]))
        string = np.argsort(-self.size, kind="stable")
        row, left = string.astype(np.int32), self.size[string]  # separators sort first, in the order of the strings
        match, at = np.zeros(len(row), np.int32), np.r_[0, (self.starts + self.size)[:-1]][string].astype(np.int32)
        for step in range(1, int(self.size.max(initial=0)) + 1):
            live = int(np.searchsorted(-left, -step, "right"))
            string, left, row, match, at = (x[:live] for x in (string, left, row, match, at))
            k = run_of[row]
            begins = self.run[k]
            inside = row != begins
            match = np.where(inside, np.minimum(match + 1, self.length), self.shared[k])
            at = np.where(inside, at, self.sample[self.before[k]]) - 1
            at[at < 0] += self.n
            row = self.target[k] + row - begins
            yield string, left - step, row, match, at

    def repeats(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(string, start in it) of all starts whose match of ``length`` symbols also occurs at a lesser place.

        ``place`` has the place of each string's first start; a later start's is so much greater.
        """
        found = [(s, a, r, p) for s, a, r, m, p in self.stream() for hit in (m >= self.length,) for s, a, r, p in ((s[hit], a[hit], r[hit], p[hit]),) if len(s)]
        if not found:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        string, start, row, at = map(np.concatenate, zip(*found, strict=True))
        by = np.argsort(row)
        string, start, row, at = string[by], start[by], row[by], at[by]
        # Rows that follow one another share a string; the row before the first of them does, too, and only its match knows where it is.
        first = np.flatnonzero(np.r_[True, np.diff(row) != 1])
        head = np.searchsorted(self.starts, at[first], "right") - 1
        head_start = at[first] - self.starts[head]
        own, ahead = place[string] + start, place[head] + head_start
        group = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(row)]))
        least = np.minimum(np.minimum.reduceat(own, first), ahead)
        late, head_late = own > least[group], ahead > least
        return np.concatenate([string[late], head[head_late]]), np.concatenate([start[late], head_start[head_late]])


def _symbols(strings: list[bytes], ends: np.ndarray) -> np.ndarray:
    """The strings in one array, each followed by a symbol of its own: these differ, so that all suffixes do."""
    out = np.frombuffer(b"\0".join(strings) + b"\0", np.uint8).astype(np.int64) + len(strings)
    out[ends] = np.arange(len(strings))
    return out


def common_prefix(text: np.ndarray, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """How many symbols the suffixes at ``a`` and ``b`` share, up to ``most``."""
    out, n = np.zeros(len(a), np.int64), len(text)
    live = np.arange(len(a))
    for k in range(most):
        i, j = a[live] + k, b[live] + k
        inside = (i < n) & (j < n)
        live = live[inside]
        live = live[text[i[inside]] == text[j[inside]]]
        if not len(live):
            break
        out[live] += 1
    return out


def sort_suffixes(text: np.ndarray) -> np.ndarray:
    """The suffix array of ``text``, whose suffixes all differ before one of them ends.

    Prefix doubling; rank pairs and position are packed into one integer, which sorts faster than
    an indirect sort.
    """
    n = len(text)
    bits = int(n + 257).bit_length()
    rank, depth = text, 1
    mask = np.int64((1 << bits) - 1)
    while True:
        low = np.zeros(n, np.int64)
        low[: max(0, n - depth)] = rank[depth:] + 1
        if 3 * bits + 1 < 63:
            key = (rank << np.int64(2 * bits + 1)) | (low << np.int64(bits)) | np.arange(n)
            key.sort()
            rows, pair = key & mask, key >> np.int64(bits)
            new = np.r_[True, pair[1:] != pair[:-1]]
        else:
            rows = np.lexsort((low, rank))
            new = np.r_[True, (rank[rows][1:] != rank[rows][:-1]) | (low[rows][1:] != low[rows][:-1])]
        if new.all():
            return rows
        rank = np.empty(n, np.int64)
        rank[rows] = np.cumsum(new) - 1
        depth *= 2


def runs_of(piece: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marked starts as (piece, first start, number of starts in a row)."""
    key = np.sort(piece * 4096 + start)
    first = np.flatnonzero(np.r_[True, np.diff(key) != 1]) if len(key) else np.empty(0, np.int64)
    return key[first] // 4096, key[first] % 4096, np.diff(np.r_[first, len(key)])


def arrow_map_of(make, schema: str):
    return lambda df: arrow_map(df, make, schema)


#: How a piece travels: to its minimizer; there, and known to need its bytes; as one of a frequent minimizer; set aside as equal to another.
PLAIN, SEVERAL, HOT, EQUAL = range(4)
#: Added where others are equal to the piece.
TWIN = 4


def batch_modes(did: np.ndarray, tie: np.ndarray, key: np.ndarray, piece: np.ndarray, start: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """Modes of the pieces of one batch."""
    by = np.lexsort((start, tie, did, piece, key))
    k, p = key[by], piece[by]
    new_key = np.r_[True, k[1:] != k[:-1]]
    new = new_key | np.r_[True, p[1:] != p[:-1]]
    first = np.maximum.accumulate(np.where(new, np.arange(len(by)), 0))
    # A repeated row of the table is no other piece.
    later = (did[by] != did[by][first]) | (tie[by] != tie[by][first]) | (start[by] != start[by][first])
    twin = np.zeros(len(by), bool)
    twin[first[later]] = True
    kinds = np.add.reduceat(new.astype(np.int64), np.flatnonzero(new_key))[np.cumsum(new_key) - 1]
    # One piece of a frequent minimizer goes to it, so that its other pieces there know of more.
    rest = np.cumsum(new) != np.maximum.accumulate(np.where(new_key, np.cumsum(new), 0))
    mode = np.where((kinds >= FREQUENT) & rest, HOT, np.where((kinds > 1) | inside[by], SEVERAL, PLAIN)) + TWIN * twin
    mode[later] = EQUAL
    out = np.empty(len(by), np.int8)
    out[by] = mode
    return out


_ANCHORS = "did long, tie long, key long, piece long, start int, size int, mode byte"


def _anchor_maker(length: int):
    """Rows of pieces with their modes."""

    def make():
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
            for b in batches:
                rows, found = [], []
                for i, t in enumerate(texts(b)):
                    if len(t) >= length:
                        found.append(pieces_of(t, length))
                        rows.append(np.full(len(found[-1][0]), i))
                if not rows:
                    continue
                row = np.concatenate(rows)
                key, piece, start, size, inside = map(np.concatenate, zip(*found, strict=True))
                did, tie = (column(b, c).to_numpy()[row] for c in ("did", "tie"))
                yield {"did": did, "tie": tie, "key": key, "piece": piece, "start": start, "size": size, "mode": batch_modes(did, tie, key, piece, start, inside)}

        return run

    return arrow_map_of(make, _ANCHORS)


def _string_maker(length: int):
    """Documents with pieces of crowded minimizers: each start of these as a piece of its own, named by its string's hash."""

    def make():
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
            for b in batches:
                rows, starts, names = [], [], []
                for i, (t, pieces) in enumerate(zip(texts(b), column(b, "pieces").to_pylist(), strict=True)):
                    at = np.concatenate([np.arange(x["start"], x["start"] + x["size"]) for x in pieces])
                    rows.append(np.full(len(at), i))
                    starts.append(at)
                    names.append(Hashes(t).of(at, at + length).view(np.int64))
                if not rows:
                    continue
                row, start, name = map(np.concatenate, (rows, starts, names))
                did, tie = (column(b, c).to_numpy()[row] for c in ("did", "tie"))
                mode = batch_modes(did, tie, name, name, start, np.zeros(len(row), bool))
                yield {"did": did, "tie": tie, "key": name, "piece": name, "start": start, "size": np.ones(len(row), np.int32), "mode": mode}

        return run

    return arrow_map_of(make, _ANCHORS)


_NAMES = ("did", "tie", "key", "piece", "start", "size")


def _equal_maker():
    """Rows sorted by minimizer, piece and place: the earliest of equal pieces if it is ``needed``, and the others.

    It is needed if its minimizer has other pieces, or it has a ``twin``, that is an equal. If it has
    only that it is ``alone``.
    """

    def make():
        place = ("did", "tie", "start")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
            held: dict | None = None  # the earliest of the last piece; the next piece decides on it
            for b in batches:
                now = {c: column(b, c).to_numpy() for c in (*_NAMES, "mode")}
                aside = now["mode"] == EQUAL
                if aside.any():
                    yield {c: now[c][aside] for c in _NAMES} | {c: np.zeros(aside.sum(), bool) for c in ("needed", "twin", "alone")}
                    now = {c: x[~aside] for c, x in now.items()}
                now["needed"], now["twin"] = now["mode"] % TWIN != PLAIN, now["mode"] >= TWIN
                if not len(now["key"]):
                    continue
                if held is not None:
                    now = {c: np.concatenate((held[c], now[c])) for c in now}
                new = np.r_[True, (now["key"][1:] != now["key"][:-1]) | (now["piece"][1:] != now["piece"][:-1])]
                at = np.flatnonzero(new)
                first = at[np.cumsum(new) - 1]
                later = np.logical_or.reduce([now[c] != now[c][first] for c in place])
                key, twin = now["key"][at], np.logical_or.reduceat(now["twin"] | later, at)
                same = key[1:] == key[:-1]
                needed = np.logical_or.reduceat(now["needed"], at) | np.r_[False, same] | np.r_[same, False]
                held = {c: x[at[-1:]].copy() for c, x in now.items()} | {"needed": needed[-1:].copy(), "twin": twin[-1:].copy()}
                ended, no = (needed | twin)[:-1], np.zeros(later.sum(), bool)
                yield {c: np.concatenate((now[c][later], now[c][at[:-1][ended]])) for c in _NAMES} | {
                    "needed": np.r_[no, np.ones(ended.sum(), bool)],
                    "twin": np.r_[no, twin[:-1][ended]],
                    "alone": np.r_[no, ~needed[:-1][ended]],
                }
            if held is not None and (held["needed"] | held["twin"])[0]:
                yield {c: held[c] for c in (*_NAMES, "twin")} | {"needed": np.ones(1, bool), "alone": ~held["needed"]}

        return run

    return arrow_map_of(make, "did long, tie long, key long, piece long, start int, size int, needed boolean, twin boolean, alone boolean")


def _bytes_maker(length: int):
    """Documents with their pieces: the bytes of each piece, and the ``names`` to which it answers, with their place in it.

    Pieces that are alone and stand in a row are brought as one, as they need not meet any other.
    """

    def make():
        def rows_of(pieces: list[dict]) -> Iterator[tuple[int, int, int, list[dict]]]:
            row: list[dict] = []
            for p in sorted(pieces, key=lambda p: (not p["alone"], p["start"])):
                name = {"key": p["key"], "piece": p["piece"], "first": 0, "n": p["size"]}
                if not p["alone"]:
                    yield p["start"], p["size"], p["key"], [name] if p["twin"] else []
                    continue
                size = p["start"] - row[0]["start"] if row else 0
                if row and (size != sum(x["n"] for x in row) or size + p["size"] > STRETCH):
                    yield row[0]["start"], sum(x["n"] for x in row), row[0]["key"], row
                    row = []
                name["first"] = p["start"] - row[0]["start"] if row else 0
                row.append(name | {"start": p["start"]})
            if row:
                yield row[0]["start"], sum(x["n"] for x in row), row[0]["key"], row

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
            for b in batches:
                out: tuple[list, ...] = [], [], [], [], [], []
                for i, (t, pieces) in enumerate(zip(texts(b), column(b, "pieces").to_pylist(), strict=True)):
                    for start, size, route, names in rows_of(pieces):
                        for to, x in zip(out, (i, start, size, route, names, t[start : start + size + length - 1]), strict=True):
                            to.append(x)
                at = pa.array(out[0], pa.int64())
                yield {c: column(b, c).take(at) for c in ("did", "tie")} | dict(zip(("start", "size", "route", "names", "bytes"), out[1:], strict=True))

        return run

    return arrow_map_of(make, "did long, tie long, start int, size int, route long, names array<struct<key:long,piece:long,first:int,n:int>>, bytes binary")


def again(pieces: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(piece, first start, number of starts) of the stretches of starts whose string's hash occurs again among the pieces."""
    size = np.fromiter(map(len, pieces), np.int64, len(pieces))
    count = size - length + 1
    piece = np.repeat(np.arange(len(pieces)), count)
    start = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    at = (np.cumsum(size) - size)[piece] + start
    mask = np.uint64((1 << int(len(at)).bit_length()) - 1)
    h = Hashes(b"".join(pieces)).of(at, at + length) & ~mask | np.arange(len(at), dtype=np.uint64)
    h.sort()
    same = (h[1:] & ~mask) == (h[:-1] & ~mask)
    repeated = np.zeros(len(at), bool)
    repeated[(h & mask).astype(np.int64)] = np.r_[False, same] | np.r_[same, False]
    return runs_of(piece[repeated], start[repeated])


#: The place of what is later than everything.
LAST = 1 << 62


def marks_of(did: np.ndarray, tie_: np.ndarray, start: np.ndarray, twin: np.ndarray, data: list[bytes], length: int) -> tuple[tuple[np.ndarray, ...], tuple[np.ndarray, ...]]:
    """What an index over the pieces ``data`` finds.

    Marks (row, first start in the piece, number of starts): starts that also start earlier among
    these pieces. Answers, alike, for the ``twin`` rows: starts that repeat in later equals.
    """
    order = np.lexsort((start, tie_, did))
    document = np.empty(len(order), np.int64)
    document[order] = np.cumsum(np.r_[0, (np.diff(did[order]) != 0) | (np.diff(tie_[order]) != 0)])
    place = (document << np.int64(32)) | start
    # Equal pieces: the earliest stands for all.
    earliest: dict[bytes, int] = {}
    copies: dict[int, list[int]] = {}
    first = []
    for i in order.tolist():
        k = earliest.setdefault(data[i], i)
        if k == i:
            first.append(i)
        else:
            copies.setdefault(k, []).append(i)
    whole = np.array([bool(twin[[i, *copies.get(i, ())]].any()) or any(place[j] > place[i] for j in copies.get(i, ())) for i in first], bool)
    # Stretches of starts that may repeat: all of a piece that has equals, and what recurs by its hash.
    own, at, n = again([data[i] for i in first], length)
    kept = ~whole[own]
    all_of = np.flatnonzero(whole)
    sizes = np.array([len(data[i]) for i in first], np.int64) - length + 1
    own, at, n = np.r_[all_of, own[kept]], np.r_[np.zeros(len(all_of), np.int64), at[kept]], np.r_[sizes[all_of], n[kept]]
    if not len(own):
        return (np.empty(0, np.int64),) * 3, (np.empty(0, np.int64),) * 3
    row = np.array(first, np.int64)[own]
    where = place[row] + at
    occurs: dict[bytes, list[int]] = {}
    for j in np.argsort(where, kind="stable").tolist():
        i, a = row[j], at[j]
        occurs.setdefault(data[i][a : a + n[j] - 1 + length], []).append(j)
    # Once in the index, and a second time, at a last place, for all that is equal and later.
    strings, lead = list(occurs), [js[0] for js in occurs.values()]
    twice = np.array([any(where[j] > where[js[0]] or whole[own[j]] for j in js) for js in occurs.values()], bool)
    number = np.cumsum(1 + twice) - 1 - twice  # of each string's first
    places = np.full(len(strings) + twice.sum(), LAST)
    places[number] = where[lead]
    string, inner, count = runs_of(*RunIndex(strings, length, twice).repeats(places))
    marks, answers = [], []
    cuts = np.searchsorted(string, np.arange(len(places) + 1))
    spans = lambda k: [(int(a), int(m)) for a, m in zip(inner[cuts[k] : cuts[k + 1]], count[cuts[k] : cuts[k + 1]], strict=True)]
    for k, js in enumerate(occurs.values()):
        first_spans, later = spans(number[k]), spans(number[k] + 1) if twice[k] else []
        for j in js:
            found = first_spans if where[j] == where[js[0]] else later
            marks += [(int(row[j]), int(at[j]) + a, m) for a, m in found]
            if whole[own[j]]:
                i = int(row[j])
                marks += [(c, a, m) for c in copies.get(i, ()) for a, m in (later if place[c] > place[i] else found)]
                answers += [(c, a, m) for c in (i, *copies.get(i, ())) if twin[c] for a, m in later]
    columns = lambda x: tuple(np.array(x, np.int64).reshape(-1, 3).T)
    return columns(marks), columns(answers)


def _mark_maker(length: int):
    """Rows sorted by route: indexes of whole routes, as many as fit a chunk."""

    def make():
        places = ("did", "tie", "start")

        def marked(held: list) -> Iterator[dict]:
            part, data, names = {c: np.concatenate([h[0][c] for h in held]) for c in places}, [x for h in held for x in h[1]], [x for h in held for x in h[2]]
            twin = np.fromiter(map(bool, names), bool, len(names))
            (row, at, n), answers = marks_of(part["did"], part["tie"], part["start"], twin, data, length)
            none = np.zeros(len(row), np.int64)
            yield {"did": part["did"][row], "tie": part["tie"][row], "key": none, "piece": none, "start": part["start"][row] + at, "size": n, "answer": none > 0}
            told = [(x["key"], x["piece"], max(0, a - x["first"]), min(a + m, x["first"] + x["n"]) - max(a, x["first"])) for i, a, m in zip(*(x.tolist() for x in answers), strict=True) for x in names[i] if a < x["first"] + x["n"] and x["first"] < a + m]
            key, piece, first, n = np.array(told, np.int64).reshape(-1, 4).T
            none = np.zeros(len(key), np.int64)
            yield {"did": none, "tie": none, "key": key, "piece": piece, "start": first, "size": n, "answer": none == 0}

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
            held: list[tuple[dict, list, list]] = []
            size, last = 0, None
            for b in batches:
                if not b.num_rows:
                    continue
                now, rows, names = {c: column(b, c).to_numpy() for c in places}, column(b, "bytes").to_pylist(), column(b, "names").to_pylist()
                route = column(b, "route").to_numpy()
                new = np.flatnonzero(np.r_[route[0] != last, route[1:] != route[:-1]])
                last, end = route[-1], 0
                if len(new):  # the last route may go on in the next batch
                    end = int(new[-1])
                    held.append(({c: x[:end] for c, x in now.items()}, rows[:end], names[:end]))
                    size += sum(map(len, held[-1][1]))
                    if size >= CHUNK:
                        yield from marked(held)
                        held, size = [], 0
                held.append(({c: x[end:] for c, x in now.items()}, rows[end:], names[end:]))
                size += sum(map(len, held[-1][1]))
            if size:
                yield from marked(held)

        return run

    return arrow_map_of(make, "did long, tie long, key long, piece long, start int, size int, answer boolean")


def covered(starts: np.ndarray, sizes: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Maximal removed stretches (first byte, end) of a text whose marked starts are given in runs."""
    by = np.argsort(starts, kind="stable")
    first, end = starts[by], np.maximum.accumulate(starts[by] + sizes[by] - 1 + length) if len(by) else starts
    new = np.flatnonzero(np.r_[True, first[1:] > end[:-1]]) if len(by) else by
    return list(zip(first[new].tolist(), end[np.r_[new[1:], len(by)] - 1].tolist(), strict=True)) if len(by) else []


def _cut_maker(length: int, carried: str | None):
    def make():
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
            for b in batches:
                marks = column(b, "marks")
                offsets, flat = marks.offsets.to_numpy(), marks.values
                start, size = (flat.field(k).to_numpy() for k in range(2))
                removed, spans, kept, digest, at = [], [], [], [], []
                text = texts(b)
                for t, a, z in zip(text, offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                    cuts = covered(start[a:z], size[a:z], length)
                    rest = b"".join(t[a:z] for a, z in zip([0, *(z for _, z in cuts)], [*(a for a, _ in cuts), len(t)], strict=True)) if cuts else t
                    removed.append(len(t) - len(rest))
                    spans.append(len(cuts))
                    at.append([{"first": a, "end": z} for a, z in cuts])
                    kept.append(rest.decode("utf-8", "ignore"))
                    digest.append(hashlib.sha256(rest).hexdigest())
                out = {"doc_id": column(b, "doc_id"), "tie": column(b, "tie"), "n_bytes": [len(t) for t in text], "n_removed": removed, "n_spans": spans, "kept_sha256": digest, "spans": at, "kept_text": kept}
                yield out | ({"carried": column(b, "carried")} if carried else {})

        return run

    return arrow_map_of(make, "doc_id long, tie long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<first:long,end:long>>, kept_text string" + (f", carried {carried}" if carried else ""))


def deduplicate(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, length: int = 100, carry: tuple[str, ...] = (), crowd: int = CROWD) -> DataFrame:
    """Remove from each text the bytes covered by a ``length``-byte string that also starts earlier.

    Earlier means a smaller id, or the same document and a smaller start; null ids come first, and
    different texts of one id are ordered by their hash. Returns doc_id, tie (the text's hash),
    n_bytes, n_removed, n_spans, kept_sha256, spans (removed stretches, in bytes) and kept_text
    (what is left; a character that loses some of its bytes loses them all), and with ``carry`` a
    struct ``carried`` of these columns. Null texts count as empty. Equal rows of the table (same
    id and text) are one document, whose result each of them gets. Texts shorter than ``length``
    stay whole. An empty table gives no rows.
    """
    if length < GRAM + 8:
        raise ValueError(f"length must be {GRAM + 8} or more")
    prepare(df.sparkSession)
    extra = {"carried": F.struct(*(F.col(f"`{c}`") for c in carry))} if carry else {}
    docs = keyed(df, id_col, text_col, did=F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(-(2**63))), **extra)
    # Where no id has two texts, ids alone tell documents apart, and no hash need travel with each piece.
    if docs.groupBy("did").agg(F.min("tie").alias("a"), F.max("tie").alias("z")).where("a <> z").isEmpty():
        docs = docs.withColumn("order", F.lit(0).cast("long"))
    else:
        docs = docs.withColumn("order", F.col("tie"))
    key = docs.select("did", F.col("order").alias("tie"), "text")

    def equals(anchors: DataFrame) -> DataFrame:
        to = F.when(F.col("mode") == EQUAL, F.xxhash64("did", "start")).when(F.col("mode").bitwiseAND(F.lit(3)) == HOT, F.xxhash64("key", "piece")).otherwise(F.col("key"))
        return cut(_equal_maker()(anchors.repartition(to).sortWithinPartitions("key", "piece", "did", "tie", "start")), "equals")

    def of_documents(found: DataFrame, *more: Column) -> DataFrame:
        return key.join(found.groupBy("did", "tie").agg(F.collect_set(F.struct("start", "size", *more)).alias("pieces")), ["did", "tie"])

    found = equals(_anchor_maker(length)(key))
    needed, others = found.where("needed"), [found.where("not needed")]
    crowds = cut(needed.groupBy("key").count().where(F.col("count") > crowd).select(F.col("key").alias("crowd")), "crowds")
    if not crowds.isEmpty():
        needed = needed.join(small(crowds), F.col("key") == F.col("crowd"), "left")
        strings = equals(_string_maker(length)(of_documents(needed.where("crowd is not null"))))
        others.append(strings.where("not needed"))
        # A crowded minimizer's piece with equals still answers to these, on its own.
        needed = needed.where("crowd is null or twin").withColumn("alone", F.col("alone") | F.col("crowd").isNotNull()).drop("crowd").unionByName(strings.where("needed"))
    data = cut(_bytes_maker(length)(of_documents(needed, "key", "piece", "twin", "alone")), "bytes")
    marks = cut(_mark_maker(length)(data.repartition("route").sortWithinPartitions("route")), "marks")
    drop(data)
    answers = marks.where("answer").select(F.col("key").alias("key2"), F.col("piece").alias("piece2"), F.col("start").alias("first"), F.col("size").alias("n")).distinct()
    waiting = others[0] if len(others) == 1 else others[0].unionByName(others[1])
    answered = waiting.join(answers, (F.col("key") == F.col("key2")) & (F.col("piece") == F.col("piece2"))).select("did", "tie", (F.col("start") + F.col("first")).alias("start"), F.col("n").alias("size"))
    marks = marks.where("not answer").select("did", "tie", "start", "size").unionByName(answered)
    per_doc = marks.groupBy("did", "tie").agg(F.collect_set(F.struct("start", "size")).alias("marks")).withColumnRenamed("tie", "order")
    carried = docs.schema["carried"].dataType.simpleString() if carry else None
    return _cut_maker(length, carried)(docs.join(per_doc, ["did", "order"], "left").drop("did", "order"))
