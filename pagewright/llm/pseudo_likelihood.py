"""Masked pseudo-likelihood scores of documents.

Every word that occurs ``LEAST`` times in the corpus is a token of its own. The most frequent words
are classes of their own, the others fall into classes by their ending. A window network, written
in numpy, predicts the class of every token from the tokens on both sides: a hidden layer sums a
vector for each neighbour and its place, and a softmax in two steps, over groups of classes and then
over the classes of the group, makes a probability of it. Within its class a word has the share that
it has in the corpus; words that are too rare are one token of their class. Every task trains a copy
of the network on all of its documents; the copies are averaged by tokens (parameter mixing), and
the next round goes on from the average. A document's score is the sum of the log-probabilities of
its words given both sides.
"""

from __future__ import annotations

import uuid
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm.common import arrow_map, column, cut, drop, keep, kept, keyed, prepare, texts

#: Times a word occurs in the corpus to be a token of its own.
LEAST = 5
#: The model's size: words with a token of their own, at most, the most frequent first. Driver and workers hold about 200 bytes for each.
VOCABULARY = 1_000_000
#: Groups of classes, and classes in each; so many frequent words have a class of their own, the other classes are endings.
GROUPS, MEMBERS = 32, 32
CLASSES, WORDS = GROUPS * MEMBERS, 512
ENDINGS = CLASSES - WORDS
#: Tokens seen on each side, and hidden units.
SIDE, HIDDEN = 2, 16
#: Each round trains on another part of the documents, so that together they cover all.
ROUNDS = 2
#: Tokens that are scored, and that are learned from, at once; of the latter an eighth in the first steps.
STEP, LEARN, FEW = 8192, 8192, 100
RATE = 0.02
#: Weights in one row of a copy, and parts in which the copies are added up at first.
SENT, SALTS = 4096, 64
_PUNCTUATION = b".,;:!?\"'()"
#: Entries of a worker's table of rare words, and words that a task counts before it hands them on.
KNOWN, COUNTED = 100_000, 250_000


def words_of(text: bytes) -> list[bytes]:
    return text.translate(None, _PUNCTUATION).lower().split()


def ending(word: bytes) -> int:
    return zlib.crc32(word[-3:]) % ENDINGS


class Tokens(dict):
    """Token of a word, with each token's class and the logarithm of its share in it.

    Tokens are the known words, most frequent first, then one for the rare words of each ending.
    """

    def __init__(self, words: list[bytes], counts: list[int] | np.ndarray, rare: dict[int, int]):
        n = len(words)
        super().__init__(zip(words, range(n), strict=True))
        # Neighbours in rank are in different groups, so that groups are about equally frequent.
        place = np.arange(CLASSES).reshape(MEMBERS, GROUPS).T.ravel().argsort()
        own = np.r_[np.arange(min(n, WORDS)), [WORDS + ending(w) for w in words[WORDS:]], WORDS + np.arange(ENDINGS)].astype(np.int64)
        weight = np.r_[np.array(counts, float), [rare.get(e, 0) + 0.5 for e in range(ENDINGS)]]
        total = np.bincount(own, weight, CLASSES)
        self.share = np.log(weight / total[own])
        #: Class of each token, and of the pad, which is the token after all others.
        self.class_of = np.append(place[own], CLASSES)
        self.n, self.total, self.most = n, len(own), n + KNOWN

    def __missing__(self, word: bytes) -> int:
        token = self.n + ending(word)
        if len(self) < self.most:
            self[word] = token
        return token

    def of(self, batch: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of texts with pads around each, and which text each belongs to (-1: a pad)."""
        pad, owner = np.full(SIDE, self.total, np.int64), [np.full(SIDE, -1)]
        tokens = [pad]
        for i, text in enumerate(batch):
            words = words_of(text)
            tokens += [np.fromiter(map(self.__getitem__, words), np.int64, len(words)), pad]
            owner += [np.full(len(words), i), np.full(SIDE, -1)]
        return np.concatenate(tokens), np.concatenate(owner)


class Network:
    """Sums a vector for each neighbour and its place, squashes it, and scores groups and the classes of a group."""

    SHAPES = ((2 * SIDE, CLASSES + 1, HIDDEN), (HIDDEN,), (HIDDEN, GROUPS), (GROUPS,), (GROUPS, MEMBERS, HIDDEN), (GROUPS, MEMBERS))
    SIZES = tuple(int(np.prod(s)) for s in SHAPES)

    def __init__(self, weights: np.ndarray | None = None, seed: int = 11):
        if weights is None:
            weights = np.random.default_rng(seed).normal(0, 0.1, sum(self.SIZES))
        self.weights = np.array(weights, np.float32)
        parts = np.split(self.weights, np.cumsum(self.SIZES)[:-1])
        self.near, self.bias, self.top, self.top_prior, self.out, self.prior = (p.reshape(s) for p, s in zip(parts, self.SHAPES, strict=True))
        self.moment, self.square, self.steps = np.zeros_like(self.weights), np.zeros_like(self.weights), 0

    @staticmethod
    def _softmax(scores: np.ndarray) -> np.ndarray:
        """Probabilities of rows of scores, in place."""
        scores -= scores.max(1, keepdims=True)
        np.exp(scores, out=scores)
        scores /= scores.sum(1, keepdims=True)
        return scores

    @staticmethod
    def _log_share(scores: np.ndarray, own: np.ndarray) -> np.ndarray:
        """Log-probability of each row's own column."""
        scores -= scores.max(1, keepdims=True)
        mine = scores[np.arange(len(own)), own]
        return mine - np.log(np.exp(scores, out=scores).sum(1))

    def _hidden(self, classes: np.ndarray, at: np.ndarray) -> np.ndarray:
        hidden = self.near[0][classes[at - SIDE]]
        for j, d in enumerate((*range(1 - SIDE, 0), *range(1, SIDE + 1)), 1):
            hidden += self.near[j][classes[at + d]]
        hidden += self.bias
        return np.tanh(hidden, out=hidden)

    @staticmethod
    def _groups(classes: np.ndarray) -> list[tuple[int, int, int]]:
        """(group, first, end) of sorted classes; pads are in none."""
        cuts = np.searchsorted(classes, np.arange(GROUPS + 1) * MEMBERS).tolist()
        return [(g, a, z) for g, (a, z) in enumerate(zip(cuts, cuts[1:], strict=False)) if z > a]

    def log_probabilities(self, classes: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Of the class at each place given the classes on both sides."""
        out = np.empty(len(at))
        for k in range(0, len(at), STEP):
            # Sorted by class, so that the classes of a group stand together.
            order = np.argsort(classes[at[k : k + STEP]].astype(np.int16), kind="stable")
            part = at[k : k + STEP][order]
            own = classes[part]
            hidden = self._hidden(classes, part)
            each = self._log_share(hidden @ self.top + self.top_prior, own // MEMBERS)
            for g, a, z in self._groups(own):
                each[a:z] += self._log_share(hidden[a:z] @ self.out[g].T + self.prior[g], own[a:z] - g * MEMBERS)
            out[k + order] = each
        return out

    def learn(self, classes: np.ndarray) -> None:
        """Adam steps over all places, a few at a time at first; pads are learned from as neighbours only."""
        k = SIDE
        while k < len(classes) - SIDE:
            z = min(len(classes) - SIDE, k + (LEARN if self.steps >= FEW else LEARN // 8))
            gradient = self.gradient(classes, k, z)
            if gradient is not None:
                self._step(gradient)
            k = z

    def gradient(self, classes: np.ndarray, first: int, end: int) -> np.ndarray | None:
        """Of the mean negative log-probability at the places from ``first`` to ``end`` that are no pads, in the order of the weights."""
        lo, window = first - SIDE, classes[first - SIDE : end + SIDE]
        order = np.argsort(window.astype(np.int16), kind="stable")  # numbers this small are sorted by their digits
        inside = order[(order >= SIDE) & (order < len(window) - SIDE) & (window[order] < CLASSES)]
        if not len(inside):
            return None
        own = window[inside]
        hidden = self._hidden(classes, inside + lo)
        p = self._softmax(hidden @ self.top + self.top_prior)
        p[np.arange(len(own)), own // MEMBERS] -= 1
        back = p @ self.top.T
        out, prior = np.zeros_like(self.out), np.zeros_like(self.prior)
        for g, a, z in self._groups(own):
            q = self._softmax(hidden[a:z] @ self.out[g].T + self.prior[g])
            q[np.arange(z - a), own[a:z] - g * MEMBERS] -= 1
            out[g], prior[g] = q.T @ hidden[a:z], q.sum(0)
            back[a:z] += q @ self.out[g]
        back *= 1 - hidden * hidden
        # What each place gives back goes to the classes of its neighbours; the window is sorted by class already.
        padded = np.zeros((len(window) + 2 * SIDE, HIDDEN), np.float32)
        padded[inside + SIDE] = back
        starts = np.flatnonzero(np.r_[True, np.diff(window[order]) > 0])
        rows = window[order[starts]]
        near = np.zeros_like(self.near)
        for j, d in enumerate((*range(-SIDE, 0), *range(1, SIDE + 1))):
            near[j][rows] = np.add.reduceat(padded[order + SIDE - d], starts)
        return np.concatenate([near.ravel(), back.sum(0), (hidden.T @ p).ravel(), p.sum(0), out.ravel(), prior.ravel()]).astype(np.float32) / np.float32(len(own))

    def _step(self, gradient: np.ndarray) -> None:
        self.steps += 1
        self.moment += 0.1 * (gradient - self.moment)
        self.square += 0.001 * (gradient * gradient - self.square)
        rate = RATE * np.sqrt(1 - 0.999**self.steps) / (1 - 0.9**self.steps)
        self.weights -= rate * self.moment / (np.sqrt(self.square) + 1e-8)


def vocabulary(docs: DataFrame, size: int = VOCABULARY) -> tuple[list[bytes], list[int], dict[int, int]]:
    """Words of all documents that occur ``LEAST`` times, most frequent first, their counts, and occurrences of all others by ending.

    If these are more than ``size`` words, a word must occur more often, so often that they aren't.
    """

    def make():
        def rows(counts: Counter) -> dict:
            return {"word": list(counts), "n": list(counts.values())}

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
            counts: Counter = Counter()
            for b in batches:
                for t in texts(b):
                    counts.update(words_of(t))
                if len(counts) > COUNTED:
                    yield rows(counts)
                    counts = Counter()
            yield rows(counts)

        return run

    counted = cut(arrow_map(docs.select("text"), make, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")
    least = LEAST
    if counted.where(F.col("n") >= least).count() > size:
        total = 0
        for r in counted.where(F.col("n") >= least).groupBy("n").count().orderBy(F.desc("n")).toLocalIterator():
            total += r["count"]
            if total > size:
                least = r["n"] + 1
                break
    found = counted.where(F.col("n") >= least).toArrow().sort_by([("n", "descending"), ("word", "ascending")])
    words, n = found["word"].to_pylist(), found["n"].to_pylist()
    of_ending = F.pmod(F.crc32(F.substring("word", -3, 3)), F.lit(ENDINGS)).cast("int")
    rare = {r["ending"]: r["n"] for r in counted.groupBy(of_ending.alias("ending")).agg(F.sum("n").alias("n")).collect()}  # at most ENDINGS rows
    drop(counted)
    for w, k in zip(words, n, strict=True):
        rare[ending(w)] -= k
    return words, n, rare


class Sent:
    """A vocabulary as a broadcast of one block of bytes; workers make a table of it once and keep it over their tasks."""

    def __init__(self, spark: SparkSession, words: list[bytes], counts: list[int], rare: dict[int, int]):
        self.block, self.key = spark.sparkContext.broadcast((b" ".join(words), np.array(counts, np.int64), rare)), uuid.uuid4().hex

    def table(self) -> Tokens:
        def made() -> Tokens:
            words, counts, rare = self.block.value
            return Tokens(words.split(), counts, rare)

        return kept(("tokens", self.key), made)


def train(docs: DataFrame, words: Sent, rounds: int = ROUNDS) -> np.ndarray:
    """The network's weights after ``rounds`` rounds of parameter mixing."""
    spark = docs.sparkSession
    weights = Network().weights
    fields = "row int, salt int, total array<float>, n double"

    def learner(start):
        def make():
            table, network = words.table(), Network(start.value)

            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
                seen = 0
                for b in batches:
                    tokens, owner = table.of(texts(b))
                    network.learn(table.class_of[tokens])
                    seen += int((owner >= 0).sum())
                if seen:
                    total = np.split(network.weights * np.float32(seen), range(SENT, len(network.weights), SENT))
                    yield {"row": range(len(total)), "salt": [TaskContext.get().partitionId() % SALTS] * len(total), "total": total, "n": [float(seen)] * len(total)}

            return run

        return make

    def adder():
        keep(("tokens", words.key))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
            sums: dict[int, list] = {}
            for b in batches:
                for row, x, n in zip(column(b, "row").to_pylist(), column(b, "total"), column(b, "n").to_pylist(), strict=True):
                    held = sums.setdefault(row, [0.0, 0.0])
                    held[0] = held[0] + x.values.to_numpy().astype(float)
                    held[1] += n
            if sums:
                yield {"row": list(sums), "salt": [0] * len(sums), "total": [x.astype(np.float32) for x, _ in sums.values()], "n": [n for _, n in sums.values()]}

        return run

    for k in range(rounds):
        start = spark.sparkContext.broadcast(weights)
        part = docs.where(F.pmod(F.xxhash64("doc_id", "tie", F.lit("round")), F.lit(rounds)) == k).select("text")
        copies = cut(arrow_map(part, learner(start), fields), "copies")
        some = arrow_map(copies.repartition("row", "salt"), adder, fields)
        sums = {r["row"]: np.array(r["total"], np.float32) / np.float32(r["n"]) for r in arrow_map(some.repartition("row"), adder, fields).collect()}  # as many rows as the weights have parts
        if sums:
            weights = np.concatenate([sums[row] for row in range(len(sums))])
        drop(copies)
        start.unpersist()
    return weights


def score(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, size: int = VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens, log_likelihood, mean_log_likelihood) for every row.

    ``log_likelihood`` is the sum over the document's tokens of the log-probability of each given
    the tokens on both sides; its mean is null for texts without words, null texts among them,
    whose sum is 0. Repeated rows get equal scores. An empty table gives no rows.

    The vocabulary grows with the corpus up to ``size`` words; the others are scored as the rest of
    their class. Training mixes the copies that tasks train on their rows, so the weights, and with
    them the scores, depend somewhat on how rows are dealt to tasks and batches: the same files read
    with the same settings give the same scores.
    """
    spark = df.sparkSession
    prepare(spark)
    docs = keyed(df, id_col, text_col)
    words = Sent(spark, *vocabulary(docs, size))
    model = spark.sparkContext.broadcast(train(docs, words))

    def make():
        table, network = words.table(), Network(model.value)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
            for b in batches:
                tokens, owner = table.of(texts(b))
                at = np.flatnonzero(owner >= 0)
                n = np.bincount(owner[at], minlength=b.num_rows)
                each = network.log_probabilities(table.class_of[tokens], at) + table.share[tokens[at]]
                total = np.bincount(owner[at], each, b.num_rows)
                mean = pa.array(total / np.maximum(n, 1), mask=n == 0)
                yield {"doc_id": column(b, "doc_id"), "n_tokens": n, "log_likelihood": total, "mean_log_likelihood": mean}

        return run

    return arrow_map(docs.select("doc_id", "text"), make, "doc_id long, n_tokens long, log_likelihood double, mean_log_likelihood double")
