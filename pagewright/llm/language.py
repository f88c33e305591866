"""Language identification with string kernels.

A stretch of text is the set of its blended-spectrum character n-grams (one to three characters,
hashed). The kernel of two stretches is the share of n-grams they have in common, by cosine.
Nyström landmarks from a bounded sample of each language's labelled texts stand for the kernel's
space; one-versus-rest kernel ridge regression on them gives each language a score. Its normal
equations are summed up by the executors, so the driver holds no texts but the landmarks. As the
kernel is a product of presence vectors, landmarks and weights fold into one matrix, and texts are
scored in batches by a product with it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.llm.common import arrow_map, column, cut, keyed, prepare, texts

ORDERS = (1, 2, 3)
#: Buckets of hashed n-grams.
BUCKETS = 1 << 14
#: Labelled texts of each language that the model learns from, about.
SAMPLE = 400
#: Landmarks in all, and of each language, at least.
LANDMARKS, EACH = 160, 2
UNDETERMINED = "und"
#: Characters of a stretch. Longer texts are scored stretch by stretch, so that none has most n-grams there are.
STRETCH = 4_000
#: Stretches in one matrix product.
BATCH = 128
#: Tasks that sum up the normal equations, at most.
ADDERS = 16


def letters(text: str) -> bool:
    return any(map(str.isalpha, text))


def stretches(text: str) -> Iterator[np.ndarray]:
    """Buckets of the n-grams that begin in each stretch of a text, repeats included. Case and the kind of white space don't matter."""
    c = np.frombuffer(f" {' '.join(text.lower().split())} ".encode("utf-32-le", "replace"), np.uint32)
    hashed, code = [], np.zeros(len(c), np.uint32)
    for n in range(1, max(ORDERS) + 1):
        if len(c) < n:
            break
        code = (code[: len(c) - n + 1] * np.uint32(0x01000193)) ^ c[n - 1 :]
        if n in ORDERS:
            hashed.append((code ^ np.uint32(n)) * np.uint32(0x9E3779B1) >> np.uint32(32 - BUCKETS.bit_length() + 1))
    for k in range(0, len(c), STRETCH):
        yield np.concatenate([h[k : k + STRETCH] for h in hashed])


def presence(batch: list[np.ndarray]) -> np.ndarray:
    """Unit-length presence vectors, one row for each array of buckets."""
    x = np.zeros((len(batch), BUCKETS), np.float32)
    for row, at in zip(x, batch, strict=True):
        row[at] = 1
    return x / np.sqrt(x.sum(1, keepdims=True))


@dataclass
class Model:
    languages: list[str]
    #: What each n-gram adds to each language's score.
    weights: np.ndarray

    def scores(self, batch: list[str]) -> np.ndarray:
        """Probability-like scores of each language for each text; rows sum to 1."""
        raw, size, held, owner = np.zeros((len(batch), len(self.languages))), np.zeros(len(batch)), [], []

        def add() -> None:
            weight = np.array([len(h) for h in held], float)
            np.add.at(raw, owner, (presence(held) @ self.weights) * weight[:, None])
            np.add.at(size, owner, weight)
            held.clear()
            owner.clear()

        for i, text in enumerate(batch):
            for at in stretches(text):
                held.append(at)
                owner.append(i)
                if len(held) == BATCH:
                    add()
        if held:
            add()
        raw /= size[:, None]
        e = np.exp(4 * (raw - raw.max(1, keepdims=True)))
        return e / e.sum(1, keepdims=True)


def nystroem(marks: np.ndarray) -> np.ndarray:
    """What turns kernels with unit-length landmarks ``marks`` into features whose products are the kernel."""
    values, vectors = np.linalg.eigh((marks @ marks.T).astype(np.float64))
    good = values > 1e-6 * values.max()
    return vectors[:, good] / np.sqrt(values[good])


def equations(x: np.ndarray, y: np.ndarray, marks: np.ndarray, root: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Normal equations' left and right sides over presence vectors ``x`` of languages ``y`` that each count by its ``weight``."""
    phi = (x @ marks.T).astype(np.float64) @ root
    weighted = phi * weight[y][:, None]
    target = np.where(y[:, None] == np.arange(len(weight)), 1.0, -1.0)
    return weighted.T @ phi, weighted.T @ target


def solve(languages: list[str], left: np.ndarray, right: np.ndarray, marks: np.ndarray, root: np.ndarray, n: int, ridge: float = 1e-3) -> Model:
    w = np.linalg.solve(left + ridge * n * np.eye(len(left)), right)
    return Model(languages, marks.T @ (root @ w).astype(np.float32))


def unpacked(rows: list[bytes]) -> np.ndarray:
    x = np.unpackbits(np.frombuffer(b"".join(rows), np.uint8).reshape(-1, BUCKETS // 8), axis=1).astype(np.float32)
    return x / np.sqrt(x.sum(1, keepdims=True))


def fit(labelled: DataFrame, sample: int = SAMPLE) -> Model:
    """Learn from about ``sample`` rows of each language of ``labelled`` (doc_id, text, lang), chosen by hash.

    Of each row one stretch, chosen by hash, is learned from. All languages are; each has its share
    of ``LANDMARKS`` landmarks, and ``EACH`` of them at least.
    """
    spark = labelled.sparkSession
    counts = labelled.groupBy("lang").agg(F.count("*").alias("n")).orderBy("lang").collect()
    if not counts:
        return Model([], np.zeros((BUCKETS, 0), np.float32))
    languages = [r["lang"] for r in counts]
    share = spark.createDataFrame([(r["lang"], k, min(1.0, sample / r["n"])) for k, r in enumerate(counts)], "lang string, number int, share double")
    place = F.pmod(F.xxhash64("doc_id", F.lit("language")), F.lit(1_000_003)) / F.lit(1_000_003.0)
    chosen = labelled.join(F.broadcast(share), "lang").where(place < F.col("share"))

    def make():
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
            for b in batches:
                keep, bits = [], []
                for i, t in enumerate(texts(b)):
                    t = t.decode("utf-8", "replace")
                    if letters(t):
                        of_text = list(stretches(t))
                        row = np.zeros(BUCKETS, bool)
                        row[of_text[zlib.crc32(t.encode("utf-8", "replace")) % len(of_text)]] = True
                        keep.append(i)
                        bits.append(np.packbits(row).tobytes())
                yield {"number": column(b, "number").take(pa.array(keep, pa.int64())), "bits": bits}

        return run

    known = cut(arrow_map(chosen.select("text", "number"), make, "number int, bits binary"), "sampled")
    each = max(EACH, LANDMARKS // len(languages))
    first = F.row_number().over(Window.partitionBy("number").orderBy(F.xxhash64("bits"), "bits"))
    marks = [r["bits"] for r in known.withColumn("first", first).where(F.col("first") <= each).orderBy("number", "first").select("bits").collect()]
    if not marks:
        return Model([], np.zeros((BUCKETS, 0), np.float32))
    seen = np.zeros(len(languages))
    for r in known.groupBy("number").count().collect():
        seen[r["number"]] = r["count"]
    n = int(seen.sum())
    weight = n / (np.count_nonzero(seen) * np.maximum(seen, 1))  # each language counts alike
    x = unpacked(marks)
    root = nystroem(x)
    sent = spark.sparkContext.broadcast((marks, root, weight))

    def adder():
        packed, basis, of_language = sent.value
        landmarks = unpacked(packed)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
            left, right = np.zeros((basis.shape[1],) * 2), np.zeros((basis.shape[1], len(of_language)))
            for b in batches:
                bits, y = column(b, "bits").to_pylist(), column(b, "number").to_numpy().astype(np.int64)
                for k in range(0, len(bits), BATCH):
                    a, z = equations(unpacked(bits[k : k + BATCH]), y[k : k + BATCH], landmarks, basis, of_language)
                    left += a
                    right += z
            yield {"both": [np.r_[left.ravel(), right.ravel()]]}

        return run

    left, right = np.zeros((root.shape[1],) * 2), np.zeros((root.shape[1], len(languages)))
    for r in arrow_map(known.coalesce(ADDERS).select("number", "bits"), adder, "both array<double>").toLocalIterator():
        both = np.array(r["both"])
        left += both[: left.size].reshape(left.shape)
        right += both[left.size :].reshape(right.shape)
    return solve(languages, left, right, x, root, n)


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def identify(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", *, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row.

    Rows whose crc32 of the id as text leaves 2 modulo 4 are held out; the model learns only from
    texts and languages of the others, all of these languages, and predicts from the text alone. ``score`` is the predicted
    language's share of the scores. A text that is null or has no letter is ``und`` with score 0,
    as is every text if there is nothing to learn from. A null id isn't held out; repeated rows
    stay repeated. An empty table gives no rows.
    """
    spark = df.sparkSession
    prepare(spark)
    docs = keyed(df, id_col, text_col, lang=F.col(f"`{lang_col}`").cast("string"))
    model = spark.sparkContext.broadcast(fit(docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull()), sample))

    def make():
        fitted: Model = model.value

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
            for b in batches:
                decoded = [t.decode("utf-8", "replace") for t in texts(b)]
                known = [i for i, t in enumerate(decoded) if letters(t)] if fitted.languages else []
                lang, score = [UNDETERMINED] * len(decoded), [0.0] * len(decoded)
                for k in range(0, len(known), BATCH):
                    part = known[k : k + BATCH]
                    p = fitted.scores([decoded[i] for i in part])
                    for i, best, s in zip(part, p.argmax(1).tolist(), p.max(1).tolist(), strict=True):
                        lang[i], score[i] = fitted.languages[best], s
                yield {"doc_id": column(b, "doc_id"), "held_out": column(b, "held_out"), "lang_pred": lang, "score": score}

        return run

    return arrow_map(docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text"), make, "doc_id long, held_out boolean, lang_pred string, score double")
