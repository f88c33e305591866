"""Document quality: a classifier's evidence combined with host and path posteriors.

The classifier learns from a bounded sample of labelled documents. One half of it gives log-odds
of words, the other half fits a logistic regression on these and on a few measures of form. Its
probabilities for all documents are summed by host and by path; the sums update a global prior to
a host posterior, and that to a path posterior, so that sparse sites stay near the global mean.
How strongly they shrink is estimated from the variance between sites. A document's final odds are
its own evidence under its path's posterior, without its own part in it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.llm.common import arrow_map, column, cut, keyed, prepare, small, texts

#: Labelled documents that the classifier learns from, at most.
SAMPLE = 20_000
#: The classifier's size: words whose log-odds are kept for each label, the surest first. No row of the table is left out for it.
WORDS = 5_000
#: Documents of the sample in which a word must be.
SEEN = 5
TARGETS = ("quality", "toxic")
_WORD = re.compile(r"\w+")
_SYMBOL = re.compile(r"[#*$%&|<>{}\[\]=_~^\\]")


@dataclass
class Model:
    """Log-odds of words and logistic weights for each target."""

    odds: dict[str, dict[str, float]]
    weights: dict[str, np.ndarray]
    mean: np.ndarray
    scale: np.ndarray


def measures(text: str, odds: dict[str, dict[str, float]]) -> list[float]:
    """The classifier's features of a text."""
    words = _WORD.findall(text.lower())
    chunks = text.split()
    n, m = max(1, len(words)), max(1, len(chunks))
    distinct = set(words)
    out = [
        np.log1p(len(words)),
        len(distinct) / n,
        sum(map(len, words)) / n,
        sum(a == b for a, b in zip(words, words[1:], strict=False)) / n,
        len(_SYMBOL.findall(text)) / m,
        sum(c == "|" for c in chunks) / m,
        sum(map(str.isdigit, words)) / n,
        sum(len(w) <= 3 for w in words) / n,
        text.count("\n") / m,
        (text.count(".") + text.count(",")) / m,
    ]
    for target in TARGETS:
        own = [odds[target][w] for w in distinct.intersection(odds[target])]
        out += [max(own, default=0.0), min(own, default=0.0), sum(x for x in own if x > 1.5), sum(own) / (1 + len(own))]
    return out


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Weights of a ridge-penalized logistic regression, by Newton steps; the last column is constant."""
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _feature_maker(odds: dict[str, dict[str, float]]):
    def make():
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
            for b in batches:
                yield {"x": [measures(t.decode("utf-8", "replace"), odds) for t in texts(b)]} | {c: column(b, c) for c in TARGETS}

        return run

    return make


def _word_maker():
    def make():
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
            for b in batches:
                labels = [column(b, c).to_pylist() for c in TARGETS]
                rows = [(w, q, t) for x, q, t in zip(texts(b), *labels, strict=True) for w in set(_WORD.findall(x.decode("utf-8", "replace").lower()))]
                word, quality, toxic = zip(*rows, strict=True) if rows else ((), (), ())
                yield {"word": list(word), "quality": list(quality), "toxic": list(toxic)}

        return run

    return make


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", sample: int = SAMPLE) -> Model:
    """Learn from at most ``sample`` labelled rows of ``docs`` (doc_id, text), chosen by a hash of their id."""
    chosen = labels.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), *(F.col(c).cast("int").alias(c) for c in TARGETS)).dropna()
    chosen = chosen.groupBy("doc_id").agg(*(F.max(c).alias(c) for c in TARGETS)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    known = cut(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").withColumn("half", F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(2))), "labelled")
    words_from = known.where("half = 0")
    totals = words_from.groupBy(*TARGETS).count().collect()
    counts = arrow_map(words_from.select("text", *TARGETS), _word_maker(), "word string, quality int, toxic int").groupBy("word").agg(F.count("*").alias("n"), *(F.sum(c).alias(c) for c in TARGETS))
    counts = cut(counts.where(F.col("n") >= SEEN), "words")
    odds: dict[str, dict[str, float]] = {}
    for target in TARGETS:
        yes = sum(r["count"] for r in totals if r[target])
        no = sum(r["count"] for r in totals) - yes
        value = F.log((F.col(target) + 0.5) / F.lit(yes + 1.0)) - F.log((F.col("n") - F.col(target) + 0.5) / F.lit(no + 1.0))
        sure = F.abs(value) * F.sqrt(F.least(F.col("n"), F.lit(200)))
        odds[target] = {r["word"]: r["odds"] for r in counts.select("word", value.alias("odds"), sure.alias("sure")).where("abs(odds) > 0.7").orderBy(F.desc("sure"), "word").limit(WORDS).collect()}
    rows = arrow_map(known.where("half = 1").select("text", *TARGETS), _feature_maker(odds), "x array<double>, quality int, toxic int").collect()
    size = 10 + 4 * len(TARGETS)
    x = np.array([r["x"] for r in rows], float).reshape(-1, size)
    mean, scale = (x.mean(0), x.std(0) + 1e-6) if len(x) else (np.zeros(size), np.ones(size))
    z = np.c_[np.clip((x - mean) / scale, -8, 8), np.ones(len(x))]
    return Model(odds, {t: logistic(z, np.array([r[t] > 0 for r in rows], float)) for t in TARGETS}, mean, scale)


def probabilities(model: Model, batch: list[str]) -> dict[str, np.ndarray]:
    """Probability of each target for each text, within [0.001, 0.999]."""
    x = np.array([measures(t, model.odds) for t in batch], float).reshape(len(batch), len(model.mean))
    z = np.c_[np.clip((x - model.mean) / model.scale, -8, 8), np.ones(len(batch))]
    return {t: np.clip(1 / (1 + np.exp(-np.clip(z @ w, -30, 30))), 0.001, 0.999) for t, w in model.weights.items()}


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def posteriors(scores: DataFrame) -> DataFrame:
    """Adds host_<t>, path_<t> and post_<t> for each target's p_<t>; ``scores`` has host and path."""
    sums = [F.count("*").alias("n"), *(F.sum(f"p_{t}").alias(f"s_{t}") for t in TARGETS), *(F.sum(F.col(f"p_{t}") ** 2).alias(f"q_{t}") for t in TARGETS)]
    paths = cut(scores.groupBy("host", "path").agg(*sums), "paths")
    add = [F.sum(c).alias(c) for c in paths.columns if c not in ("host", "path")]
    hosts = cut(paths.groupBy("host").agg(*add), "hosts")
    whole = hosts.agg(*add, F.count("*").alias("groups")).first()
    n = whole["n"] or 0
    prior, strength = {}, {}
    for t in TARGETS:
        mean = min(0.99, max(0.01, (whole[f"s_{t}"] or 0.0) / n)) if n else 0.5
        within = max(1e-6, (whole[f"q_{t}"] or 0.0) / n - mean**2) if n else 0.25
        # Prior strength: documents whose spread equals that between the sites' means.
        strength[t] = []
        for groups in (hosts, paths):
            r = groups.agg(F.sum(F.col("n") * (F.col(f"s_{t}") / F.col("n") - mean) ** 2).alias("b"), F.sum(F.col("n") ** 2).alias("n2"), F.count("*").alias("g")).first()
            between = ((r["b"] or 0.0) - max(0, r["g"] - 1) * within) / max(1.0, n - (r["n2"] or 0) / max(1, n))
            strength[t].append(float(min(1e4, max(5.0, within / max(between, 1e-9)))))
        prior[t] = mean

    def shrunk(total: Column, count: Column, toward: Column, k: float) -> Column:
        return (total + k * toward) / (count + k)

    for t in TARGETS:
        hosts = hosts.withColumn(f"host_{t}", shrunk(F.col(f"s_{t}"), F.col("n"), F.lit(prior[t]), strength[t][0]))
    table = paths.withColumnRenamed("host", "h").withColumnRenamed("path", "p").join(hosts.select(F.col("host").alias("h2"), *(f"host_{t}" for t in TARGETS)), F.col("h") == F.col("h2")).drop("h2")
    table = small(cut(table, "priors"))
    out = scores.join(table, (F.col("host") == F.col("h")) & (F.col("path") == F.col("p")))
    for t in TARGETS:
        own = F.col(f"p_{t}")
        path = shrunk(F.col(f"s_{t}") - own, F.col("n") - 1, F.col(f"host_{t}"), strength[t][1])
        path = F.least(F.greatest(path, F.lit(0.001)), F.lit(0.999))
        odds = _logit(own) + _logit(path) - _logit(F.lit(prior[t]))
        out = out.withColumn(f"path_{t}", path).withColumn(f"post_{t}", 1 / (1 + F.exp(-odds)))
    return out.select(*scores.columns, *(f"{k}_{t}" for t in TARGETS for k in ("host", "path", "post")))


def classify(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang", *, sample: int = SAMPLE, least: float = 0.5, toxic: float = 0.5) -> DataFrame:
    """Per row: doc_id, tie, host, path, p_, host_, path_ and post_ of quality and toxic, and keep.

    ``keep`` says that the posterior of quality reaches ``least`` and that of toxic stays below
    ``toxic``. The model is bounded: it learns from at most ``sample`` labelled rows and keeps
    ``WORDS`` words for each label. Null texts count as empty, null hosts and paths as empty names, repeated rows as
    often as they occur. The table of documents has no URL: by default source stands for the host
    and lang for the path. Labels without a document or with nulls teach nothing; of several labels
    of one document the larger counts. Without any labels every document has even odds. An empty
    table gives no rows.
    """
    spark = df.sparkSession
    prepare(spark)
    docs = keyed(df, id_col, text_col)
    model = spark.sparkContext.broadcast(fit(docs, labels, id_col, sample))

    def make():
        fitted = model.value

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
            for b in batches:
                found = probabilities(fitted, [t.decode("utf-8", "replace") for t in texts(b)])
                yield {c: column(b, c) for c in ("doc_id", "tie", "host", "path")} | {f"p_{t}": found[t] for t in TARGETS}

        return run

    named = keyed(df, id_col, text_col, host=F.coalesce(F.col(f"`{host_col}`").cast("string"), F.lit("")), path=F.coalesce(F.col(f"`{path_col}`").cast("string"), F.lit("")))
    scores = cut(arrow_map(named, make, "doc_id long, tie long, host string, path string, p_quality double, p_toxic double"), "scores")
    return posteriors(scores).withColumn("keep", (F.col("post_quality") >= least) & (F.col("post_toxic") < toxic))
