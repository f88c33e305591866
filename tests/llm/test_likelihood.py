"""Log-probabilities of the language model against plain loops over its weights."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from pagewright.llm import pseudo_likelihood as lm

DOCS = "doc_id long, text string"


def a_table(rng, n):
    words = [f"w{i}{rng.choice('abcd')}{rng.choice('xyz')}".encode() for i in range(n)]
    return words, lm.Tokens(words, sorted((rng.randint(5, 500) for _ in words), reverse=True), {3: 40, 77: 2})


def softmax(scores, own):
    return scores[own] - math.log(sum(math.exp(s) for s in scores))


def plain(table, network, tokens, at):
    """Log-probability of the token at ``at``: of its group, of its class in the group, and of the word in its class."""
    classes = [int(table.class_of[tokens[at + d]]) for d in (*range(-lm.SIDE, 0), *range(1, lm.SIDE + 1))]
    hidden = [math.tanh(float(network.bias[h]) + sum(float(network.near[j][c][h]) for j, c in enumerate(classes))) for h in range(lm.HIDDEN)]
    group, member = divmod(int(table.class_of[tokens[at]]), lm.MEMBERS)
    total = softmax([sum(hidden[h] * float(network.top[h][g]) for h in range(lm.HIDDEN)) + float(network.top_prior[g]) for g in range(lm.GROUPS)], group)
    total += softmax([sum(hidden[h] * float(network.out[group][m][h]) for h in range(lm.HIDDEN)) + float(network.prior[group][m]) for m in range(lm.MEMBERS)], member)
    return total + float(table.share[tokens[at]])


def of_table(network, table, tokens, at):
    return network.log_probabilities(table.class_of[tokens], at) + table.share[tokens[at]]


def test_log_probabilities_are_those_of_plain_loops():
    rng = random.Random(1)
    words, table = a_table(rng, 900)
    network = lm.Network(seed=5)
    network.weights *= 3
    texts = [" ".join(rng.choice(words).decode() for _ in range(rng.randint(1, 40))).encode() for _ in range(6)] + [b"unseen rarewords here", b""]
    tokens, owner = table.of(texts)
    at = np.flatnonzero(owner >= 0)
    assert np.allclose(of_table(network, table, tokens, at), [plain(table, network, tokens, k) for k in at.tolist()], atol=1e-3)


@pytest.mark.parametrize("n", [0, 40, 900])
def test_probabilities_of_all_tokens_sum_to_one(n):
    _, table = a_table(random.Random(3), n)
    tokens = np.full(5, table.total, np.int64)
    tokens[[0, 1, 3, 4]] = [3, table.total // 2, 7, table.total - 1]
    whole = np.tile(tokens, table.total)
    whole[2::5] = np.arange(table.total)
    total = np.exp(of_table(lm.Network(), table, whole, np.arange(2, len(whole), 5))).sum()
    # Words share out their classes; a class that no word has yet keeps its own part.
    empty = set(range(lm.CLASSES)) - set(table.class_of[:-1].tolist())
    assert total <= 1 + 1e-3 and (total > 1 - 1e-3 or empty)


@pytest.mark.parametrize("size", [lm.VOCABULARY, 20])
def test_scores_of_a_table(spark, size):
    rng = random.Random(4)
    words = [f"v{i}" for i in range(60)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(30))) for i in range(80)]
    rows += [rows[0], rows[0], (None, rows[1][1]), (900, None), (901, ""), (902, "  \n"), (903, " ".join(rng.choice(words) for _ in range(60_000))), (904, "neverseen words only")]
    df = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 AS word", "2 AS row", "3 AS n", "4 AS tie").repartition(3)
    got = lm.score(df, size=size).collect()
    assert Counter((r["doc_id"], r["n_tokens"]) for r in got) == Counter((i, len((t or "").split())) for i, t in rows)
    by = {r["doc_id"]: r for r in got}
    assert all(by[i]["mean_log_likelihood"] is None and by[i]["log_likelihood"] == 0 for i in (900, 901, 902))
    assert all(abs(r["mean_log_likelihood"] * r["n_tokens"] - r["log_likelihood"]) < 1e-6 for r in got if r["n_tokens"])
    assert len({r["log_likelihood"] for r in got if r["doc_id"] == 0}) == 1 and all(r["log_likelihood"] < 0 for r in got if r["n_tokens"])
    assert lm.score(df.where("false"), size=size).count() == 0


def test_vocabulary_grows_with_the_corpus(spark):
    docs = [(i, " ".join(f"x{i % 40}y" for _ in range(6))) for i in range(80)]
    few, many = (lm.vocabulary(spark.createDataFrame(docs[:n], DOCS)) for n in (10, 80))
    assert len(few[0]) == 10 and len(many[0]) == 40
    docs += [(1000 + i, f"x{i}y " * 9) for i in range(5)]
    capped = lm.vocabulary(spark.createDataFrame(docs, DOCS), 7)
    assert sorted(capped[0]) == sorted(f"x{i}y".encode() for i in range(5)) and sum(capped[2].values()) + sum(capped[1]) == 525
