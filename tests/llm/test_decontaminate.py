"""Decontamination end to end against aligning every item with every whole document."""

import random

import numpy as np
import pytest

from pagewright.llm import decontaminate

RNG = random.Random(21)
WORDS = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in "lmnrs"] + ["of", "the", "and"] * 12
DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"


def prose(n):
    return [RNG.choice(WORDS) for _ in range(n)]


def edited(words, share):
    out = []
    for w in words:
        r = RNG.random()
        if r < share:
            out += [[], [RNG.choice(WORDS)], [w, RNG.choice(WORDS)]][RNG.randrange(3)]
        else:
            out.append(w)
    return out


def brute(docs, items, least):
    """(doc, item, score) of every pair whose alignment over the whole document reaches ``least``."""
    number = {}
    rows = [(i, np.array([number.setdefault(w, len(number)) for w in decontaminate.words_of((t or "").encode())])) for i, t in docs]
    for item, text in items:
        a = np.array([number.setdefault(w, len(number)) for w in decontaminate.words_of((text or "").encode())])
        if len(a):
            yield from ((i, item, score) for i, b in rows if len(b) and (score := decontaminate.align(a, b)[0] / len(a)) >= least)


def test_recall_and_precision(spark):
    items = [(k, " ".join(prose(RNG.randint(3, 60)))) for k in range(60)]
    docs = [(i, " ".join(prose(RNG.randint(20, 150)))) for i in range(60)]
    for k, (_, text) in enumerate(items):
        for share in (0.0, 0.1, 0.2):
            docs.append((1000 + 10 * k + int(share * 10), " ".join(prose(25) + edited(text.split(), share) + prose(25))))
    got = {(r["doc_id"], r["item_id"]): r["score"] for r in decontaminate.contaminated(spark.createDataFrame(docs, DOCS).repartition(3), spark.createDataFrame(items, ITEMS)).collect()}
    want = {(i, k): s for i, k, s in brute(docs, items, 0.5)}
    assert set(got) <= set(want) and all(s <= want[p] + 1e-9 for p, s in got.items())
    long = [p for p in want if len(items[p[1]][1].split()) >= 6]
    assert all((1000 + 10 * k, k) in got for k in range(60))  # whole copies, however short
    assert len(got.keys() & long) >= 0.9 * len(long) and len(got.keys() & want.keys()) >= 0.9 * len(want)
    assert np.mean([got[p] >= want[p] - 1e-9 for p in got]) > 0.95


def test_short_items_and_scripts_without_spaces(spark):
    docs = [(0, "x alpha beta y z"), (1, "x alpha gamma y"), (2, "前文今天天气很好我们去公园散步吧后文"), (3, "今天"), (4, "ทดสอบภาษาไทยครับ"), (5, None), (6, ""), (0, "x alpha beta y z"), (None, "alpha beta")]
    items = [(10, "alpha beta"), (11, "gamma"), (12, "今天天气很好，我们去公园散步吧。"), (13, "ภาษาไทย"), (14, None), (15, "..."), (None, "gamma")]
    more = spark.createDataFrame(docs, DOCS).selectExpr("*", "1 AS item_id", "2 AS words", "3 AS score")
    got = [(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(more, spark.createDataFrame(items, ITEMS)).collect()]
    want = [(0, 10), (0, 10), (None, 10), (1, 10), (1, 11), (1, None), (2, 12), (4, 13)]
    assert sorted(map(str, got)) == sorted(map(str, want))


@pytest.mark.parametrize("size", [1, 400])
def test_blocks_of_items(spark, monkeypatch, size):
    items = [(k, " ".join(prose(20))) for k in range(12)]
    docs = [(k, " ".join(prose(10)) + " " + text + " " + " ".join(prose(40_000 if k == 3 else 10))) for k, text in items]
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", size)
    got = decontaminate.contaminated(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got if r["score"] == 1} == {(k, k) for k in range(12)}
    assert all((r["first_word"], r["end_word"]) == (10, 30) for r in got if r["doc_id"] == r["item_id"] and r["score"] == 1)
