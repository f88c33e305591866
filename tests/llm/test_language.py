"""String kernels against plain set arithmetic, the folded model against ridge regression on the kernel itself, and held-out accuracy."""

import random

import numpy as np
import pytest

from pagewright.llm import language

DOCS = "doc_id long, text string, lang string"


def plain_grams(text):
    t = f" {' '.join(text.lower().split())} "
    return {t[i : i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1)}


def texts_of(rng, n):
    alphabets = ["abcdef", "defghi", "ghijkl", "αβγδε"]
    return [" ".join("".join(rng.choice(alphabets[k % 4]) for _ in range(rng.randint(1, 6))) for _ in range(30)) for k in range(n)], np.arange(n) % 4


def test_kernel_is_that_of_sets():
    a, _ = texts_of(random.Random(1), 12)
    x = language.presence([next(language.stretches(t)) for t in a])
    sets = [plain_grams(t) for t in a]
    want = [[len(s & t) / np.sqrt(len(s) * len(t)) for t in sets] for s in sets]
    assert np.allclose(x @ x.T, want, atol=0.05)  # but for n-grams that share a bucket


def test_solution_is_kernel_ridge_regression():
    """With all texts as landmarks, Nyström features are the kernel's own: scores must be those of K (K + c)^-1 y."""
    a, y = texts_of(random.Random(2), 40)
    x = language.presence([next(language.stretches(t)) for t in a]).astype(np.float64)
    root = language.nystroem(x)
    left, right = (sum(z) for z in zip(*(language.equations(x[k : k + 7], y[k : k + 7], x, root, np.ones(4)) for k in range(0, 40, 7)), strict=True))
    model = language.solve(list("abcd"), left, right, x.astype(np.float32), root, 40)
    kernel, target = x @ x.T, np.where(y[:, None] == np.arange(4), 1.0, -1.0)
    want = kernel @ np.linalg.solve(kernel + 1e-3 * 40 * np.eye(40), target)
    assert np.allclose(x @ model.weights, want, atol=1e-3)


def test_long_texts_are_scored_stretch_by_stretch(monkeypatch):
    rng = random.Random(3)
    text = " ".join("".join(rng.choice("abcdef") for _ in range(5)) for _ in range(20_000))
    parts = list(language.stretches(text))
    assert len(parts) == -(-(len(text) + 2) // language.STRETCH) and sum(map(len, parts)) == 3 * (len(text) + 2) - 3
    model = language.Model(["x", "y"], np.random.default_rng(0).normal(size=(language.BUCKETS, 2)).astype(np.float32))
    raw = np.average([language.presence([p])[0] @ model.weights for p in parts], axis=0, weights=[len(p) for p in parts])
    e = np.exp(4 * (raw - raw.max()))
    assert np.allclose(model.scores(["a b", text])[1], e / e.sum())


@pytest.mark.parametrize("n", [3, 260])
def test_every_language_is_learned(spark, n):
    rng = random.Random(4)
    alphabets = ["".join(chr(0x4E00 + 30 * k + j) for j in range(30)) for k in range(n)]
    rows = [(i, " ".join("".join(rng.choice(alphabets[i % n]) for _ in range(4)) for _ in range(25)), f"l{i % n}") for i in range(8 * n + 60)]
    rows += [rows[0], rows[0], (None, rows[1][1], "l1"), (10**6, None, "l0"), (10**6 + 1, "12 3", "l0"), (10**6 + 2, "", None), (10**6 + 3, rows[2][1] * 900, None)]
    df = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 AS number", "2 AS bits", "3 AS held_out", "4 AS share")
    got = language.identify(df).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    held = [by[i]["lang_pred"] == f"l{i % n}" for i in range(8 * n + 60) if by[i]["held_out"]]
    assert np.mean(held) > 0.97 and by[None]["lang_pred"] == "l1" and by[10**6 + 3]["lang_pred"] == f"l{2 % n}"
    assert [by[10**6 + k]["lang_pred"] for k in range(3)] == ["und"] * 3 and sum(r["doc_id"] == 0 for r in got) == 3
    assert all(0 <= r["score"] <= 1 for r in got)
    assert language.identify(df.where("false")).count() == 0
