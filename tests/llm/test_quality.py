"""Host and path posteriors against plain sums, and the classifier on awkward tables."""

import math
import random
from collections import Counter, defaultdict

import pytest

from pagewright.llm import quality

DOCS = "doc_id long, text string, lang string, source string"
LABELS = "doc_id long, quality int, toxic int"


def plain_posteriors(rows):
    """host_, path_ and post_ of each target for rows (host, path, p_quality, p_toxic)."""
    out = [dict() for _ in rows]
    for t, name in enumerate(quality.TARGETS):
        p = [r[2 + t] for r in rows]
        n = len(p)
        mean = min(0.99, max(0.01, sum(p) / n))
        within = max(1e-6, sum(x * x for x in p) / n - mean**2)

        def groups(key, p=p):
            found = defaultdict(list)
            for r, x in zip(rows, p, strict=True):
                found[key(r)].append(x)
            return found

        def strength(found, mean=mean, within=within, n=n):
            b = sum(len(x) * (sum(x) / len(x) - mean) ** 2 for x in found.values())
            between = (b - max(0, len(found) - 1) * within) / max(1.0, n - sum(len(x) ** 2 for x in found.values()) / n)
            return min(1e4, max(5.0, within / max(between, 1e-9)))

        hosts, paths = groups(lambda r: r[0]), groups(lambda r: r[:2])
        k_host, k_path = strength(hosts), strength(paths)
        logit = lambda x: math.log(x / (1 - x))
        for r, x, o in zip(rows, p, out, strict=True):
            h, q = hosts[r[0]], paths[r[:2]]
            host = (sum(h) + k_host * mean) / (len(h) + k_host)
            path = min(0.999, max(0.001, (sum(q) - x + k_path * host) / (len(q) - 1 + k_path)))
            post = 1 / (1 + math.exp(-(logit(x) + logit(path) - logit(mean))))
            o.update({f"host_{name}": host, f"path_{name}": path, f"post_{name}": post})
    return out


@pytest.mark.parametrize("spread", [0.02, 0.4])
def test_posteriors(spark, spread):
    rng = random.Random(5)
    rows = []
    for host in range(12):
        centre = min(0.95, max(0.05, 0.5 + rng.uniform(-spread, spread)))
        for _ in range(rng.choice([1, 2, 30, 80])):
            rows.append((f"h{host}", f"p{rng.randrange(3)}", min(0.999, max(0.001, rng.gauss(centre, 0.1))), min(0.999, max(0.001, rng.gauss(0.1, 0.05)))))
    rows.append(rows[0])
    df = spark.createDataFrame([(i, 0, *r) for i, r in enumerate(rows)], "doc_id long, tie long, host string, path string, p_quality double, p_toxic double").repartition(3)
    got = {r["doc_id"]: r for r in quality.posteriors(df).collect()}
    assert len(got) == len(rows)
    for i, want in enumerate(plain_posteriors(rows)):
        assert all(math.isclose(got[i][k], v, rel_tol=1e-6, abs_tol=1e-9) for k, v in want.items())
    # A site with one page stays nearer to the global mean than its page's own evidence.
    sparse = [r for r in got.values() if sum(x[0] == r["host"] for x in rows) == 1]
    mean = sum(r[2] for r in rows) / len(rows)
    assert all(abs(r["host_quality"] - mean) <= abs(r["p_quality"] - mean) + 1e-9 for r in sparse)


def table(spark):
    rng = random.Random(6)
    good, bad = [f"good{i}" for i in range(40)], [f"bad{i}" for i in range(10)]
    rows = [(i, " ".join(rng.choice(good + (bad if i % 4 == 0 else [])) for _ in range(40)), "en", f"s{i % 6}") for i in range(320)]
    labels = [(i, int(i % 4 != 0), int(i % 4 == 0)) for i in range(320)]
    rows += [(1000, " ".join(rng.choice(good) for _ in range(60_000)), "en", "s1"), (1001, None, None, None), (1002, "", "en", "s1"), (None, rows[1][1], "en", "s1"), rows[2], rows[2], (3, "good1 good2 other", "en", "s2")]
    labels += [(5, 0, 0), (5, 1, 0), (9999, 1, 1), (None, 1, 0), (6, None, 1)]
    names = ("host", "path", "keep", "half", "p_quality", "n", "word", "h", "p")
    return spark.createDataFrame(rows, DOCS).selectExpr("*", *(f"{k} AS {n}" for k, n in enumerate(names))), spark.createDataFrame(labels, LABELS).withColumnRenamed("doc_id", "doc_id"), rows


def test_awkward_tables(spark):
    docs, labels, rows = table(spark)
    got = quality.classify(docs, labels).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(r[0] for r in rows)
    by = defaultdict(list)
    for r in got:
        by[r["doc_id"]].append(r)
    assert all(not by[i][0]["keep"] for i in range(0, 320, 4)) and all(by[i][0]["keep"] for i in range(1, 320, 4))
    assert by[1000][0]["keep"] and len({r["post_quality"] for r in by[2]}) == 1 and len(by[2]) == 3
    assert all(0 < r["post_quality"] < 1 and 0 < r["post_toxic"] < 1 for r in got)
    assert quality.classify(docs.where("false"), labels).count() == 0
    assert quality.classify(docs, labels.where("false")).count() == len(rows)
