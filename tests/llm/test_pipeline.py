"""The stages of the corpus pipeline and run() against plain versions, with nulls, repeated rows and clashing columns."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from pagewright.llm import decontaminate

from test_ops import plain_dedup, plain_groups

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
RNG = random.Random(31)
GOOD = [f"{a}{b}{c}" for a in "bdgklm" for b in "aeiou" for c in "rnst"]
TOXIC = ["vilex", "hatez", "scumq"]


def prose(n, words=GOOD):
    return " ".join(RNG.choice(words) for _ in range(n))


def rows():
    out, labels = [], []
    for i in range(240):
        toxic = i % 6 == 5
        out.append((i, prose(60, GOOD[:40] + TOXIC * 8 if toxic else GOOD), "en", f"site{i % 5}", 1))
        labels.append((i, 0 if toxic else 1, 1 if toxic else 0))
    items = [(k, prose(30)) for k in range(4)]
    shared = prose(60)
    more = [(1000 + k, prose(20) + " " + text + " " + prose(20)) for k, text in items]
    more += [(1100 + k, prose(30) + " " + shared + " " + prose(30)) for k in range(4)]
    more += [(1200, out[0][1]), (1201, out[0][1] + " tail"), (1202, out[7][1].upper())]
    out += [(i, t, "en", "site1", 1) for i, t in more]
    out += [out[8], out[8], (None, out[9][1], None, None, None), (2000, None, "en", "site1", 1), (2001, "", "en", "site1", 1), (2002, prose(30_000), "en", "site2", 1)]
    return out, labels, items


@pytest.fixture(scope="module")
def data(spark, tmp_path_factory):
    docs, labels, items = rows()
    path = f"file://{tmp_path_factory.mktemp('sf')}"
    spark.createDataFrame(docs, DOCS).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, docs, items


def clashing(df):
    names = ("did", "tie", "row", "number", "group", "key", "n", "kept_text", "carried", "label", "part", "host", "path", "keep", "block")
    return df.selectExpr("*", *(f"{k} AS `{n}`" for k, n in enumerate(names)))


def pairs(df):
    return Counter((r["doc_id"], r["text"]) for r in df.collect())


def near(docs):
    """What the near-duplicate stage keeps of rows (id, text)."""
    full = [(i, t, None, None, None) for i, t in docs]
    best = {}
    for r, x in zip(full, plain_groups(full, 0.8), strict=True):
        mark = (-(2**63) if r[0] is None else r[0], r[1] or "")
        best[x] = min(best.get(x, (mark, r)), (mark, r), key=lambda y: y[0])
    return [(r[0], r[1]) for _, r in best.values()]


def without_repeats(docs):
    """The suffix stage on rows (id, text) whose ids differ."""
    seen, out = set(), []
    for i, t in sorted(docs, key=lambda r: -(2**63) if r[0] is None else r[0]):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - 99):
            if b[k : k + 100] in seen:
                gone[k : k + 100] = b"\1" * 100
            seen.add(b[k : k + 100])
        out.append((i, bytes(x for x, g in zip(b, gone, strict=True) if not g).decode("utf-8", "ignore")))
    return out


def clean(docs, items):
    """Rows (id, text) that hold no item by aligning each with the whole text."""
    number = {}
    code = lambda t: [number.setdefault(w, len(number)) for w in decontaminate.words_of((t or "").encode())]
    wanted = [np.array(code(t)) for _, t in items]
    return [(i, t) for i, t in docs if not (b := np.array(code(t), np.int64)).size or all(decontaminate.align(a, b)[0] < 0.5 * len(a) for a in wanted)]


def test_quality_rejects_toxic_rows_and_keeps_clean_ones(spark, data):
    path, docs, _ = data
    got = pairs(corpus_pipeline.quality_classifier(spark, spark.read.parquet(f"{path}/documents.parquet"), path))
    toxic = {(i, t) for i, t, *_ in docs if t and any(w in t for w in TOXIC)}
    kept = Counter((i, t) for i, t, *_ in docs)
    assert not toxic & got.keys() and sum((kept - got).values()) <= len(toxic) + 4
    assert all(got[k] == kept[k] for k in got)
    df = clashing(spark.read.parquet(f"{path}/documents.parquet"))
    more = corpus_pipeline.quality_classifier(spark, df, path)
    assert more.columns == df.columns and pairs(more) == got


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_empty_tables_and_clashing_columns(spark, data, name):
    path, docs, _ = data
    stage = dict(corpus_pipeline.STAGES)[name]
    df = clashing(spark.read.parquet(f"{path}/documents.parquet").where("doc_id IS NULL OR doc_id < 30 OR doc_id > 1000"))
    last = name == "best_fit_packing"
    got = stage(spark, df, path)
    assert last or got.columns == df.columns
    assert got.count() > 0 and stage(spark, df.where("false"), path).count() == 0


def test_near_copies_leave_one(spark, data):
    path, docs, _ = data
    got = pairs(corpus_pipeline.simhash_near_dedup(spark, spark.read.parquet(f"{path}/documents.parquet"), path))
    got = Counter({(i, t or ""): n for (i, t), n in got.items()})
    assert got == Counter((i, t or "") for i, t in near([r[:2] for r in docs]))


def test_suffix_stage_cuts_repeats(spark, data):
    path, docs, _ = data
    docs = list({r[0]: r for r in docs}.values())
    df = spark.createDataFrame(docs, DOCS)
    out = corpus_pipeline.suffix_array_dedup(spark, df, path).collect()
    assert Counter((r["doc_id"], r["text"]) for r in out) == Counter(without_repeats([r[:2] for r in docs]))
    assert all(r["n_chars"] == len(r["text"]) for r in out)
    plain = {k[0]: k for k in plain_dedup(docs, 100)}
    assert all(hashlib.sha256(r["text"].encode()).hexdigest() == plain[r["doc_id"]][4] for r in out)


def test_decontamination_drops_what_holds_an_item(spark, data):
    path, docs, items = data
    got = pairs(corpus_pipeline.benchmark_decontamination(spark, spark.read.parquet(f"{path}/documents.parquet"), path))
    assert got == Counter(clean([r[:2] for r in docs], items))


def test_run(spark, data):
    import public_tokenizers
    from tokenizers import Tokenizer

    path, docs, items = data
    judged = corpus_pipeline.quality_classifier(spark, spark.read.parquet(f"{path}/documents.parquet"), path)
    want = clean(without_repeats(near([(r["doc_id"], r["text"]) for r in judged.select("doc_id", "text").collect()])), items)
    out = corpus_pipeline.run(spark, path).collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    sizes = Counter((i, len(tokenizer.encode(t, add_special_tokens=False).ids) + 1) for i, t in want)
    got, sequences = defaultdict(int), defaultdict(list)
    for r in out:
        got[r["doc_id"]] += r["length"]
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert Counter(got.items()) == sizes
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 2048
    assert len({i for i, _ in want}) == len(want)
