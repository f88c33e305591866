"""Each operator against a plain version, with nulls, empty and very long texts, ties, repeated rows and clashing names."""

import gzip
import hashlib
import random
import re
import time
import zlib
from collections import Counter
from functools import cache

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from pagewright.llm import decontaminate, html_text, language, packing, pseudo_likelihood, quality, repetition, simhash, suffix_dedup, warc
from pagewright.llm.components import components

RNG = random.Random(5)
WORDS = ["".join(RNG.choice("abcdefgh") for _ in range(RNG.randint(2, 7))) for _ in range(400)]
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(n):
    return " ".join(RNG.choice(WORDS) for _ in range(n))


@cache
def corpus():
    base = [prose(RNG.randint(5, 120)) for _ in range(30)]
    rows = list(base)
    for t in base[:10]:
        w = t.split()
        w[len(w) // 2] = "edited"
        rows += [t, " ".join(w), t.upper(), prose(8) + " " + t + " " + prose(8)]
    rows += [None, "", " \n ", "the " * 300, "ab" * 900, prose(9000), "é" * 250 + base[0]]
    out = [(i, t, "en", "s", 1) for i, t in enumerate(rows)]
    return [*out, (None, base[1], None, None, None), (None, None, None, None, None), (3, base[3], "en", "s", 1), (3, base[3] + " other", "en", "s", 1)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS).withColumn("tie", F.lit("x")).withColumn("fp", F.lit(1)).withColumn("key", F.lit(2)).repartition(3)


def empty(docs):
    return docs.where("false")


# 7


def plain_fingerprint(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    sh = [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize(("shingle", "distance", "segments"), [(4, 4, 3), (5, 7, 4), (4, 4, 2), (4, 4, None)])
def test_simhash(docs, shingle, distance, segments):
    rows = corpus()
    fps = [plain_fingerprint(r[1], shingle) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= distance:
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    want = Counter((r[0], fps[i], least.get(find(i))) for i, r in enumerate(rows))
    got = Counter((r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in simhash.near_duplicates(docs, shingle=shingle, distance=distance, segments=segments).collect())
    assert got == want
    assert simhash.near_duplicates(empty(docs)).count() == 0


def plain_groups(rows, similarity):
    """Index of the least row that links of ``similarity`` or more connect with each row."""
    sets = []
    for r in rows:
        w = (r[1] or "").lower().split()
        sets.append({" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    lab = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if lab[i] != lab[j] and 10 * both >= 8 * (len(sets[i]) + len(sets[j]) - both):
                lab = [min(lab[i], lab[j]) if x in (lab[i], lab[j]) else x for x in lab]
    return lab


def near_copy_rows():
    """Texts in pairs of five-word similarity from 0.7 to 1, chains of such, nulls and repeated rows."""
    rng, rows = random.Random(3), []
    for k in range(60):
        w = [f"w{rng.randrange(10**6)}" for _ in range(rng.randint(40, 400))]
        rows.append((3 * k, " ".join(w), "en", "s", 1))
        for j in range(1 + k % 2):
            for i in rng.sample(range(len(w)), max(1, len(w) * rng.randint(1, 5) // 200)):
                w[i] = f"v{rng.randrange(10**6)}"
            rows.append((3 * k + 1 + j, " ".join(w), "en", "s", 1))
    return [*rows, (None, rows[0][1], None, None, None), (None, rows[50][1] + " end", None, None, None), (None, None, None, None, None), (900, None, "en", "s", 1), (901, " ", "en", "s", 1), (902, "two words", "en", "s", 1), rows[7], rows[7]]


def test_pipeline_removes_all_near_copies(spark):
    import corpus_pipeline

    rows = near_copy_rows()
    lab, best = plain_groups(rows, 0.8), {}
    for r, x in zip(rows, lab, strict=True):
        mark = (-(2**63) if r[0] is None else r[0], np.uint64(xxhash.xxh64_intdigest((r[1] or "").encode(), 42)).astype(np.int64))
        best[x] = min(best.get(x, (mark, r)), (mark, r), key=lambda y: y[0])
    got = corpus_pipeline.simhash_near_dedup(spark, spark.createDataFrame(rows, DOCS).repartition(3), "").collect()
    assert Counter((r["doc_id"], r["text"] or "") for r in got) == Counter((r[0], r[1] or "") for _, r in best.values())
    assert corpus_pipeline.simhash_near_dedup(spark, spark.createDataFrame([], DOCS), "").count() == 0


@pytest.mark.parametrize("group", [4, 25])
def test_near_copies_of_split_groups(spark, group):
    rng, rows = random.Random(9), near_copy_rows()
    # One large group: chains of edits of one text, and a cluster apart that only shares half of it.
    base = [f"b{i}" for i in range(200)]
    for k in range(60):
        w = list(base) if k % 3 else base[:100] + [f"c{i}" for i in range(100)]
        for i in rng.sample(range(200), 1 + k % 4):
            w[i] = f"e{k}"
        rows.append((2000 + k, " ".join(w), "en", "s", 1))
    lab = plain_groups(rows, 0.8)
    found = simhash.near_copies(spark.createDataFrame(rows, DOCS).repartition(3), group=group).collect()
    mark = {(r["doc_id"], r["tie"]): r["group"] for r in found}
    ties = [np.uint64(xxhash.xxh64_intdigest((r[1] or "").encode(), 42)).astype(np.int64) for r in rows]
    got = [mark[r[0], t] for r, t in zip(rows, ties, strict=True)]
    assert len(found) == len(rows) and len(set(got)) == len(set(lab)) == len(set(zip(got, lab, strict=True)))


def test_links_of_split_buckets(spark):
    rng = np.random.default_rng(4)
    centres = rng.integers(0, 2**63, 5, dtype=np.uint64)
    fps = np.unique(np.concatenate([c ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (60, 4), dtype=np.uint64), 1) for c in centres]))
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4
    want = simhash.labels_of(len(fps), *np.nonzero(near))
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    at = {int(x): i for i, x in enumerate(fps.view(np.int64))}
    for own, segments in ((simhash.OWN, 3), (7, 3), (7, 2), (1, 3)):
        got = simhash.links(df, 4, segments, own).collect()
        a, b = (np.array([at[r[c]] for r in got]) for c in "uv")
        assert near[a, b].all() and np.array_equal(simhash.labels_of(len(fps), a, b), want)


def test_segments_grow_with_the_number_of_fingerprints():
    assert simhash.segments_for(1000, 4) == 3 and simhash.segments_for(10**11, 4) == 2


def test_bucket_links_keep_connectivity():
    rng = np.random.default_rng(0)
    for _ in range(20):
        centre = rng.integers(0, 2**63, dtype=np.uint64)
        fps = np.unique(centre ^ (np.uint64(1) << rng.integers(0, 64, (60, 3), dtype=np.uint64)).sum(1).astype(np.uint64))
        own = len(fps) // 2
        a, b = simhash.bucket_links(own, fps, 4)
        all_ = [(i, j) for i in range(own) for j in range(len(fps)) if i != j and int(fps[i] ^ fps[j]).bit_count() <= 4]
        want = simhash.labels_of(len(fps), *(np.array(x, np.int64) for x in (zip(*all_, strict=True) if all_ else ([], []))))
        assert np.array_equal(simhash.labels_of(len(fps), a, b), want)


def test_components(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(5, 9), (9, 5), (7, 7), (200, 5), (300, 301)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert {got[i] for i in range(100, 161)} == {100} and got[200] == 5 and got[301] == 300 and 7 not in got


# 4


def plain_dedup(rows, length):
    order = sorted({(-(2**63) if r[0] is None else r[0], r[1] or "") for r in rows}, key=lambda r: (r[0], np.uint64(xxhash.xxh64_intdigest(r[1].encode(), 42)).astype(np.int64)))
    seen, out = set(), {}
    for did, text in order:
        b = text.encode()
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            s = b[i : i + length]
            if s in seen:
                gone[i : i + length] = b"\1" * length
            seen.add(s)
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (not i or not gone[i - 1]))
        out[did, text] = len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()
    return Counter((r[0], *out[-(2**63) if r[0] is None else r[0], r[1] or ""]) for r in rows)


def test_suffix_dedup(docs):
    names = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    got = Counter(tuple(r[c] for c in names) for r in suffix_dedup.deduplicate(docs, length=100).collect())
    assert got == plain_dedup(corpus(), 100)
    assert suffix_dedup.deduplicate(empty(docs)).count() == 0


@pytest.mark.parametrize("crowd", [1, 3])
def test_suffix_dedup_of_crowded_minimizers(docs, spark, crowd):
    passage = prose(40)
    more = [(1000 + i, f"{prose(12)} {passage} {prose(12)}", "en", "s", 1) for i in range(40)]
    rows = corpus() + more + more[:5]
    names = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    got = Counter(tuple(r[c] for c in names) for r in suffix_dedup.deduplicate(spark.createDataFrame(rows, DOCS).repartition(3), length=100, crowd=crowd).collect())
    assert got == plain_dedup(rows, 100)


def random_pieces(rng, t):
    base = bytes(rng.integers(97, 99 + t % 3, 400).astype(np.uint8))
    data, start = [], []
    for i in range(int(rng.integers(1, 12))):
        a, n = int(rng.integers(0, 200)), int(rng.integers(1, 65))
        data.append(data[-1] if data and rng.random() < 0.3 else base[a : a + n + 99])
        start.append(1000 * i)
    return np.arange(len(data)) // 2, np.zeros(len(data), np.int64), np.array(start), data


def test_index_marks_what_starts_earlier():
    rng = np.random.default_rng(1)
    for t in range(120):
        did, zero, start, data = random_pieces(rng, t)
        by = rng.permutation(len(data))
        twin = rng.random(len(data)) < 0.3
        (row, at, n), answers = suffix_dedup.marks_of(did[by], zero, start[by], twin[by], [data[i] for i in by], 100)
        got = {(int(by[r]), int(a) + k) for r, a, m in zip(row, at, n, strict=True) for k in range(m)}
        seen, want = set(), set()
        for i, d in enumerate(data):
            for j in range(len(d) - 99):
                if d[j : j + 100] in seen:
                    want.add((i, j))
                seen.add(d[j : j + 100])
        assert got == want
        # Later equals of a twin repeat throughout.
        told = {(data[by[r]], int(a) + k) for r, a, m in zip(*answers, strict=True) for k in range(m)}
        assert told == {(data[i], j) for i in np.flatnonzero(twin) for j in range(len(data[i]) - 99)}


def test_marks_come_from_the_index(monkeypatch):
    did, zero, start, data = random_pieces(np.random.default_rng(2), 1)
    monkeypatch.setattr(suffix_dedup.RunIndex, "stream", lambda self: iter(()))
    marks, answers = suffix_dedup.marks_of(did, zero, start, np.ones(len(data), bool), [data[0]] * len(data), 100)
    assert not len(marks[0]) and not len(answers[0])


def test_matching_statistics():
    rng = np.random.default_rng(3)
    for _ in range(40):
        strings = [bytes(rng.integers(97, 100, int(rng.integers(1, 30))).astype(np.uint8)) for _ in range(int(rng.integers(1, 7)))]
        index = suffix_dedup.RunIndex(strings, 6)
        suffixes = sorted((s[i:], k, i) for k, s in enumerate(strings) for i in range(len(s)))  # ends sort first, then by string
        rank = {(k, i): len(strings) + r for r, (_, k, i) in enumerate(suffixes)}
        seen = set()
        for string, start, row, match, at in index.stream():
            for k, i, r, m, p in zip(string.tolist(), start.tolist(), row.tolist(), match.tolist(), at.tolist(), strict=True):
                seen.add((k, i))
                assert rank[k, i] == r
                before = suffixes[r - len(strings) - 1] if r > len(strings) else None
                if before:
                    a, b = strings[k][i:], before[0]
                    shared = next((j for j, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
                    assert m == min(6, shared) and p == index.starts[before[1]] + before[2]
                else:
                    assert m == 0
        assert len(seen) == sum(map(len, strings))


def test_the_index_grows_with_runs():
    rng = np.random.default_rng(4)
    text = bytes(rng.integers(97, 123, 1500).astype(np.uint8))
    few, many = (suffix_dedup.RunIndex([text] * n, 100) for n in (5, 100))
    assert many.nbytes() < few.nbytes() + 100 * 8 * 8
    string, start = many.repeats(np.arange(100) << 32)
    assert len(string) == 99 * 1401 and not (string == 0).any()


# 3


def test_packing(docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    path, capacity = public_tokenizers.path("word_bpe_49k.json"), 128
    tokenizer = Tokenizer.from_file(path)
    rows = packing.pack(docs.unionByName(docs.select(F.lit(99).cast("long").alias("doc_id"), F.lit("It's <|endoftext|> İ ﬁ x y").alias("text"), *docs.columns[2:]).limit(1)), path, capacity=capacity).collect()
    want = Counter()
    for did, text, *_ in [*corpus(), (99, "It's <|endoftext|> İ ﬁ x y")]:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), capacity):
            part = ids[k : k + capacity]
            want[did, k // capacity, k, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= capacity
    total = sum(r["length"] for r in rows)
    assert len(sequences) <= -(-total // capacity) * 1.02
    assert packing.pack(empty(docs), path).count() == 0


def test_words_get_their_ids_by_parts(monkeypatch):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    plain, encoder = Tokenizer.from_file(path), packing.WordEncoder(path)
    rng = random.Random(8)
    letters = "aabeinstABSTéÉñßÄöøŁłıİſʼn'’.,!?;:-_*#%%`\"()3٣\u0301\u0327ªºµɐʰαΣςжאש日ﬁ🙂\u00ad\u200d"
    words = ["".join(rng.choices(letters, k=rng.randint(1, 9))) for _ in range(4_000)] + ["it's", "IT'S,", "don't'", "<|endoftext|>", "x" * 150, "x" * 150 + ".", "é" * 99 + "."]
    words += ["the,", "The", "the.\"", "thé!", "THÉ"] * 50
    space = lambda: rng.choice([" ", "  ", "\n", "\t ", "\u00a0", "\u2003", "\u3000", "\u2028", "\r\n", "\x85", "\x1c", "\u200b"] if rng.random() < 0.1 else " \n")
    texts = ["".join(x for _ in range(rng.randint(0, 60)) for x in (rng.choice(words), space())) for _ in range(400)]
    texts += ["", " ", "\n\n", " lead", "trail ", "<|endoftext|>", "a <|x", "\ufeffa b", *(f"a{chr(c)}b{chr(c)}{chr(c)}" for c in range(0x3100) if not 0xD800 <= c < 0xE000)]
    calls, encode = [], encoder._encode
    monkeypatch.setattr(encoder, "_encode", lambda given: calls.append(list(given)) or encode(given))
    monkeypatch.setattr(packing, "CACHE", 500)
    monkeypatch.setattr(packing, "PLACED", 37)
    got = []
    for k in range(0, len(texts), 100):
        ids, ends = encoder(pa.array(texts[k : k + 100], pa.string()), 7)
        got += [ids[a:z].tolist() for a, z in zip([0, *ends], ends)]
    assert got == [[*plain.encode(t, add_special_tokens=False).ids, 7] for t in texts]
    assert encoder.parted and not {"the,", "The", "the.\"", "thé!", "THÉ"} & {w for given in calls for w in given}
    encoder.parted = False
    encoder.young, encoder.old = {}, {}
    ids, ends = encoder(pa.array(texts[:400], pa.string()), 7)
    assert [ids[a:z].tolist() for a, z in zip([0, *ends], ends)] == got[:400]
    assert encoder(pa.array([], pa.string()), 7)[0].tolist() == []


def test_plan_uses_every_piece_once():
    rng = np.random.default_rng(2)
    for t in range(20):
        counts = {int(k): int(rng.integers(1, 2000)) for k in rng.integers(1, 200 if t % 2 else 50, 40)}
        planned = packing.plan(counts, 200)
        used = Counter()
        for pattern, times in planned:
            assert sum(pattern) <= 200 and times > 0
            for x in pattern:
                used[x] += times
        assert used == Counter(counts)
        slots = packing.Slots(planned, 200)
        length = np.repeat(list(counts), list(counts.values()))
        rank = np.concatenate([np.arange(n) for n in counts.values()])
        sequence, offset = slots(length, rank)
        cells = np.sort(sequence * 1000 + offset)
        assert len(np.unique(cells)) == len(cells)


# 2


def plain_alignment(a, b):
    h = np.zeros((len(a) + 1, len(b) + 1))
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (1 if a[i - 1] == b[j - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
    return h.max()


def test_alignment():
    rng = np.random.default_rng(4)
    for _ in range(60):
        a, b = rng.integers(0, 4, rng.integers(1, 15)), rng.integers(0, 4, rng.integers(1, 25))
        score, lo, hi = decontaminate.align(a, b)
        assert score == plain_alignment(a, b)
        if score:
            assert plain_alignment(a, b[lo:hi]) == score


def test_decontamination(spark, docs):
    items = [prose(30) for _ in range(5)]
    edited = items[1].split()
    edited[7], edited[19] = "other", "words"
    del edited[12]
    planted = [(1000, prose(50) + " " + items[0].upper().replace(" ", ", ") + " " + prose(50)), (1001, prose(20) + " " + " ".join(edited)), (1002, items[2]), (1003, prose(40)), (1004, " ".join(items[3].split()[:6]) + prose(40))]
    more = spark.createDataFrame([(i, t, None, None, None) for i, t in planted], DOCS)
    bench = spark.createDataFrame([*enumerate(items), (7, None), (8, ""), (None, prose(4))], "item_id long, text string")
    got = decontaminate.contaminated(docs.select("doc_id", "text").unionByName(more.select("doc_id", "text")), bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got if r["item_id"] is not None} == {(1000, 0), (1001, 1), (1002, 2)}
    assert {r["doc_id"]: round(r["score"], 2) for r in got}[1000] == 1.0
    assert decontaminate.contaminated(docs, bench.where("false")).count() == 0
    assert decontaminate.contaminated(empty(docs), bench).count() == 0


# 5


def test_quality(spark):
    rows, labels = [], []
    for i in range(600):
        bad, rude = i % 5 == 0, i % 7 == 0
        text = " | ".join(prose(40).split()) if bad else prose(60)
        rows.append((i, text + (" vile" if rude else ""), None if i % 11 == 0 else "en", f"h{i % 3}", 1))
        labels.append((i, int(not bad), int(rude)))
    rows += [(None, None, None, None, None), (5, "", "x", "sparse", 1)]
    docs = spark.createDataFrame(rows, DOCS)
    known = spark.createDataFrame([x for x in labels if x[0] % 2] + [(5, None, 1)], "doc_id long, quality int, toxic int")
    got = quality.classify(docs, known).collect()
    assert len(got) == len(rows)
    truth = {i: q and not t for i, q, t in labels}
    right = [r["keep"] == truth[r["doc_id"]] for r in got if r["doc_id"] is not None and r["host"] != "sparse"]
    assert np.mean(right) > 0.97
    sparse = next(r for r in got if r["host"] == "sparse")
    overall = np.mean([r["p_quality"] for r in got])
    assert abs(sparse["path_quality"] - overall) < 0.2  # no other evidence: near the global prior
    assert quality.classify(docs.where("false"), known).count() == 0
    assert quality.classify(docs, known.where("false")).count() == len(rows)


# 6


@pytest.mark.parametrize("broadcast", [warc.SMALL, 0])
def test_warc(spark, tmp_path, broadcast):
    long = "x" * 100
    pages = [(4, "http://a b/\n", long), (2, None, long), (9, "u", long), (5, "u", "short"), (6, "u", "short"), (7, "u", None), (8, "u", "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n" * 4 + "é"), (None, "u", long), (2, None, long)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("digest", F.lit(1))
    path = f"file://{tmp_path}/a"
    warc.write_archives(df, path, broadcast=broadcast)
    rows = warc.read_archives(spark, path).collect()
    assert all(r["kind"] == "record" for r in rows) and len(rows) == len(pages)
    got = Counter((int(r["headers"]["x-page-id"]) if "x-page-id" in r["headers"] else None, r["headers"]["warc-type"], r["headers"].get("x-refers-to-page-id")) for r in rows)
    assert got == Counter({(2, "response", None): 2, (4, "revisit", "2"): 1, (9, "revisit", "2"): 1, (None, "revisit", "2"): 1, (5, "response", None): 1, (6, "response", None): 1, (7, "response", None): 1, (8, "response", None): 1})
    assert next(bytes(r["payload"]) for r in rows if r["headers"].get("x-page-id") == "8").decode() == pages[6][2]


def test_members_end_with_zero():
    big = b"x" * (1 << 24)
    for data in (b"", b"abc", big):
        m = warc.member(data)
        assert m.endswith(b"\0") and gzip.decompress(m) == data
    got = warc.salvage(warc.member(record_of(1, big)) + warc.member(record_of(2, b"b")))
    assert [r.headers["x-id"] for r in got.records] == ["1", "2"] and not got.gaps


def record_of(i, payload):
    digest = hashlib.sha256(payload).hexdigest()
    return f"WARC/1.1\r\nWARC-Type: resource\r\nX-Id: {i}\r\nWARC-Block-Digest: sha256:{digest}\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + payload + b"\r\n\r\n"


@pytest.mark.parametrize("pack", [lambda x: x, gzip.compress])
def test_salvage(pack):
    rng = random.Random(1)
    parts = [pack(record_of(i, rng.randbytes(200) + b"WARC/1.1\r\n" + rng.randbytes(30))) for i in range(6)]
    whole = b"".join(parts)
    clean = warc.salvage(whole)
    assert [r.headers["x-id"] for r in clean.records] == list("012345") and not clean.gaps
    at = len(parts[0]) + len(parts[1]) // 2
    for broken in (whole[:at] + bytes([whole[at] ^ 255]) + whole[at + 1 :], whole[:at] + whole[at + 9 :], b"junk" + whole[:at] + whole[len(parts[0]) + len(parts[1]) :] + b"tail"):
        got = warc.salvage(broken)
        assert [r.headers["x-id"] for r in got.records] == list("02345")
        spans = sorted([(r.offset, r.length) for r in got.records] + [(g.offset, g.length) for g in got.gaps])
        end = 0
        for offset, length in spans:
            assert offset == end
            end += length
        assert end == len(broken) and got.gaps
    assert warc.salvage(whole[: len(whole) - 20]).gaps and not warc.salvage(b"").gaps


def test_reader_takes_time_in_proportion_and_logs_gaps(spark, tmp_path):
    rng = random.Random(3)
    members = [gzip.compress(record_of(i, rng.randbytes(800))) for i in range(300)]
    took = []
    for times in (10, 40):
        began = time.process_time()
        assert len(warc.salvage(b"".join(members) * times).records) == 300 * times
        took.append(time.process_time() - began)
    assert took[1] < 8 * took[0]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(members[:5]) + b"junk" + members[5][:-9] + members[6])
    (tmp_path / "b.warc").write_bytes(b"".join(record_of(i, b"y" * (1 << 20)) for i in range(12)) + b"tail")
    (tmp_path / "c.warc").write_bytes(b"")
    got = warc.read_archives(spark, f"file://{tmp_path}/*").collect()
    kinds = Counter((r["path"].rsplit("/", 1)[1], r["kind"]) for r in got)
    assert kinds == {("a.warc.gz", "record"): 6, ("a.warc.gz", "gap"): 1, ("b.warc", "record"): 12, ("b.warc", "gap"): 1}
    assert next(r for r in got if r["kind"] == "gap" and r["path"].endswith("a.warc.gz"))["length"] == 4 + len(members[5]) - 9


def test_salvage_of_members_with_many_records():
    rng = random.Random(2)
    parts = [record_of(i, rng.randbytes(4000) + bytes(range(256)) * 40) for i in range(40)]
    ids = [str(i) for i in range(40)]
    damaged = b"".join(parts[:7]) + parts[7][:-50] + b"?" + parts[7][-49:] + b"".join(parts[8:])
    got = warc.salvage(gzip.compress(damaged) + gzip.compress(record_of(40, b"x")))
    assert [r.headers["x-id"] for r in got.records] == [*ids[:7], *ids[8:], "40"] and len(got.gaps) == 1
    whole = gzip.compress(b"".join(parts))
    cut = whole[: len(whole) * 3 // 4]
    plain = zlib.decompressobj(31).decompress(cut)
    want = [r.headers["x-id"] for r in warc.salvage_plain(plain) if isinstance(r, warc.Record)]
    got = warc.salvage(cut)
    assert [r.headers["x-id"] for r in got.records] == want and len(want) > 25 and got.gaps[0].reason == "member does not end"
    got = warc.salvage(whole[:-8] + bytes([whole[-8] ^ 1]) + whole[-7:] + gzip.compress(record_of(40, b"x")))
    assert [r.headers["x-id"] for r in got.records] == [*ids, "40"] and "member fails" in got.gaps[0].reason
    # A block of no type that deflate knows, behind 20 records.
    deflate = zlib.compressobj(wbits=31)
    got = warc.salvage(deflate.compress(b"".join(parts[:20])) + deflate.flush(zlib.Z_FULL_FLUSH) + b"\x07" + whole[100:] + gzip.compress(record_of(40, b"x")))
    assert [r.headers["x-id"] for r in got.records] == [*ids[:20], "40"] and got.gaps


# 1


def page(body):
    return f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style></head><body>{body}</body></html>"


def test_html(spark):
    article = "<article><h1>Head &amp; line</h1><p>One <b>bold</b> word<p>Two<br>lines &lt;x&gt;<aside>side</aside><div class='share-links'>share</div><ul><li>a<li>b</ul><section id=comments><p>reader</p></section></article>"
    rows = [
        (1, "http://h/1", page("<nav>menu</nav><header>top</header>" + article + "<footer>&copy;</footer><script>var a = '</p>';</script>")),
        (2, "http://h/2", page("<div>Plain &nbsp; body</div><form>f</form><p hidden>no</p>")),
        (3, None, None), (4, "::bad", ""), (5, "http://h/5", "no markup < at all"), (None, "http://h/6", "<p>" + "word " * 50_000),
    ]
    rows += [(100 + i, "http://site/x", page(f"<div>Welcome to the site</div><p>Story {i} of its own</p>")) for i in range(12)]
    rows += [(200 + i, "http://copies/x", page("<p>Same story</p>")) for i in range(12)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(1))
    got = {r["page_id"]: r for r in html_text.main_text(df).collect()}
    assert got[1]["text"] == "Head & line\nOne bold word\nTwo lines <x>\na\nb"
    assert got[2]["text"] == "Plain body" and got[3]["text"] == "" and got[4]["n_chars"] == 0
    assert got[5]["text"] == "no markup < at all" and got[None]["n_chars"] == 5 * 50_000 - 1
    assert got[105]["text"] == "Story 5 of its own" and got[205]["text"] == "Same story"
    assert html_text.main_text(df.where("false")).count() == 0


# 8


def test_language(spark):
    alphabets = {"aa": "abcde", "bb": "cdefg", "cc": "αβγδε"}
    rows = []
    for i in range(360):
        lang = list(alphabets)[i % 3]
        rows.append((i, " ".join("".join(RNG.choice(alphabets[lang]) for _ in range(RNG.randint(2, 6))) for _ in range(40)), lang if i % 10 else None, "s", 1))
    rows += [(1000, None, "aa", "s", 1), (1001, "123 !?", "aa", "s", 1), (None, "abc de", None, None, None), (1002, "", None, None, None)]
    docs = spark.createDataFrame(rows, DOCS)
    got = {r["doc_id"]: r for r in language.identify(docs).collect()}
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i in range(360))
    held = [got[i]["lang_pred"] == list(alphabets)[i % 3] for i in range(360) if got[i]["held_out"]]
    assert np.mean(held) > 0.97
    assert [got[i]["lang_pred"] for i in (1000, 1001, 1002)] == ["und"] * 3 and got[None]["lang_pred"] == "aa"
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert {r["lang_pred"] for r in language.identify(docs.where("lang is null")).collect()} == {"und"}


# 9


def test_pseudo_likelihood(spark, docs):
    lines = ["the cat sat on the mat", "a dog ran to the park", "we saw the red boat go"]
    rows = [(i, " ".join(RNG.choice(lines) for _ in range(40))) for i in range(300)] + [(900, None), (901, ""), (None, "the cat")]
    shuffled = lines[0].split() * 40
    RNG.shuffle(shuffled)
    df = spark.createDataFrame([*rows, (902, " ".join(shuffled)), (903, " ".join(lines[:1] * 40))], "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r for r in pseudo_likelihood.score(df).collect()}
    assert got[903]["mean_log_likelihood"] > got[902]["mean_log_likelihood"] + 0.2
    assert got[900]["n_tokens"] == 0 and got[900]["log_likelihood"] == 0 and got[901]["mean_log_likelihood"] is None
    assert got[903]["n_tokens"] == 240 and abs(got[903]["log_likelihood"] / 240 - got[903]["mean_log_likelihood"]) < 1e-9
    assert pseudo_likelihood.score(df.where("false")).count() == 0


def test_rare_words_have_scores_of_their_own(spark):
    rng = random.Random(4)
    plain = [f"{a}{b}ing" for a in "bcdfghjklmnp" for b in "aeiou" for _ in range(1)] + [f"{a}{b}{c}ed" for a in "bcdfg" for b in "aeiou" for c in "lmnrs"]
    # The word before says which of two words with one ending comes next.
    rows = [(i, " ".join(rng.choice(["red xxstone", "blue yystone"]) if rng.random() < 0.4 else rng.choice(plain) for _ in range(60))) for i in range(300)]
    other = "qqzzstone"  # of the same ending, in no other document
    tests = [(1000, "red xxstone " * 20), (1001, "red yystone " * 20), (1002, f"red {other} " * 20)]
    df = spark.createDataFrame([*rows, *[(i, t.strip()) for i, t in tests]], "doc_id long, text string").repartition(2)
    got = {r["doc_id"]: r["mean_log_likelihood"] for r in pseudo_likelihood.score(df).collect()}
    assert got[1000] > got[1001] + 0.1 and got[1000] > got[1002] + 0.1
    words = [b"w%d" % i for i in range(5000)]
    table = pseudo_likelihood.Tokens(words, list(range(5000, 0, -1)), {})
    assert len({table[w] for w in words}) == 5000 and table[b"unseen"] not in {table[w] for w in words}


def test_gradient():
    rng = np.random.default_rng(0)
    classes = rng.integers(0, pseudo_likelihood.CLASSES, 120)
    classes[[0, 1, 40, 41, 118, 119]] = pseudo_likelihood.CLASSES
    at = np.flatnonzero(classes < pseudo_likelihood.CLASSES)
    net = pseudo_likelihood.Network()
    gradient = net.gradient(classes, 2, 118)
    before = net.log_probabilities(classes, at).mean()
    used = np.flatnonzero(gradient)
    for k in [*rng.integers(0, len(net.weights), 40), *rng.choice(used, 60)]:
        other = pseudo_likelihood.Network(net.weights)
        other.weights[k] += 1e-2
        slope = -(other.log_probabilities(classes, at).mean() - before) / 1e-2
        assert abs(slope - gradient[k]) < 2e-3


# 10


def test_repetition(docs):
    got = repetition.rules(docs).collect()
    want = Counter()
    for did, text, *_ in corpus():
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        seen = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        again = {i + k for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for k in range(3)}
        lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want[did, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(again), len(w) < 50 or 100 * len(again) > 50 * len(w)] += 1
    names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert Counter(tuple(r[c] for c in names) for r in got) == want
    assert repetition.rules(empty(docs)).count() == 0


@pytest.mark.parametrize("chunk", [repetition.CHUNK, 3])
def test_longest_repeats(monkeypatch, chunk):
    monkeypatch.setattr(repetition, "CHUNK", chunk)
    rng = np.random.default_rng(0)
    for t in range(80):
        s = rng.integers(0, 1 + t % 4, rng.integers(1, 40)).tolist()
        n = len(s)
        want = [max((next((k for k in range(n) if i + k >= n or j + k >= n or s[i + k] != s[j + k]), n) for j in range(n) if j != i), default=0) for i in range(n)]
        assert repetition.longest_repeats(np.array(s)).tolist() == want


def plain_verdict(text):
    """base_failed, kept, share and characters of repeats of four words or more, by comparing all pairs of words."""
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(w)
    seen = Counter(tuple(w[i : i + 3]) for i in range(n - 2))
    again = {i + k for i in range(n - 2) if seen[tuple(w[i : i + 3])] > 1 for k in range(3)}
    failed = n < 50 or 100 * len(again) > 50 * n
    covered, longest = set(), 0
    for i in range(n):
        r = max((next((k for k in range(n) if max(i, j) + k >= n or w[i + k] != w[j + k]), n) for j in range(n) if j != i), default=0)
        if r >= repetition.LEAST_WORDS:
            covered |= set(range(i, i + r))
            longest = max(longest, sum(map(len, w[i : i + r])))
    share = sum(len(w[i]) for i in covered) / max(1, sum(map(len, w)))
    return failed, not failed and share <= repetition.MOST_COVERED and longest <= repetition.LONGEST, share, longest


def test_kept_against_all_pairs(spark):
    a, b = prose(30), prose(12)
    long = prose(170)
    texts = [prose(90), prose(60) + " " + a + " " + prose(9) + " " + a, (b + " ") * 9, prose(49), prose(50), long + " " + prose(200) + " " + long, None, "", "x " * 60, prose(40) + " " + b + "\n" + b + " " + prose(40)]
    # Ties at the limits: exactly 40 hundredths of the characters in repeats, exactly as long as allowed, and one more.
    tie = " ".join(f"r{i:03d}" for i in range(20))
    texts += [tie + " " + " ".join(f"u{i:03d}" for i in range(60)) + " " + tie, tie + " " + " ".join(f"u{i:03d}" for i in range(59)) + " " + tie]
    rows = [(i, t) for i, t in enumerate(texts)] + [(0, texts[0]), (None, texts[1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS kept", "2 AS n_words")
    got = Counter((r["doc_id"], r["base_failed"], r["kept"], round(r["repeat_covered"], 9), r["longest_repeat"]) for r in repetition.rules(df, longest=repetition.LONGEST).collect())
    assert got == Counter((i, f, k, round(c, 9), m) for i, t in rows for f, k, c, m in (plain_verdict(t),))


def test_long_texts_take_bounded_memory():
    import tracemalloc

    words = [f"w{i % 5000}".encode() for i in range(repetition.CHUNK + 1000)]
    tracemalloc.start()
    got = repetition.measure([b" ".join(words)])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got["repeat_covered"] == [1.0] and peak < 800 * len(words)


def test_verdict_on_repeats():
    clean, again = prose(200), prose(80)
    got = repetition.measure([clean.encode(), (prose(60) + " " + again + " " + prose(10) + " " + again).encode()])
    assert got["repeat_covered"][0] < 0.05
    assert got["repeat_covered"][1] > 0.6 and got["longest_repeat"][1] == len(again.replace(" ", ""))
