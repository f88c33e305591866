"""SimHash near-duplicate detection by multi-index hashing.

Each text gets a 64-bit fingerprint. A fingerprint is cut into segments; it is stored once per
segment under the segment's value and looked up under every value in a small Hamming ball around
it. Two fingerprints within ``distance`` bits agree in one segment up to the ball's radius, so
they meet in a table; the complete distance is then verified.

Texts of one fingerprint are one entry of the tables. A table bucket sends out at most a star
over its linked members instead of all its pairs, so a large group of near copies stays linear.

Near copies by similarity of shingle sets (``near_copies``) take these links, and those of MinHash
bands for what lies further apart in bits, as candidates only and compare the sets themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm.common import arrow_map, column, cut, drop, keyed, prepare, small, texts
from pagewright.llm.components import components

BITS = 64
SEED = 42
_BIT_OF_BYTE = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
#: Pairs compared at once in a bucket.
BLOCK = 1 << 20
#: MinHash bands, and values in each. Sets of similarity 0.8 share no band once in 17,000 times, more similar ones less often.
BANDS, BAND = 32, 6
_FACTORS, _TERMS = np.random.default_rng(SEED).integers(0, 2**63, (2, BANDS * BAND, 1), np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
#: Bits of the parity map of a set.
PARITY = 2048
#: Sets, and hashes in them, that one task compares with one another; larger groups are split.
GROUP, GROUP_HASHES = 128, 8_000_000
#: Sets of a split group that go into each of its parts.
PIVOTS = 16
#: Own fingerprints of a bucket that one task compares; larger buckets are split.
OWN = 4096
#: What it costs to send a row to a bucket, in comparisons of two fingerprints.
ROW = 200


def shingle_hashes(text: bytes, shingle: int) -> np.ndarray:
    """Hashes of a text's shingles, as often as they occur.

    A-Z are lower-cased, words end at ASCII white space; a text of fewer words is one shingle, one
    without words has none.
    """
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined, size, digest = b" ".join(words), len(words), xxhash.xxh64_intdigest
    if size <= shingle:
        return np.array([digest(joined, SEED)], np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, size) + 1
    ends = np.cumsum(lengths)
    starts = (ends - lengths)[: size - shingle + 1].tolist()
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts, (ends[shingle - 1 :] - 1).tolist(), strict=True)], np.uint64)


def fingerprint(text: bytes, shingle: int) -> int:
    """Unsigned fingerprint of a text: a bit is set if over half of its shingles' hashes set it; 0 without words."""
    return fingerprint_of(shingle_hashes(text, shingle))


def fingerprint_of(hashes: np.ndarray) -> int:
    if not len(hashes):
        return 0
    at = hashes.view(np.uint8).reshape(-1, 8) + np.arange(8) * 256
    ones = np.bincount(at.ravel(), minlength=2048).reshape(8, 256) @ _BIT_OF_BYTE
    return int.from_bytes(np.packbits(2 * ones > len(hashes), axis=1, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, tie, fp): the fingerprint as a signed long for every row of ``docs`` (doc_id, text)."""

    def make():
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
            for b in batches:
                fps = np.array([fingerprint(t, shingle) for t in texts(b)], np.uint64).view(np.int64)
                yield {"doc_id": column(b, "doc_id"), "tie": column(b, "tie"), "fp": fps}

        return run

    return arrow_map(docs, make, "doc_id long, tie long, fp long")


def labels_of(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least index reachable from each of ``n`` indices over the links (a, b)."""
    lab = np.arange(n)
    while True:
        new = lab.copy()
        least = np.minimum(lab[a], lab[b])
        np.minimum.at(new, lab[a], least)
        np.minimum.at(new, lab[b], least)
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, lab):
            return lab
        lab = new


def bucket_links(own: np.ndarray, fps: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of a bucket: of its own fingerprints (the first ``own``) with all of its members."""
    n, keep = len(fps), (np.empty(0, np.int64), np.empty(0, np.int64))
    step = max(1, BLOCK // n)
    for lo in range(0, own, step):
        hit = np.bitwise_count(fps[lo : min(own, lo + step), None] ^ fps[None, :]) <= distance
        a, b = np.nonzero(hit)
        a += lo
        a, b = a[a < b], b[a < b]
        keep = np.concatenate([keep[0], a]), np.concatenate([keep[1], b])
        if len(keep[0]) > 2 * n:
            lab = labels_of(n, *keep)
            far = np.flatnonzero(lab != np.arange(n))
            keep = far, lab[far]
    return keep


def _link_maker(distance: int):
    """Reads rows sorted by bucket, own fingerprints first; keeps one bucket at a time."""

    def runs(bucket: np.ndarray) -> np.ndarray:
        return np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])

    def of(bucket, own, fps) -> tuple[np.ndarray, np.ndarray]:
        starts = runs(bucket)
        ends = np.r_[starts[1:], len(bucket)]
        owned = np.add.reduceat(own.astype(np.int64), starts)
        us, vs = [], []
        # Buckets with one own fingerprint are compared all at once.
        single = np.repeat(owned == 1, ends - starts)
        first = np.repeat(fps[starts], ends - starts)
        hit = single & (np.bitwise_count(first ^ fps) <= distance) & (first != fps)
        us.append(first[hit])
        vs.append(fps[hit])
        for k in np.flatnonzero((owned > 1) & (ends - starts > 1)):
            part = fps[starts[k] : ends[k]]
            a, b = bucket_links(int(owned[k]), part, distance)
            us.append(part[a])
            vs.append(part[b])
        return np.concatenate(us), np.concatenate(vs)

    def make():
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
            kept: list[tuple] = []
            for b in batches:
                if not b.num_rows:
                    continue
                bucket, own, fps = (column(b, c).to_numpy(zero_copy_only=False) for c in ("bucket", "own", "fp"))
                last = runs(bucket)[-1]
                kept.append((bucket[:last], own[:last], fps[:last].view(np.uint64)))
                if last:
                    rows = [np.concatenate(x) for x in zip(*kept, strict=True)]
                    kept = []
                    u, v = of(*rows)
                    yield {"u": u.view(np.int64), "v": v.view(np.int64)}
                kept.append((bucket[last:], own[last:], fps[last:].view(np.uint64)))
            if kept:
                u, v = of(*[np.concatenate(x) for x in zip(*kept, strict=True)])
                yield {"u": u.view(np.int64), "v": v.view(np.int64)}

        return run

    return make


def segments_for(n: int, distance: int) -> int:
    """How many segments make ``n`` fingerprints cheapest to link, with balls of radius 1 or 2."""

    def cost(k: int) -> float:
        bits, radius = BITS // k, distance // k
        return k * (1 + bits + (bits * (bits - 1) / 2 if radius == 2 else 0)) * (ROW + n / 2**bits)

    return min((k for k in range(1, 9) if distance // k in (1, 2)), key=cost, default=max(1, distance))


def links(distinct: DataFrame, distance: int, segments: int | None = None, own: int = OWN) -> DataFrame:
    """(u, v): links of fingerprints (column fp) at ``distance`` or fewer bits, as stars within buckets.

    A bucket with more than ``own`` fingerprints of its own is split: each part has some of these,
    and all that look them up.
    """
    segments = segments or segments_for(distinct.count(), distance)
    radius = distance // segments
    if radius > 2:
        raise ValueError(f"{segments} segments need balls of radius {radius}; take more segments")
    bounds = [BITS * k // segments for k in range(segments + 1)]

    def make():
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
            for b in batches:
                fps = column(b, "fp").to_numpy().view(np.uint64)
                for k, (lo, hi) in enumerate(zip(bounds, bounds[1:], strict=False)):
                    value = (fps >> np.uint64(lo)) & np.uint64((1 << (hi - lo)) - 1) | np.uint64(k << 56)
                    one = [1 << j for j in range(hi - lo)] if radius else []
                    flips = np.array([0, *one, *(x | y for i, x in enumerate(one) for y in one[:i] if radius == 2)], np.uint64)
                    at = (value[:, None] ^ flips).ravel().view(np.int64)
                    yield {"bucket": at, "own": np.tile(flips == 0, len(fps)), "fp": np.repeat(fps, len(flips)).view(np.int64)}

        return run

    owned = F.explode(F.array(*(F.shiftrightunsigned("fp", lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1)).bitwiseOR(F.lit(k << 56)) for k, (lo, hi) in enumerate(zip(bounds, bounds[1:], strict=False)))))
    large = cut(distinct.select(owned.alias("large")).groupBy("large").count().where(F.col("count") > own).select("large", F.ceil(F.col("count") / own).cast("int").alias("parts")), "large")
    table = arrow_map(distinct.select("fp"), make, "bucket long, own boolean, fp long")
    if not large.isEmpty():
        split = table.join(small(large), F.col("bucket") == F.col("large"), "left")
        own_part = F.array(F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
        part = F.when(F.col("parts").isNull(), F.array(F.lit(0))).when(F.col("own"), own_part).otherwise(F.sequence(F.lit(0), F.col("parts") - 1))
        # A fingerprint of its own bucket is also compared with those of the other parts.
        both = F.when(F.col("own") & F.col("parts").isNotNull(), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(part)
        table = split.select("bucket", "own", "fp", part.alias("home"), F.explode(both).alias("part"))
        table = table.select("bucket", "part", (F.col("own") & F.array_contains("home", F.col("part"))).alias("own"), "fp")
        table = table.withColumn("bucket", F.when(F.col("part") == 0, F.col("bucket")).otherwise(F.xxhash64("bucket", "part"))).drop("part")
    sorted_ = table.repartition("bucket").sortWithinPartitions("bucket", F.desc("own"))
    return arrow_map(sorted_, _link_maker(distance), "u long, v long").distinct()


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, shingle: int = 5, distance: int = 7, segments: int | None = None) -> DataFrame:
    """(doc_id, tie, fp, component_id) for every row: its fingerprint and the smallest id it reaches over links.

    Null texts and texts without words have fingerprint 0, which links like any other. Null ids
    keep their row; a component takes the smallest id that isn't null. Repeated rows stay repeated.
    An empty table gives no rows.
    """
    prepare(df.sparkSession)
    docs = cut(fingerprints(keyed(df, id_col, text_col), shingle), "fingerprints")
    distinct = cut(docs.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = components(links(distinct, distance, segments))
    named = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    smallest = named.groupBy("root").agg(F.min("least").alias("component_id")).withColumnRenamed("root", "root2")
    ids = cut(named.join(smallest, F.col("root") == F.col("root2")).select(F.col("fp").alias("fp2"), "component_id"), "components")
    return docs.join(ids, docs.fp == ids.fp2).select("doc_id", "tie", "fp", "component_id")


def bands_of(shingles: np.ndarray) -> list[int]:
    """A signed key for each MinHash band of a set of hashes."""
    least = np.full(BANDS * BAND, 2**64 - 1, np.uint64)
    for k in range(0, len(shingles), 1024):
        np.minimum(least, (shingles[k : k + 1024] * _FACTORS + _TERMS).min(1), out=least)
    return np.array([xxhash.xxh64_intdigest(x.tobytes(), k) for k, x in enumerate(least.reshape(BANDS, BAND))], np.uint64).view(np.int64).tolist()


def groups_of(sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """A label for each set (distinct hashes): equal for sets that links of ``similarity`` or more connect.

    Similar sets differ in at most (1 - similarity) / (1 + similarity) of the sum of their sizes,
    and their parity maps in no more bits than that; only sets that pass this are compared.
    """
    size, labels = np.array([len(s) for s in sets]), np.arange(len(sets))
    parity = np.stack([np.packbits((np.bincount((s % np.uint64(PARITY)).astype(np.int64), minlength=PARITY) & 1).astype(bool)) for s in sets]).view(np.uint64)
    share = (1 - similarity) / (1 + similarity)
    for i in range(1, len(sets)):
        differ = np.maximum(np.bitwise_count(parity[:i] ^ parity[i]).sum(1, dtype=np.int64), np.abs(size[:i] - size[i]))
        near = np.flatnonzero(differ <= share * (size[:i] + size[i]) + 1e-6)
        while len(near := near[labels[near] != labels[i]]):
            j, near = near[-1], near[:-1]
            both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if both >= similarity * (size[i] + size[j] - both) - 1e-9:
                labels[labels == labels[i]] = labels[j]
    return labels


def _star_maker():
    """Reads rows (bucket, key) sorted by both; links each key to the first of its bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        bucket, first = None, None
        for b in batches:
            if not b.num_rows:
                continue
            buckets, keys = (column(b, c).to_numpy() for c in ("bucket", "key"))
            starts = np.flatnonzero(np.r_[True, buckets[1:] != buckets[:-1]])
            firsts = keys[starts]
            if buckets[0] == bucket:
                firsts[0] = first
            v = np.repeat(firsts, np.diff(np.r_[starts, len(keys)]))
            bucket, first = buckets[-1], firsts[-1]
            yield {"u": keys[keys != v], "v": v[keys != v]}

    return run


def cross_links(sets: list[np.ndarray], labels: list[int], asks: list[bool], similarity: float) -> list[tuple[int, int]]:
    """Links between sets of different labels of which one asks, enough to connect the labels that any link connects."""
    now, out = np.array(labels), []
    for i in np.flatnonzero(asks):
        for j in np.flatnonzero(now != now[i]):
            a, b = sets[i], sets[j]
            if now[i] != now[j] and min(len(a), len(b)) >= similarity * max(len(a), len(b)) - 1e-9:
                both = len(np.intersect1d(a, b, assume_unique=True))
                if both >= similarity * (len(a) + len(b) - both) - 1e-9:
                    out.append((i, j))
                    now[now == now[j]] = now[i]
    return out


def _judge_maker(shingle: int, similarity: float):
    """Rows (root, part, asks, key, label, text) sorted by root and part: links (u, v) of the sets of each part."""

    def make():
        def judged(found: dict[int, tuple]) -> dict:
            keys = np.array(list(found))
            sets, labels, asks = zip(*found.values(), strict=True)
            if labels[0] is None:
                return {"u": keys, "v": keys[groups_of(list(sets), similarity)]}
            pairs = np.array(cross_links(list(sets), labels, asks, similarity), np.int64).reshape(-1, 2)
            return {"u": keys[pairs[:, 0]], "v": keys[pairs[:, 1]]}

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
            now, found = None, {}
            for b in batches:
                columns = (column(b, c).to_pylist() for c in ("root", "part", "key", "label", "asks"))
                for root, part, key, label, asks, text in zip(*columns, texts(b), strict=True):
                    if (root, part) != now and found:
                        yield judged(found)
                        found = {}
                    now = root, part
                    if key not in found:
                        found[key] = np.unique(shingle_hashes(text, shingle)), label, asks
                    elif asks and not found[key][2]:
                        found[key] = (*found[key][:2], True)
            if found:
                yield judged(found)

        return run

    return make


def near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, shingle: int = 5, similarity: float = 0.8, distance: int = 7, segments: int | None = None, group: int = GROUP) -> DataFrame:
    """(doc_id, tie, group) for every row; rows of one group are connected by links of ``similarity`` or more.

    The similarity is Jaccard's of the sets of shingles. Candidates are links of fingerprints at
    ``distance`` or fewer bits and sets that share a MinHash band. What candidates connect is
    compared set by set, each distinct set once: by one task up to ``group`` sets. Larger groups are
    dealt out in parts that share a few pivots, which connect what is similar to them; the sets that
    this leaves apart from the largest cluster are then compared with all of the group, in blocks.
    So no link is lost, and no task holds more than two blocks. Texts without words are one group.
    An empty table gives no rows.
    """
    prepare(df.sparkSession)
    docs = keyed(df, id_col, text_col)

    def make():
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
            for b in batches:
                hashes = [shingle_hashes(t, shingle) for t in texts(b)]
                sets = [np.unique(h) for h in hashes]
                fps = np.array([fingerprint_of(h) for h in hashes], np.uint64).view(np.int64)
                keys = np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)
                yield {"doc_id": column(b, "doc_id"), "tie": column(b, "tie"), "fp": fps, "key": keys, "n": [len(s) for s in sets], "bands": [bands_of(s) for s in sets]}

        return run

    rows = cut(arrow_map(docs, make, "doc_id long, tie long, fp long, key long, n long, bands array<long>"), "sets")
    distinct = cut(rows.groupBy("key").agg(F.first("bands").alias("bands"), F.first("n").alias("n"), F.min(F.struct("doc_id", "tie")).alias("one")), "distinct")
    prints = cut(rows.select("fp", "key").distinct(), "prints")
    least = cut(prints.groupBy("fp").agg(F.min("key").alias("least")), "least")
    at = least.select(F.col("fp").alias("fp2"), F.col("least").alias("u2"))
    same = prints.join(at, F.col("fp") == F.col("fp2")).select(F.col("key").alias("u"), F.col("u2").alias("v"))
    near = links(least, distance, segments).join(at, F.col("u") == F.col("fp2")).select(F.col("u2").alias("first"), "v")
    near = near.join(at, F.col("v") == F.col("fp2")).select(F.col("first").alias("u"), F.col("u2").alias("v"))
    banded = distinct.select(F.explode("bands").alias("bucket"), "key").repartition("bucket").sortWithinPartitions("bucket", "key")
    stars = arrow_map(banded, _star_maker, "u long, v long")
    roots = components(same.unionByName(near).unionByName(stars))
    ones = distinct.join(roots, F.col("key") == F.col("node")).select("root", "key", "n", F.col("one.doc_id").alias("doc_id2"), F.col("one.tie").alias("tie2"))
    ones = cut(ones, "candidates")
    drop(prints, least, roots, distinct)
    parts = F.ceil(F.greatest(F.count("*") / group, F.sum("n") / GROUP_HASHES)).cast("int")
    large = cut(ones.groupBy("root").agg(parts.alias("parts")).where("parts > 1").withColumnRenamed("root", "large"), "large")

    def judge(asked: DataFrame) -> DataFrame:
        """Links among the sets of ``asked`` (root, part, key, doc_id2, tie2, label, asks), part by part."""
        held = docs.join(asked, F.col("doc_id").eqNullSafe(F.col("doc_id2")) & (F.col("tie") == F.col("tie2"))).select("root", "part", "key", "label", "asks", "text")
        return arrow_map(held.repartition("root", "part").sortWithinPartitions("root", "part", "key"), _judge_maker(shingle, similarity), "u long, v long")

    many = ones.join(small(large), F.col("root") == F.col("large"), "left").withColumn("parts", F.coalesce("parts", F.lit(1))).drop("large")
    many = many.withColumns({"part": F.pmod(F.xxhash64("key"), F.col("parts")).cast("int"), "label": F.lit(None).cast("long"), "asks": F.lit(False)})
    pivots = many.where("parts > 1").groupBy("root", F.pmod(F.xxhash64("key", F.lit("pivot")), F.lit(PIVOTS))).agg(F.min(F.struct("key", "doc_id2", "tie2", "parts")).alias("p"))
    pivots = pivots.select("root", "p.*", F.explode(F.sequence(F.lit(0), F.col("p.parts") - 1)).alias("part"), F.lit(None).cast("long").alias("label"), F.lit(False).alias("asks"))
    columns = ["root", "part", "key", "doc_id2", "tie2", "label", "asks"]
    found = cut(judge(many.select(columns).unionByName(pivots.select(columns))), "judged")
    if not large.isEmpty():
        # Sets that their group's largest cluster doesn't hold are compared with all of the group.
        labels = components(found)
        labels = labels.select("node", F.col("root").alias("label"))
        named = many.where("parts > 1").drop("label", "asks").join(labels, F.col("key") == F.col("node"), "left").withColumn("label", F.coalesce("label", "key")).drop("node")
        named = cut(named, "labels")
        first = named.groupBy("root", "label").count().groupBy("root").agg(F.max_by("label", F.struct("count", "label")).alias("main")).withColumnRenamed("root", "r2")
        apart = cut(named.join(first, F.col("root") == F.col("r2")).where(F.col("label") != F.col("main")).drop("r2", "main"), "apart")
        blocks = apart.groupBy("root").agg(parts.alias("blocks")).withColumnRenamed("root", "r3")
        blocks = cut(blocks, "blocks")
        block = F.pmod(F.xxhash64("key", F.lit("block")), F.col("blocks")).cast("int")
        asking = apart.join(small(blocks), F.col("root") == F.col("r3")).withColumn("block", block).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("asks", F.lit(True))
        asked = named.join(small(blocks), F.col("root") == F.col("r3")).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("asks", F.lit(False))
        pairs = asking.unionByName(asked).withColumn("part", F.col("block") * F.col("parts") + F.col("part"))
        found = cut(found.unionByName(judge(pairs.select(columns))), "judged")
        drop(named, apart, blocks)
    # Links within parts are stars already where no group is split.
    groups = components(found).select(F.col("node").alias("key2"), F.col("root").alias("group")) if not large.isEmpty() else found.select(F.col("u").alias("key2"), F.col("v").alias("group"))
    return rows.join(groups, F.col("key") == F.col("key2"), "left").select("doc_id", "tie", F.coalesce("group", "key").alias("group"))
