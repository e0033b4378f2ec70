"""SimHash near-duplicate detection by multi-index hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.llm.names import fresh_names
from kinfold.operators.graph import connected_components
from kinfold.runtime import materialise

BITS = 64
#: Groups up to this size compare by shifted arrays; larger ones by a search that emits a spanning forest.
SMALL_GROUP = 32
#: More distinct fingerprints than this: two segments instead of three, so that buckets stay small.
THREE_SEGMENTS_UP_TO = 1 << 27


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """XXH64 (seed 42) of each word shingle in text order, repeats included; a text of at most width words is one shingle, one of no words has none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([digest(joined, 42)], np.uint64)
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    n = len(words) - width + 1
    a, b = (end - size)[:n].tolist(), end[width - 1 :].tolist()
    return np.fromiter((digest(joined[i:j], 42) for i, j in zip(a, b)), np.uint64, n)


def majority(hashes: np.ndarray) -> int:
    """The SimHash of shingle hashes: a bit is 1 if it is in over half of them; of none 0."""
    total = np.zeros(BITS, np.int64)
    for k in range(0, len(hashes), 1 << 14):
        planes = np.unpackbits(hashes[k : k + (1 << 14)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        total += planes.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(total * 2 > len(hashes)).tobytes(), "big")


def fingerprint(text: str | None, width: int = 4) -> int:
    """64-bit SimHash of a text's word shingles; no words: 0."""
    return majority(shingle_hashes(text, width))


def _fingerprints(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t.as_py(), width) for t in b.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], ["id", "fp"])

    return run


def _keyed(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t.as_py(), width) for t in b.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(fp.view(np.int64))], ["id", "key", "fp"])

    return run


def segments(count: int, distance: int) -> list[tuple[int, int, int]]:
    """(first bit, bits, radius) of count segments, such that two fingerprints within the distance differ by
    at most the radius in one segment at least: with distance = k * count + a, the first a + 1 have radius k, the others k - 1."""
    k, a = divmod(distance, count)
    cuts = [round(i * BITS / count) for i in range(count + 1)]
    return [(lo, hi - lo, k if i <= a else k - 1) for i, (lo, hi) in enumerate(zip(cuts, cuts[1:])) if (k if i <= a else k - 1) >= 0]


def _masks(bits: int, radius: int) -> np.ndarray:
    """Masks of at most radius bits within so many bits, the empty one first."""
    masks, last = [0], [(0, 0)]
    for _ in range(radius):
        last = [(m | 1 << j, j + 1) for m, i in last for j in range(i, bits)]
        masks += [m for m, _ in last]
    return np.array(masks, np.uint64)


def _probes(parts: list[tuple[int, int, int]]):
    """(key, fp, probe): the index row of each segment's own value, and a probe for each other value of its ball.

    Of two values within the ball of each other one probe is enough: that of the one without the highest differing bit.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), 4096):
                fp = whole.column(0).slice(at, 4096).to_numpy().view(np.uint64)
                for i, (lo, bits, radius) in enumerate(parts):
                    value = (fp >> np.uint64(lo)) & np.uint64((1 << bits) - 1)
                    for masks in np.array_split(_masks(bits, radius), max(1, (bits**radius) // 64)):
                        top = np.array([1 << (int(m).bit_length() - 1) if m else 0 for m in masks], np.uint64)
                        row, col = np.nonzero((value[:, None] & top[None, :]) == 0)
                        key = (value[row] ^ masks[col]) | np.uint64(i << 40)
                        yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(fp[row].view(np.int64)), pa.array((masks[col] > 0).astype(np.int8))], ["key", "fp", "probe"])

    return run


def local_links(fp: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links within one bucket. Points near the bitwise majority come first, so that a
    dense group empties the unvisited list in a few scans and no pair list of the group arises."""
    planes = np.unpackbits(fp.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    middle = int.from_bytes(np.packbits(planes.sum(axis=0, dtype=np.int64) * 2 > len(fp)).tobytes(), "big")
    left = fp[np.argsort(np.bitwise_count(fp ^ np.uint64(middle)), kind="stable")]
    a, b = [], []
    while len(left):
        root, left = left[0], left[1:]
        queue = [root]
        while queue and len(left):
            x = queue.pop()
            near = np.bitwise_count(left ^ x) <= distance
            found = left[near]
            if len(found):
                a.append(np.full(len(found), x))
                b.append(found)
                queue.extend(found[::-1])
                left = left[~near]
    none = np.zeros(0, np.uint64)
    return (np.concatenate(a), np.concatenate(b)) if a else (none, none)


def bucket_links(key: np.ndarray, fp: np.ndarray, probe: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links among fingerprints with equal keys, all of index rows with index rows and probes in small groups, a spanning forest in large ones; key is sorted."""
    start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    size = np.diff(np.r_[start, len(key)])
    of = np.repeat(size, size)
    a, b = [], []
    small = of <= SMALL_GROUP
    k, f, p = key[small], fp[small], probe[small]
    for d in range(1, int(of[small].max()) if small.any() else 0):
        i = np.flatnonzero((k[:-d] == k[d:]) & ((p[:-d] & p[d:]) == 0))
        i = i[np.bitwise_count(f[i] ^ f[i + d]) <= distance]
        a.append(f[i])
        b.append(f[i + d])
    for s, n in zip(start[size > SMALL_GROUP], size[size > SMALL_GROUP]):
        if not probe[s : s + n].all():
            x, y = local_links(fp[s : s + n], distance)
            a.append(x)
            b.append(y)
    none = [np.zeros(0, np.uint64)]
    return np.concatenate(a + none), np.concatenate(b + none)


def _link(distance: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = [[], [], []]
        count = 0

        def out(k, f, p):
            a, b = bucket_links(k, f.view(np.uint64), p, distance)
            ends = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1) if len(a) else np.zeros((2, 0), np.uint64)
            return pa.RecordBatch.from_arrays([pa.array(ends[0].view(np.int64)), pa.array(ends[1].view(np.int64))], ["a", "b"])

        for batch in batches:
            if not len(batch):
                continue
            for h, c in zip(held, batch.columns):
                h.append(c.to_numpy())
            count += len(batch)
            if count >= 1 << 17 and held[0][-1][-1] != held[0][0][0]:
                cols = [np.concatenate(h) for h in held]
                cut = int(np.searchsorted(cols[0], cols[0][-1]))
                yield out(*(c[:cut] for c in cols))
                held, count = [[c[cut:]] for c in cols], len(cols[0]) - cut
        if count:
            yield out(*(np.concatenate(h) for h in held))

    return run


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4) -> DataFrame:
    """(id, fp) for every row, repeated rows included; null and empty texts have fingerprint 0."""
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(_fingerprints(width), f"id {kind}, fp long")


def links(distinct: DataFrame, distance: int = 4, count: int | None = None) -> DataFrame:
    """Edges (a, b) of fingerprints within the distance, whose connected components are those of all such pairs.

    Multi-index hashing: a fingerprint has an index row under each segment's own value and probes for the other values of a small
    Hamming ball around it; those that meet under a key are compared in full. A key's rows are distinct fingerprints, eight bytes each,
    and the links of a large group leave as a spanning forest, never as all pairs.
    """
    n = distinct.count()
    parts = segments(count or (3 if n <= THREE_SEGMENTS_UP_TO else 2), distance)
    rows = distinct.select("fp").mapInArrow(_probes(parts), "key long, fp long, probe byte")
    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(_link(distance), "a long, b long").where("a <> b")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = 4, width: int = 4) -> DataFrame:
    """One row per document: id, fingerprint (16 hex digits), component_id (the smallest id reachable by links).

    Null or empty texts have fingerprint zero and link like any other. Repeated rows stay repeated. Rows with a null id
    keep it and get their component's smallest id (null if it has none). Other columns of docs are ignored. An empty table gives no rows.
    """
    fps = materialise(fingerprints(docs, id_col, text_col, width))
    distinct = materialise(fps.groupBy("fp").agg(F.min("id").alias("least")))
    roots = connected_components(links(distinct, distance))
    rooted = distinct.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    whole = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of = rooted.select("fp", "root").join(whole, "root").select("fp", "component_id")
    shown = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return fps.join(of, "fp").select(F.col("id").alias(id_col), shown.alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = 4, width: int = 4) -> DataFrame:
    """The rows of docs, all columns, one of each component: that of the smallest id (then of the smallest hash of the text).

    Rows are told apart by id and text, so repeated ids with other texts are not lost; a component whose ids are all null keeps one row.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    own = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("key", F.xxhash64("text"))
    fps = materialise(own.mapInArrow(_keyed(width), f"id {kind}, key long, fp long"))
    distinct = materialise(fps.select("fp").distinct())
    roots = connected_components(links(distinct, distance)).select(F.col("node").alias("fp"), "root")
    one = fps.groupBy("fp").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key")).alias("least"))
    kept = one.join(roots, "fp", "left").groupBy(F.coalesce("root", "fp").alias("root")).agg(F.min("least").alias("least"))
    i, k, own = fresh_names(docs.columns, "kept_id", "kept_key", "key")
    kept = kept.select(F.col("least.id").alias(i), F.col("least.key").alias(k))
    named = docs.withColumn(own, F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    stay = named.join(kept, named[id_col].eqNullSafe(F.col(i)) & (F.col(own) == F.col(k)), "left_semi")
    return stay.dropDuplicates([id_col, own]).drop(own)
