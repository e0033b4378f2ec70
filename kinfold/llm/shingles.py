"""Near-duplicate documents by the Jaccard similarity of their word shingles.

SimHash with multi-index hashing links most copies; prefix filtering finds every pair that its radius misses. Each pair is verified in full.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.llm import simhash
from kinfold.llm.memory import driver_gives_back, given_back
from kinfold.llm.names import fresh_names
from kinfold.operators.graph import connected_components
from kinfold.runtime import discard, materialise

#: Words of a shingle.
WIDTH = 5
#: Shingles in more than this share of a sample of texts come last in the order of shingles. Any order finds all pairs; this one keeps groups small.
COMMON = 0.0002
#: Bits of a set's first bitmap: the power of two over its number of shingles, from the first to the second of these; a bitmap too small for its set only
#: lets more pairs through. The second bitmap has 8 to 16 for each shingle.
MAP = (1 << 10, 1 << 13)


def grams(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct hashes of the word shingles."""
    return np.unique(simhash.shingle_hashes(text, width))


def set_id(own: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(own.tobytes(), 42)


def alike(o, x, y):
    """Whether an overlap of o of x and y shingles is a Jaccard similarity of 0.8 or more, in whole numbers."""
    return 9 * o >= 4 * (x + y)


def prefix(own: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The first shingles in the order (common, hash), so many that two sets with similarity 0.8 share one of them."""
    late = np.isin(own, common, assume_unique=True)
    return np.concatenate([own[~late], own[late]])[: len(own) - (4 * len(own) + 4) // 5 + 1] if len(own) else own


def map_size(n: int) -> int:
    return min(MAP[1], max(MAP[0], 1 << n.bit_length()))


def bitmap(own: np.ndarray, size: int) -> bytes:
    """One bit for each shingle; a bit that another set's map lacks stands for at least one shingle that the other lacks."""
    bits = np.zeros(size, np.uint8)
    bits[(own % np.uint64(size)).astype(np.int64)] = 1
    return np.packbits(bits).tobytes()


def _folded(bits: np.ndarray, size: int) -> np.ndarray:
    """A bitmap of a power of two bits as the one of fewer bits that the same set has."""
    return np.bitwise_or.reduce(bits.reshape(-1, size), axis=0)


def _signed(values: list[int] | np.ndarray) -> pa.Array:
    return pa.array(np.asarray(values, np.uint64).view(np.int64))


def _lists(parts: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), _signed(np.concatenate([np.zeros(0, np.uint64), *parts])))


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, len(whole), 256):
            own = [grams(t.as_py()) for t in whole.column(0).slice(at, 256)]
            yield pa.RecordBatch.from_arrays([_signed([set_id(g) for g in own]), _lists(own)], ["sid", "grams"])


def _keyed(common: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), 256):
                b = whole.slice(at, 256)
                every = [simhash.shingle_hashes(t.as_py(), WIDTH) for t in b.column(1)]
                own = [np.unique(h) for h in every]
                cols = [b.column(0), b.column(2), _signed([simhash.majority(h) for h in every]), _signed([set_id(g) for g in own]), pa.array([len(g) for g in own], pa.int64()), _lists([prefix(g, common) for g in own]), pa.array([bitmap(g, map_size(len(g))) for g in own], pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, ["id", "key", "fp", "sid", "n", "prefix", "map"])

    return run


def _fits(at: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether two sets can be similar if the shingle at these places of the order is the first that they share. at: size and place, 32 bits each."""
    n, rest = at >> 32, (at >> 32) - (at & 0xFFFFFFFF)
    return alike(np.minimum(rest[i], rest[j]), n[i], n[j])


def _runs(batches: Iterator[pa.RecordBatch], work, most: int = 1 << 15) -> Iterator[pa.RecordBatch]:
    """work() over the columns of batches sorted by their first column, so cut that equal keys stay together."""
    held: list[list[np.ndarray]] = []
    count = 0
    for batch in batches:
        if not len(batch):
            continue
        held = held or [[] for _ in batch.columns]
        for h, c in zip(held, batch.columns):
            h.append(c.to_numpy(zero_copy_only=False))
        count += len(batch)
        if count >= most and held[0][-1][-1] != held[0][0][0]:
            cols = [np.concatenate(h) for h in held]
            cut = int(np.searchsorted(cols[0], cols[0][-1]))
            yield work(*(c[:cut] for c in cols))
            held, count = [[c[cut:]] for c in cols], len(cols[0]) - cut
    if count:
        yield work(*(np.concatenate(h) for h in held))


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def work(gram: np.ndarray, at: np.ndarray, sid: np.ndarray) -> pa.RecordBatch:
        same = gram[1:] == gram[:-1]
        keep = np.r_[False, same] | np.r_[same, False]
        return pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in (gram, at, sid)], ["gram", "at", "sid"])

    yield from _runs(batches, work)


def star_pairs(gram: np.ndarray, at: np.ndarray, sid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of sets under equal keys the pairs with a key's first set that can be similar. gram is sorted."""
    start = np.flatnonzero(np.r_[True, gram[1:] != gram[:-1]])
    i = np.repeat(start, np.diff(np.r_[start, len(gram)]))
    j = np.flatnonzero(_fits(at, i, np.arange(len(gram))) & (i != np.arange(len(gram))))
    return sid[i[j]], sid[j]


class Maps:
    """Bitmaps of rows, those of one size as a table of 64-bit words."""

    def __init__(self, maps: list[bytes]):
        self.words = np.array([len(m) // 8 for m in maps], np.int64)
        self.place = np.zeros(len(maps), np.int64)
        self.table = {}
        for w in np.unique(self.words).tolist():
            rows = np.flatnonzero(self.words == w)
            self.place[rows] = np.arange(len(rows))
            self.table[w] = np.frombuffer(b"".join(maps[k] for k in rows), np.uint64).reshape(-1, w)

    def lacking(self, i: int, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many bits of row i each of the rows j lacks, and row i of theirs; of two sizes the larger bitmap is folded to the smaller."""
        fewer, more = np.zeros(len(j), np.int64), np.zeros(len(j), np.int64)
        words = self.words[j]
        for w in np.unique(words).tolist():
            some = np.flatnonzero(words == w)
            both = min(w, int(self.words[i]))
            own = np.bitwise_or.reduce(self.table[int(self.words[i])][self.place[i]].reshape(-1, both), axis=0)
            other = self.table[w][self.place[j[some]]]
            if w > both:
                other = np.bitwise_or.reduce(other.reshape(len(some), -1, both), axis=1)
            fewer[some] = np.bitwise_count(own & ~other).sum(axis=1, dtype=np.int64)
            more[some] = np.bitwise_count(other & ~own).sum(axis=1, dtype=np.int64)
        return fewer, more


def _most(at: np.ndarray, maps: Maps, i: int, j: np.ndarray) -> np.ndarray:
    """What the overlaps of set i and the sets j are at most, by their bitmaps."""
    n = at >> 32
    fewer, more = maps.lacking(i, j)
    return np.minimum(n[i] - fewer, n[j] - more)


def _may(at: np.ndarray, maps: Maps, i: int, j: np.ndarray) -> np.ndarray:
    """Which of the sets j can be similar to the set i, by size, place and bitmap."""
    n = at >> 32
    can = _fits(at, np.full(len(j), i), j)
    k = j[can]
    can[can] = alike(_most(at, maps, i, k), n[i], n[k])
    return can


def part_forest(gram: np.ndarray, at: np.ndarray, sid: np.ndarray, part: np.ndarray, maps: Maps) -> list[np.ndarray]:
    """A spanning forest, for each key, of the pairs that can be similar or are of one part: (gram, at, sid, part, sid and part of the set it hangs on,
    sid of the tree's root), for the trees with more than one part. gram is sorted."""
    start = np.flatnonzero(np.r_[True, gram[1:] != gram[:-1]])
    row, on, root = [], [], []
    for s, e in zip(start.tolist(), [*start[1:].tolist(), len(gram)]):
        left = np.arange(s, e)
        while len(left):
            tree, hang, left = [left[:1]], [left[:1]], left[1:]
            queue = tree[0].tolist()
            while queue and len(left):
                i = queue.pop()
                near = (part[left] == part[i]) | _may(at, maps, i, left)
                if near.any():
                    found = left[near]
                    tree.append(found)
                    hang.append(np.full(len(found), i))
                    queue.extend(found.tolist())
                    left = left[~near]
            own = np.concatenate(tree)
            if (part[own] != part[own[0]]).any():
                row.append(own)
                on.append(np.concatenate(hang))
                root.append(np.full(len(own), own[0]))
    none = np.zeros(0, np.int64)
    k, h, r = (np.concatenate([none, *x]) for x in (row, on, root))
    return [gram[k], at[k], sid[k], part[k], sid[h], part[h], sid[r]]


def part_pairs(gram: np.ndarray, at: np.ndarray, sid: np.ndarray, part: np.ndarray, maps: Maps, best: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Of sets under equal keys in different parts all pairs that can be similar; with best only the pair, of each two parts, whose overlap can be the
    largest share. gram is sorted."""
    start = np.flatnonzero(np.r_[True, gram[1:] != gram[:-1]])
    n = at >> 32
    none = np.zeros(0, np.int64)
    a, b = [none], [none]
    for s, e in zip(start.tolist(), [*start[1:].tolist(), len(gram)]):
        ours: list[list[np.ndarray]] = [[none], [none], [np.zeros(0)]]
        for i in range(s, e - 1):
            j = np.arange(i + 1, e)
            j = j[part[j] != part[i]]
            j = j[_may(at, maps, i, j)]
            if len(j):
                most = _most(at, maps, i, j) if best else n[j]
                for held, own in zip(ours, (np.full(len(j), i), j, most / (n[i] + n[j] - most) if best else most)):
                    held.append(own)
        i, j, share = (np.concatenate(x) for x in ours)
        if best and len(i):
            p, q = np.minimum(part[i], part[j]), np.maximum(part[i], part[j])
            order = np.lexsort((j, i, -share, q, p))
            p, q = p[order], q[order]
            order = order[np.r_[True, (p[1:] != p[:-1]) | (q[1:] != q[:-1])]]
            i, j = i[order], j[order]
        a.append(sid[i])
        b.append(sid[j])
    return np.concatenate(a), np.concatenate(b)


def _batch(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    ends = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1) if len(a) else np.zeros((2, 0), np.int64)
    return pa.RecordBatch.from_arrays([pa.array(ends[0]), pa.array(ends[1])], ["a", "b"])


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from _runs(batches, lambda *cols: _batch(*star_pairs(*cols)))


def paired(gram: np.ndarray, at: np.ndarray, sid: np.ndarray, part: np.ndarray) -> np.ndarray:
    """Which rows have one of another part under their key that they can be similar to by size and place. gram is sorted."""
    start = np.flatnonzero(np.r_[True, gram[1:] != gram[:-1]])
    size = np.diff(np.r_[start, len(gram)])
    many = np.minimum.reduceat(part, start) != np.maximum.reduceat(part, start) if len(gram) else size > 0
    keep = np.zeros(len(gram), bool)
    row = np.flatnonzero(np.repeat(many & (size <= simhash.SMALL_GROUP), size))
    for d in range(1, int(size[many & (size <= simhash.SMALL_GROUP)].max(initial=0))):
        i, j = row[:-d], row[d:]
        same = (gram[i] == gram[j]) & (part[i] != part[j])
        i, j = i[same], j[same]
        fit = _fits(at, i, j)
        keep[i[fit]] = True
        keep[j[fit]] = True
    many &= size > simhash.SMALL_GROUP
    for s, k in zip(start[many].tolist(), size[many].tolist()):
        for i in range(s, s + k):
            if not keep[i]:
                j = np.arange(s, s + k)
                j = j[part[j] != part[i]]
                j = j[_fits(at, np.full(len(j), i), j)]
                keep[j] = True
                keep[i] = len(j) > 0
    return keep


def _mixed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows that paired() keeps."""

    def work(*cols: np.ndarray) -> pa.RecordBatch:
        keep = paired(*cols)
        return pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in cols], ["gram", "at", "sid", "part"])

    yield from _runs(batches, work)


#: Rows with bitmaps that a worker holds at once, but for those of one key.
MAPPED = 1 << 13


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from _runs(batches, lambda *cols: pa.RecordBatch.from_arrays([pa.array(c) for c in part_forest(*cols[:4], Maps(cols[4].tolist()))], _TREE), MAPPED)


def _across(best: bool):
    return lambda batches: _runs(batches, lambda *cols: _batch(*part_pairs(*cols[:4], Maps(cols[4].tolist()), best)), MAPPED)


_TREE = ["gram", "at", "sid", "part", "hung", "hung_part", "root"]


def _possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows (a, b, n, x, m, y) whose bitmaps x and y let an overlap be large enough."""
    for b in batches:
        if not len(b):
            continue
        n, m = b.column(2).to_numpy(), b.column(4).to_numpy()
        x, y = b.column(3).to_pylist(), b.column(5).to_pylist()
        if len({len(v) for v in x} | {len(v) for v in y}) == 1:
            p, q = (np.frombuffer(b"".join(v), np.uint8).reshape(len(b), -1) for v in (x, y))
            fewer, more = (np.bitwise_count(u & ~v).sum(axis=1, dtype=np.int64) for u, v in ((p, q), (q, p)))
        else:
            fewer, more = np.zeros(len(b), np.int64), np.zeros(len(b), np.int64)
            for k, (v, w) in enumerate(zip(x, y)):
                size = min(len(v), len(w))
                p, q = _folded(np.frombuffer(v, np.uint8), size), _folded(np.frombuffer(w, np.uint8), size)
                fewer[k], more[k] = np.bitwise_count(p & ~q).sum(), np.bitwise_count(q & ~p).sum()
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(alike(np.minimum(n - fewer, m - more), n, m)))


#: Bits of the filter that names the sets to be verified, at most; beyond, more sets than needed are looked at, with the same result.
FILTER_BITS = 1 << 27


def _filter(need: DataFrame) -> np.ndarray:
    """A bit for the row of each needed set, 16 bits of room for each, FILTER_BITS at most."""
    bits = min(FILTER_BITS, 1 << max(6, (16 * need.count()).bit_length()))
    place = F.pmod("row", F.lit(bits))
    rows = need.select(F.shiftright(place, 6).alias("word"), F.expr(f"shiftleft(1L, cast(pmod(row, {bits}) % 64 as int))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).toPandas()
    out = np.zeros(bits // 64, np.uint64)
    out[rows["word"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64).view(np.uint64)
    return out


def _needed_sets(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        there = sent.value
        for whole in batches:
            place = whole.column(0).to_numpy() % (64 * len(there))
            hit = np.flatnonzero((there[place >> 6] >> (place & 63).astype(np.uint64)) & np.uint64(1))
            for at in range(0, len(hit), 256):
                own = {set_id(g): g for g in (grams(whole.column(1)[k].as_py()) for k in hit[at : at + 256].tolist())}
                maps = [bitmap(g, 1 << max(9, (8 * len(g)).bit_length())) for g in own.values()]
                cols = [_signed([*own]), pa.array([len(g) for g in own.values()], pa.int64()), pa.array(maps, pa.binary()), _lists([*own.values()])]
                yield pa.RecordBatch.from_arrays(cols, ["sid", "n", "map", "grams"])

    return run


def verified(pairs: DataFrame, texts: DataFrame, rows: DataFrame) -> DataFrame:
    """The pairs (a, b) of set ids whose sets have a Jaccard similarity of 0.8 or more. Bitmaps of the sets first bound the overlap from above, so
    that few pairs carry whole sets. rows has (sid, row), so that a needed set is made from one row of texts (row, text) and no others are looked at. pairs
    is a table in shared scratch and is deleted."""
    need = pairs.select(F.explode(F.array("a", "b")).alias("sid")).distinct()
    one = rows.join(need, "sid", "left_semi").groupBy("sid").agg(F.min("row").alias("row"))
    sent = pairs.sparkSession.sparkContext.broadcast(_filter(one))
    made = texts.select("row", "text").mapInArrow(given_back(lambda it: _needed_sets(sent)(it)), "sid long, n long, map binary, grams array<long>")
    own = materialise(made.join(need, "sid", "left_semi").dropDuplicates(["sid"]))
    maps, own_sets = own.select("sid", "n", "map"), own.select("sid", "grams")
    mapped = pairs.join(maps.toDF("a", "n", "x"), "a").join(maps.toDF("b", "m", "y"), "b").select("a", "b", "n", "x", "m", "y")
    near = materialise(mapped.mapInArrow(given_back(_possible), "a long, b long"))
    both = near.join(own_sets.toDF("a", "x"), "a").join(own_sets.toDF("b", "y"), "b")
    overlap = F.size(F.array_intersect("x", "y"))  # row by row; Arrow batches would hold thousands of whole sets
    out = materialise(both.where(alike(overlap, F.size("x"), F.size("y"))).select("a", "b"))
    for done in (near, own, pairs):
        discard(done)
    driver_gives_back(pairs.sparkSession)
    return out


def common_grams(texts: DataFrame) -> np.ndarray:
    """Shingles in more than COMMON of a sample of the distinct texts. It sets only the order of shingles, so it bears on time and not on results."""
    some = materialise(texts.where(F.pmod("key", F.lit(16)) == 5).select("text").mapInArrow(given_back(_sets), "sid long, grams array<long>").distinct())
    least = max(1, COMMON * some.count())
    rows = some.select(F.explode("grams").alias("g")).groupBy("g").count().where(F.col("count") > least).select("g").toPandas()
    return np.sort(rows["g"].to_numpy(np.int64).view(np.uint64))


def simhash_pairs(keyed: DataFrame, distance: int = 4) -> DataFrame:
    """(a, b) of set ids whose SimHash fingerprints differ by `distance` bits at most: those that multi-index hashing links, each
    fingerprint standing for its smallest set id, and that id with the others of the fingerprint."""
    sets = materialise(keyed.select("fp", "sid").distinct())
    least = materialise(sets.groupBy("fp").agg(F.min("sid").alias("low")))
    linked = simhash.links(least, distance)
    across = linked.join(least.toDF("a", "x"), "a").join(least.toDF("b", "y"), "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    return across.unionByName(sets.join(least, "fp").where("sid <> low").select(F.col("low").alias("a"), F.col("sid").alias("b")))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, one of each component of texts linked by a Jaccard similarity of their 5-word shingles of 0.8 or more:
    that of the smallest id (then of the smallest hash of the text).

    SimHash finds most links, but similarity 0.8 is ten differing bits on average, which no index over segments can look up; so pairs
    that share a shingle of both prefixes, as all such pairs do, come second: those with a shingle's first set, along with those of SimHash,
    then for each shingle a spanning forest of the pairs that bitmaps leave, then the likeliest pair of each two components, and last all that are left. Pairs within a component found
    before need no look, so that a large group of near copies makes no pair list.
    Texts without words are alike. Rows are told apart by id and text, so repeated ids with other texts are not lost; a component whose
    ids are all null keeps one row. Names of docs cannot clash with those used here; an empty table gives no rows.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("key", F.xxhash64("text")).withColumn("row", F.xxhash64("id", "key"))
    keyed = materialise(texts.select("id", "text", "key").mapInArrow(given_back(_keyed(common_grams(texts))), f"id {kind}, key long, fp long, sid long, n long, prefix array<long>, map binary"))
    rows = keyed.select("sid", F.xxhash64("id", "key").alias("row"))
    maps = keyed.select("sid", "map").dropDuplicates(["sid"])
    each = keyed.select("sid", "n", "prefix").dropDuplicates(["sid"]).select("sid", "n", F.posexplode("prefix").alias("pos", "gram")).select("gram", (F.shiftleft("n", 32) + F.col("pos")).alias("at"), "sid")
    shared = materialise(each.repartition("gram").sortWithinPartitions("gram", "at", "sid").mapInArrow(given_back(_repeated), "gram long, at long, sid long"))

    def by_gram(table: DataFrame) -> DataFrame:
        return table.repartition("gram").sortWithinPartitions("gram", "at", "sid")

    def parted(table: DataFrame) -> DataFrame:
        """The rows of the table, with bitmaps, that can be similar by size and place to one of another component of the links so far."""
        own = table.select("gram", "at", "sid").join(roots, "sid", "left").select("gram", "at", "sid", F.coalesce("root", "sid").alias("part"))
        mixed = materialise(by_gram(own).mapInArrow(given_back(_mixed), "gram long, at long, sid long, part long"))
        return by_gram(mixed.join(maps, "sid").select("gram", "at", "sid", "part", "map"))

    def merged(links: DataFrame, known: DataFrame | None = None) -> DataFrame:
        """(sid, root) of the components of the links and of those known."""
        both = links if known is None else links.unionByName(known.toDF("a", "b"))
        out = connected_components(both).select(F.col("node").alias("sid"), "root")
        driver_gives_back(docs.sparkSession)
        return out

    roots = merged(verified(materialise(by_gram(shared).mapInArrow(given_back(_stars), "a long, b long").unionByName(simhash_pairs(keyed)).distinct()), texts, rows))
    trees = materialise(parted(shared).mapInArrow(given_back(_forest), ", ".join(f"{c} long" for c in _TREE)))
    pairs = trees.where("sid <> hung and part <> hung_part").select(F.least("sid", "hung").alias("a"), F.greatest("sid", "hung").alias("b")).distinct()
    roots = merged(verified(materialise(pairs), texts, rows), roots)
    rest = trees.select(F.xxhash64("gram", "root").alias("gram"), "at", "sid")
    for best in (True, False):
        pairs = parted(rest).mapInArrow(given_back(_across(best)), "a long, b long").distinct()
        roots = merged(verified(materialise(pairs), texts, rows), roots)
    one = keyed.groupBy("sid").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key")).alias("least"))
    kept = one.join(roots, "sid", "left").groupBy(F.coalesce("root", "sid").alias("root")).agg(F.min("least").alias("least"))
    i, k, own = fresh_names(docs.columns, "kept_id", "kept_key", "key")
    kept = kept.select(F.col("least.id").alias(i), F.col("least.key").alias(k))
    named = docs.withColumn(own, F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    stay = named.join(kept, named[id_col].eqNullSafe(F.col(i)) & (F.col(own) == F.col(k)), "left_semi")
    return stay.dropDuplicates([id_col, own]).drop(own)
