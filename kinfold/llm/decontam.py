"""Benchmark decontamination with training-side suffix arrays."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.llm.memory import given_back

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")  # on lower-cased UTF-8: the bytes outside \x00-\x2F, \x3A-\x60, \x7B-\x7F
#: Words of benchmark text that one broadcast block may hold; a larger benchmark is worked off block by block.
BLOCK_WORDS = 2_000_000
#: Bytes of document text in one shard, that is, under one suffix array.
SHARD_BYTES = 2 << 20


def words_of(text: str | None) -> list[bytes]:
    return _WORD.findall((text or "").encode("utf-8", "surrogatepass").lower())


def suffix_array(ids: np.ndarray) -> np.ndarray:
    """Start positions of all suffixes of ids in lexicographic order, by prefix doubling."""
    n = len(ids)
    order = np.argsort(ids, kind="stable")
    rank = np.empty(n, np.int64)
    rank[order] = np.cumsum(np.r_[0, ids[order][1:] != ids[order][:-1]])
    k = 1
    while n and rank.max() < n - 1:
        second = np.full(n, -1, np.int64)
        second[: n - k] = rank[k:] if k < n else rank[:0]
        order = np.lexsort((second, rank))
        a, b = rank[order], second[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.r_[0, (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
        k *= 2
    return order


class Queries:
    """A block of benchmark items: vocabulary, item texts as ids one after the other, every distinct window, and the suffixes that begin with each.

    A window's suffixes stand together in `suffix` from `begin[w]` on; a window of many items is searched once.
    """

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.vocabulary: dict[bytes, int] = {}
        code = self.vocabulary.setdefault
        self.names = [name for name, _ in items]
        ids, at, item, need, room = [], [], [], [], []
        groups: dict[tuple[int, ...], list[int]] = {}
        for k, (_, words) in enumerate(items):
            base, n = len(ids), len(words)
            ids += [code(w, len(self.vocabulary) + 1) for w in words]
            w = min(window, n)
            for p in range(n - w + 1 if n else 0):
                groups.setdefault(tuple(ids[base + p : base + p + w]), []).append(len(at))
                at.append(base + p)
                item.append(k)
                need.append(w)
                room.append(n - p)
        self.ids = np.array(ids, np.int64)
        order = np.array([i for g in groups.values() for i in g], np.int64)
        self.suffix_at, self.item, self.room = (np.array(x, np.int64)[order] for x in (at, item, room))
        self.begin = np.cumsum([0, *map(len, groups.values())])
        first = self.begin[:-1]
        self.at = self.suffix_at[first]
        self.need = np.array(need, np.int64)[order][first]
        self.least = int(self.need.min()) if len(self.need) else 0

    def items_of(self, windows: np.ndarray) -> set[str]:
        return {self.names[k] for w in windows.tolist() for k in self.item[self.begin[w] : self.begin[w + 1]].tolist()}


def _compare(text: np.ndarray, start: np.ndarray, q: Queries, which: np.ndarray, after: bool) -> np.ndarray:
    """Whether each text suffix sorts before the wanted one (or, with after, before the end of its matches), over `need` words."""
    depth = int(q.need[which].max())
    before = np.zeros(len(start), bool)
    same = np.ones(len(start), bool)
    for j in range(depth):
        live = same & (j < q.need[which])
        if not live.any():
            break
        t = text[np.minimum(start + j, len(text) - 1)]
        t = np.where(start + j < len(text), t, -1)
        w = q.ids[np.minimum(q.at[which] + j, len(q.ids) - 1)]
        before |= live & (t < w)
        same &= ~live | (t == w)
    return before | same if after else before


def _search(text: np.ndarray, order: np.ndarray, q: Queries) -> tuple[np.ndarray, np.ndarray]:
    """For every window, the range of the suffix array whose suffixes start with it. All binary searches run side by side."""
    out = []
    which = np.arange(len(q.at))
    for after in (False, True):
        lo, hi = np.zeros(len(which), np.int64), np.full(len(which), len(order), np.int64)
        while (open_ := lo < hi).any():
            mid = (lo + hi) >> 1
            less = np.zeros(len(which), bool)
            less[open_] = _compare(text, order[mid[open_]], q, which[open_], after)
            lo = np.where(open_ & less, mid + 1, lo)
            hi = np.where(open_ & ~less, mid, hi)
        out.append(lo)
    return out[0], out[1]


def _occurrences(ids: np.ndarray, q: Queries) -> tuple[np.ndarray, np.ndarray]:
    """(position in ids, window) of all window matches in one shard. ids: 0 where a word is in no item, and between documents.

    Only runs of benchmark words that are long enough for a window go into the suffix array; no other suffix can match.
    """
    none = np.zeros(0, np.int64)
    if not q.least:
        return none, none
    edge = np.diff(np.r_[0, (ids > 0).astype(np.int8), 0])
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    keep = end - begin >= q.least
    begin, end = begin[keep], end[keep]
    if not len(begin):
        return none, none
    size = end - begin + 1  # with a zero after each run
    first = np.cumsum(size) - size
    place = np.arange(size.sum()) - np.repeat(first, size) + np.repeat(begin, size)
    text = np.where(place < np.repeat(end, size), ids[np.minimum(place, len(ids) - 1)], 0)
    order = suffix_array(text)
    lo, hi = _search(text, order, q)
    n = hi - lo
    which = np.repeat(np.arange(len(n)), n)
    inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
    return place[order[inside]], which


def _lengths(ids: np.ndarray, pos: np.ndarray, q: Queries, window: np.ndarray, suffix: np.ndarray) -> np.ndarray:
    """Words that each match goes on for, verbatim, up to the item's end."""
    n = q.need[window].copy()
    live = np.flatnonzero(n < q.room[suffix])
    while len(live):
        to = pos[live] + n[live]
        ok = (to < len(ids)) & (ids[np.minimum(to, len(ids) - 1)] == q.ids[q.suffix_at[suffix[live]] + n[live]])
        live = live[ok]
        n[live] += 1
        live = live[n[live] < q.room[suffix[live]]]
    return n


#: Matches whose lengths are looked at together; a window of many items in many places is worked off in such parts.
MATCHES = 1 << 20


def _longest(ids: np.ndarray, pos: np.ndarray, window: np.ndarray, doc: np.ndarray, q: Queries) -> Iterator[tuple[int, int, int, int]]:
    """(document, length, position, item) of long matches, the longest of each document among them."""
    each = q.begin[window + 1] - q.begin[window]
    ends = np.cumsum(each)
    for lo in range(0, int(ends[-1]), MATCHES):
        k = np.arange(lo, min(lo + MATCHES, int(ends[-1])))
        i = np.searchsorted(ends, k, "right")
        suffix = q.begin[window[i]] + k - (ends[i] - each[i])
        long = _lengths(ids, pos[i], q, window[i], suffix)
        best = np.lexsort((suffix, pos[i], -long, doc[i]))
        for b in best[np.unique(doc[i][best], return_index=True)[1]].tolist():
            yield int(doc[i[b]]), int(long[b]), int(pos[i[b]]), int(q.item[suffix[b]])


_OUT = ["n_words", "n_hit", "n_items", "items_sha256", "items", "longest", "longest_at", "longest_item"]


def _shard(rows: list[list[bytes]], blocks) -> dict[str, list]:
    n = [len(w) for w in rows]
    start = np.cumsum([0] + [x + 1 for x in n])
    hit = np.zeros(start[-1] + 1, np.int64)
    items: list[set[str]] = [set() for _ in rows]
    longest = [(0, 0, None)] * len(rows)
    for block in blocks:
        q: Queries = block.value
        ids = np.zeros(start[-1], np.int64)
        get = q.vocabulary.get
        for w, at in zip(rows, start.tolist()):
            ids[at : at + len(w)] = [get(x, 0) for x in w]
        pos, which = _occurrences(ids, q)
        if len(pos):
            np.add.at(hit, pos, 1)
            np.add.at(hit, pos + q.need[which], -1)
            doc = np.searchsorted(start, pos, "right") - 1
            both = np.unique(np.stack([doc, which]), axis=1)
            cut = np.flatnonzero(np.r_[True, both[0][1:] != both[0][:-1], True])
            for i, j in zip(cut, cut[1:]):
                items[both[0][i]] |= q.items_of(both[1][i:j])
            for d, n_words, at, item in _longest(ids, pos, which, doc, q):
                if n_words > longest[d][0]:
                    longest[d] = (n_words, at - int(start[d]), q.names[item])
        if len(blocks) > 1:  # a worker holds one block at a time
            block.__dict__.pop("_value", None)
    inside = np.r_[0, np.cumsum(np.cumsum(hit[:-1]) > 0)]
    names = [sorted(x) for x in items]
    return {
        "n_words": n,
        "n_hit": [int(inside[a + x] - inside[a]) for a, x in zip(start.tolist(), n)],
        "n_items": [len(x) for x in names],
        "items_sha256": [hashlib.sha256(",".join(x).encode()).hexdigest() for x in names],
        "items": names,
        "longest": [x[0] for x in longest],
        "longest_at": [x[1] if x[0] else None for x in longest],
        "longest_item": [x[2] for x in longest],
    }


def _scan(blocks):
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.string()), pa.int64(), pa.int64(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part, words in _shards(whole, 1):
                out = _shard(words, blocks)
                yield pa.RecordBatch.from_arrays([part.column(0)] + [pa.array(out[k], t) for k, t in zip(_OUT, kinds)], ["id", *_OUT])

    return run


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, window: int):
    """Broadcasts of at most BLOCK_WORDS words (or one item) each; the driver holds one block at a time."""
    spark = benchmark.sparkSession
    rows = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).alias("text")).where("item is not null and text is not null").toLocalIterator()
    held, n, out = [], 0, []
    for r in rows:
        words = words_of(r["text"])
        if n and n + len(words) > BLOCK_WORDS:
            out.append(spark.sparkContext.broadcast(Queries(held, window)))
            held, n = [], 0
        held.append((r["item"], words))
        n += len(words)
    return [*out, spark.sparkContext.broadcast(Queries(held, window))] if held else out


def _shards(batch: pa.RecordBatch, column: int) -> Iterator[tuple[pa.RecordBatch, list[list[bytes]]]]:
    size = np.cumsum(pa.compute.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    cuts = [0, *(np.flatnonzero(np.diff(size // SHARD_BYTES)) + 1).tolist(), len(batch)]
    for a, b in zip(cuts, cuts[1:]):
        part = batch.slice(a, b - a)
        yield part, [words_of(t) for t in part.column(column).to_pylist()]


def scan(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 8, limit: int = 2) -> DataFrame:
    """One row per document: id, n_words, n_hit, n_items, items_sha256, contaminated, the items, and the longest verbatim match (words, place, item).

    A window is `window` consecutive words of an item; an item of fewer words, but not none, is one window. Items are a set: repeated
    item ids count once. Items with a null id or text have no windows. Null and empty documents have no words and no hits. Repeated documents and null
    ids stay rows of their own; other columns are ignored. An empty benchmark gives rows without hits.

    The longest match is the longest run of words that a document shares with an item, from a window's length on; of equally long ones the first.

    Every batch of documents is a shard with a suffix array of its own, in which the windows that begin the test suffixes are found by binary search;
    nothing is shuffled, and a very common passage only gives each of its documents its own hits.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    shape = f"id {kind}, n_words long, n_hit long, n_items long, items_sha256 string, items array<string>, longest long, longest_at long, longest_item string"
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(_scan(_blocks(benchmark, item_col, item_text_col, window)), shape)
    return out.select(F.col("id").alias(id_col), "n_words", "n_hit", "n_items", "items_sha256", (F.col("n_items") >= limit).alias("contaminated"), "items", "longest", "longest_at", "longest_item")


def keep_clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 8, limit: int = 1) -> DataFrame:
    """The rows of docs, all columns, in which windows of fewer than `limit` items occur. Nothing is shuffled."""
    blocks = _blocks(benchmark, item_col, item_text_col, window)
    column = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part, words in _shards(whole, column):
                yield part.filter(pa.array([n < limit for n in _shard(words, blocks)["n_items"]], pa.bool_()))

    return docs.mapInArrow(given_back(run), docs.schema)
