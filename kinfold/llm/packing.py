"""Best-fit packing of tokenised documents with exact-complement hashing."""

from __future__ import annotations

import itertools
import re
import zlib
from bisect import bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinfold.runtime import materialise

END_ID = 1
#: Texts of these characters only are split here; there, NFC changes nothing and lower case is letter by letter.
_PLAIN = re.compile("[\\t\\n\\r\\x20-\\x7e\\xa1-\\xffŒœ‐-‧€]*")
_LETTER = "a-z\\xaa\\xb5\\xba\\xdf-\\xf6\\xf8-\\xffœ"
_NUMBER = "0-9\\xb2\\xb3\\xb9\\xbc-\\xbe"
#: The vocabulary's own splitting rule, written for those characters.
_SPLIT = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_NUMBER}]|[^\\s{_LETTER}{_NUMBER}]+")
#: Special tokens (<|startoftext|>, <|endoftext|>) are ids of their own wherever they stand.
_OPEN = "<|"
#: Words kept in a worker's memory; beyond it the store starts anew, which changes speed only.
WORDS_KEPT = 400_000


class WordCoder:
    """Ids of texts by a word-end BPE vocabulary, word by word.

    A word's ids depend on the word alone, so known words come from a store and only new ones go to
    the tokenizer, many at once. Texts with characters outside the plain set, or with what opens a special token's name, go to the tokenizer whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size()
        self.ends = np.array([str(self.tokenizer.id_to_token(i)).endswith("</w>") for i in range(size)])
        self.known: dict[str, bytes] = {}

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4").tobytes()

    def _learn(self, words: list[str]) -> None:
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, "<u4")
        stops = np.flatnonzero(self.ends[ids]) + 1
        if len(stops) != len(words):  # a vocabulary without word ends
            self.known.update((w, self._whole(w)) for w in words)
            return
        raw, at = ids.tobytes(), 0
        for w, to in zip(words, (stops * 4).tolist()):
            self.known[w] = raw[at:to]
            at = to

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        if len(self.known) > WORDS_KEPT:
            self.known.clear()
        cut = [_SPLIT.findall(t.lower()) if _OPEN not in t and _PLAIN.fullmatch(t) else None for t in texts]
        words = list(itertools.chain.from_iterable(c for c in cut if c))
        parts = list(map(self.known.get, words))
        gaps = [i for i, p in enumerate(parts) if p is None]
        if gaps:
            self._learn(list({words[i] for i in gaps}))
            for i in gaps:
                parts[i] = self.known[words[i]]
        out, at = [], 0
        for c, t in zip(cut, texts):
            if c is None:
                out.append(self._whole(t))
            else:
                out.append(b"".join(parts[at : at + len(c)]))
                at += len(c)
        return out


_CODERS: dict[str, WordCoder] = {}


def coder(path: str) -> WordCoder:
    """One coder for each vocabulary in each worker process."""
    if path not in _CODERS:
        _CODERS[path] = WordCoder(path)
    return _CODERS[path]


def _pieces(path: str | Callable[[], str], capacity: int, keep_ids: bool):
    names = ["id", "piece", "start", "length", "ids_crc32"] + ["ids"] * keep_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, end = coder(path if isinstance(path, str) else path()), np.array([END_ID], "<u4").tobytes()
        for whole in batches:
            for at in range(0, len(whole), 256):
                b = whole.slice(at, 256)
                row, piece, start, length, crc, ids = [], [], [], [], [], []
                for i, raw in enumerate(own.encode([t or "" for t in b.column(1).to_pylist()])):
                    raw += end
                    for k, lo in enumerate(range(0, len(raw), 4 * capacity)):
                        part = raw[lo : lo + 4 * capacity]
                        row.append(i)
                        piece.append(k)
                        start.append(lo // 4)
                        length.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
                        if keep_ids:
                            ids.append(np.frombuffer(part, "<u4").astype(np.int32))
                cols = [b.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(cols + ([pa.array(ids, pa.list_(pa.int32()))] if keep_ids else []), names)

    return run


class Sums:
    """Index of the sums of one, two and three available lengths.

    For each sum there is a list of its pairs (the longer length of each), and a list of the first lengths of its triples, both made when the
    sum is first asked for. Availability only falls while lengths are used up, so an entry that has run out is passed over for good and each
    list is walked once. A triple is a first length with a pair of the rest, found through the pair index.
    """

    def __init__(self, count: np.ndarray):
        self.count = count
        self.there = np.flatnonzero(count)
        self.pairs: dict[int, tuple[np.ndarray, int]] = {}
        self.firsts: dict[int, tuple[np.ndarray, int]] = {}

    def _has(self, *lengths: int) -> bool:
        return all(self.count[a] >= lengths.count(a) for a in lengths)

    def pair(self, total: int, but: int = 0) -> list[int] | None:
        """The pair with the longest length whose sum is the total; with `but` one of that length is spoken for."""
        if total not in self.pairs:
            own = self.there[(2 * self.there >= total) & (self.there < total)]
            self.pairs[total] = (own[self.count[total - own] > 0][::-1].astype(np.int32), 0)
        own, at = self.pairs[total]
        while at < len(own) and not self._has(int(own[at]), total - int(own[at])):
            at += 1
        self.pairs[total] = (own, at)
        taken = (but,) if but else ()
        return next(([int(a), total - int(a)] for a in own[at:] if self._has(int(a), total - int(a), *taken)), None)

    def triple(self, total: int) -> list[int] | None:
        if total not in self.firsts:
            self.firsts[total] = (self.there[(3 * self.there >= total) & (self.there < total - 1)][::-1].astype(np.int32), 0)
        own, at = self.firsts[total]
        for k in range(at, len(own)):
            a = int(own[k])
            if self.count[a] and (found := self.pair(total - a, a)):
                self.firsts[total] = (own, k)
                return [a, *found]
        self.firsts[total] = (own, len(own))
        return None

    def exact(self, gap: int) -> list[int] | None:
        """One, two or three available lengths whose sum is the gap, the fewest first, among equally many the longest first; None if there are none."""
        if gap <= 0:
            return None
        if gap < len(self.count) and self.count[gap]:
            return [gap]
        return self.pair(gap) or self.triple(gap)


def _fill(count: np.ndarray, capacity: int, defer: bool) -> list[tuple[int, list[int]]]:
    """Patterns that use up count. Each starts with the longest length left; one, two or three lengths of exactly the remaining sum close it while there
    are some, and else the longest that fits goes in (best fit) and the search goes on. With `defer`, patterns that do not close exactly wait until
    all others are made. A pattern repeats as often as its lengths last."""
    plans, waiting = [], np.zeros_like(count)
    sums = Sums(count.copy())
    count = sums.count
    while count.any():
        gap, own = capacity, []
        while gap > 0:
            if own and (found := sums.exact(gap)):
                own += found
                np.subtract.at(count, found, 1)
                gap = 0
                break
            here = np.flatnonzero(count[: gap + 1])
            if not len(here) or own and defer:
                break
            a = int(here[-1])
            own.append(a)
            count[a] -= 1
            gap -= a
        used = np.bincount(own, minlength=capacity + 1)
        more = int((count[used > 0] // used[used > 0]).min())
        count -= more * used
        if defer and gap:
            waiting += (more + 1) * used
        else:
            plans.append((more + 1, own))
    return plans + (_fill(waiting, capacity, False) if waiting.any() else [])


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, list[int]]]:
    """(how many sequences, the lengths in each) that use up the histogram: the shorter of two plans.

    One closes gaps exactly where it can as it goes and puts the best fit elsewhere; the other makes all sequences that close at once first and
    then treats the residuals like that. There are about as many patterns as different lengths, whatever the number of documents.
    """
    count = np.zeros(capacity + 1, np.int64)
    for k, v in histogram.items():
        count[k] += v
    return min((_fill(count, capacity, defer) for defer in (False, True)), key=lambda p: sum(n for n, _ in p))


def _slots(plans: list[tuple[int, list[int]]]) -> dict[int, tuple[list[int], list[int], list[int]]]:
    """For each length: first ranks, the sequence of the first rank, the offset."""
    out: dict[int, tuple[list[int], list[int], list[int]]] = {}
    given: dict[int, int] = {}
    base = 0
    for times, own in plans:
        at = 0
        for a in own:
            ranks, first, offset = out.setdefault(a, ([], [], []))
            ranks.append(given.get(a, 0))
            first.append(base)
            offset.append(at)
            given[a] = given.get(a, 0) + times
            at += a
        base += times
    return out


def _place(slots: dict[int, tuple[list[int], list[int], list[int]]], names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seq, off = [], []
            for a, r in zip(b.column("length").to_pylist(), b.column("rank").to_pylist()):
                ranks, first, offset = slots[a]
                k = bisect_right(ranks, r) - 1
                seq.append(first[k] + r - ranks[k])
                off.append(offset[k])
            yield pa.RecordBatch.from_arrays([b.column(n) for n in names] + [pa.array(seq, pa.int64()), pa.array(off, pa.int64())], [*names, "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, tokenizer: str | Callable[[], str], capacity: int = 4096, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset (and ids with keep_ids).

    Pieces of equal length take their places in the order of a hashed bucket, id, piece and ids; pieces equal in all of these are alike, so
    which of them comes first makes no difference.

    Null text is empty and gives the end id alone; each document ends with the end id; only documents of more than `capacity`
    ids are cut. A null id stays null. Repeated rows are packed each on their own. An empty table gives no rows. Other columns of docs are ignored.

    What reaches the driver is the histogram of lengths, at most `capacity` rows at any input size, and the plan made of
    it. Ranks within a length are taken in hashed buckets, so that a length of very many copies spreads over tasks.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    shape = f"id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids
    cut = materialise(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(_pieces(tokenizer, capacity, keep_ids), shape))
    buckets = max(16, int(spark.conf.get("spark.sql.shuffle.partitions")))
    cut = cut.withColumn("bucket", F.pmod(F.xxhash64("id", "piece", "ids_crc32"), F.lit(buckets)).cast("int"))
    counts = materialise(cut.groupBy("length", "bucket").count())
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select("length", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first"))
    within = Window.partitionBy("length", "bucket").orderBy("id", "piece", "ids_crc32")
    ranked = cut.withColumn("own", F.row_number().over(within) - 1).join(firsts, ["length", "bucket"])
    names = ["id", "piece", "start", "length", "ids_crc32"] + ["ids"] * keep_ids
    slots = spark.sparkContext.broadcast(_slots(plan(histogram, capacity)))
    placed = ranked.select(*names, (F.col("own") + F.col("first")).alias("rank")).mapInArrow(lambda it: _place(slots.value, names)(it), f"{shape}, sequence_id long, offset long")
    return placed.withColumnRenamed("id", id_col)
