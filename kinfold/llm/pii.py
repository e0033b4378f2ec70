"""Personal data: fixed patterns as seeds, lexical contexts bootstrapped from them, and unseen identifiers found by the contexts."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.llm.names import fresh_names
from kinfold.runtime import discard, materialise

KINDS = ("email", "ip", "card", "phone")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGIT = re.compile("[0-9]")
_DOTTED = re.compile("[0-9][0-9.]*")
_CARD = re.compile("[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_RUN = re.compile("[0-9]+")
_EDGE = ".,;:!?()[]{}<>\"'"
#: A word counts as a candidate identifier with an @ or so many digits.
CANDIDATE_DIGITS = 4
_SPACE = re.compile(r"\s")
_WORD = re.compile(r"\S+")


def emails(text: str) -> Iterator[tuple[int, int]]:
    at, floor = text.find("@"), 0
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            floor = found.end()
        at = text.find("@", max(at + 1, floor))


def addresses(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost fours of dotted digit runs; a four with a part over 255 is used up and dropped."""
    for m in _DOTTED.finditer(text):
        at, own = m.start(), []
        for part in m.group().split("."):
            own = [*own, (at, part)] if part else []
            if len(own) == 4:
                if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for _, p in own):
                    yield own[0][0], at + len(part)
                own = []
            at += len(part) + 1


def _luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def cards(text: str) -> Iterator[tuple[int, int]]:
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and _luhn(digits):
            yield m.span()


def phones(text: str) -> Iterator[tuple[int, int]]:
    for m in _PHONE.finditer(text):
        if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
            yield m.span()


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end), by kind and then start."""
    out = [(0, a, b) for a, b in emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        out += [(1, a, b) for a, b in addresses(text)]
        out += [(2, a, b) for a, b in cards(text)]
        if "+" in text:
            out += [(3, a, b) for a, b in phones(text)]
    return out


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def candidates(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Whole words with an @ or CANDIDATE_DIGITS digits that touch no base span, without marks at their ends, however long; one pass over the text."""
    out: list[tuple[int, int]] = []
    marks = sorted((a, b) for _, a, b in taken)
    last = k = covered = 0
    for at in sorted([m.start() for m in _RUN.finditer(text)] + [m.start() for m in re.finditer("@", text)]):
        if at < last:
            continue
        start = at
        while start > last and not text[start - 1].isspace():
            start -= 1
        stop = _SPACE.search(text, at)
        last = end = stop.start() if stop else len(text)
        while start < end and text[start] in _EDGE:
            start += 1
        while end > start and text[end - 1] in _EDGE:
            end -= 1
        word = text[start:end]
        if "@" not in word and sum(c in "0123456789" for c in word) < CANDIDATE_DIGITS:
            continue
        while k < len(marks) and marks[k][0] < end:
            covered = max(covered, marks[k][1])
            k += 1
        if covered <= start:
            out.append((start, end))
    return out


def _hash(text: str) -> int:
    """As Spark's xxhash64 of one string."""
    h = xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"), 42)
    return h - (1 << 64) if h >> 63 else h


def contexts(text: str, words: tuple[list[int], list[int]], start: int, end: int) -> list[int]:
    """Hashes of the lexical patterns around a span: the two words before it, and the word before with the word after.

    words: starts and ends of the text's words. What a span leaves of its own word counts as a word.
    """
    starts, ends = words
    i = bisect_right(ends, start)  # the first word that ends after the span's start
    left = [text[a:b] for a, b in zip(starts[max(0, i - 2) : i], ends[max(0, i - 2) : i])]
    if i < len(starts) and starts[i] < start:
        left.append(text[starts[i] : start])
    j = bisect_right(ends, end)
    right = [text[max(starts[j], end) : ends[j]].lower()] if j < len(starts) else []
    left = [w.lower() for w in left[-2:]]
    if not left:
        return []
    forms = ["\x00".join(["L", *left])] if len(left) == 2 else []
    return [_hash(f) for f in forms + ["\x00".join(["R", left[-1], *right])]]


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    occurrence = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("instance", pa.int64()), ("patterns", pa.list_(pa.int64()))]))
    for whole in batches:
        for at in range(0, len(whole), 1024):
            b = whole.slice(at, 1024)
            counts, base, found, keys = [], [], [], []
            for raw in b.column(1):
                text = raw.as_py() or ""
                spans = base_spans(text)
                counts.append([sum(k == i for k, _, _ in spans) for i in range(4)])
                base.append(joined(spans))
                keys.append(_hash(text))
                own = [(k, a, e) for k, a, e in spans] + [(None, a, e) for a, e in candidates(text, spans)] if spans or _DIGIT.search(text) or "@" in text else []
                words = ([m.start() for m in _WORD.finditer(text)], [m.end() for m in _WORD.finditer(text)]) if own else ([], [])
                found.append([{"kind": k, "start": a, "end": e, "instance": _hash(text[a:e].lower()), "patterns": contexts(text, words, a, e)} for k, a, e in own])
            cols = [b.column(0), pa.array(keys, pa.int64())] + [pa.array([c[i] for c in counts], pa.int64()) for i in range(4)]
            cols += [pa.array([hashlib.sha256(x.encode()).hexdigest() for x in base]), pa.array(base, pa.string()), pa.array(found, occurrence)]
            yield pa.RecordBatch.from_arrays(cols, ["id", "key", *(f"n_{k}" for k in KINDS), "base_sha256", "base", "found"])


def extract(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    kind = docs.schema[id_col].dataType.simpleString()
    shape = f"id {kind}, key long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, base string, found array<struct<kind:int,start:long,end:long,instance:long,patterns:array<long>>>"
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(_extract, shape)


def discover(base: DataFrame, sure: float = 0.8, support: float = 3.0) -> DataFrame:
    """(id, key, more): for the rows that have some, the added spans as an array of (kind, start, end).

    A pattern's score for a kind is the weight of its instances known to be of that kind over the number of all its instances plus one,
    if that weight is `support` or more. An unknown instance belongs to a kind with probability 1 - prod(1 - score) over its patterns, and
    joins the known ones with that weight from `sure` on. Rounds go on until one accepts nothing, so contexts that no seed has come in by
    way of accepted instances; every round but the last accepts one instance at least. Then all unknown words whose instance was
    accepted are spans, of its weightiest kind (of equal ones the first). Weights are rounded to nine places, so that the order of sums does not count.

    Patterns of fewer instances than `support` can have no score and those without unknown words no effect; only these are left out.
    """
    every = base.where(F.size("found") > 0).select("id", "key", F.explode("found").alias("o")).select("id", "key", "o.kind", "o.start", "o.end", "o.instance", "o.patterns")
    seeds = materialise(every.where("kind is not null").select("instance", "kind", F.lit(1.0).alias("weight")).distinct())
    pairs = materialise(every.select(F.explode("patterns").alias("pattern"), "instance", F.col("kind").isNull().alias("open")).groupBy("pattern", "instance").agg(F.max("open").alias("open")))
    sizes = materialise(pairs.groupBy("pattern").agg(F.count("*").alias("size"), F.max("open").alias("open")).where((F.col("size") >= support) & F.col("open")).select("pattern", "size"))
    links = materialise(pairs.join(sizes, "pattern", "left_semi"))
    unknown = links.where("open").join(seeds.select("instance").distinct(), "instance", "left_anti").select("pattern", "instance")
    new, weights, accepted = seeds, None, None
    while True:
        gained = links.join(new, "instance").groupBy("pattern", "kind").agg(F.sum("weight").alias("weight"))
        after = materialise(gained if weights is None else weights.unionByName(gained).groupBy("pattern", "kind").agg(F.round(F.sum("weight"), 9).alias("weight")))
        if weights is not None:
            discard(weights)
        weights = after
        scored = weights.where(F.col("weight") >= support).join(sizes, "pattern").select("pattern", "kind", (F.col("weight") / (F.col("size") + 1)).alias("score"))
        belief = unknown.join(scored, "pattern").groupBy("instance", "kind").agg(F.round(1 - F.exp(F.sum(F.log(1 - F.col("score")))), 9).alias("weight")).where(F.col("weight") >= sure)
        new = materialise(belief if accepted is None else belief.join(accepted.select("instance", "kind"), ["instance", "kind"], "left_anti"))
        if not new.head(1):
            break
        accepted = new if accepted is None else materialise(accepted.unionByName(new))
    for done in (weights, links, sizes, pairs, seeds):
        discard(done)
    known = (new if accepted is None else accepted).groupBy("instance").agg(F.min_by("kind", F.struct(-F.col("weight"), "kind")).alias("kind"))
    ours = every.where("kind is null").select("id", "key", "start", "end", "instance").join(known, "instance").select("id", "key", "kind", "start", "end").distinct()
    return ours.groupBy("id", "key").agg(F.array_sort(F.collect_list(F.struct("kind", "start", "end"))).alias("more"))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_email, n_ip, n_card, n_phone, base_sha256, spans (kind:start:end by kind, then start).

    Null and empty texts have no spans. Rows with equal ids and texts get equal results and stay separate rows; a null id
    stays null. Other columns are ignored; an empty table gives no rows. Whole texts are read, once.
    """
    base = materialise(extract(docs, id_col, text_col))
    more = discover(base).select(F.col("id").alias("more_id"), F.col("key").alias("more_key"), "more")
    rows = base.drop("found").join(more, base["id"].eqNullSafe(F.col("more_id")) & (base["key"] == F.col("more_key")), "left")
    place = F.array(*map(F.lit, KINDS))
    parts = F.filter(F.split("base", ","), lambda s: s != "")
    old = F.transform(parts, lambda s: F.struct((F.array_position(place, F.element_at(F.split(s, ":"), 1)) - 1).cast("int").alias("kind"), F.element_at(F.split(s, ":"), 2).cast("long").alias("start"), F.element_at(F.split(s, ":"), 3).cast("long").alias("end")))
    both = F.array_sort(F.concat(old, F.col("more")))
    text = F.array_join(F.transform(both, lambda s: F.concat_ws(":", F.element_at(place, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")
    return rows.select(F.col("id").alias(id_col), *(f"n_{k}" for k in KINDS), "base_sha256", F.when(F.col("more").isNull(), F.col("base")).otherwise(text).alias("spans"))


def masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each span replaced by its kind in brackets; of spans that overlap the first names the whole."""
    out, at, name = [], 0, ""
    for a, b, k in sorted((a, b, k) for k, a, b in spans):
        if a >= at or not name:
            out += [name, text[at:a]]
            name = f"[{KINDS[k].upper()}]"
            at = b
        else:
            at = max(at, b)
    return "".join([*out, name, text[at:]])


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", count_col: str = "n_chars") -> DataFrame:
    """The rows of docs, all columns, with base and discovered spans masked and n_chars, where there is such a column, counted anew.

    The discovered spans come in by a join whose smaller side Spark broadcasts only while it is under its own size limit. Null texts stay null,
    repeated rows stay repeated, names of docs cannot clash with those used here; an empty table gives no rows.
    """
    i, k, m = fresh_names(docs.columns, "more_id", "more_key", "more")
    more = materialise(discover(materialise(extract(docs, id_col, text_col))).toDF(i, k, m))
    key = F.xxhash64(F.coalesce(docs[text_col], F.lit("")))
    joined_ = docs.join(more, docs[id_col].eqNullSafe(F.col(i)) & (key == F.col(k)), "left").drop(i, k)
    column = docs.columns.index(text_col)
    count = docs.columns.index(count_col) if count_col in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = []
            for raw, more_ in zip(b.column(column).to_pylist(), b.column(b.num_columns - 1).to_pylist()):
                spans = base_spans(raw or "") + [(m["kind"], m["start"], m["end"]) for m in more_ or []]
                texts.append(masked(raw, spans) if spans else raw)
            cols = list(b.columns[:-1])
            cols[column] = pa.array(texts, pa.string())
            if count is not None:
                cols[count] = pa.array([None if t is None else len(t) for t in texts], cols[count].type)
            yield pa.RecordBatch.from_arrays(cols, docs_names)

    docs_names = docs.columns
    return joined_.mapInArrow(run, docs.schema)
