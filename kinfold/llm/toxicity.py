"""Toxicity: a linear-chain conditional random field tags toxic words; their marginals make document scores and spans."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.llm import labelled
from kinfold.llm.memory import driver_gives_back, give_back, given_back
from kinfold.llm.wordhash import Tokens, chunks, code_points, mix, tokens

BITS = 20
#: Labelled documents of each class that training reads at most.
PER_CLASS = 1500
#: Chains longer than this are worked off block by block, with the same result.
LONG = 256
#: Bytes of the word beginnings that are features of a word.
STEMS = (4, 6)
#: A word or a beginning is tagged in training if this share of the texts with it, at least, is toxic, and if it follows so many different
#: words there that chance would not leave one such word in CHANCE vocabularies.
LEAST_SHARE, CHANCE = 0.97, 10.0


@dataclass
class Model:
    weight: np.ndarray  # the toxic state's score for each hashed feature
    bias: float
    capital: float  # of words of capitals
    move: np.ndarray  # 2 x 2, from state to state
    level: tuple[float, float]  # document score: logistic of level[0] + level[1] * log(1 + 20 * evidence)

    def score(self, at: list[np.ndarray], capital: np.ndarray) -> np.ndarray:
        out = np.full(len(capital), self.bias) + self.capital * capital
        for i in at:
            out += self.weight[i]
        return out


@dataclass
class Words:
    """Words of some documents in text order."""

    doc: np.ndarray
    sentence: np.ndarray
    word: np.ndarray
    stems: list[np.ndarray]
    capital: np.ndarray

    def features(self) -> list[np.ndarray]:
        """Buckets of each word's features: the word at two places, so that one which shares a single place with a toxic word gets half its score;
        its beginnings; the words before and after it in the document."""
        h, top = self.word, np.uint64(64 - BITS)
        same = self.doc[1:] == self.doc[:-1] if len(h) else np.zeros(0, bool)
        before, after = np.zeros(len(h), np.uint64), np.zeros(len(h), np.uint64)
        before[1:] = np.where(same, h[:-1], 0)
        after[:-1] = np.where(same, h[1:], 0)
        with np.errstate(over="ignore"):
            wide = [h, *self.stems, mix(before + np.uint64(1)), mix(after + np.uint64(2))]
        return [(h & np.uint64((1 << BITS) - 1)).astype(np.int32), *((x >> top).astype(np.int32) for x in wide)]


#: Shares of the log odds that a feature starts training with, in the order of features().
_START = (0.25, 0.25, *(0.35 for _ in STEMS), 0.0, 0.0)


def words_of(t: Tokens) -> Words:
    return Words(t.doc, t.sentence, t.hash, [t.prefix(k) for k in STEMS], t.capital)


def chains(doc: np.ndarray, sentence: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First word and length of each chain, over words in text order."""
    n = len(doc)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = np.r_[True, (doc[1:] != doc[:-1]) | (sentence[1:] != sentence[:-1])]
    begin = np.flatnonzero(new)
    return begin, np.diff(np.r_[begin, n])


def long_chain(score: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """forward_backward() of one chain. Its blocks of LONG words advance side by side, from either state that may come in and to either that may go
    out; then the blocks are joined one after the other."""
    none, n = -1e30, len(score)
    blocks = -(-n // LONG)
    s = np.r_[score, np.zeros(blocks * LONG - n)].reshape(blocks, LONG)
    real = np.arange(blocks * LONG).reshape(blocks, LONG) < n
    add = np.stack([np.zeros_like(s), s], axis=-1)  # score by state
    ahead, back = np.empty((blocks, LONG, 2, 2)), np.empty((blocks, LONG, 2, 2))
    ahead[:, 0] = move[None] + add[:, 0, None, :]
    ahead[0, 0] = [[0.0, score[0]], [none, none]]
    for t in range(1, LONG):
        step = np.logaddexp(ahead[:, t - 1, :, :1] + move[0], ahead[:, t - 1, :, 1:] + move[1]) + add[:, t, None, :]
        ahead[:, t] = np.where(real[:, t, None, None], step, ahead[:, t - 1])
    back[:, -1] = [[0.0, none], [none, 0.0]]
    for t in range(LONG - 2, -1, -1):
        after = add[:, t + 1, :, None] + back[:, t + 1]  # by the next state and the last one
        step = np.logaddexp(move[:, 0, None] + after[:, :1], move[:, 1, None] + after[:, 1:])
        back[:, t] = np.where(real[:, t + 1, None, None], step, back[:, t + 1])
    come, go = np.zeros((blocks + 1, 2)), np.zeros((blocks, 2))
    come[0] = [0.0, none]
    for k in range(blocks):
        come[k + 1] = np.logaddexp(come[k, 0] + ahead[k, -1, 0], come[k, 1] + ahead[k, -1, 1])
    for k in range(blocks - 2, -1, -1):
        later = add[k + 1, 0] + np.logaddexp(back[k + 1, 0, :, 0] + go[k + 1, 0], back[k + 1, 0, :, 1] + go[k + 1, 1])
        go[k] = np.logaddexp(move[:, 0] + later[0], move[:, 1] + later[1])
    z = float(np.logaddexp(*come[-1]))
    a = np.logaddexp(come[:-1, None, 0, None] + ahead[:, :, 0], come[:-1, None, 1, None] + ahead[:, :, 1]).reshape(-1, 2)[:n]
    b = np.logaddexp(back[..., 0] + go[:, None, 0, None], back[..., 1] + go[:, None, 1, None]).reshape(-1, 2)[:n]
    moves = np.exp(a[:-1, :, None] + move + (b[1:] + add.reshape(-1, 2)[1:n])[:, None, :] - z).sum(axis=0)
    return np.exp(a[:, 1] + b[:, 1] - z), moves, z


def forward_backward(score: np.ndarray, first: np.ndarray, size: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Marginals of the toxic state, expected moves (2 x 2) and the sum of log partition functions.

    score: of the toxic state at each word; the clean state has 0. Chains up to LONG advance together, the longest first, so that step t
    touches the chains with more than t words; a longer one advances in all of its blocks at once.
    """
    if (size > LONG).any():
        few = size <= LONG
        marginal, moves, total = np.zeros(len(score)), np.zeros((2, 2)), 0.0
        rest = np.concatenate([np.zeros(0, np.int64), *(np.arange(i, i + n) for i, n in zip(first[few], size[few]))])
        if len(rest):
            marginal[rest], moves, total = forward_backward(score[rest], np.cumsum(size[few]) - size[few], size[few], move)
        for i, n in zip(first[~few].tolist(), size[~few].tolist()):
            marginal[i : i + n], own, z = long_chain(score[i : i + n], move)
            moves, total = moves + own, total + z
        return marginal, moves, total
    order = np.argsort(-size, kind="stable")
    first, size = first[order], size[order]
    live = [int(x) for x in np.searchsorted(-size, -np.arange(size[0] if len(size) else 0), "left")]
    a0, a1 = np.zeros(len(score)), np.zeros(len(score))
    b0, b1 = np.zeros(len(score)), np.zeros(len(score))
    for t, m in enumerate(live):
        i = first[:m] + t
        if t == 0:
            a1[i] = score[i]
        else:
            p0, p1 = a0[i - 1], a1[i - 1]
            a0[i] = np.logaddexp(p0 + move[0, 0], p1 + move[1, 0])
            a1[i] = np.logaddexp(p0 + move[0, 1], p1 + move[1, 1]) + score[i]
    for t in range(len(live) - 1, 0, -1):
        i = first[: live[t]] + t
        n0, n1 = b0[i], b1[i] + score[i]
        b0[i - 1] = np.logaddexp(move[0, 0] + n0, move[0, 1] + n1)
        b1[i - 1] = np.logaddexp(move[1, 0] + n0, move[1, 1] + n1)
    last = first + size - 1
    z = np.logaddexp(a0[last], a1[last])
    whole = np.zeros(len(score))
    for t, m in enumerate(live):
        whole[first[:m] + t] = z[:m]
    marginal = np.exp(a1 + b1 - whole)
    inner = np.ones(len(score), bool)
    inner[first] = False
    k = np.flatnonzero(inner)
    moves = np.array([[np.exp(a[k - 1] + move[x, y] + b[k] + y * score[k] - whole[k]).sum() for y, b in ((0, b0), (1, b1))] for x, a in ((0, a0), (1, a1))])
    return marginal, moves, float(z.sum())


def by_blocks(score: np.ndarray, first: np.ndarray, size: np.ndarray, move: np.ndarray, words: int = 1 << 17) -> tuple[np.ndarray, np.ndarray]:
    """forward_backward() over blocks of whole chains, so that its working arrays stay small. first is in text order."""
    marginal, moves = np.zeros(len(score)), np.zeros((2, 2))
    cuts = np.unique(np.r_[0, np.searchsorted(first, np.arange(words, len(score), words)), len(first)])
    for i, j in zip(cuts, cuts[1:]):
        lo, hi = first[i], first[j - 1] + size[j - 1]
        marginal[lo:hi], m, _ = forward_backward(score[lo:hi], first[i:j] - lo, size[i:j], move)
        moves += m
    return marginal, moves


def tagged(units: np.ndarray, word: np.ndarray, doc: np.ndarray, toxic: np.ndarray, base: float) -> np.ndarray:
    """Of the units (words, or beginnings of words) those that stand almost only in toxic texts and there after many different words. word: numbers of the words."""
    names, unit = np.unique(units, return_inverse=True)
    unit, n = unit.astype(np.int32), len(names)
    pairs = np.unique(doc.astype(np.int64) * n + unit)
    every = np.bincount(pairs % n, minlength=n)
    bad = np.bincount((pairs % n)[toxic[pairs // n]], minlength=n)
    del pairs
    follows = np.flatnonzero((doc[1:] == doc[:-1]) & toxic[doc[1:]]) + 1
    many = int(word.max()) + 1
    support = np.bincount(np.unique(unit[follows].astype(np.int64) * many + word[follows - 1]) // many, minlength=n)
    return names[(bad > 0) & (bad >= LEAST_SHARE * every) & (support >= np.log(CHANCE * n) / -np.log(base))]


def gold_tags(w: Words, toxic: np.ndarray) -> np.ndarray:
    """Token labels from document labels: the words of toxic texts that are tagged themselves or begin like many that are.

    Each text counts once, however many copies there are; near copies repeat a word in the same place and so add no support to it. A beginning tells of
    words that each are too rare to tell by themselves.
    """
    cut = np.searchsorted(w.doc, np.arange(len(toxic) + 1))
    seen: set = set()
    once = np.zeros(len(toxic), bool)
    for d, (i, j) in enumerate(zip(cut, cut[1:])):
        key = (bool(toxic[d]), hashlib.sha256(w.word[i:j].tobytes()).digest())
        once[d] = j > i and key not in seen
        seen.add(key)
    k = np.flatnonzero(once[w.doc])
    if not len(k) or not toxic[w.doc[k]].any():
        return np.zeros(len(w.word), bool)
    base = min(0.9, max(1e-3, float(toxic[w.doc[k]].mean())))
    out = np.zeros(len(w.word), bool)
    number = np.unique(w.word[k], return_inverse=True)[1].astype(np.int32)
    for unit in (w.word, *w.stems):
        out |= np.isin(unit, tagged(unit[k], number, w.doc[k], toxic, base))
    return out & toxic[w.doc]


def untrained() -> Model:
    """What there is without a word to learn from."""
    return Model(np.zeros(1 << BITS, np.float32), -8.0, 0.0, np.zeros((2, 2)), (-4.0, 1.0))


def train_crf(w: Words, toxic: np.ndarray, steps: int = 20, rate: float = 0.2, decay: float = 1e-4) -> Model:
    """Fits the field to tagged words by full-gradient Adagrad from smoothed log odds, then the document level. toxic: of each document."""
    width = 1 << BITS
    if not len(toxic) or not len(w.word):
        return untrained()
    gold = gold_tags(w, toxic)
    first, size = chains(w.doc, w.sentence)
    at = w.features()
    r = min(0.5, (gold.sum() + 1e-3) / (len(gold) + 1))
    start = float(np.log(r / (1 - r)))
    weight = np.zeros(width)
    for i, share in zip(at, _START):
        if share:
            n, g = np.bincount(i, minlength=width), np.bincount(i[gold], minlength=width)
            weight += share * (np.log((g + r) / (n - g + 1 - r)) - start)
    model = Model(weight, start, 0.0, np.zeros((2, 2)), (0.0, 1.0))
    inner = np.ones(len(gold), bool)
    inner[first] = False
    k = np.flatnonzero(inner)
    seen = np.array([[np.sum((gold[k - 1] == x) & (gold[k] == y)) for y in (0, 1)] for x in (0, 1)], float)
    sums = [np.full(width, 1e-8), 1e-8, 1e-8, np.full((2, 2), 1e-8)]
    each = 1.0 / max(1, gold.sum())
    for _ in range(steps):
        marginal, moves = by_blocks(model.score(at, w.capital), first, size, model.move)
        off = (marginal - gold) * each
        grad = decay * each * model.weight
        for i in at:
            grad += np.bincount(i, weights=off, minlength=width)
        grads = [grad, off.sum(), off[w.capital].sum(), (moves - seen) * each]
        for j, g in enumerate(grads):
            sums[j] = sums[j] + g * g
        model.weight = model.weight - rate * grads[0] / np.sqrt(sums[0])
        model.bias -= rate * grads[1] / np.sqrt(sums[1])
        model.capital -= rate * grads[2] / np.sqrt(sums[2])
        model.move = model.move - rate * grads[3] / np.sqrt(sums[3])
    marginal, _ = by_blocks(model.score(at, w.capital), first, size, model.move)
    x = _evidence(w.doc, marginal, len(toxic))
    share = np.where(toxic, 0.5 / max(1, toxic.sum()), 0.5 / max(1, (~toxic).sum()))
    k0, k1 = -1.0, 1.0
    for _ in range(400):  # Newton steps on two numbers, damped
        p = 1 / (1 + np.exp(-np.clip(k0 + k1 * x, -35, 35)))
        g = np.array([(share * (p - toxic)).sum(), (share * (p - toxic) * x).sum() + 1e-3 * k1])
        q = share * p * (1 - p)
        hess = np.array([[q.sum() + 1e-6, (q * x).sum()], [(q * x).sum(), (q * x * x).sum() + 1e-3]])
        d = np.linalg.solve(hess, g)
        k0, k1 = k0 - 0.5 * d[0], k1 - 0.5 * d[1]
    model.weight, model.level = model.weight.astype(np.float32), (float(k0), float(k1))
    return model


def _evidence(doc: np.ndarray, marginal: np.ndarray, rows: int) -> np.ndarray:
    """Of each document the sum of its words' squared marginals, on a log scale: the background of a long text fades, no word is left out."""
    return np.log1p(20 * np.bincount(doc, weights=marginal * marginal, minlength=rows))


_ROW = "word array<bigint>, sentence array<int>, capital array<boolean>, " + ", ".join(f"stem{k} array<int>" for k in STEMS)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for part, text in chunks(b, 2):
            t = tokens(text, words_only=True)
            w = words_of(t)
            cut = pa.array(np.searchsorted(t.doc, np.arange(t.rows + 1)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(cut, pa.array(v)) for v in (w.word.view(np.int64), w.sentence, w.capital, *((x >> np.uint64(32)).astype(np.uint32).view(np.int32) for x in w.stems))]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *lists], ["id", "y", "word", "sentence", "capital", *(f"stem{k}" for k in STEMS)])


_MODEL = "weight binary, bias double, capital double, move array<double>, level array<double>"


def _fitted(got: pa.Table) -> pa.Table:
    """The model of all training rows, as one row of _MODEL. They are put in order by id, so that sums do not depend on how rows arrive."""
    got = got.append_column("n", pa.compute.list_value_length(got["word"]))
    got = got.take(pa.compute.sort_indices(got.select(["id", "n"]), sort_keys=[("id", "ascending"), ("n", "ascending")]))
    toxic = got["y"].to_numpy() == 1
    doc = np.repeat(np.arange(len(toxic), dtype=np.int32), got["n"].to_numpy())
    got = got.select(["word", "sentence", "capital", *(f"stem{k}" for k in STEMS)])
    flat = {}
    for name in got.column_names:  # a column leaves the table as soon as it is an array
        flat[name] = got[name].combine_chunks().flatten().to_numpy(zero_copy_only=False)
        got = got.drop_columns([name])
    stems = [flat[f"stem{k}"].view(np.uint32).astype(np.uint64) << np.uint64(32) for k in STEMS]  # the upper half is enough for places and names
    words = Words(doc, flat["sentence"], flat["word"].view(np.uint64), stems, flat["capital"].astype(bool))
    del doc, flat, stems
    m = train_crf(words, toxic)
    del words
    give_back()
    lists = [pa.array([x], pa.list_(pa.float64())) for x in (m.move.ravel().tolist(), list(m.level))]
    return pa.Table.from_arrays([pa.array([m.weight.tobytes()], pa.binary()), pa.array([m.bias], pa.float64()), pa.array([m.capital], pa.float64()), *lists], ["weight", "bias", "capital", "move", "level"])


def train(docs: DataFrame, labels: DataFrame, train_rows, label: str = "toxic", per_class: int = PER_CLASS, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """The model of at most per_class labelled documents of each class; of rows with one id all texts count, as one label's.

    One task trains, on an executor: its working arrays are many times the sample, and the driver gets the finished model only, of 4 MB.
    """
    rows = labelled.sample(docs, labels, label, train_rows, per_class, id_col, text_col).withColumn("id", F.col("id").cast("string"))
    words = rows.mapInArrow(given_back(_rows), f"id string, y int, {_ROW}")
    got = words.groupBy(F.lit(0).alias("all")).applyInArrow(_fitted, _MODEL).collect()
    driver_gives_back(docs.sparkSession)
    if not got:  # no labelled row
        return untrained()
    m = got[0]
    return Model(np.frombuffer(m.weight, np.float32), m.bias, m.capital, np.array(m.move).reshape(2, 2), tuple(m.level))


def tag(t: Tokens, m: Model) -> tuple[np.ndarray, np.ndarray]:
    """(score of each document, marginal of each word)."""
    first, size = chains(t.doc, t.sentence)
    w = words_of(t)
    marginal = forward_backward(m.score(w.features(), w.capital), first, size, m.move)[0] if len(t.hash) else np.zeros(0)
    x = _evidence(t.doc, marginal, t.rows)
    return 1 / (1 + np.exp(-np.clip(m.level[0] + m.level[1] * x, -35, 35))), marginal


def _spans(t: Tokens, marginal: np.ndarray) -> list[list[dict]]:
    out: list[list[dict]] = [[] for _ in range(t.rows)]
    k = np.flatnonzero(marginal > 0.5)
    doc = t.doc[k]
    for d, a, b, p in zip(doc.tolist(), code_points(t, t.start[k], doc).tolist(), code_points(t, t.end[k], doc).tolist(), marginal[k].tolist()):
        out[d].append({"start": a, "end": b, "p": p})
    return out


def _score(model):
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("p", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for b in batches:
            for part, text in chunks(b, 1):
                t = tokens(text, words_only=True)
                p, marginal = tag(t, m)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(p), pa.array(_spans(t, marginal), span)], ["id", "score", "spans"])

    return run


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, spans) for every row; spans are the words whose toxic marginal is over one half, in code points, end exclusive.

    Null and empty texts have no words, no spans and the score of no evidence. Whole texts count, whatever their length. Repeated
    rows and null ids are scored like any other; an empty table gives no rows; other columns are ignored. The model is a fixed 4 MB.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(model)
    shape = f"id {kind}, score double, spans array<struct<start:long,end:long,p:double>>"
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(lambda it: _score(sent)(it), shape).withColumnRenamed("id", id_col)


def keep_clean(docs: DataFrame, model: Model, at: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, whose score is under `at`. Nothing is shuffled; null and empty texts stay."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    column = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, text in chunks(b, column):
                yield part.filter(pa.array(tag(tokens(text, words_only=True), sent.value)[0] < at))

    return docs.mapInArrow(given_back(run), docs.schema)
