"""Quality classifier: hashed word n-gram logistic regression trained by follow-the-regularised-leader."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.llm import labelled
from kinfold.llm.wordhash import Tokens, chunks, mix, tokens

BUCKETS = 1 << 18
#: Labelled documents of each class that training reads at most.
PER_CLASS = 2500
SCALE = 16.0


def features(t: Tokens) -> tuple[np.ndarray, np.ndarray]:
    """(document, bucket) of all n-grams: words, word pairs, and pairs of word forms.

    A form says symbol or word, all capitals or not, and whether the token is that of one or two places before.
    """
    h, d = t.hash, t.doc
    same = np.zeros(len(h), np.uint64)
    for back in (2, 1):
        if len(h) > back:
            same[back:][(h[back:] == h[:-back]) & (d[back:] == d[:-back])] = back
    form = same * np.uint64(4) + t.capital.astype(np.uint64) * np.uint64(2) + t.symbol.astype(np.uint64)
    pair = d[1:] == d[:-1]
    with np.errstate(over="ignore"):
        two = mix(h[:-1] * np.uint64(3) + h[1:])[pair]
        forms = mix(form[:-1] * np.uint64(16) + form[1:] + np.uint64(1 << 40))[pair]
    shift = np.uint64(64 - 18)
    return np.concatenate([d, d[1:][pair], d[1:][pair]]), (np.concatenate([h, two, forms]) >> shift).astype(np.int64)


def vectors(t: Tokens) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each document, its distinct buckets and their shares of all its n-grams, times SCALE."""
    d, b = features(t)
    key, n = np.unique(d * BUCKETS + b, return_counts=True)
    total = np.bincount(d, minlength=t.rows)
    cut = np.searchsorted(key, np.arange(t.rows + 1) * BUCKETS)
    return [(key[i:j] - k * BUCKETS, n[i:j] * (SCALE / max(1, total[k]))) for k, (i, j) in enumerate(zip(cut, cut[1:]))]


def train_ftrl(rows: list[tuple[int, np.ndarray, np.ndarray]], epochs: int = 5, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.1) -> tuple[np.ndarray, float]:
    """Weights and bias by FTRL-proximal over (label, buckets, values); the classes count alike. Without rows all weights are zero."""
    z, n = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)
    ones = sum(y for y, _, _ in rows)
    share = {1: len(rows) / (2 * ones) if ones else 1.0, 0: len(rows) / (2 * (len(rows) - ones)) if len(rows) > ones else 1.0}

    def weights(i):
        w = -(z[i] - np.sign(z[i]) * l1) / ((beta + np.sqrt(n[i])) / alpha + l2)
        return np.where(np.abs(z[i]) <= l1, 0.0, w)

    order = np.random.default_rng(11)
    for _ in range(epochs):
        for k in order.permutation(len(rows)):
            y, b, v = rows[k]
            i, x = np.append(b, BUCKETS), np.append(v, 1.0)
            w = weights(i)
            p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
            g = (p - y) * x * share[y]
            s = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha
            z[i] += g - s * w
            n[i] += g * g
    w = weights(np.arange(BUCKETS + 1))
    return w[:-1].astype(np.float32), float(w[-1])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for part, text in chunks(b, 2):
            got = vectors(tokens(text))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([x.astype(np.int32) for x, _ in got], pa.list_(pa.int32())), pa.array([x.astype(np.float32) for _, x in got], pa.list_(pa.float32()))], ["id", "y", "bucket", "value"])


def train(docs: DataFrame, labels: DataFrame, train_rows, label: str = "quality", per_class: int = PER_CLASS, id_col: str = "doc_id", text_col: str = "text") -> tuple[np.ndarray, float]:
    rows = labelled.sample(docs, labels, label, train_rows, per_class, id_col, text_col)
    kind = docs.schema[id_col].dataType.simpleString()
    got = rows.mapInArrow(_rows, f"id {kind}, y int, bucket array<int>, value array<float>").toArrow()
    table = sorted(zip(got["id"].to_pylist(), got["y"].to_pylist(), got["bucket"], got["value"]), key=lambda r: (str(r[0]), len(r[2])))
    return train_ftrl([(int(y), b.values.to_numpy().astype(np.int64), v.values.to_numpy().astype(np.float64)) for _, y, b, v in table])


def _score(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = model.value
        for b in batches:
            for part, text in chunks(b, 1):
                d, bucket = features(tokens(text))
                total = np.bincount(d, minlength=len(part))
                dot = np.bincount(d, weights=weights[bucket], minlength=len(part)) * SCALE / np.maximum(total, 1)
                p = 1 / (1 + np.exp(-np.clip(dot + bias, -35, 35)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(p)], ["id", "score"])

    return run


def score(docs: DataFrame, model: tuple[np.ndarray, float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) for every row: the logistic of the sparse dot product of weights and n-gram shares.

    Null and empty texts have no n-grams and get the logistic of the bias. Whole texts count, whatever their length. Repeated rows and
    null ids are scored like any other; an empty table gives no rows; other columns are ignored. The model is a fixed 1 MB.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(lambda it: _score(sent)(it), f"id {kind}, score double").withColumnRenamed("id", id_col)
