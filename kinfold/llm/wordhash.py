"""Words of Arrow text batches as hashes, computed with NumPy over the UTF-8 bytes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_SPACE, _WORD, _SYMBOL = 0, 1, 2
_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_P_INV = np.uint64(pow(int(_P), -1, 1 << 64))
_CLASS = np.full(256, _SYMBOL, np.uint8)
_CLASS[[9, 10, 11, 12, 13, 32]] = _SPACE
for _a, _b in ((48, 58), (65, 91), (97, 123), (128, 256)):
    _CLASS[_a:_b] = _WORD
_VALUE = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64)
_VALUE[65:91] = _VALUE[97:123]  # A-Z count as a-z
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_BREAK = np.zeros(256, bool)
_BREAK[[10, 33, 46, 63]] = True  # line feed ! . ?
_POWERS: dict[str, np.ndarray] = {}


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("p", ())) < n:
        m = max(n, 1 << 20)
        with np.errstate(over="ignore"):
            for name, base in (("p", _P), ("q", _P_INV)):
                x = np.full(m, base, np.uint64)
                x[0] = 1
                _POWERS[name] = np.cumprod(x, dtype=np.uint64)
    return _POWERS["p"][:n], _POWERS["q"][:n]


@dataclass
class Tokens:
    """Runs of word bytes and runs of symbols, in text order. start and end are byte places in the chunk."""

    rows: int
    hash: np.ndarray
    doc: np.ndarray
    symbol: np.ndarray
    capital: np.ndarray  # two capitals or more, and nothing but capitals or non-ASCII bytes
    sentence: np.ndarray  # number of sentence breaks before the token in the chunk
    start: np.ndarray
    end: np.ndarray
    data: np.ndarray
    offset: np.ndarray  # where each row begins in the chunk, one more than rows
    sums: np.ndarray  # running sums from which hashes of parts of words come

    def prefix(self, size: int) -> np.ndarray:
        """Hashes of each token's first bytes, so many at most."""
        with np.errstate(over="ignore"):
            part = self.sums[np.minimum(self.end, self.start + size)] - self.sums[self.start]
            return mix(part * _powers(len(self.sums))[1][self.start] + np.uint64(size))


def tokens(text: pa.Array, words_only: bool = False) -> Tokens:
    """Tokens of a (large) string array; null rows have none."""
    raw = text.cast(pa.large_binary())
    n = len(raw)
    ends = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + n + 1] if n else np.zeros(1, np.int64)
    data = np.frombuffer(raw.buffers()[2], np.uint8)[ends[0] : ends[-1]] if n and raw.buffers()[2] is not None else np.zeros(0, np.uint8)
    offset = ends - ends[0]
    size = len(data)
    kind = _CLASS[data]
    cut = np.ones(size + 1, bool)
    cut[1:size] = kind[1:] != kind[:-1]
    cut[offset] = True
    edge = np.flatnonzero(cut)
    start, end = edge[:-1], edge[1:]
    keep = kind[start] == _WORD if words_only else kind[start] != _SPACE
    start, end = start[keep], end[keep]
    with np.errstate(over="ignore"):
        p, q = _powers(size + 1)
        total = np.zeros(size + 1, np.uint64)
        np.cumsum(_VALUE[data] * p[:size], out=total[1:])
        h = mix((total[end] - total[start]) * q[start])
    upper = np.r_[0, np.cumsum(_UPPER[data] | (data >= 128), dtype=np.int32)]
    strict = np.r_[0, np.cumsum(_UPPER[data], dtype=np.int32)]
    capital = ((upper[end] - upper[start]) == end - start) & ((strict[end] - strict[start]) >= 2)
    breaks = np.r_[0, np.cumsum(_BREAK[data], dtype=np.int32)]
    doc = np.searchsorted(offset, start, "right") - 1
    return Tokens(n, h, doc, kind[start] == _SYMBOL, capital, breaks[start], start, end, data, offset, total)


def code_points(t: Tokens, at: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Places within their documents, in code points, of byte places in the chunk."""
    whole = np.r_[0, np.cumsum((t.data & 0xC0) != 0x80, dtype=np.int64)]
    return whole[at] - whole[t.offset[doc]]


def chunks(batch: pa.RecordBatch, column: int, target: int = 1 << 19) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Slices of about so many bytes of text (one row at least), with the text column as large strings."""
    text = batch.column(column).cast(pa.large_string())
    n = len(text)
    size = np.diff(np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + n + 1]) if n else np.zeros(0, np.int64)
    at = np.flatnonzero(np.diff(np.cumsum(size) // target)) + 1
    cuts = [0, *at.tolist(), n]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a), text.slice(a, b - a)
