"""Near duplicates of the pipeline's stage against all pairs."""

import random

import numpy as np
import pytest

pytest.importorskip("kinfold.llm")

import corpus_pipeline  # noqa: E402
from kinfold.llm import shingles  # noqa: E402

from test_operators import ODD, components, docs  # noqa: E402


def brute_set(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def near_copies(rng, n=60):
    rows = []
    for k in range(n):
        words = [rng.choice("abcdefghijklmnop") + str(rng.randint(0, 400)) for _ in range(rng.randint(40, 160))]
        rows.append(" ".join(words))
        for _ in range(rng.randint(0, 3)):
            own = list(words)
            for at in rng.sample(range(len(own)), rng.randint(1, max(1, len(own) // 40))):
                own[at] = "changed"
            rows.append(" ".join(own))
    return rows


def test_near_copies_from_similarity_080_are_found(spark):
    rng = random.Random(11)
    texts = near_copies(rng) + ["passage of many texts stands here in front " + t for t in near_copies(rng, 40)]
    rows = [(i, t) for i, t in enumerate(texts)]
    sets = [brute_set(t) for t in texts]
    near = {(i, j): s for i in range(len(sets)) for j in range(i) if (s := jaccard(sets[i], sets[j])) >= 0.6}
    assert sum(0.8 <= s < 0.9 for s in near.values()) >= 10 and sum(s < 0.8 for s in near.values()) >= 10
    root = components(len(sets), lambda i: [j for j in range(i) if near.get((i, j), 0) >= 0.8])
    least = {}
    for i, k in enumerate(root):
        least[k] = min(least.get(k, i), i)
    got = corpus_pipeline.drop_near_duplicates(spark, docs(spark, rows), "")
    assert sorted(r.doc_id for r in got.collect()) == sorted(least.values())


def test_groups_have_all_pairs_and_odd_rows_stay(spark):
    key = np.repeat(np.arange(3), [2, 40, 1])
    sid, at, maps = np.arange(43), np.full(43, 10 << 32), shingles.Maps([b"\1" * 128] * 43)
    assert len(shingles.star_pairs(key, at, sid)[0]) == 1 + 39
    assert len(shingles.part_pairs(key, at, sid, sid, maps)[0]) == 1 + 40 * 39 // 2
    assert len(shingles.part_pairs(key, at, sid, np.zeros(43), maps)[0]) == 0
    assert len(shingles.part_pairs(key, at, sid, sid % 3, maps, True)[0]) == 1 + 3
    tree = shingles.part_forest(key, at, sid, sid, maps)
    assert len(tree[0]) == 42 and np.sum(tree[2] != tree[4]) == 1 + 39 and set(tree[6]) == {0, 2}
    assert len(shingles.part_forest(key, at, sid, np.zeros(43), maps)[0]) == 0
    kept = shingles.keep_one(docs(spark, ODD)).collect()
    assert sorted((r.doc_id, r.text) for r in kept if r.doc_id) == sorted([(1, None), (4, "one"), (4, "two"), (5, ODD[8][1]), (6, ODD[9][1])], key=lambda x: x[0])
    assert shingles.keep_one(docs(spark, [])).count() == 0


def test_a_bitmap_never_bounds_the_overlap_too_low():
    import pyarrow as pa

    rng = np.random.default_rng(5)
    pool = rng.integers(0, 1 << 63, 9000).astype(np.uint64)
    for size in (1, 50, 400, 1000, 6000):
        x, y = np.unique(pool[:size]), np.unique(pool[size // 10 : size + size // 10])
        cols = [pa.array([1]), pa.array([2]), pa.array([len(x)]), pa.array([shingles.bitmap(x, shingles.map_size(len(x)))]), pa.array([len(y)]), pa.array([shingles.bitmap(y, shingles.map_size(len(y)))])]
        maps = shingles.Maps([c.to_pylist()[0] for c in (cols[3], cols[5])])
        assert shingles._most(np.array([len(x), len(y)]) << 32, maps, 0, np.array([1]))[0] >= len(np.intersect1d(x, y))
        out = list(shingles._possible([pa.RecordBatch.from_arrays(cols, list("abnxmy"))]))
        assert len(out[0]) == 1 or not shingles.alike(len(np.intersect1d(x, y)), len(x), len(y))


def test_rows_are_kept_if_a_partner_fits():
    gram, at = np.array([1, 1, 1, 2, 2]), np.array([100 << 32, (100 << 32) + 16, 90 << 32, 100 << 32, 50 << 32])
    assert shingles.paired(gram, at, np.arange(5), np.arange(5)).tolist() == [True, False, True, False, False]
    assert shingles.paired(gram, at, np.arange(5), np.zeros(5)).tolist() == [False] * 5
    rng = np.random.default_rng(3)
    gram = np.repeat(np.arange(40), rng.integers(1, 80, 40))
    n = len(gram)
    at, part = (rng.integers(50, 90, n) << 32) + rng.integers(0, 12, n), rng.integers(0, 4, n)
    brute = [bool(((gram == gram[i]) & (part != part[i]) & shingles._fits(at, np.full(n, i), np.arange(n))).any()) for i in range(n)]
    assert shingles.paired(gram, at, np.arange(n), part).tolist() == brute
