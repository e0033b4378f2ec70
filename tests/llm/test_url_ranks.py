"""Ranks over long ways, and against a solved linear system."""

import random

import pytest

pytest.importorskip("kinfold.llm")

from kinfold.llm import urls  # noqa: E402

PAGES = "page_id long, url string, html string"


def test_ranks_are_followed_to_the_end(spark):
    hosts = [f"h{i}.net" for i in range(31)] + ["bad.com"]
    rows = [(i, f"http://{h}/", f'<a href="http://{hosts[i + 1]}/">' if i < 31 else None) for i, h in enumerate(hosts)] + [(99, "http://bad.com/de/1", None)]
    got = {r.page_id: r for r in urls.judge(spark.createDataFrame(rows, PAGES)).collect()}
    assert all(got[i].verdict == "block" for i in range(31))
    assert abs(got[0].distrust - 0.15 * 0.85**31 / (1 - 0.85**32)) < 1e-9
    assert got[30].distrust > got[12].distrust > got[11].distrust


def test_a_blocked_parent_reaches_its_sub_domains(spark):
    rows = [(1, "http://example.com/de/1", None), (2, "http://www.example.com/x", None), (3, "http://b.example.com/de/", None), (4, "http://a.b.example.com/", None), (5, "http://net/", None), (6, "http://x.net/", None)]
    got = {r.page_id: r for r in urls.judge(spark.createDataFrame(rows, PAGES)).collect()}
    assert [got[i].verdict for i in (1, 2, 3, 4, 5, 6)] == ["block", "block", "block", "block", "allow", "allow"]
    assert got[2].distrust > 0 and got[4].distrust > 0


def test_ranks_equal_the_solved_system(spark):
    import numpy as np

    rng = random.Random(9)
    n = 12
    links = {(i, j): rng.randint(1, 3) for i in range(n - 2) for j in range(n) if i != j and rng.random() < 0.2}
    edges = spark.createDataFrame([(f"h{i}", f"h{j}", float(k)) for (i, j), k in links.items()], "src string, dst string, n double")
    seeds = [(f"h{i}", float(i % 3), float(i % 2)) for i in range(n)]
    got = {r.host: r for r in urls.propagate(edges, spark.createDataFrame(seeds, "host string, trust double, distrust double")).collect()}
    for side, name in enumerate(("trust", "distrust")):
        start = np.array([s[1 + side] for s in seeds])
        start /= start.sum()
        move = np.zeros((n, n))
        for (i, j), k in links.items():
            a, b = (i, j) if side == 0 else (j, i)
            move[b, a] += k
        own = move.sum(axis=0)
        move = np.where(own > 0, move / np.where(own > 0, own, 1), start[:, None])  # a host without links restarts
        want = np.linalg.solve(np.eye(n) - 0.85 * move, 0.15 * start)
        assert np.allclose(want, [got[f"h{i}"][name] if f"h{i}" in got else 0.0 for i in range(n)], atol=1e-8)
