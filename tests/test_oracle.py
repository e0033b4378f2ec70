"""Registered queries against their SQL twins in DuckDB."""

import math
import importlib.util
import sys

import pytest

duckdb = pytest.importorskip("duckdb")

import __spark_entry__ as entry  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SKIP = {"components_bipartite", "monte_carlo_census", "bootstrap_effect_hash", "sign_randomisation_hash", "tfidf_cosine", "set_overlap", "cluster_bootstrap"}  # slow; compared by the driver


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9) + 0.0)
    return v if v is None or isinstance(v, (str, bool)) else str(v)


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(set(entry.oracle_sql()) - SKIP))
def test_query_equals_its_sql(spark, sf, con, name):
    df = entry.queries()[name](spark, sf)
    got = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted((tuple(plain(v) for v in r) for r in got.fetchall()), key=repr)
    assert sorted((tuple(plain(v) for v in r) for r in df.select(*names).collect()), key=repr) == want


def test_entry_and_guard(spark, monkeypatch):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


    for m in [m for m in sys.modules if m.startswith("kinfold.llm")]:
        monkeypatch.delitem(sys.modules, m)
    monkeypatch.delitem(sys.modules, "corpus_pipeline", raising=False)
    monkeypatch.setitem(sys.modules, "kinfold.llm", None)
    bare = importlib.util.module_from_spec(importlib.util.find_spec("__spark_entry__"))
    bare.__spec__.loader.exec_module(bare)
    assert not any(k.startswith("op") for k in bare.queries()) and "pipeline" not in bare.queries() and len(bare.queries()) > 50
