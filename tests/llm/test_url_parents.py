"""Host and parent edges."""

import pytest

pytest.importorskip("kinfold.llm")

from kinfold.llm import urls  # noqa: E402


def test_sub_domains_have_edges_to_a_parent_of_one_dot(spark):
    edges = urls.host_edges(spark.createDataFrame([("www.foo.com", ""), ("foo.com", ""), ("com", ""), ("www.bar.com", "")], "host string, html string"))
    assert sorted((r.src, r.dst) for r in edges.collect()) == [("foo.com", "www.foo.com"), ("www.foo.com", "foo.com")]
