"""Contexts of the second hop and occurrences outside contexts."""

import pytest

pytest.importorskip("kinfold.llm")

from kinfold.llm import pii  # noqa: E402

from test_operators import docs  # noqa: E402


def test_second_hop_contexts_and_every_occurrence(spark):
    rows = [(i, f"text {i} please write mail to user{i}@host{i}.example.com today") for i in range(40)]
    rows += [(100 + i, f"please write mail to inner{i}@localhost today") for i in range(6)]
    rows += [(200 + i, f"our desk account is inner{i}@localhost for now") for i in range(6)]
    rows += [(300, "our desk account is outer77@localhost for now"), (301, "elsewhere outer77@localhost stands alone"), (302, "outer77@localhost"), (303, "code 12345678 stays")]
    clean = {r.doc_id: r.text for r in pii.redact(docs(spark, rows)).collect()}
    assert clean[300] == "our desk account is [EMAIL] for now"
    assert clean[301] == "elsewhere [EMAIL] stands alone" and clean[302] == "[EMAIL]"
    assert clean[303] == rows[-1][1]
    assert all("localhost" not in t for t in clean.values())
