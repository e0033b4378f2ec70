"""Lines without licence words, and licence words without a notice's."""

import pytest

pytest.importorskip("kinfold.llm")

from kinfold.llm import licences  # noqa: E402

from test_operators import docs  # noqa: E402


def test_licences_without_licence_words_and_unknown_lines(spark):
    rows = [(1, "Released under Apache 2.0"), (2, "Code under GPL-3.0 or later"), (3, "Dedicated under CC0 1.0"), (4, "MPL-2.0"), (5, "Copyright 2021 Jane Doe"), (6, "the end of the version in the general work"), (7, "a text\nof no licence at all")]
    got = {r.doc_id: r for r in licences.scan(docs(spark, rows)).collect()}
    assert [got[i].families for i in (1, 2, 3, 4)] == ["apache", "gpl", "public-domain", "mpl"]
    assert (got[5].families, got[5].n_unknown) == ("", 1)
    assert (got[6].families, got[6].n_unknown) == ("", 0)
    assert (got[7].families, got[7].n_unknown) == ("", 1)
