"""The pipeline's stages against brute force on what each reads, at a small size, and run() over odd tables."""

from collections import defaultdict

import pytest

pytest.importorskip("kinfold.llm")

import corpus_pipeline  # noqa: E402
from kinfold.llm import packing, toxicity  # noqa: E402
from kinfold.llm.queries import table, toxicity_model, word_bpe  # noqa: E402
from kinfold.runtime import materialise  # noqa: E402

from test_operators import brute_hits, brute_personal, components  # noqa: E402
from test_shingles import brute_set  # noqa: E402


def brute_near(texts):
    """For each text its component under links of Jaccard similarity 0.8 or more between sets of 5-word shingles."""
    sets = [brute_set(t) for t in texts]
    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for g in s or {()}:
            holders[g].append(i)
    shared = defaultdict(int)
    for own in holders.values():
        for n, i in enumerate(own):
            for j in own[:n]:
                shared[i, j] += 1
    linked = defaultdict(list)
    for (i, j), n in shared.items():
        if not sets[i] or 10 * n >= 8 * (len(sets[i]) + len(sets[j]) - n):
            linked[i].append(j)
    return components(len(texts), lambda i: linked[i])


def test_every_stage_does_its_work(spark, sf):
    before = table(spark, sf, "documents")
    stages = {}
    for name, stage in corpus_pipeline.STAGES:
        after = materialise(stage(spark, before, sf))
        stages[name] = (before.collect(), after.collect())
        if name != corpus_pipeline.STAGES[-1][0]:
            assert after.columns == before.columns
        before = after
    old, new = stages["toxicity"]
    score = {r.doc_id: r.score for r in toxicity.score(table(spark, sf, "documents"), toxicity_model(spark, sf)).collect()}
    assert {r.doc_id for r in new} == {r.doc_id for r in old if score[r.doc_id] < 0.5}
    old, new = stages["simhash_near_dedup"]
    least = {}
    for r, k in zip(old, brute_near([r.text for r in old])):
        least[k] = min(least.get(k, r.doc_id), r.doc_id)
    assert sorted(r.doc_id for r in new) == sorted(least.values())
    old, new = stages["benchmark_decontamination"]
    hits = brute_hits([r.text for r in old], [(r.item_id, r.text) for r in table(spark, sf, "benchmark").collect()])
    assert sorted(r.doc_id for r in new) == sorted(r.doc_id for r, h in zip(old, hits) if h[2] == 0)
    old, new = stages["pii"]
    assert len(old) == len(new)
    clean = {r.doc_id: r for r in new}
    for r in old:
        assert not brute_personal(clean[r.doc_id].text) and clean[r.doc_id].n_chars == len(clean[r.doc_id].text)
        if not brute_personal(r.text):
            assert clean[r.doc_id].text == r.text
    old, new = stages["best_fit_packing"]
    own = packing.coder(word_bpe())
    assert sum(r.length for r in new) == sum(len(x) // 4 + 1 for x in own.encode([r.text for r in old]))


#: Columns with names that the stages use themselves.
MORE = "key string, _key string, kept_id string, more string, _more string, id string, n string"


def write_tables(spark, folder, rows, labels, items):
    spark.createDataFrame([(*r, *"abcdefg") for r in rows], f"doc_id long, text string, lang string, source string, n_chars long, {MORE}").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


def test_run_over_nulls_empties_repeats_and_clashing_columns(spark, tmp_path):
    passage = "one two three four five six seven eight nine ten"
    words = " ".join(f"w{i}" for i in range(60))
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "  \n", "en", "s", 3), (None, "a text whose id is null", "en", "s", 23), (5, words, "en", "s", len(words)), (5, words, "en", "s", len(words)), (6, words + " tail", "en", "s", 9)]
    rows += [(7, f"before {passage} after", "en", "s", 9), (8, "mail to a@b.com now", "en", "s", 19), (9, "x " * 50_000, "en", "s", 100_000), (8, "another text of the same id", "en", "s", 9)]
    write_tables(spark, tmp_path, rows, [(1, 1, 0), (None, 1, 1), (77, None, None)], [(1, passage), (None, None), (2, "")])
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ends = defaultdict(int)
    for r in got:
        ends[r.doc_id] += r.piece == 0
    assert ends == {1: 1, None: 1, 5: 1, 8: 2, 9: 1}
    docs = table(spark, str(tmp_path), "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialise(stage(spark, docs, str(tmp_path)))
        assert docs.columns == table(spark, str(tmp_path), "documents").columns, name
        assert all((r.key, r._key, r.kept_id, r.more, r._more, r.id, r.n) == tuple("abcdefg") for r in docs.collect()), name
    assert {r.text for r in docs.collect() if r.doc_id == 8} == {"mail to [EMAIL] now", "another text of the same id"}


def test_run_over_empty_tables(spark, tmp_path):
    write_tables(spark, tmp_path, [], [], [])
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert got.count() == 0 and "sequence_id" in got.columns
