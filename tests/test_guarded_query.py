"""The registered guarded merging reads its whole table."""

from kinfold.plans import catalogue, views


def test_guarded_query_takes_all_order_part_pairs(spark, sf):
    want = views.table(spark, sf, "lineitem").select("l_orderkey", "l_partkey").distinct().count()
    assert catalogue.QUERIES["guarded_components"](spark, sf).count() == want


def test_batches_decide_as_one_pass(spark):
    """Many batches and one: one large component, scores and idx with ties, a repeated pair and a self-pair."""
    import random

    from kinfold.operators import graph

    rng = random.Random(5)
    pairs = [(rng.randrange(60), 60 + rng.randrange(40)) for _ in range(300)] + [(3, 3)]
    rows = [(a, b, rng.choice([0.25, 0.5, 0.75]), rng.randrange(200)) for a, b in pairs]
    home, want = {n: {n} for n in range(100)}, {}
    for a, b, s, i in sorted(rows, key=lambda r: (-r[2], -r[3], -r[1], -r[0])):
        if home[a] is home[b]:
            want.setdefault((a, b, s, i), []).append("within")
        elif len(home[a]) + len(home[b]) > 7:
            want.setdefault((a, b, s, i), []).append("size_guard")
        else:
            both = home[a] | home[b]
            home.update(dict.fromkeys(both, both))
            want.setdefault((a, b, s, i), []).append("merged")
    df = spark.createDataFrame(rows, "a long, b long, score double, idx long")
    for batch in (70, 1000):
        got: dict = {}
        for r in graph.guarded_components(df, 7, batch).collect():
            got.setdefault((r.a, r.b, r.score, r.idx), []).append(r.decision)
            assert (r.component_a, r.component_b) == (min(home[r.a]), min(home[r.b]))
        assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}


def test_rounds_and_pass_of_a_batch_agree():
    import random

    import numpy as np
    from kinfold.operators import graph

    rng = random.Random(8)
    pairs = [(rng.randrange(40_000), 40_000 + rng.randrange(8_000)) for _ in range(250_000)]
    x, y = np.array(pairs).T
    one = np.ones(len(x), np.int64)
    said, final = graph._merge(pairs, 20)
    merged, label, size = graph._merges(x, y, one, one, 20)
    assert merged.tolist() == [s == "merged" for s in said]
    assert all(label[n] == final.get(n, n) for n in range(48_000)) and size.max() <= 20
