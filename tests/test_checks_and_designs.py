"""Strict family maps, manifests, seeds and designs."""

import pytest
from pyspark.sql import functions as F

from kinfold import validate
from kinfold.operators import contamination, features, graph, split
from kinfold.plans import source_queries


def ids(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "id string")


def edges(spark, *pairs):
    return spark.createDataFrame(list(pairs), "a string, b string")


@pytest.mark.parametrize(
    "names, pairs, problem",
    [("aab", [], "repeated id: a"), ("ab", [("a", "z")], "unknown edge end: z"), ("ab", [("a", "b"), ("b", "a")], "repeated edge: a|b")],
)
def test_family_maps_refuse_bad_graphs(spark, names, pairs, problem):
    with pytest.raises(ValueError) as e:
        graph.family_map(ids(spark, *names), edges(spark, *pairs))
    assert str(e.value) == problem


def test_families_are_attached_or_missed(spark):
    known = spark.createDataFrame([("a", "f1"), ("b", "f2")], "id string, family_id string")
    got = graph.attach_families(spark.createDataFrame([("a", 1), ("b", 2), ("a", 3)], "id string, n int"), known)
    assert sorted((r.id, r.n, r.family_id) for r in got.collect()) == [("a", 1, "f1"), ("a", 3, "f1"), ("b", 2, "f2")]
    with pytest.raises(ValueError, match="no family is mapped for c"):
        graph.attach_families(ids(spark, "a", "c", "d"), known)


def test_hubs_are_joined_like_other_nodes(spark, monkeypatch):
    rows = [(0, i) for i in range(1, 400)] + [(1000 + i, 1001 + i) for i in range(50)] + [(399, 1000)]
    table = spark.createDataFrame(rows, "a long, b long")
    want = sorted((r.node, r.root) for r in graph.connected_components(table).collect())
    monkeypatch.setattr(graph, "HUB_EDGES", 3)
    monkeypatch.setattr(graph, "HUB_SHARE", 1_000_000)
    assert sorted((r.node, r.root) for r in graph.connected_components(table).collect()) == want and {r for _, r in want} == {0}


@pytest.mark.parametrize("shares, names", [((0.5, 0.4), "ab"), ((0.5,), "ab"), ((), ""), ((1.5, -0.5), "ab"), ((float("nan"), 1.0), "ab"), (("x", 1.0), "ab")])
def test_shares_must_hold_every_rule(shares, names):
    with pytest.raises(ValueError):
        validate.ratios(shares, names)
    validate.ratios((0.8, 0.1, 0.1), "abc")


def test_manifest_members_and_hash_are_those_of_the_rows(spark):
    manifest = spark.createDataFrame([("f", [("a",), ("b",)])], "family_id string, members array<struct<id:string>>")
    rows = spark.createDataFrame([("f", "a"), ("f", "c")], "family_id string, id string")
    got = {(r.violation, r.subject) for r in validate.manifest_matches(manifest, rows, "x", "y").collect()}
    assert got == {("member without rows", "f|b"), ("row of no member", "f|c"), ("manifest hash differs", "x")}
    assert validate.manifest_matches(manifest, spark.createDataFrame([("f", "a"), ("f", "b")], "family_id string, id string")).count() == 0


def test_condition_sets_must_not_differ_between_seeds(spark):
    def row(seed, condition):
        return ("d", "t", "s", seed, condition, "treated", "f", 1.0)

    shape = "dataset string, architecture string, model_size string, seed int, condition string, split string, family_id string, nll double"
    even = [row(s, c) for s in (1, 2) for c in ("clean", "family_leak")]
    assert not validate.nll_violations(spark.createDataFrame(even, shape)).count()
    odd = validate.nll_violations(spark.createDataFrame([*even, row(2, "control")], shape)).collect()
    assert {r.violation for r in odd} == {"condition sets differ across seeds"}


def test_donors_stand_where_they_replace(spark, sf):
    design = source_queries._design(spark, sf)
    clean = [r.id for r in design.clean.select(F.col("id").cast("string").alias("id")).collect()]
    swaps = {r.removed: r.donor for r in design.replacements.collect()}
    got = {r.place: r.id for r in contamination.in_place(design).collect()}
    assert len(got) == len(clean) and swaps and set(got.values()) == set(clean) - set(swaps) | set(swaps.values())
    assert sorted(got) == list(range(1, len(clean) + 1))
    bare = contamination.Design(design.clean, design.leak, design.replacements.limit(0), {}, {})
    before = {r.place: r.id for r in contamination.in_place(bare).collect()}
    assert {p: i for p, i in got.items()} == {p: swaps.get(i, i) for p, i in before.items()}


def test_equal_seeds_split_equal_groups_alike(spark):
    nodes = spark.createDataFrame([(run, 7, run * 100 + n) for run in (0, 1) for n in range(100)], "run int, seed int, node long")
    groups = spark.createDataFrame([(run, 7, run * 100 + n, run * 100 + n // 3 * 3) for run in (0, 1) for n in range(30)], "run int, seed int, node long, root long")
    got = split.component_split(nodes, groups, 100, (0.8, 0.1, 0.1), F.col("seed"), ["run", "seed"], F.pmod("node", F.lit(100))).collect()
    part = {(r.run, r.node % 100): r.split for r in got}
    assert len(part) == 200 and all(part[0, n] == part[1, n] for n in range(100))


def test_tokens_that_share_a_bucket_share_its_frequency(spark):
    bags = spark.createDataFrame([(p, "g", str(t), 1) for p in range(3) for t in range(40)], "piece long, grp string, token string, tf long")
    hashed = features.hash_tokens(bags, 4)
    assert sorted({r.token for r in hashed.collect()}) <= ["0", "1", "2", "3"]
    weights = features.tfidf(hashed, 10).collect()
    assert len(weights) == 3 * len({r.token for r in hashed.collect()})
    assert features.tfidf(hashed, 10).agg(F.max("weight")).first()[0] <= 1
