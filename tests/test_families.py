"""Families, splits, audits, census, contamination and simulation against plain Python."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import pytest
from kinfold import hashing, validate
from kinfold.operators import audit, census, contamination, graph, simulation, split
from kinfold.runtime import scratch_dir
from pyspark.sql import functions as F

NUL = "\x00"


def sha(*parts):
    return hashlib.sha256(NUL.join(map(str, parts)).encode()).hexdigest()


def union_find(nodes, edges):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in edges:
        up[find(a)] = find(b)
    groups = defaultdict(list)
    for n in nodes:
        groups[find(n)].append(n)
    return list(groups.values())


def test_hashes_match_python(spark):
    r = spark.range(1).select(hashing.stable("a", F.lit(None), F.lit(3)).alias("h"), hashing.draw(10, "split", F.lit("x")).alias("d"), hashing.int_array_hash(F.array(F.lit(1), F.lit(2))).alias("j")).first()
    assert r.h == sha("a", "None", "3") and r.d == int(sha("split", "x")[:8], 16) % 10 and r.j == hashlib.sha256(b"[1,2]").hexdigest()
    assert hashing.big_endian_seed("a", 1) == int.from_bytes(hashlib.sha256(b"a\x001").digest()[:8], "big") % 2**32
    assert hashing.little_endian_seed("a", 1) == int.from_bytes(hashlib.sha256(b"a|1").digest()[:8], "little") % (2**63 - 1)


def test_scratch_follows_the_session(spark):
    assert scratch_dir(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")


@pytest.mark.parametrize("seed", range(3))
def test_components_and_labels(spark, seed):
    rng = random.Random(seed)
    nodes = [f"n{i:03d}" for i in range(120)]
    edges = [tuple(rng.sample(nodes, 2)) for _ in range(80)] + [("n000", "n000")] + [(f"n{i:03d}", f"n{i + 1:03d}") for i in range(30)]
    want = union_find(nodes, edges)
    got = {r.id: r.family_id for r in graph.family_map(spark.createDataFrame([(n,) for n in nodes], "id string"), spark.createDataFrame(edges, "a string, b string"), checked=False).collect()}
    assert got == {n: sha("family-component-v1", *sorted(g)) for g in want for n in g}
    linked = {n for e in edges for n in e}
    groups = graph.groups_of(spark.createDataFrame(edges, "a string, b string")).collect()
    assert {r.node for r in groups} == {n for g in want if len(g) > 1 for n in g} <= linked
    assert graph.connected_components(spark.createDataFrame([], "a string, b string")).count() == 0


def test_closed_form_values(spark):
    r = spark.range(1).select(graph.cross_split_probability(F.lit(2), 0.8, 0.1).alias("a"), graph.sibling_probability(F.lit(3), 0.8).alias("b")).first()
    assert math.isclose(r.a, 0.16, abs_tol=1e-12) and math.isclose(r.b, 0.96, abs_tol=1e-12)


@pytest.mark.parametrize("limit", [3, 6])
def test_guarded_components_match_one_pass(spark, limit):
    rng = random.Random(limit)
    edges = sorted({tuple(sorted(rng.sample(range(40), 2))) for _ in range(60)})
    rows = [(a, b, rng.choice([0.5, 0.7, 0.9]), i) for i, (a, b) in enumerate(edges)]
    home = {n: {n} for n in range(40)}
    said = {}
    for a, b, _, i in sorted(rows, key=lambda r: (-r[2], -r[3])):
        if home[a] is home[b]:
            said[i] = "within"
        elif len(home[a]) + len(home[b]) > limit:
            said[i] = "size_guard"
        else:
            both = home[a] | home[b]
            for n in both:
                home[n] = both
            said[i] = "merged"
    got = graph.guarded_components(spark.createDataFrame(rows, "a long, b long, score double, idx long"), limit).collect()
    assert {r.idx: r.decision for r in got} == said
    assert all(r.component_a == min(home[r.a]) and r.component_b == min(home[r.b]) for r in got)


def greedy(families, ratios, seed):
    total = sum(families.values())
    target, current, out = [r * total for r in ratios], [0.0] * len(ratios), {}
    for f in sorted(families, key=lambda f: (-families[f], sha(seed, f))):
        def cost(j):
            c = 0.0
            for k, t in enumerate(target):
                has = current[k] + (families[f] if k == j else 0)
                c += ((has - t) / t) ** 2 if t > 0 else (math.inf if has else 0)
            return c

        out[f] = min(range(len(ratios)), key=lambda j: (cost(j), j))
        current[out[f]] += families[f]
    return out


@pytest.mark.parametrize("ratios", [(0.5, 0.25, 0.25), (0.9, 0.1, 0.0), (0.8, 0.2)])
def test_family_aware_split(spark, ratios):
    rng = random.Random(1)
    rows = [(f"i{i}", f"f{i % 37}", rng.randint(1, 90), rng.choice([None, "train", "test"]), "extra") for i in range(150)]
    names = split.default_names(ratios)
    got = split.family_aware_split(spark.createDataFrame(rows, "id string, family_id string, tokens long, split string, note string"), ratios, 17, names)
    sizes = Counter()
    for _, f, t, _, _ in rows:
        sizes[f] += t
    want = greedy(sizes, ratios, 17)
    assert {(r.id, r.split) for r in got.collect()} == {(i, names[want[f]]) for i, f, *_ in rows}
    a = split.split_audit(got, names).first()
    assert a.files == 150 and a.family_components == 37
    assert a.file_reassignment_count == sum(s is not None and s != names[want[f]] for _, f, _, s, _ in rows)
    assert audit.audit_summary(got).first().contaminated_test_families == 0


def test_split_errors(spark):
    rows = spark.createDataFrame([("a", "f", 1)], "id string, family_id string, tokens long")
    for bad in ((0.5, 0.4, 0.2), (1.5, -0.5, 0.0), (0.5, 0.5), (float("nan"), 0.5, 0.5)):
        with pytest.raises(ValueError):
            split.family_aware_split(rows, bad)
    with pytest.raises(ValueError, match="missing required columns: tokens"):
        split.family_aware_split(rows.drop("tokens"))
    assert split.target_counts(10, (0.8, 0.1, 0.1)) == [8, 1, 1] and split.target_counts(9, (0.8, 0.1, 0.1)) == [9, 0, 0]


def test_file_and_component_splits(spark):
    nodes = spark.createDataFrame([(i,) for i in range(50)], "id long")
    got = Counter(r.split for r in split.file_split(nodes, seed=4).collect())
    assert got == {"train": 40, "validation": 5, "test": 5}
    edges = spark.createDataFrame([(0, 1), (1, 2), (10, 11), (20, 21), (21, 22), (22, 23)], "a long, b long")
    out = {r.node: r.split for r in split.component_split(nodes.withColumnRenamed("id", "node"), graph.groups_of(edges), 50).collect()}
    assert len(out) == 50 and Counter(out.values()) == {0: 40, 1: 5, 2: 5}
    for g in ((0, 1, 2), (10, 11), (20, 21, 22, 23)):
        assert len({out[n] for n in g}) == 1


def test_batches_follow_numpy():
    import numpy as np

    order = np.random.default_rng(3).permutation(5).tolist()
    assert [x for b in split.batches(3, 5, 2, 2) for x in b] == order[:4]
    assert next(split.batches(202608040, 38374, 5, 1)) == [4458, 2215, 9471, 741, 5656]
    every = [x for b in split.shuffled_batches(range(5), "s", 2, 5) for x in b]
    assert sorted(every[:5]) == sorted(every[5:]) == list(range(5)) and every == [x for b in split.shuffled_batches(range(5), "s", 5, 2) for x in b]


def test_audit_rates_and_undefined(spark):
    rows = [("a", "f1", "train"), ("b", "f1", "test"), ("c", "f2", "test"), ("d", "f3", "validation"), ("e", "f3", "test")]
    df = spark.createDataFrame(rows, "id string, family_id string, split string")
    a = audit.audit_summary(df).first()
    assert (a.test_families, a.test_files, a.contaminated_test_families) == (3, 3, 1) and math.isclose(a.test_file_contamination_rate, 1 / 3)
    none = audit.audit_summary(df.where("split <> 'test'")).first()
    assert none.test_family_contamination_rate is None and none.undefined_rate_reason == "zero test denominator"
    r = audit.contaminated_families(df).collect()
    assert [(x.family_id, x.test_ids, x.train_ids, x.family_size) for x in r] == [("f1", "b", "a", 2)]


def test_relation_metrics_perfect_and_fragmented(spark):
    make = lambda groups: spark.createDataFrame([(i, i // 2, g) for i, g in enumerate(groups)], "id long, family_id long, group long")
    one = audit.relation_metrics(make([0, 0, 1, 1])).first()
    assert (one.reference_family_recovery_rate, one.pairwise_relation_f1, one.over_merge_component_count) == (1.0, 1.0, 0)
    two = audit.relation_metrics(make([0, 0, None, None])).first()
    assert (two.reference_family_recovery_rate, two.pairwise_relation_precision, two.pairwise_same_family_recall, two.under_split_reference_family_count) == (0.5, 1.0, 0.5, 1)
    three = audit.relation_metrics(make([0, 0, 0, 0])).first()
    assert three.over_merge_component_count == 1 and math.isclose(three.pairwise_relation_precision, 1 / 3)
    nothing = audit.relation_metrics(make([None] * 4)).first()
    assert nothing.pairwise_relation_precision == 1.0 and nothing.pairwise_same_family_recall == 0.0


def test_pair_metrics_agree(spark):
    rng = random.Random(2)
    rows = [(i, rng.randint(0, 6), rng.randint(0, 8)) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, work long, component long")
    a = audit.group_pair_metrics(df).first()
    b = audit.pair_metrics(audit.closure_pairs(df, "component"), audit.closure_pairs(df, "work")).first()
    for c in b.__fields__:
        assert math.isclose(a[c], b[c]), c


def test_census_simulation_approaches_the_closed_form(spark):
    sizes = [1] * 60 + [2] * 30 + [5] * 10
    files = [(f"{f}-{k}", f"f{f}") for f, n in enumerate(sizes) for k in range(n)]
    got = census.monte_carlo(spark.createDataFrame(files, "id string, family_id string"), seeds=150).first()
    want = census.analytic_rates(spark.createDataFrame([(n,) for n in sizes], "family_size long")).first()
    assert abs(got.family_mean - want.test_family_contamination_rate) < 0.03
    exact = census.monte_carlo_numpy(sizes, seeds=50, seed=1)
    assert abs(exact["test_family_contamination"]["mean"] - want.test_family_contamination_rate) < 0.05
    with pytest.raises(ValueError):
        census.monte_carlo_numpy([0, 1])


def test_donor_matching_is_greedy_and_without_replacement(spark):
    rng = random.Random(6)
    pool = [(f"p{i}", rng.randint(1, 30)) for i in range(60)]
    donors = [(f"d{i}", f"f{rng.randint(0, 9)}", rng.randint(1, 35)) for i in range(50)]
    free, want = dict(pool), {}
    for d, _, t in sorted(donors, key=lambda x: (x[1], x[0])):
        best = min(free, key=lambda p: (abs(free[p] - t), sha(3, p)))
        want[d] = (best, free.pop(best))
    D, P = spark.createDataFrame(donors, "id string, family_id string, tokens long"), spark.createDataFrame(pool, "id string, tokens long")
    got = contamination.match_donors(D, P, 3).collect()
    assert {r.donor: (r.removed, r.removed_tokens) for r in got} == want
    near = {r.donor: (r.removed, r.absolute_difference) for r in contamination.nearest_with_replacement(D, P, 3).collect()}
    for d, _, t in donors:
        best = min(dict(pool), key=lambda p: (abs(dict(pool)[p] - t), sha(3, p)))
        assert near[d] == (best, abs(dict(pool)[best] - t))
    with pytest.raises(Exception, match="donor count exceeds"):
        contamination.match_donors(D, P.limit(3)).collect()


def design(spark, **change):
    base = spark.createDataFrame([("b1", "f1", 10), ("b2", "f2", 21), ("r", "t", 5), ("x", "c", 9)], "id string, family_id string, tokens long")
    treated = spark.createDataFrame([("t", [("d", "t", change.get("tokens", 20)), ("r", "t", 5)])], "family_id string, members array<struct<id:string,family_id:string,tokens:long>>")
    cohorts = spark.createDataFrame([("treated", "t"), ("control", change.get("control", "c"))], "cohort string, family_id string")
    assignments = spark.createDataFrame([("t", change.get("donor", "d"), change.get("receiver", "r"))], "family_id string, donor_id string, receiver_id string")
    return contamination.build(base, cohorts, treated, assignments, max_total=change.get("max_total"), max_pair=change.get("max_pair"))


def test_contamination_design(spark):
    d = design(spark)
    assert sorted(r.id for r in d.clean.collect()) == ["b1", "b2"] and sorted(r.id for r in d.leak.collect()) == ["b1", "d"]
    assert d.integrity == {"receiver_in_train": 0, "non_designated_treated_in_train": 0, "family_sets_disjoint": True}
    assert d.budget["matching"] == "APPROXIMATE" and d.budget["absolute_total_difference"] == 1
    assert design(spark, tokens=21).budget["matching"] == "EXACT"
    for change, text in (({"donor": "zz"}, "donor does not exist"), ({"receiver": "d"}, "donor equals receiver"), ({"tokens": 0}, "non-positive"), ({"control": "t"}, "overlap"), ({"max_total": 0.001}, "total token"), ({"max_pair": 0.001}, "pair token")):
        with pytest.raises(ValueError, match=text):
            design(spark, **change)


def test_violations_name_every_offence(spark):
    rows = spark.createDataFrame([("a", "f", 1.0), ("a", " ", 2.0), ("b\n", "f", float("nan")), (" ", "f", -1.0), (None, "f", None)], "id string, family_id string, tokens double")
    got = Counter(r.violation for r in validate.row_violations(rows, tokens=True).collect())
    assert got == {"malformed file id": 3, "duplicate file ID": 1, "malformed family id": 1, "non-positive token count": 3}
    with pytest.raises(ValueError, match="duplicate file ID: a"):
        validate.raise_first(validate.row_violations(rows.limit(1).union(rows.limit(1)), tokens=True))
    ids = spark.createDataFrame([("a",), ("b",)], "id string")
    bad = validate.edge_violations(ids, spark.createDataFrame([("a", "b"), ("b", "a"), ("a", "z")], "a string, b string")).collect()
    assert {r.violation for r in bad} == {"unknown edge end", "repeated edge"}
    man = spark.createDataFrame([("f", "treated", []), ("g", "odd", [("m", "x")]), ("h", "control", None)], "family_id string, split string, members array<struct<id:string,family_id:string>>")
    res = spark.createDataFrame([("f", "control"), ("h", "control"), ("h", "treated"), ("k", "treated")], "family_id string, split string")
    kinds = {r.violation for r in validate.manifest_violations(res, man).collect()}
    assert kinds == {"unsupported split", "empty members", "member of wrong family", "family without rows", "family not in manifest", "several analysis cohorts", "split differs from manifest"}


def test_simulation_baselines(spark):
    nodes = spark.createDataFrame([(i, f"f{i // 3}") for i in range(60)], "node long, family_id string")
    edges = graph.identical_edges(nodes, "family_id", "node")
    got = {r.condition + r.variant: r for r in simulation.simulate(nodes, edges, simulation.grid((0.5,), (0.2,)), (1,)).collect()}
    perfect, none = got["perfect_referencenone"], got["file_level_randomnone"]
    assert perfect.reference_family_recovery_rate == 1.0 and perfect.residual_known_cross_split_family_count == 0 and perfect.largest_inferred_component == 3
    assert none.reference_family_recovery_rate == 0.0 and none.inferred_component_count == 60 and none.residual_known_cross_split_family_count > 0
    assert got["edge_dropnone"].retained_edges == 20 and 0 < got["edge_dropnone"].pairwise_same_family_recall < 1
    assert got["false_edgeschain"].pairwise_relation_precision < 1


def test_both_ways_to_simulate_agree(spark):
    rng = random.Random(9)
    families = [rng.randint(0, 40) for _ in range(120)]
    nodes = spark.createDataFrame([(i, f"f{f}") for i, f in enumerate(families)], "node long, family_id string")
    edges = graph.identical_edges(nodes, "family_id", "node")
    plans = simulation.grid((0.8, 0.5, 0.4, 0.3), (0.05, 0.1, 0.3, 0.4, 0.45))
    rows = []
    for most in (10**6, 0):
        got = simulation.simulate(nodes, edges, plans, (1, 2), largest=-1, in_memory_up_to=most)
        rows.append(sorted((tuple((c, round(v, 9) if isinstance(v, float) else v) for c, v in sorted(r.asDict().items())) for r in got.collect()), key=str))
    assert len(rows[0]) == 2 * len(plans) and rows[0] == rows[1]


def test_census_draws_are_not_shuffled(spark):
    """The same draws as uniform() makes, with one exchange before the rows are taken once for each run."""
    files = spark.createDataFrame([(f"i{i}", f"f{i % 40}") for i in range(200)], "id string, family_id string")
    got = Counter((r.run, r.family_id, r.split) for r in census.file_draws(files, 7, 3, (0.8, 0.1, 0.1)).collect())
    u = lambda run, i: int(sha(3, run, f"i{i}")[:8], 16) / 2**32
    assert got == Counter((run, f"f{i % 40}", 0 if u(run, i) < 0.8 else 1 if u(run, i) < 0.9 else 2) for run in range(7) for i in range(200))
    drawn = census.file_draws(files, 7, 3, (0.8, 0.1, 0.1)).groupBy("run", "family_id").count()
    drawn.collect()
    assert drawn._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("Exchange hashpartitioning") == 1
    edges = spark.createDataFrame([(f"{n:08x}" + "0" * 56,) for n in (0, 3435973836, 3435973837, 2**32 - 1)], "h string")
    assert [r.b for r in edges.select(census.below(F.col("h"), 0.8).alias("b")).collect()] == [n / 2**32 < 0.8 for n in (0, 3435973836, 3435973837, 2**32 - 1)]


@pytest.mark.parametrize("seed", range(4))
def test_donor_clusters_match_as_one_stream(spark, seed):
    """Crowded and loose token counts: clusters matched apart give what one pass over all donors gives."""
    rng = random.Random(seed)
    pool = [(f"p{i}", rng.choice([rng.randint(1, 30), rng.randint(100, 110), rng.randint(200, 900)])) for i in range(160)]
    donors = [(f"d{i}", f"f{rng.randint(0, 50)}", rng.choice([rng.randint(1, 40), 105, rng.randint(150, 900)])) for i in range(70)]
    free, want = dict(pool), {}
    for d, f, t in sorted(donors, key=lambda x: (x[1], x[0])):
        want[d] = min(free, key=lambda p: (abs(free[p] - t), sha(5, p)))
        del free[want[d]]
    make = lambda rows, shape: spark.createDataFrame(rows, shape)
    own, files = make(donors, "id string, family_id string, tokens long"), make(pool, "id string, tokens long")
    assert {r.donor: r.removed for r in contamination.match_donors(own, files, 5).collect()} == want
    assert contamination.clusters(own, files).select("cluster").distinct().count() > 3
