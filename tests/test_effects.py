"""Effects and statistics against plain Python and known values."""

import hashlib
import math
import random

import numpy as np
import pytest
from kinfold import validate
from kinfold.operators import effects, stats


def rows(spark, drop=(), seeds=(0, 1, 2)):
    rng = random.Random(1)
    out = []
    for seed in seeds:
        for split, gain in (("treated", -0.4), ("control", 0.1), ("clean_validation", 0.0)):
            for f in range(6):
                base = 2 + rng.random()
                for condition, nll in (("clean", base), ("family_leak", base + gain + rng.random() / 10)):
                    if (seed, split, f, condition) not in drop:
                        out.append(("d", "a", "m", seed, condition, split, f"{split}{f}", nll))
    return out, spark.createDataFrame(out, "dataset string, architecture string, model_size string, seed int, condition string, split string, family_id string, nll double")


def test_effect_matches_plain_means(spark):
    raw, df = rows(spark)
    by = {(s, c, f): v for *_, s, c, _, f, v in raw}
    delta = lambda f: np.mean([by[s, "family_leak", f] - by[s, "clean", f] for s in range(3)])
    treated, control = [delta(f"treated{i}") for i in range(6)], [delta(f"control{i}") for i in range(6)]
    e = effects.effect(df).first()
    assert math.isclose(e.tau, np.mean(treated) - np.mean(control)) and e.treated_negative_sign_rate == 1.0 and e.three_of_three_seed_negative
    clean = np.mean([by[s, "clean", f"treated{i}"] for s in range(3) for i in range(6)])
    assert math.isclose(e.treated_relative_nll_improvement, -np.mean(treated) / clean)
    assert all(r.effect < 0 for r in effects.seed_effects(df).collect())
    b = effects.bootstrap_effect(df, 200, 7).first()
    assert b.ci_low < e.tau < b.ci_high and b.extreme == 0 and math.isclose(b.p_two_sided, 2 / 201)
    n = effects.bootstrap_effect_numpy(df, 1000, 1)
    assert math.isclose(n["tau"], e.tau) and n["p_two_sided"] == 2 / 1001 and n == effects.bootstrap_effect_numpy(df, 1000, 1)
    assert n["ci95"] != effects.bootstrap_effect_numpy(df, 1000, 1, blocks=True)["ci95"]


def test_incomplete_results_are_named_and_dropped(spark):
    _, df = rows(spark, drop={(1, "treated", 2, "clean"), (0, "control", 3, "clean"), (0, "control", 3, "family_leak")})
    kinds = {(r.violation, r.subject) for r in validate.nll_violations(df).collect()}
    assert kinds == {("missing result pair", "treated|1|treated2"), ("family sets differ across seeds", "control|control3")}
    left = {r.family_id for r in effects.complete_families(df).select("family_id").distinct().collect()}
    assert len(left) == 16 and not left & {"treated2", "control3"}
    twice = df.union(df.limit(1))
    assert any(r.violation == "duplicate result key" for r in validate.nll_violations(twice).collect())


def test_holm_and_ranks(spark):
    p = [0.01, 0.04, 0.03, 0.005]
    got = {r.k: r.holm_p for r in stats.holm(spark.createDataFrame(list(enumerate(p)), "k int, p double"), "p", "k").collect()}
    assert [round(got[i], 9) for i in range(4)] == [0.03, 0.06, 0.06, 0.02]
    x, y = [1, 2, 2, 3, 9, float("nan")], [5.0, 4.0, 4.0, 1.0, 0.0, 2.0]
    r = stats.spearman(spark.createDataFrame(list(zip(map(float, x), y)), "x double, y double"), "x", "y").first()
    rank = lambda v: [sum(b < a for b in v) + (sum(b == a for b in v) + 1) / 2 for a in v]
    assert r.n == 5 and math.isclose(r.rho, np.corrcoef(rank(x[:5]), rank(y[:5]))[0, 1])


def test_slope_sign_test_and_summary(spark):
    pts = [(1.0, 3.0), (math.e, 5.0), (math.e**2, 7.0)]
    s = stats.log_slope(spark.createDataFrame(pts, "x double, y double"), "x", "y").first()
    assert math.isclose(s.slope, 2.0) and math.isclose(s.intercept, 3.0)
    v = spark.createDataFrame([(i, 1.0 + i / 10) for i in range(12)], "i long, value double")
    r = stats.sign_randomisation(v, 100, 1).first()
    assert math.isclose(r.observed, 1.55) and r.p_value <= 3 / 101
    t = stats.condition_summary(spark.createDataFrame([("a", None, 1.0), ("a", None, 3.0), ("b", 1, 2.0)], "c string, d int, m double"), ["c", "d"], ["m"]).collect()
    assert {(x.c, x.d, x.n_seeds, x.m_mean, x.m_median) for x in t} == {("a", None, 2, 2.0, 2.0), ("b", 1, 1, 2.0, 2.0)}


def test_numpy_streams():
    x = np.arange(8.0) - 3
    rng = np.random.default_rng(2)
    m = np.array([rng.choice(x, 8, True).mean() for _ in range(50)])
    got = stats.numpy_bootstrap(x, 50, 2)
    assert got["ci95"] == np.quantile(m, [0.025, 0.975]).tolist()
    m = x[np.random.default_rng(2).integers(0, 8, size=(50, 8))].mean(axis=1)
    assert stats.numpy_bootstrap(x, 50, 2, "index_matrix")["ci95"] == np.quantile(m, [0.025, 0.975]).tolist()
    with pytest.raises(ValueError):
        stats.numpy_bootstrap(x, 5, 2, "other")


def test_audited_fields_follow_printed_decimals(spark):
    want = [("r", "a", "0.25", 1e-12), ("r", "b", "0.25", 1e-12), ("r", "c", "1e3", 1e-12), ("r", "d", "", 1e-12), ("r", "e", "7", 0.5), ("r", "f", "1.0", 1e-12)]
    have = [("r", "a", 0.2549), ("r", "b", 0.2551), ("r", "c", 1000.4), ("r", "d", 1.0), ("r", "e", 7.4)]
    got = stats.audit_fields(spark.createDataFrame(want, "result_id string, field string, expected string, tolerance double"), spark.createDataFrame(have, "result_id string, field string, value double"))
    assert {r.field: r.status for r in got.collect()} == {"a": "PASS", "b": "MISMATCH", "c": "MISMATCH", "d": "NOT_APPLICABLE", "e": "PASS", "f": "UNREPRODUCED"}
    assert stats.compare({"a": [1, 2.0], "b": "x"}, {"a": [1, 2.0 + 1e-13], "b": "x", "c": 3}) == []
    assert stats.compare({"a": [1, 2.0], "b": "x"}, {"a": [1, 2.1]}) == ["$.a[1]", "$.b"]


def test_huber_resists_an_outlier():
    rng = np.random.default_rng(1)
    x = rng.normal(size=80)
    y = 2 * x + 1 + rng.normal(size=80) / 20
    y[0] += 500
    fit = stats.huber({"x": x, "y": y}, ["x"], "y")
    assert abs(fit["coefficients"]["x"] / x.std() - 2) < 0.1


def test_cluster_bootstrap_bounds(spark):
    per = spark.createDataFrame([(i, i % 3, 3, 0.5) for i in range(20)], "i long, hit long, positive long, false double")
    r = stats.cluster_bootstrap(per, 60, 1).first()
    assert 0 <= r.precision_low <= r.precision_high <= 1 and r.recall_low <= 19 / 60 <= r.recall_high


def test_first_groups_keep_input_order(spark):
    df = spark.createDataFrame([(0, "b"), (1, "a"), (2, "b"), (3, "c")], "i int, k string")
    assert sorted(r.i for r in effects.first_groups(df, ["k"], "i", 2).collect()) == [0, 1, 2]


def test_resamples_of_so_many_draws(spark):
    """The registered bootstrap draws 10,000 values at most, as its SQL does; where there are fewer families, as many as there are."""
    rows = spark.createDataFrame([(i, float(i * i % 7)) for i in range(30)], "i int, value double")
    for draws, most in ((None, 30), (12, 12), (99, 30)):
        got = {r.replicate: r["mean"] for r in stats.resamples(rows, 5, 5, "treated", draws).collect()}
        for b in range(5):
            picked = [int(hashlib.sha256(f"5\0treated\0{b}\0{j}".encode()).hexdigest()[:8], 16) % 30 for j in range(most)]
            assert math.isclose(got[b], sum(i * i % 7 for i in picked) / most, abs_tol=1e-12)
