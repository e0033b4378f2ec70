"""How often families straddle random file-level splits: closed form and simulation."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold import validate
from kinfold.hashing import stable
from kinfold.operators.graph import cross_split_probability, sibling_probability
from kinfold.runtime import parts


def analytic_by_size(sizes: DataFrame, ratios: Sequence[float] = (0.8, 0.1, 0.1)) -> DataFrame:
    """(family_size, families, cross_probability, test_member_has_train_sibling) of each size."""
    k = F.col("family_size")
    per = sizes.groupBy("family_size").agg(F.count("*").alias("families"))
    return per.select("family_size", "families", cross_split_probability(k, ratios[0], ratios[-1]).alias("cross_probability"), sibling_probability(k, ratios[0]).alias("test_member_has_train_sibling"))


def analytic_rates(sizes: DataFrame, ratios: Sequence[float] = (0.8, 0.1, 0.1)) -> DataFrame:
    """One row: expected contaminated test families over expected test families, and the same for files."""
    k, p, q = F.col("family_size"), ratios[0], ratios[-1]
    has_test = 1 - F.pow(F.lit(1 - q), k)
    return sizes.agg(
        (F.sum(cross_split_probability(k, p, q)) / F.sum(has_test)).alias("test_family_contamination_rate"),
        (F.sum(k * q * sibling_probability(k, p)) / F.sum(k * q)).alias("test_file_contamination_rate"),
    )


def below(digest: Column, edge: float) -> Column:
    """Whether hashing.uniform() of a digest is under edge: its first eight hex digits against those of the edge, without a number for each row."""
    most = math.ceil(edge * 2**32)
    return F.lit(True) if most >= 2**32 else F.substring(digest, 1, 8) < F.lit(f"{most:08x}")


def file_draws(files: DataFrame, seeds: int, seed: int, ratios: Sequence[float]) -> DataFrame:
    """(run, family_id, split number) of every file in every run, by hash of seed, run and file. Files are dealt out by family before they are
    taken once for each run, so that no draw is shuffled."""
    dealt = files.select("id", "family_id").repartition(parts(files, 2.0), "family_id")
    runs = dealt.select("id", "family_id", F.explode(F.sequence(F.lit(0), F.lit(seeds - 1))).alias("run"))
    hashed = runs.select("run", "family_id", stable(seed, F.col("run"), F.col("id")).alias("h"))
    edge, out = 0.0, F.lit(len(ratios) - 1)
    cases: Column | None = None
    for k, r in enumerate(ratios[:-1]):
        edge += r
        cases = F.when(below(F.col("h"), edge), k) if cases is None else cases.when(below(F.col("h"), edge), k)
    return hashed.select("run", "family_id", (out if cases is None else cases.otherwise(out)).alias("split"))


def monte_carlo_runs(files: DataFrame, ratios: Sequence[float] = (0.8, 0.1, 0.1), seeds: int = 20, seed: int = 0) -> DataFrame:
    """(run, test_families, test_files, contaminated_families, contaminated_files). Train is the first split, test the last."""
    validate.ratios(ratios, [str(i) for i in range(len(ratios))])
    last = len(ratios) - 1
    per = file_draws(files, seeds, seed, ratios).groupBy("run", "family_id").agg(F.count_if(F.col("split") == last).alias("t"), F.bool_or(F.col("split") == 0).alias("train"))
    bad = (F.col("t") > 0) & F.col("train")
    return per.groupBy("run").agg(F.count_if(F.col("t") > 0).alias("test_families"), F.sum("t").alias("test_files"), F.count_if(bad).alias("contaminated_families"), F.sum(F.when(bad, F.col("t")).otherwise(0)).alias("contaminated_files"))


def monte_carlo(files: DataFrame, ratios: Sequence[float] = (0.8, 0.1, 0.1), seeds: int = 20, seed: int = 0) -> DataFrame:
    """One row: mean and 95 % range of both rates over the runs; runs without test files are left out and counted."""
    runs = monte_carlo_runs(files, ratios, seeds, seed)
    fam, fil = F.try_divide("contaminated_families", "test_families"), F.try_divide("contaminated_files", "test_files")
    return runs.agg(
        F.count_if(F.col("test_files") == 0).alias("undefined_zero_denominator_seeds"),
        *(f(c).alias(f"{n}_{s}") for n, c in (("family", fam), ("file", fil)) for s, f in (("mean", F.avg), ("q025", lambda c: F.percentile(c, 0.025)), ("q975", lambda c: F.percentile(c, 0.975)))),
    )


def monte_carlo_numpy(family_sizes: Sequence[int], ratios: Sequence[float] = (0.8, 0.1, 0.1), seeds: int = 1000, seed: int = 0) -> dict:
    """The simulation with NumPy's own stream, one generator through all families of all runs, for results that must repeat that stream."""
    import numpy as np

    if not len(family_sizes) or min(family_sizes) <= 0:
        raise ValueError("family sizes must be non-empty positive integers")
    rng, rates, undefined = np.random.default_rng(seed), [], 0
    owner = np.repeat(np.arange(len(family_sizes)), family_sizes)
    for _ in range(seeds):
        split = np.concatenate([rng.choice(len(ratios), int(n), p=list(ratios)) for n in family_sizes])
        tested = np.bincount(owner, weights=split == len(ratios) - 1)
        trained = np.bincount(owner, weights=split == 0) > 0
        if not tested.sum():
            undefined += 1
            continue
        rates.append(((trained & (tested > 0)).sum() / (tested > 0).sum(), tested[trained].sum() / tested.sum()))
    if not rates:
        raise ValueError("undefined census metric for every seed: zero test denominator")
    table = np.array(rates)
    named = zip(("test_family_contamination", "test_file_contamination"), table.T)
    return {"undefined_zero_denominator_seeds": undefined} | {n: {"mean": float(v.mean()), "q025": float(np.quantile(v, 0.025)), "q975": float(np.quantile(v, 0.975))} for n, v in named}
