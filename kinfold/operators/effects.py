"""Paired family effects: leak minus clean, treated minus control."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinfold.operators import stats


def weighted_nll(losses: DataFrame, keys: list[str], loss: str = "loss", tokens: str = "tokens") -> DataFrame:
    """Token-weighted mean loss of each key."""
    return losses.groupBy(*keys).agg((F.sum(F.col(loss) * F.col(tokens)) / F.sum(tokens)).alias("nll"), F.sum(tokens).alias("tokens"))


def complete_families(rows: DataFrame) -> DataFrame:
    """The rows of the families that have a value for every seed under both conditions."""
    seeds = rows.agg(F.count_distinct("seed").alias("seeds"))
    cells = rows.groupBy("split", "family_id").agg(F.count_distinct("seed", "condition").alias("cells"))
    full = cells.join(F.broadcast(seeds)).where(F.col("cells") == 2 * F.col("seeds")).select("split", "family_id")  # seeds is one row
    return rows.join(full, ["split", "family_id"], "left_semi")


def deltas(rows: DataFrame) -> DataFrame:
    """(seed, split, family_id, clean, leak, delta) of the cells that have both conditions."""
    pick = lambda c: F.max(F.when(F.col("condition") == c, F.col("nll")))
    cells = rows.groupBy("seed", "split", "family_id").agg(pick("clean").alias("clean"), pick("family_leak").alias("leak"))
    return cells.where("clean is not null and leak is not null").withColumn("delta", F.col("leak") - F.col("clean"))


def family_deltas(rows: DataFrame) -> DataFrame:
    """(split, family_id, delta, clean): means over seeds."""
    return deltas(rows).groupBy("split", "family_id").agg(F.avg("delta").alias("delta"), F.avg("clean").alias("clean"))


def _side(split: str, value: str):
    return F.avg(F.when(F.col("split") == split, F.col(value)))


def seed_effects(rows: DataFrame) -> DataFrame:
    """(seed, effect): treated minus control mean delta of each seed."""
    return deltas(rows).groupBy("seed").agg((_side("treated", "delta") - _side("control", "delta")).alias("effect"))


def effect(rows: DataFrame) -> DataFrame:
    """One row: tau, treated mean, control drift, share of treated families below zero, relative improvement, validation drift, and
    whether all of exactly three seeds have a negative effect."""
    per = family_deltas(rows)
    treated = _side("treated", "delta")
    one = per.agg(
        (treated - _side("control", "delta")).alias("tau"),
        treated.alias("treated_mean_delta"),
        _side("control", "delta").alias("control_drift"),
        F.avg(F.when(F.col("split") == "treated", (F.col("delta") < 0).cast("double"))).alias("treated_negative_sign_rate"),
        F.try_divide(-treated, _side("treated", "clean")).alias("treated_relative_nll_improvement"),
        _side("clean_validation", "delta").alias("clean_validation_drift"),
    )
    three = seed_effects(rows).agg(((F.count("*") == 3) & F.bool_and(F.col("effect") < 0)).alias("three_of_three_seed_negative"))
    return one.crossJoin(three)  # single rows


def bootstrap_effect(rows: DataFrame, replicates: int = 200, seed: int | str = 0, draws: int | None = None) -> DataFrame:
    """One row: interval and p-value of tau under resampled families, treated and control drawn apart, by hash; a resample has as many values as there are families, or `draws` where that is less."""
    per = family_deltas(rows)
    side = lambda s: stats.resamples(stats.indexed(per.where(F.col("split") == s), "delta", "family_id"), replicates, seed, s, draws)
    both = side("treated").withColumnRenamed("mean", "t").join(side("control").withColumnRenamed("mean", "c"), "replicate")
    return stats.interval(both.withColumn("tau", F.col("t") - F.col("c")), "tau", replicates)


def bootstrap_effect_numpy(rows: DataFrame, replicates: int = 10_000, seed: int = 0, blocks: bool = False) -> dict:
    """The same with NumPy's stream over families in sorted order: one value for each family reaches the driver."""
    per = family_deltas(rows).orderBy("family_id").toPandas()
    return stats.numpy_difference(per.loc[per["split"] == "treated", "delta"], per.loc[per["split"] == "control", "delta"], replicates, seed, blocks)


def with_fallback(rows: DataFrame, fallback: DataFrame, keys: list[str], value: str) -> DataFrame:
    """rows with `value` from rows, or where that is null or missing from fallback."""
    other = fallback.select(*keys, F.col(value).alias("_other"))
    return rows.join(other, keys, "left").withColumn(value, F.coalesce(value, "_other")).drop("_other")


def condition_contrast(rows: DataFrame, left: str, right: str, keys: list[str], unit: str = "family_id", value: str = "value") -> DataFrame:
    """Mean of left minus right over the units that have both conditions, for each key."""
    a = rows.where(F.col("condition") == left).select(*keys, unit, F.col(value).alias("_a"))
    b = rows.where(F.col("condition") == right).select(*keys, unit, F.col(value).alias("_b"))
    return a.join(b, [*keys, unit]).groupBy(*keys).agg(F.avg(F.col("_a") - F.col("_b")).alias("mean_difference"), F.count("*").alias("units"))


def first_seen(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key in order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("_n = 1").drop("_n")


def first_groups(rows: DataFrame, keys: list[str], order: str, most: int) -> DataFrame:
    """The rows of the first `most` groups in order of their first row; a limit asked for by the caller."""
    heads = rows.groupBy(*keys).agg(F.min(order).alias("_first")).orderBy("_first").limit(most)
    return rows.join(heads.select(*keys), keys, "left_semi")
