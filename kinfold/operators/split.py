"""Splitters: by hash bucket, by exact counts, by families under token budgets, by components under file thresholds."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinfold import validate
from kinfold.hashing import draw, stable

NAMES = ("train", "validation", "test")


def default_names(ratios: Sequence[float]) -> tuple[str, ...]:
    return NAMES if len(ratios) == 3 else ("train", "test")


def hash_bucket(id_col: Column) -> Column:
    """Six tenths train, two tenths validation, two tenths test, by the id's hash."""
    k = draw(10, "split", id_col)
    return F.when(k < 6, "train").when(k < 8, "validation").otherwise("test")


def target_counts(size: int, ratios: Sequence[float]) -> list[int]:
    """Whole counts by rounding down; what is left over goes to the first."""
    counts = [int(r * size) for r in ratios]
    counts[0] += size - sum(counts)
    return counts


def file_split(rows: DataFrame, ratios: Sequence[float] = (0.8, 0.1, 0.1), seed: int = 0, id_col: str = "id") -> DataFrame:
    """Exact target counts over a random order of the files, families ignored. Order: hash of seed and id, then id.

    Only a file's rank is global; it is taken in hash ranges, so the largest window holds one range of files.
    """
    train, validation, _ = target_counts(rows.count(), ratios)
    ranked = global_rank(rows.withColumn("_h", stable(seed, F.col(id_col))), "_h", [F.col("_h"), F.col(id_col)], "_r")
    n = F.col("_r")
    return ranked.withColumn("split", F.when(n <= train, NAMES[0]).when(n <= train + validation, NAMES[1]).otherwise(NAMES[2])).drop("_h", "_r")


def global_rank(df: DataFrame, digest: str, order: list[Column], name: str, digits: int = 3, by: Sequence[str] = ()) -> DataFrame:
    """Ranks from 1 by a hex digest (then `order`), within each `by`: ranks within the digest's first digits, plus the rows of the digit groups before."""
    keyed = df.withColumn("_g", F.substring(digest, 1, digits))
    counts = keyed.groupBy(*by, "_g").count()
    before = Window.partitionBy(*by).orderBy("_g").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select(*by, "_g", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_f"))  # at most 16**digits rows for each by
    own = F.row_number().over(Window.partitionBy(*by, "_g").orderBy(*order))
    return keyed.withColumn("_o", own).join(first, [*by, "_g"]).withColumn(name, F.col("_o") + F.col("_f")).drop("_g", "_o", "_f")


def _greedy(ratios: Sequence[float], total: float):
    target = [r * total for r in ratios]

    def off(current: list[float], j: int, w: float) -> float:
        cost = 0.0
        for k, t in enumerate(target):
            has = current[k] + (w if k == j else 0)
            if t > 0:
                cost += ((has - t) / t) ** 2
            elif has:
                return float("inf")
        return cost

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current = [0.0] * len(target)
        for b in batches:
            chosen = []
            for w in b.column(1).to_pylist():
                costs = [off(current, j, w) for j in range(len(target))]
                j = costs.index(min(costs))
                current[j] += w
                chosen.append(j)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(chosen, pa.int32())], ["family_id", "choice"])

    return run


def family_choices(rows: DataFrame, ratios: Sequence[float], seed: int | str = 0) -> DataFrame:
    """(family_id, choice): families by falling tokens (ties: hash of seed and family) go one by one to the split that leaves the least
    sum of squared relative distances to the token targets; ties go to the first split.

    Each choice depends on all before, so one task folds the sorted stream of families; it holds one number for each split.
    """
    per = rows.groupBy(F.col("family_id").cast("string").alias("family_id")).agg(F.sum(F.col("tokens").cast("double")).alias("w"))
    total = per.agg(F.sum("w")).first()[0] or 0.0
    keyed = per.select("family_id", "w", stable(seed, F.col("family_id")).alias("h"))
    return keyed.repartition(1).sortWithinPartitions(F.desc("w"), "h").select("family_id", "w").mapInArrow(_greedy(ratios, total), "family_id string, choice int")


def family_aware_split(rows: DataFrame, ratios: Sequence[float] = (0.8, 0.1, 0.1), seed: int | str = 0, names: Sequence[str] = NAMES) -> DataFrame:
    """rows with split; whole families, by family_choices(). Rows need id, family_id, tokens; an earlier split stays as original_split."""
    validate.ratios(ratios, names)
    validate.require_columns(rows, ["id", "family_id", "tokens"], "split input")
    choice = family_choices(rows, ratios, seed).select(F.col("family_id").alias("_family"), F.element_at(F.array(*map(F.lit, names)), F.col("choice") + 1).alias("_split"))
    had = rows.withColumnRenamed("split", "original_split") if "split" in rows.columns else rows
    return had.join(choice, had["family_id"].cast("string") == F.col("_family")).withColumn("split", F.col("_split")).drop("_family", "_split")


def split_audit(split: DataFrame, names: Sequence[str] = NAMES) -> DataFrame:
    """One row: components, files, files by split, tokens by split (zero where none), files whose split changed and their share."""
    n, t = F.col("split"), F.col("tokens")
    moved = F.count_if(F.col("original_split").isNotNull() & (F.col("original_split") != n)) if "original_split" in split.columns else F.lit(0).cast("bigint")
    out = split.agg(
        F.count_distinct("family_id").alias("family_components"),
        F.count("*").alias("files"),
        *(F.count_if(n == s).alias(f"files_{s}") for s in names),
        *(F.coalesce(F.sum(F.when(n == s, t)), F.lit(0)).alias(f"tokens_{s}") for s in names),
        moved.alias("file_reassignment_count"),
    )
    return out.withColumn("file_reassignment_ratio", F.try_divide("file_reassignment_count", "files"))


def component_order(index: Column, seed: int | Column) -> Column:
    """Tie-breaker between components of a size: a multiplicative hash of the component's number."""
    return F.pmod(index.cast("decimal(38,0)") * F.lit(2654435761).cast("decimal(38,0)") + (seed if isinstance(seed, Column) else F.lit(seed)), F.lit(4294967296).cast("decimal(38,0)")).cast("bigint")


def component_choices(components: DataFrame, files: int, ratios: Sequence[float] = (0.8, 0.1, 0.1), seed: int | Column = 0, by: Sequence[str] = ()) -> DataFrame:
    """(by, component, size, choice): components by falling size, and a component goes to the split in whose range of files its running total ends.

    components: (by, component, size, index). The running total is kept in ranges of equal sizes, so no window holds all components.
    """
    cut = target_counts(files, ratios)
    keyed = components.withColumn("_t", component_order(F.col("index"), seed))
    sizes = keyed.groupBy(*by, "size").agg(F.sum("size").alias("_all"))
    before = Window.partitionBy(*by).orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, -1)
    first = sizes.select(*by, "size", F.coalesce(F.sum("_all").over(before), F.lit(0)).alias("_first"))  # a row for each different size
    own = F.row_number().over(Window.partitionBy(*by, "size").orderBy("_t", "index"))
    total = F.col("_first") + F.col("_own") * F.col("size")
    return keyed.withColumn("_own", own).join(first, [*by, "size"]).select(*by, "component", "size", F.when(total <= cut[0], 0).when(total <= cut[0] + cut[1], 1).otherwise(2).alias("choice"))


def component_split(nodes: DataFrame, groups: DataFrame, files: int, ratios: Sequence[float] = (0.8, 0.1, 0.1), seed: int | Column = 0, by: Sequence[str] = (), own: Column | None = None) -> DataFrame:
    """(by, node, split 0..2): components by component_choices(), then the other nodes in hash order fill what the targets leave.

    nodes: (by, node); groups: (by, node, root) of components with two nodes or more, numbered by their smallest node; files: nodes of each `by`;
    own: what of a node its hash is made of.
    """
    comps = groups.groupBy(*by, "root").agg(F.count("*").alias("size"), F.min("node").alias("least"))
    index = F.row_number().over(Window.partitionBy(*by).orderBy("least")) - 1  # numbers of components are part of the rule
    chosen = component_choices(comps.select(*by, F.col("root").alias("component"), "size", index.alias("index")), files, ratios, seed, by)
    inside = groups.join(chosen.select(*by, F.col("component").alias("root"), "choice"), [*by, "root"]).select(*by, "node", F.col("choice").alias("split"))
    target = target_counts(files, ratios)
    used = chosen.groupBy(*by).agg(*(F.coalesce(F.sum(F.when(F.col("choice") == k, F.col("size"))), F.lit(0)).alias(f"_u{k}") for k in range(3)))
    alone = nodes.join(groups.select(*by, "node"), [*by, "node"], "left_anti")
    ranked = global_rank(alone.withColumn("_h", stable("singleton-fill", seed, F.col("node") if own is None else own)), "_h", [F.col("_h"), F.col("node")], "_r", by=by)
    ranked = ranked.join(used, list(by), "left") if by else ranked.crossJoin(F.broadcast(used))  # without by, used is one row
    has = [F.coalesce(f"_u{k}", F.lit(0)) for k in range(3)]
    room = [F.greatest(F.lit(t) - u, F.lit(0)) for t, u in zip(target, has)]
    full = [F.greatest(u, F.lit(t)) / max(1, t) for t, u in zip(target, has)]
    rest = F.when((full[0] <= full[1]) & (full[0] <= full[2]), 0).when(full[1] <= full[2], 1).otherwise(2)
    n = F.col("_r")
    filled = F.when(n <= room[0], 0).when(n <= room[0] + room[1], 1).when(n <= room[0] + room[1] + room[2], 2).otherwise(rest)
    return inside.unionByName(ranked.select(*by, "node", filled.alias("split")))


def batches(seed: int, size: int, batch: int, steps: int):
    """Formal batch schedule: permutations of all windows one after the other, cut into batches across their ends."""
    import numpy as np

    rng = np.random.default_rng(seed)
    held = np.zeros(0, np.int64)
    for _ in range(steps):
        while len(held) < batch:
            held = np.concatenate([held, rng.permutation(size)])
        yield held[:batch].tolist()
        held = held[batch:]


def shuffled_batches(indices: Sequence[int], seed: int | str, batch: int, steps: int):
    """Batch schedule over given windows with Python's own generator: shuffles of all of them one after the other, cut into batches."""
    import random

    rng, held = random.Random(seed), []
    for _ in range(steps):
        while len(held) < batch:
            again = list(indices)
            rng.shuffle(again)
            held += again
        yield held[:batch]
        held = held[batch:]


def epoch_order(rows: DataFrame, seed: int, epoch: int, id_col: str = "id") -> DataFrame:
    """rows with their place in an epoch's order, by hash."""
    return global_rank(rows.withColumn("_h", stable(seed, epoch, F.col(id_col))), "_h", [F.col("_h"), F.col(id_col)], "place")


