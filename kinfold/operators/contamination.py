"""Contaminated and clean training sets with equal token budgets: donors replace the nearest clean files."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinfold import validate
from kinfold.hashing import stable
from kinfold.runtime import materialise, parts


def protected_rows(base: DataFrame, families: DataFrame, ids: DataFrame) -> DataFrame:
    """base without the rows of protected families (family_id) and without protected ids (id)."""
    return base.join(families.select("family_id").distinct(), "family_id", "left_anti").join(ids.select("id").distinct(), "id", "left_anti")


def cohort_overlaps(cohorts: DataFrame) -> DataFrame:
    """Families in more than one cohort. cohorts: (cohort, family_id)."""
    return cohorts.groupBy("family_id").agg(F.count_distinct("cohort").alias("cohorts")).where("cohorts > 1")


def assignment_violations(treated: DataFrame, assignments: DataFrame) -> DataFrame:
    """(violation, subject) of (family_id, donor_id, receiver_id) against treated families with members array<struct<id, family_id, tokens>>."""
    member = treated.select(F.col("family_id").alias("home"), F.explode("members").alias("m")).select("home", "m.*")
    out = validate.row_violations(member.select("id", "family_id", "tokens"), tokens=True)
    wrong = member.where("family_id <> home").select(F.lit("member of wrong family").alias("violation"), F.col("id").cast("string").alias("subject"))
    few = treated.where(F.col("members").isNull() | (F.size("members") < 2)).select(F.lit("treated family without donor and receiver").alias("violation"), F.col("family_id").alias("subject"))
    lost = assignments.join(treated.select("family_id"), "family_id", "left_anti").select(F.lit("assignment references missing family").alias("violation"), F.col("family_id").alias("subject"))
    out = out.unionByName(wrong).unionByName(few).unionByName(lost)
    for role in ("donor", "receiver"):
        at = assignments.select("family_id", F.col(f"{role}_id").alias("id")).join(member.select("id", F.col("home")), "id", "left")
        out = out.unionByName(at.where("home is null").select(F.lit(f"{role} does not exist").alias("violation"), F.col("id").alias("subject")))
        out = out.unionByName(at.where("home <> family_id").select(F.lit(f"{role} of another family").alias("violation"), F.col("id").alias("subject")))
    out = out.unionByName(assignments.where("donor_id = receiver_id").select(F.lit("donor equals receiver").alias("violation"), F.col("family_id").alias("subject")))
    rows = assignments.groupBy("family_id", "donor_id", "receiver_id").count().where("count > 1").select(F.lit("duplicate assignment row").alias("violation"), F.col("receiver_id").alias("subject"))
    many = assignments.groupBy("receiver_id").agg(F.count_distinct("family_id", "donor_id").alias("n")).where("n > 1").select(F.lit("duplicate receiver assignment").alias("violation"), F.col("receiver_id").alias("subject"))
    return out.unionByName(rows).unionByName(many)


def nearest_with_replacement(donors: DataFrame, pool: DataFrame, seed: int | str = 0) -> DataFrame:
    """(donor, removed, absolute_difference): for each donor the pool file of nearest tokens; ties by hash of seed and id. A file may serve several donors.

    Only the pool's distinct token counts are candidates: the nearest at or below and the nearest at or above. They are found within ranges of
    counts on a logarithmic scale, a few thousand at most, and across ranges by the ranges' own ends. Token counts must be positive.
    """
    best = pool.groupBy("tokens").agg(F.min(F.struct(stable(seed, F.col("id")).alias("h"), F.col("id").alias("id"))).alias("best"))
    kind = best.schema["tokens"].dataType
    span = F.floor(F.log2(F.col("tokens").cast("double")) * 32).alias("span")
    own = best.select(span, "tokens", F.col("tokens").alias("at"), F.lit(None).cast("string").alias("donor"))
    ends = own.groupBy("span").agg(F.min("at").alias("lo"), F.max("at").alias("hi"))
    marks = own.unionByName(donors.select(span, "tokens", F.lit(None).cast(kind).alias("at"), F.col("id").cast("string").alias("donor")))
    line = Window.partitionBy("span").orderBy("tokens", F.col("donor").asc_nulls_first())
    inside = marks.withColumn("low", F.last("at", True).over(line.rowsBetween(Window.unboundedPreceding, 0))).withColumn("high", F.first("at", True).over(line.rowsBetween(0, Window.unboundedFollowing))).where("donor is not null")
    known = inside.select("span").distinct().join(ends, "span", "full")
    spans = Window.orderBy("span")
    outside = known.select("span", F.max("hi").over(spans.rowsBetween(Window.unboundedPreceding, -1)).alias("below"), F.min("lo").over(spans.rowsBetween(1, Window.unboundedFollowing)).alias("above"))
    near = inside.join(outside, "span").select("donor", "tokens", F.explode(F.array_distinct(F.array(F.coalesce("low", "below"), F.coalesce("high", "above")))).alias("near")).where("near is not null")
    pick = near.join(best.withColumnRenamed("tokens", "near"), "near").select("donor", F.struct(F.abs(F.col("near") - F.col("tokens")).alias("d"), "best").alias("x")).groupBy("donor").agg(F.min("x").alias("x"))
    return pick.select("donor", F.col("x.best.id").alias("removed"), F.col("x.d").alias("absolute_difference"))


class FreeFiles:
    """Pool files in order of (tokens, hash), of which the nearest free one can be taken. Taken runs are skipped by path-compressed links."""

    def __init__(self, tokens: list[float], hashes: list[str]):
        self.tokens, self.hashes = tokens, hashes
        n = len(tokens)
        self.after, self.before = list(range(n + 1)), list(range(n + 1))  # before: place + 1, and 0 for none

    @staticmethod
    def _free(links: list[int], k: int) -> int:
        end = k
        while links[end] != end:
            end = links[end]
        while links[k] != end:
            links[k], k = end, links[k]
        return end

    def take(self, wanted: float) -> int | None:
        at = bisect_left(self.tokens, wanted)
        up, down = self._free(self.after, at), self._free(self.before, at)
        near = [up] if up < len(self.tokens) else []
        if down:
            near.append(self._free(self.after, bisect_left(self.tokens, self.tokens[down - 1])))
        if not near:
            return None
        k = min(near, key=lambda p: (abs(self.tokens[p] - wanted), self.hashes[p]))
        self.after[k], self.before[k + 1] = k + 1, k
        return k


def _match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reads clusters one after the other, each with its files before its donors, and holds the files of one cluster."""
    tokens, hashes, ids, free, now = [], [], [], None, None
    names = ("donor", "family_id", "removed", "removed_tokens")
    for b in batches:
        rows = []
        for cluster, donor, tie, i, t in zip(*(b.column(n).to_pylist() for n in ("cluster", "donor", "tie", "id", "tokens"))):
            if cluster != now:
                tokens, hashes, ids, free, now = [], [], [], None, cluster
            if not donor:
                tokens.append(t)
                hashes.append(tie)
                ids.append(i)
                continue
            free = free or FreeFiles(tokens, hashes)
            k = free.take(t)
            if k is None:
                raise ValueError("donor count exceeds replaceable sample count")
            rows.append((i, tie, ids[k], tokens[k]))
        cols = list(zip(*rows)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.string(), pa.string(), pa.float64()))], list(names))


def clusters(donors: DataFrame, pool: DataFrame) -> DataFrame:
    """(tokens, cluster) of the token counts of those clusters that have donors: stretches of the line of counts that no donor's choice leaves or enters.

    Between two counts, no choice crosses to the right if no stretch that ends there has more donors than files: at the first crossing, all files
    from the donor's place to the border would be taken, and by donors of that stretch alone. The same holds to the left. So a border with neither
    is never crossed, and clusters can be matched apart. One row for each different count goes through one window.
    """
    each = pool.select("tokens", F.lit(-1).alias("n")).unionByName(donors.select("tokens", F.lit(1).alias("n")))
    line = Window.orderBy("tokens")
    counts = each.groupBy("tokens").agg(F.sum("n").alias("n"), F.count_if(F.col("n") > 0).alias("donors")).withColumn("s", F.sum("n").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    lowest = F.min(F.col("s") - F.col("n")).over(line.rowsBetween(Window.unboundedPreceding, 0))
    highest = F.max("s").over(Window.orderBy(F.desc("tokens")).rowsBetween(Window.unboundedPreceding, -1))  # a frame to the end is taken anew for each row
    closed = counts.withColumn("closed", (F.col("s") <= lowest) & (F.coalesce(highest, F.col("s")) <= F.col("s")))
    numbered = closed.withColumn("cluster", F.coalesce(F.sum(F.col("closed").cast("int")).over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return numbered.withColumn("any", F.sum("donors").over(Window.partitionBy("cluster"))).where("any > 0").select("tokens", "cluster")


def match_donors(donors: DataFrame, pool: DataFrame, seed: int | str = 0) -> DataFrame:
    """(donor, family_id, removed, removed_tokens, donor_tokens, ...): donors in order of family and id take the free pool file of nearest tokens, ties
    by hash of seed and id; no file serves twice.

    A choice depends on those before it in the same of clusters() only, so tasks read the sorted streams of pool files (id, hash, tokens) and donors of one cluster after the other.
    """
    own = donors.select(F.col("id").cast("string").alias("id"), F.col("tokens").cast("double").alias("tokens"), F.col("family_id").cast("string").alias("tie"), F.lit(True).alias("donor"))
    files = pool.select(F.col("id").cast("string").alias("id"), F.col("tokens").cast("double").alias("tokens"), stable(seed, F.col("id")).alias("tie"), F.lit(False).alias("donor"))
    known = materialise(clusters(own, files))
    stream = files.unionByName(own).join(known, "tokens").repartition(parts(pool, 4.0), "cluster").sortWithinPartitions("cluster", "donor", F.when(~F.col("donor"), F.col("tokens")), "tie", "id")
    got = stream.mapInArrow(_match, "donor string, family_id string, removed string, removed_tokens double")
    out = got.join(own.select(F.col("id").alias("donor"), F.col("tokens").alias("donor_tokens")), "donor").withColumn("signed_difference", F.col("donor_tokens") - F.col("removed_tokens"))
    return out.withColumn("absolute_difference", F.abs("signed_difference")).withColumn("relative_difference", F.col("absolute_difference") / F.col("removed_tokens"))


@dataclass
class Design:
    clean: DataFrame
    leak: DataFrame
    replacements: DataFrame
    budget: dict
    integrity: dict


def build(base: DataFrame, cohorts: DataFrame, treated: DataFrame, assignments: DataFrame, seed: int | str = 0, max_total: float | None = None, max_pair: float | None = None) -> Design:
    """Clean and contaminated training sets. base: (id, family_id, tokens); cohorts: (cohort, family_id) of treated, control, validation;
    treated: families with members; assignments: (family_id, donor_id, receiver_id).

    Clean is base without the cohorts' families and without donors and receivers; in the contaminated set the nearest files give way to the
    donors. Raises on violations, overlapping cohorts, and differences over the configured maxima.
    """
    validate.raise_first(validate.row_violations(base, tokens=True).unionByName(assignment_violations(treated, assignments)))
    if first := cohort_overlaps(cohorts).head(1):
        raise ValueError(f"probe family sets overlap: {first[0]['family_id']}")
    members = treated.select(F.explode("members").alias("m")).select("m.id", "m.family_id", "m.tokens")
    donors = materialise(members.join(assignments.select(F.col("donor_id").alias("id")).distinct(), "id", "left_semi"))
    named = assignments.select(F.explode(F.array("donor_id", "receiver_id")).alias("id"))
    clean = materialise(protected_rows(base, cohorts, named))
    swaps = materialise(match_donors(donors, clean, seed))
    if max_pair is not None and (bad := swaps.where(F.col("relative_difference") > max_pair).head(1)):
        raise ValueError(f"pair token relative difference {bad[0]['relative_difference']} exceeds configured maximum {max_pair}")
    columns = ["id", "family_id", "tokens"]
    leak = clean.join(swaps.select(F.col("removed").alias("id")), "id", "left_anti").select(*columns).unionByName(donors.select(*columns))
    total, after = clean.agg(F.sum("tokens")).first()[0], leak.agg(F.sum("tokens")).first()[0]
    if not total:
        raise ValueError("undefined token budget: clean total is zero")
    relative = abs(after - total) / total
    if max_total is not None and relative > max_total:
        raise ValueError(f"total token relative difference {relative} exceeds configured maximum {max_total}")
    both = clean.select(*columns).unionByName(leak)
    receivers = assignments.select(F.col("receiver_id").alias("id")).distinct()
    families = treated.select("family_id").distinct()
    integrity = {
        "receiver_in_train": both.join(receivers, "id", "left_semi").count(),
        "non_designated_treated_in_train": both.join(families, "family_id", "left_semi").join(donors.select("id"), "id", "left_anti").count(),
        "family_sets_disjoint": True,
    }
    budget = {"matching": "EXACT" if after == total else "APPROXIMATE", "clean_total_tokens": total, "family_leak_total_tokens": after, "absolute_total_difference": abs(after - total), "relative_total_difference": relative}
    return Design(clean, leak, swaps, budget, integrity)


def in_place(design: Design) -> DataFrame:
    """(place, id, family_id, tokens): the contaminated set in the order of ids of the clean one, each donor in the place of the file that it replaces."""
    from kinfold.operators.split import global_rank

    clean = design.clean.select(F.col("id").cast("string").alias("id"), "family_id", "tokens")
    placed = global_rank(clean.withColumn("_h", stable("place", F.col("id"))), "_h", [F.col("_h"), F.col("id")], "place")
    donors = design.leak.select(F.col("id").cast("string").alias("donor"), F.col("family_id").alias("_family"), F.col("tokens").alias("_tokens"))
    swaps = design.replacements.select(F.col("removed").alias("id"), F.col("donor")).join(donors, "donor")
    both = placed.join(swaps, "id", "left")
    return both.select("place", F.coalesce("donor", "id").alias("id"), F.coalesce("_family", "family_id").alias("family_id"), F.coalesce("_tokens", "tokens").alias("tokens"))


def override_slots(clean: DataFrame, other: DataFrame, key: str = "slot") -> DataFrame:
    """Every slot of clean, whole rows from other where other has the slot."""
    own, new = F.struct(*(F.col(f"c.{x}") for x in clean.columns)), F.struct(*(F.col(f"o.{x}").alias(x) for x in clean.columns))
    both = clean.alias("c").join(other.select(*clean.columns).alias("o"), F.col(f"c.{key}") == F.col(f"o.{key}"), "left")
    return both.select(F.when(F.col(f"o.{key}").isNotNull(), new).otherwise(own).alias("r")).select("r.*")
