"""URL filter: path rules, and for the rest trust and distrust propagated over links between hosts."""

from __future__ import annotations

import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.runtime import discard, materialise


@dataclass(frozen=True)
class Rule:
    verdict: str  # allow or block
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


RULES = (Rule("allow", "org", "/"), Rule("block", "example.org", "/es/"), Rule("block", "example.org", "/en/1"), Rule("allow", "com", "/fr/"), Rule("block", "com", "/de/"))

#: Steps of the walks that one job makes.
STEPS = 8
_LINK = r"""(?i)href\s*=\s*["']?(?:https?:)?//([^/?#"'\s<>]+)"""


def host_of(url: Column) -> Column:
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _fit(rule: Rule, host: Column, path: Column) -> Column:
    return ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)


def match(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; null where none does."""
    order = sorted(rules, key=lambda r: (-len(r.text), r.text))
    rule = F.coalesce(*(F.when(_fit(r, host, path), F.lit(r.text)) for r in order), F.lit(None).cast("string"))
    verdict = F.coalesce(*(F.when(_fit(r, host, path), F.lit(r.verdict)) for r in order), F.lit(None).cast("string"))
    return rule, verdict


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, n): links from pages of one host to another host, and between a host and its parent domain if that has pages.

    A parent is the host without its first label, if that leaves two labels at least.
    """
    links = pages.where("html like '%//%'").select(F.col("host").alias("src"), F.explode(F.regexp_extract_all("html", F.lit(_LINK), F.lit(1))).alias("dst"))
    links = links.select("src", F.translate("dst", string.ascii_uppercase, string.ascii_lowercase).alias("dst")).where("src <> '' and src <> dst")
    links = links.groupBy("src", "dst").agg(F.count("*").cast("double").alias("n"))
    hosts = pages.select("host").distinct()
    up = hosts.where("host like '%.%.%'").select("host", F.regexp_replace("host", r"^[^.]*\.", "").alias("parent")).join(hosts.select(F.col("host").alias("parent")), "parent", "left_semi")
    site = up.select(F.col("host").alias("src"), F.col("parent").alias("dst"), F.lit(1.0).alias("n")).unionByName(up.select(F.col("parent").alias("src"), F.col("host").alias("dst"), F.lit(1.0).alias("n")))
    return links.unionByName(site).groupBy("src", "dst").agg(F.sum("n").alias("n"))


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = 0.85, tolerance: float = 1e-10) -> DataFrame:
    """(host, trust, distrust): personalised PageRank of the trusted seeds along links, and of the blocked seeds against them.

    seeds: (host, trust, distrust), the restart mass of each host; either kind is scaled to a sum of 1. Both ranks walk in one table: side
    0 follows src to dst, side 1 dst to src. A rank is the sum of all walks from the restart, each step kept with probability `damping`.
    A host without links returns its mass to the restart, which is the same as scaling each side's sum of walks to 1 at the end.

    Every step is one join on the host and one sum; STEPS of them make a job, whose result is written to shared scratch. A step loses
    1 - damping of the mass at least, so steps end by themselves when what still walks is under the tolerance (142 by default, 144
    as they come in jobs), earlier where no walk has a link left.
    """
    both = edges.select(F.lit(0).alias("side"), "src", "dst", "n").unionByName(edges.select(F.lit(1).alias("side"), F.col("dst").alias("src"), F.col("src").alias("dst"), "n"))
    out = both.groupBy("side", "src").agg(F.sum("n").alias("total"))
    links = both.join(out, ["side", "src"]).select("side", "src", "dst", (damping * F.col("n") / F.col("total")).alias("p"))
    sides = F.array(F.struct(F.lit(0).alias("side"), F.col("trust").alias("r")), F.struct(F.lit(1).alias("side"), F.col("distrust").alias("r")))
    start = seeds.select("host", F.explode(sides).alias("x")).select("x.side", "host", "x.r").where("r > 0")
    sums = start.groupBy("side").agg(F.sum("r").alias("all"))
    state = materialise(start.join(F.broadcast(sums), "side").select("side", "host", (F.col("r") / F.col("all")).alias("r")).withColumn("walked", F.col("r")))
    stay = both.select("side", F.col("src").alias("host")).union(both.select("side", "dst")).union(state.select("side", "host")).distinct()
    step = materialise(links.withColumnRenamed("src", "host").unionByName(stay.select("side", "host", F.col("host").alias("dst"), F.lit(None).cast("double").alias("p"))))  # p is null: what a host holds stays with it
    left = 2.0 if step.where("p is not null").head(1) else 0.0
    while left > tolerance:
        after = state
        for _ in range(STEPS):
            moved = after.join(step, ["side", "host"])
            goes = moved.select("side", F.col("dst").alias("host"), F.coalesce(F.col("r") * F.col("p"), F.lit(0.0)).alias("r"), F.when(F.col("p").isNull(), F.col("walked")).otherwise(0.0).alias("walked"))
            after = goes.groupBy("side", "host").agg(F.sum("r").alias("r"), F.sum(F.col("walked") + F.col("r")).alias("walked"))
        after = materialise(after)
        discard(state)
        state = after
        left = state.agg(F.sum("r")).first()[0] or 0.0
    whole = state.groupBy("side").agg(F.sum("walked").alias("all"))
    ranks = state.join(F.broadcast(whole), "side").select("side", "host", (F.col("walked") / F.col("all")).alias("r"))
    return ranks.groupBy("host").agg(F.sum(F.when(F.col("side") == 0, F.col("r")).otherwise(0.0)).alias("trust"), F.sum(F.when(F.col("side") == 1, F.col("r")).otherwise(0.0)).alias("distrust"))


def judge(pages: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", margin: float = 2.0, least: float = 1e-6) -> DataFrame:
    """One row per page: id, host, path, rule, verdict, trust, distrust.

    A page that a rule fits has the rule's verdict. Any other is blocked if its host's distrust is over `margin` times its trust and at
    least `least` of what a blocked seed restarts with on average, and else allowed; hosts that no seed reaches have neither and are allowed.
    Trust and distrust sum to 1 each. Seeds are hosts with rule-matched pages: a host restarts with its share of all matched pages that
    are allowed (trust), and of those that are blocked (distrust). Of equally long rules the first in text order holds, of equal rules the
    first given. Null urls and urls without :// have an empty host and path and are no part of the graph; null html has no links. Repeated
    pages are judged one by one; their links count again. Other columns are ignored; an empty table gives no rows.
    """
    host, path = host_of(F.col(url_col)), path_of(F.col(url_col))
    rule, verdict = match(F.col("host"), F.col("path"), rules)
    read = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"), F.col(html_col).alias("html"))
    ruled = read.select("id", "host", "path", rule.alias("rule"), verdict.alias("ruled"))
    counts = materialise(ruled.where("ruled is not null and host <> ''").groupBy("host").agg(F.count_if(F.col("ruled") == "allow").alias("trust"), F.count_if(F.col("ruled") == "block").alias("distrust")))
    blocked = max(1, counts.where("distrust > 0").count())
    ranks = propagate(host_edges(read), counts, tolerance=1e-4 * least / blocked)
    seen = ruled.join(ranks, "host", "left")
    trust, distrust = F.coalesce("trust", F.lit(0.0)), F.coalesce("distrust", F.lit(0.0))
    own = F.when((distrust > margin * trust) & (distrust >= least / blocked), F.lit("block")).otherwise(F.lit("allow"))
    return seen.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("ruled", own).alias("verdict"), trust.alias("trust"), distrust.alias("distrust"))
