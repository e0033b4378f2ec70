"""Secret scan: fixed patterns, and candidate values weighed by how many owners have them. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.runtime import materialise

KINDS = ("assign", "access", "hex", "generic")
#: What the stand-in for a null repository begins with.
NOWHERE = "\x00"
#: Patterns in Java's syntax; the group that holds the value; the least length of the value.
_ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
_PATTERNS = ((_ASSIGN, 1, 6), ("(AKIA[A-Z0-9]{16,})", 1, 20), ("([0-9a-f]{24,})", 1, 24), ("(?<![A-Za-z0-9+/_-])([A-Za-z0-9+/_-]{20,}+)", 1, 20))


def places(text: Column, number: int) -> Column:
    """array<struct<start, kind, end, value>> of one pattern's matches, in code points.

    The pieces that split() leaves between the matches give the places: a match starts where the pieces and matches before it end.
    """
    pattern, group, least = _PATTERNS[number]
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    between = F.slice(F.split(text, pattern, -1), 1, F.size(whole))
    steps = F.transform(F.arrays_zip(between.alias("gap"), whole.alias("all"), value.alias("value")), lambda x: F.struct(F.char_length(x["gap"]).cast("long").alias("gap"), F.char_length(x["all"]).cast("long").alias("n"), x["value"].alias("value")))
    empty = F.array().cast("array<struct<start:bigint,kind:int,end:bigint,value:string>>")

    def add(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        one = F.struct(start.alias("start"), F.lit(number).alias("kind"), (start + x["n"]).alias("end"), x["value"].alias("value"))
        return F.struct((start + x["n"]).alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

    folded = F.aggregate(steps, F.struct(F.lit(0).cast("long").alias("at"), empty.alias("out")), add)["out"]
    kept = F.filter(folded, lambda s: F.char_length(s["value"]) >= least)
    return F.when(text.rlike(pattern), kept).otherwise(empty)


def _text(spans: Column) -> Column:
    name = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(name, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repository_col: str = "source", common_owners: int = 3) -> DataFrame:
    """One row per document: id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_example, classes, repositories.

    Base spans are those of the three fixed patterns. A further candidate is a run of 20 or more characters of letters, digits and +/_- with
    a capital, a small letter and a digit that touches no base span. The values of all candidates are counted over the corpus by
    distinct repositories and owners (a repository's owner is its name up to the first /): a value of a single owner is live-looking, one of `common_owners` or
    more an example, one in between shared. Further candidates become spans of kind generic if they are live-looking. `classes` has the class of each span (live,
    shared or example) in the order of spans, `repositories` the most repositories that hold one of the document's values. Null text is empty; a row of null
    repository is an owner and repository of its own; rows with equal ids and texts get equal results and stay separate; a null id stays null; other
    columns are ignored; an empty table gives no rows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    own = F.concat(F.lit(NOWHERE), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), F.sha2(text, 256))
    read = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(repository_col), own).alias("repository"), text.alias("text"))
    found = read.select("id", "repository", F.xxhash64("text").alias("key"), *(places(F.col("text"), i).alias(k) for i, k in enumerate(KINDS)))
    base = F.array_sort(F.concat("assign", "access", "hex"))
    found = found.withColumn("base", base)
    mixed = F.filter("generic", lambda g: g["value"].rlike("[A-Z]") & g["value"].rlike("[a-z]") & g["value"].rlike("[0-9]") & ~F.exists("base", lambda b: (b["start"] < g["end"]) & (g["start"] < b["end"])))
    rows = materialise(found.select("id", "repository", "key", *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:3]), F.sha2(_text(F.col("base")), 256).alias("base_sha256"), _text(F.col("base")).alias("base_text"), F.concat("base", mixed).alias("candidates")))
    each = rows.where(F.size("candidates") > 0).select("id", "key", "repository", F.explode("candidates").alias("c")).select("id", "key", "repository", "c.start", "c.kind", "c.end", F.sha2("c.value", 256).alias("value"))
    owned = each.select("value", "repository").distinct().groupBy("value", F.substring_index("repository", "/", 1).alias("owner")).agg(F.count("*").alias("n"))
    held = owned.groupBy("value").agg(F.sum("n").alias("repositories"), F.count("*").alias("owners"))
    weighed = each.select("id", "key", "start", "kind", "end", "value").distinct().join(held, "value")
    live = F.col("owners") == 1
    of = F.when(live, "live").when(F.col("owners") >= common_owners, "example").otherwise("shared")
    kept = weighed.groupBy("id", "key").agg(
        F.array_sort(F.collect_list(F.when((F.col("kind") < 3) | live, F.struct("start", "kind", "end", of.alias("class"))))).alias("spans"),
        F.count_if(live).alias("n_live"),
        F.count_if(F.col("owners") >= common_owners).alias("n_example"),
        F.max("repositories").alias("repositories"),
    )
    kept = kept.select(F.col("id").alias("kept_id"), F.col("key").alias("kept_key"), _text(F.col("spans")).alias("spans"), "n_live", "n_example", F.array_join("spans.class", ",").alias("classes"), "repositories")
    out = rows.join(kept, rows["id"].eqNullSafe(F.col("kept_id")) & (rows["key"] == F.col("kept_key")), "left")
    return out.select(F.col("id").alias(id_col), *(f"n_{k}" for k in KINDS[:3]), "base_sha256", F.coalesce("spans", "base_text").alias("spans"), F.coalesce("n_live", F.lit(0)).alias("n_live"), F.coalesce("n_example", F.lit(0)).alias("n_example"), F.coalesce("classes", F.lit("")).alias("classes"), F.coalesce("repositories", F.lit(0)).alias("repositories"))
