"""I-Match document fingerprints over randomised lexicon subsets. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Terms of the lexicon stand in this share of all documents, so their idf is within ln(1/0.2) and ln(1/0.005). The shares of all terms sum
#: to the mean number of distinct terms a document has, so a lexicon has no more than 200 times as many terms, however many documents there are.
LEAST_SHARE, MOST_SHARE = 0.005, 0.2
#: A text with fewer lexicon terms than this is fingerprinted by all its terms.
FEW = 4
#: (bits to skip, random lexicon subsets, of which GROUPS are hashed): a term is in a subset with probability 1/32, 1/256, 1/2048.
LEVELS = ((0, 32), (12, 256), (26, 2048))
GROUPS = 32
WIDTH = 3
NONE = "-" * WIDTH
#: Documents that one window of neighbours holds, about.
NEIGHBOURS = 1000
#: Boundaries between windows, at most 2**14 - 1.
DEPTH = 14


def term_hashes(text: Column) -> Column:
    """Distinct terms (runs of letters and digits, lower case) as hashes."""
    words = F.filter(F.split(F.lower(text), "[^\\p{L}\\p{N}]+"), lambda w: w != "")
    return F.array_distinct(F.transform(words, lambda w: F.xxhash64(w)))


def lexicon(docs: DataFrame, text_col: str = "text", least: float = LEAST_SHARE, most: float = MOST_SHARE) -> list[int]:
    """Hashes of the terms within the band. Document frequencies are exact and over all documents."""
    n = docs.count()
    terms = docs.select(F.explode(term_hashes(F.col(text_col))).alias("term"))
    band = terms.groupBy("term").agg(F.count("*").alias("df")).where(F.col("df").between(max(2, least * n), most * n))
    return sorted(r[0] for r in band.select("term").collect())


def _once(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns behind a generator, so that the optimizer does not copy their expressions into the lambdas that use them."""
    made = F.struct(*(c.alias(k) for k, c in columns.items()))
    return df.select("*", F.explode(F.array(made)).alias("_made")).select("*", *(F.col(f"_made.{k}").alias(k) for k in columns)).drop("_made")


def _subset(skip: int, subsets: int):
    return lambda term: F.shiftrightunsigned(term, skip).bitwiseAND(F.lit(subsets - 1).cast("long"))


def _sampled(terms: str, skip: int, subsets: int) -> Column:
    of = _subset(skip, subsets)
    return F.filter(terms, lambda t: of(t) < GROUPS)


def _groups(terms: str, skip: int, subsets: int) -> Column:
    of = _subset(skip, subsets)
    split = F.transform(F.sequence(F.lit(0), F.lit(GROUPS - 1)), lambda g: F.filter(terms, lambda t: of(t) == g))
    shown = F.transform(split, lambda x: F.when(F.size(x) == 0, F.lit(NONE)).otherwise(F.lower(F.substring(F.lpad(F.hex(F.xxhash64(x)), 16, "0"), 1, WIDTH))))
    return F.array_join(shown, "")


def with_fingerprint(df: DataFrame, text: Column, words: list[int], name: str) -> DataFrame:
    """Adds the fingerprint of a text column: for each level and each of its GROUPS lexicon subsets the hash of the text's sorted
    distinct terms in that subset, WIDTH hex digits, or NONE if there are none. A term's own hash says in which subset of a level it is."""
    df = _once(df, _all=term_hashes(text))
    band = F.filter("_all", lambda t: t.isin(words)) if words else F.slice("_all", 1, 0)
    df = _once(df, _band=band)
    df = _once(df, _terms=F.array_sort(F.when(F.size("_band") < FEW, F.col("_all")).otherwise(F.col("_band"))))
    df = _once(df, **{f"_at{i}": _sampled("_terms", *level) for i, level in enumerate(LEVELS)})
    parts = [_groups(f"_at{i}", *level) for i, level in enumerate(LEVELS)]
    return df.withColumn(name, F.concat(*parts)).drop("_all", "_band", "_terms", *(f"_at{i}" for i in range(len(LEVELS))))


def _shared(counted: Column, least: int) -> Column:
    return F.transform(F.array(counted), lambda c: F.when(c["n"] >= least, c["same"] / c["n"]))[0]


def likeness(a: Column, b: Column, sure: int = 6) -> Column:
    """0 to 1: the share of equal hashes among the subsets that either text has terms in, at the finest level with `sure`
    such subsets (else at the coarsest); 1 for equal fingerprints."""
    out = None
    for i in range(len(LEVELS)):
        at = [F.struct(F.substring(a, j, WIDTH).alias("a"), F.substring(b, j, WIDTH).alias("b")) for j in range(1 + i * GROUPS * WIDTH, 1 + (i + 1) * GROUPS * WIDTH, WIDTH)]
        pairs = F.filter(F.array(*at), lambda x: (x["a"] != NONE) | (x["b"] != NONE))
        counted = F.aggregate(pairs, F.struct(F.lit(0).alias("n"), F.lit(0).alias("same")), lambda acc, x: F.struct((acc["n"] + 1).alias("n"), (acc["same"] + (x["a"] == x["b"]).cast("int")).alias("same")))
        share = _shared(counted, sure if i else 1)
        out = share if out is None else F.coalesce(share, out)
    return F.when(a == b, F.lit(1.0)).otherwise(F.coalesce(out, F.lit(0.0)))


def _boundaries(docs: DataFrame, id_col: str) -> tuple[list[int], bool]:
    """Ids that start the windows, the smallest first, and whether null ids exist."""
    n, nulls = docs.agg(F.count("*"), F.count_if(F.col(id_col).isNull())).first()
    many = min((1 << DEPTH) - 1, max(1, n // NEIGHBOURS))
    got = docs.agg(F.percentile_approx(id_col, [i / many for i in range(many)], 20 * many), F.min(id_col)).first()
    return sorted({*(got[0] or []), *([got[1]] if got[1] is not None else [])}), nulls > 0


def _rank(value: Column, cuts: Column) -> Column:
    """How many of the sorted cuts, padded with the largest long, are at most the value, by binary search."""
    return F.aggregate(F.array(*(F.lit(1 << k) for k in range(DEPTH - 1, -1, -1))), F.lit(0), lambda acc, step: F.when(F.element_at(cuts, acc + step) <= value, acc + step).otherwise(acc))


def with_next(df: DataFrame, cuts: list[int], nulls: bool, payload: list[str]) -> DataFrame:
    """Each row with next_<payload> of the row that follows by (id, key); after the last row comes the first.

    Rows go to windows that start at the cuts. The row that starts a window also goes, as a mark, to the window before, and the
    first row of all goes to the last window, so that no window of all rows is needed.
    """
    last = len(cuts)
    size = (1 << DEPTH) - 1
    table = F.from_json(F.lit("[" + ",".join(map(str, cuts + [(1 << 63) - 1] * (size - last))) + "]"), "array<bigint>")
    own = F.coalesce(_rank(F.col("id").cast("long"), table), F.lit(0))
    df = _once(df, _own=own)
    first = F.element_at(table, F.greatest("_own", F.lit(1))) == F.col("id")
    place = lambda w, late, real: F.struct(w.cast("int").alias("window"), F.lit(late).alias("late"), F.lit(real).alias("real"))
    marks = F.when(F.col("id").isNull(), F.array(place(F.lit(last), 1, 0))).when(first & (F.col("_own") > 1), F.array(place(F.col("_own") - 1, 0, 0)))
    marks = marks.when(first & (F.col("_own") == 1), F.array(place(F.lit(0 if nulls else last), 0 if nulls else 1, 0)))
    df = df.select("*", F.explode(F.concat(F.array(place(F.col("_own"), 0, 1)), F.coalesce(marks, F.array().cast("array<struct<window:int,late:int,real:int>>")))).alias("_at"))
    order = Window.partitionBy("_at.window").orderBy("_at.late", F.col("id").asc_nulls_first(), "key", F.col("_at.real").desc())
    nexts = F.lead(F.struct(*payload)).over(order)
    out = df.withColumn("_next", nexts).where("_at.real = 1")
    return out.select(*[c for c in df.columns if c not in ("_own", "_at")], *(F.col(f"_next.{p}").alias(f"next_{p}") for p in payload))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST_SHARE, most: float = MOST_SHARE) -> DataFrame:
    """One row per document: id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text is the text with its last floor(n_chars / 2) code points replaced by as many (or all) from the start of the next document
    in ascending order of id; rows with equal ids follow by a hash of the text, null ids come first, after the last comes the first, a single
    row follows itself. Null text is empty: it has no terms and the fingerprint of none. Ids must be integers. Other columns are ignored; an empty table gives no rows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    read = docs.select(F.col(id_col).alias("id"), text.alias("text"))
    words = lexicon(read, "text", least, most)
    cuts, nulls = _boundaries(read, "id")
    rows = with_fingerprint(read.withColumn("key", F.xxhash64("text")).withColumn("n_chars", F.char_length("text").cast("long")), F.col("text"), words, "fingerprint")
    rows = with_next(rows, cuts, nulls, ["text", "fingerprint"])
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - half), F.substring("next_text", F.lit(1), half))
    rows = with_fingerprint(_once(rows, edited=edited), F.col("edited"), words, "edited_fingerprint")
    return rows.select(
        F.col("id").alias(id_col),
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        "fingerprint",
        "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )
