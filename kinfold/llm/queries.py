"""The queries of this folder, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.llm import decontam, imatch, labelled, licences, packing, pii, quality, secrets, simhash, toxicity, urls


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def word_bpe() -> str:
    """Where the worker's own copy of the vocabulary file is."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), word_bpe)


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def _judged(scored: DataFrame, folds: int, held: int, at: float, *more: str) -> DataFrame:
    return scored.select("doc_id", F.coalesce(labelled.fold("doc_id", folds) == held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= at).cast("int").alias("predicted"), *more)


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, table(spark, sf_dir, "labels"), lambda c: F.crc32(c.cast("string").cast("binary")) % 4 != 2)
    return _judged(quality.score(docs, model), 4, 2, 0.7)


def toxicity_model(spark: SparkSession, sf_dir: str) -> toxicity.Model:
    return toxicity.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), lambda c: F.crc32(c.cast("string").cast("binary")) % 5 != 0)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.score(table(spark, sf_dir, "documents"), toxicity_model(spark, sf_dir))
    return _judged(scored, 5, 0, 0.5, "spans")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op5_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.fingerprints(table(spark, sf_dir, "documents"))


def op9_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_url_filter, op2_simhash_near_dedup, op3_best_fit_packing, op4_secret_scan, op5_document_fingerprints, op6_benchmark_decontamination, op7_pii, op8_quality_classifier, op9_licence_scan, op10_toxicity)}
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: op6 as a join of word windows; positions are counted over the distinct hit words of each document.
_OP6 = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT item_id::VARCHAR AS item, regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
q AS (SELECT DISTINCT item, least(8, len(w)) AS k, array_to_string(w[p:p + least(8, len(w)) - 1], ' ') AS g FROM (SELECT item, w, unnest(range(1, len(w) - least(8, len(w)) + 2)) AS p FROM b WHERE len(w) > 0)), ks AS (SELECT DISTINCT k FROM q),
h AS (SELECT r, p, q.k, item FROM (SELECT r, k, p, array_to_string(w[p:p + k - 1], ' ') AS g FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM d, ks WHERE len(w) >= k)) x JOIN q ON q.k = x.k AND q.g = x.g),
n AS (SELECT r, count(DISTINCT pos) AS n_hit FROM (SELECT r, unnest(range(p, p + k)) AS pos FROM (SELECT DISTINCT r, p, k FROM h)) GROUP BY r), i AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM h) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated FROM d LEFT JOIN n USING (r) LEFT JOIN i USING (r)"""


def _places(number: int, pattern: str, group: int, least: int) -> str:
    """Matches of one pattern as structs of start, kind, end and value, from the pieces between them."""
    return f"""(SELECT r, list({{'start': s, 'kind': {number}, 'end': e, 'value': v}} ORDER BY s) AS spans FROM (SELECT r, v, sum(length(g) + length(m)) OVER w - length(m) AS s, sum(length(g) + length(m)) OVER w AS e FROM
 (SELECT r, unnest(string_split_regex(t, '{pattern}')[1:len(regexp_extract_all(t, '{pattern}'))]) AS g, unnest(regexp_extract_all(t, '{pattern}')) AS m, unnest(regexp_extract_all(t, '{pattern}', {group})) AS v, unnest(range(len(regexp_extract_all(t, '{pattern}')))) AS i FROM d WHERE regexp_matches(t, '{pattern}')) WINDOW w AS (PARTITION BY r ORDER BY i)) WHERE length(v) >= {least} GROUP BY r)"""


_QUOTE = chr(39) * 2
_ASSIGN = f"""(?i:password|passwd|secret|token|api_?key)["{_QUOTE}]?\\x20*[:=]\\x20*["{_QUOTE}]?([A-Za-z0-9+/_.=-]+)"""
_SPANS = "coalesce(list_aggregate(list_transform(list_sort({0}), lambda x: ['assign', 'access', 'hex', 'generic'][x.kind + 1] || ':' || x.start || ':' || x.end), 'string_agg', ','), '')"
_OP4 = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(source, chr(1) || coalesce(doc_id::VARCHAR, '') || ':' || sha256(coalesce(text, ''))) AS repo, coalesce(text, '') AS t FROM documents),
a AS {_places(0, _ASSIGN, 1, 6)}, k AS {_places(1, 'AKIA[A-Z0-9]{16,}', 0, 20)}, x AS {_places(2, '[0-9a-f]{24,}', 0, 24)}, g AS {_places(3, '[A-Za-z0-9+/_-]{20,}', 0, 20)},
j AS (SELECT d.r, doc_id, repo, coalesce(len(a.spans), 0) AS n_assign, coalesce(len(k.spans), 0) AS n_access, coalesce(len(x.spans), 0) AS n_hex, list_sort(coalesce(a.spans, []) || coalesce(k.spans, []) || coalesce(x.spans, [])) AS base, coalesce(g.spans, []) AS gen FROM d LEFT JOIN a USING (r) LEFT JOIN k USING (r) LEFT JOIN x USING (r) LEFT JOIN g USING (r)),
m AS (SELECT *, list_filter(gen, lambda y: regexp_matches(y.value, '[A-Z]') AND regexp_matches(y.value, '[a-z]') AND regexp_matches(y.value, '[0-9]') AND len(list_filter(base, lambda z: z.start < y.end AND y.start < z.end)) = 0) AS more FROM j),
c AS (SELECT r, repo, unnest(base || more) AS s FROM m), o AS (SELECT s.value AS value, count(DISTINCT string_split(repo, '/')[1]) AS owners, count(DISTINCT repo) AS repositories FROM c GROUP BY ALL),
f AS (SELECT r, list(s) FILTER (s.kind < 3 OR owners = 1) AS spans, count(*) FILTER (owners = 1) AS n_live, count(*) FILTER (owners >= 3) AS n_example, max(repositories) AS repositories, string_agg(CASE WHEN owners = 1 THEN 'live' WHEN owners >= 3 THEN 'example' ELSE 'shared' END, ',' ORDER BY s) FILTER (s.kind < 3 OR owners = 1) AS classes FROM c JOIN o ON o.value = s.value GROUP BY r)
SELECT doc_id, n_assign, n_access, n_hex, sha256({_SPANS.format('base')}) AS base_sha256, {_SPANS.format('coalesce(spans, [])')} AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_example, 0) AS n_example, coalesce(classes, '') AS classes, coalesce(repositories, 0) AS repositories FROM m LEFT JOIN f USING (r)"""

_FITS = sorted(urls.RULES, key=lambda r: -len(r.text))
_CASE = "CASE " + " ".join(f"WHEN (host = '{r.host}' OR host LIKE '%.{r.host}') AND path LIKE '{r.path}%' THEN '{{0[{i}]}}'" for i, r in enumerate(_FITS)) + " END"
_HOST = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: op1 from the definition: a rank is the sum of all walks from the restart, scaled to 1; those of over 240 steps hold 1e-17 of it. A host's
#: links go to the hosts that its pages name, and both ways between a host and the host without its first label, if that has pages and a dot.
_OP1 = f"""WITH RECURSIVE p AS (SELECT page_id, html, {_HOST.format("regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1)")} AS host, regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
u AS (SELECT page_id, host, path, {_CASE.format([r.text for r in _FITS])} AS rule, {_CASE.format([r.verdict for r in _FITS])} AS ruled FROM p),
links AS (SELECT host AS src, {_HOST.format("dst")} AS dst FROM (SELECT host, unnest(regexp_extract_all(html, '(?i)href\\s*=\\s*["'']?(?:https?:)?//([^/?#"''\\s<>]+)', 1)) AS dst FROM p)),
hosts AS (SELECT DISTINCT host, split_part(host, '.', 1) AS label FROM p), family AS (SELECT c.host AS child, a.host AS parent FROM hosts c JOIN hosts a ON c.host = c.label || '.' || a.host WHERE contains(a.host, '.')),
e AS (SELECT src, dst, count(*)::DOUBLE AS n FROM (SELECT * FROM links WHERE src <> '' AND src <> dst UNION ALL SELECT child, parent FROM family UNION ALL SELECT parent, child FROM family) GROUP BY ALL),
step AS (SELECT side, src, dst, 0.85::DOUBLE * n / sum(n) OVER (PARTITION BY side, src) AS p FROM (SELECT 'trust' AS side, src, dst, n FROM e UNION ALL SELECT 'distrust', dst, src, n FROM e)),
seed AS (SELECT CASE ruled WHEN 'allow' THEN 'trust' ELSE 'distrust' END AS side, host, count(*)::DOUBLE AS n FROM u WHERE ruled IS NOT NULL AND host <> '' GROUP BY ALL),
w(j, side, host, r) AS (SELECT 0, side, host, n / sum(n) OVER (PARTITION BY side) FROM seed UNION ALL SELECT j + 1, side, dst, sum(r * p) FROM (SELECT w.j, w.side, step.dst, w.r, step.p FROM w JOIN step ON step.side = w.side AND step.src = w.host WHERE w.j < 240) GROUP BY ALL),
rank AS (SELECT side, host, sum(r) / sum(sum(r)) OVER (PARTITION BY side) AS r FROM w GROUP BY side, host), k AS (SELECT host, coalesce(sum(r) FILTER (side = 'trust'), 0) AS trust, coalesce(sum(r) FILTER (side = 'distrust'), 0) AS distrust FROM rank GROUP BY host),
least AS (SELECT 1e-6 / greatest(1, count(*)) AS least FROM seed WHERE side = 'distrust')
SELECT page_id, u.host, path, rule, coalesce(ruled, CASE WHEN distrust > 2 * trust AND distrust >= least THEN 'block' ELSE 'allow' END) AS verdict FROM u CROSS JOIN least LEFT JOIN k ON k.host = u.host"""

ORACLES: dict[str, str] = {"op1_url_filter": _OP1, "op4_secret_scan": _OP4, "op6_benchmark_decontamination": _OP6}
