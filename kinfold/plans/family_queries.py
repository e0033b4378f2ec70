"""Families, splits, audits, census and relation queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold import validate
from kinfold.hashing import stable
from kinfold.operators import audit, census, contamination, graph, simulation, split, stats
from kinfold.plans import views
from kinfold.plans.catalogue import query
from kinfold.runtime import materialise
from kinfold.sources import files

R = 9


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, R) for n in names})


@query(f"WITH {views.FILES} SELECT id, split FROM files")
def stable_hash_split(spark: SparkSession, sf: str) -> DataFrame:
    return views.files(spark, sf).select("id", "split")


@query("WITH g AS (SELECT text, sha256('family-component-v1' || chr(0) || string_agg(doc_id::VARCHAR, chr(0) ORDER BY doc_id::VARCHAR)) AS family_id FROM documents GROUP BY text) SELECT doc_id::VARCHAR AS id, family_id FROM documents JOIN g USING (text)")
def exact_family_map(spark: SparkSession, sf: str) -> DataFrame:
    rows = views.files(spark, sf)
    return graph.family_map(rows.select("id"), graph.identical_edges(rows, "family_id"))


_SIDES = "sides AS (SELECT family_id, count(*) AS family_size, count(*) FILTER (split = 'train') AS train_files, count(*) FILTER (split = 'test') AS test_files FROM {0} GROUP BY family_id)"


@query(f"WITH {views.FILES}, {_SIDES.format('files')} SELECT *, train_files > 0 AND test_files > 0 AS contaminated FROM sides")
def leakage_audit_families(spark: SparkSession, sf: str) -> DataFrame:
    return audit.family_sides(views.files(spark, sf))


_AUDIT = """SELECT count(*) FILTER (test_files > 0) AS test_families, sum(test_files)::BIGINT AS test_files, count(*) FILTER (train_files > 0 AND test_files > 0) AS contaminated_test_families,
 coalesce(sum(test_files) FILTER (train_files > 0), 0)::BIGINT AS contaminated_test_files, round(count(*) FILTER (train_files > 0 AND test_files > 0) / nullif(count(*) FILTER (test_files > 0), 0), 9) AS test_family_contamination_rate,
 round(coalesce(sum(test_files) FILTER (train_files > 0), 0) / nullif(sum(test_files), 0), 9)::DOUBLE AS test_file_contamination_rate, CASE WHEN sum(test_files) = 0 THEN 'zero test denominator' END AS undefined_rate_reason FROM sides"""


@query(f"WITH {views.ORDERS}, {_SIDES.format('ord')} {_AUDIT}")
def leakage_audit_summary(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(audit.audit_summary(views.orders(spark, sf)), "test_family_contamination_rate", "test_file_contamination_rate")


@query(f"WITH {views.FILES}, {_SIDES.format('files')} SELECT family_id, any_value(family_size) AS family_size, string_agg(id, ',' ORDER BY id) FILTER (split = 'test') AS test_ids, string_agg(id, ',' ORDER BY id) FILTER (split = 'train') AS train_ids FROM files JOIN sides USING (family_id) WHERE train_files > 0 AND test_files > 0 GROUP BY family_id")
def contaminated_families(spark: SparkSession, sf: str) -> DataFrame:
    return audit.contaminated_families(views.files(spark, sf))


@query(f"WITH {views.ORDERS} SELECT family_size, count(*) AS families FROM (SELECT count(*) AS family_size FROM ord GROUP BY family_id) GROUP BY family_size")
def family_size_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return audit.size_histogram(views.orders(spark, sf))


@query(f"WITH {views.ORDERS} SELECT n.split, count(id) AS files, coalesce(sum(tokens), 0)::BIGINT AS tokens FROM (VALUES ('train'), ('validation'), ('test'), ('reserve')) n(split) LEFT JOIN ord USING (split) GROUP BY n.split")
def split_file_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    names = spark.range(1).select(F.explode(F.array(*map(F.lit, ("train", "validation", "test", "reserve")))).alias("split"))
    return audit.split_counts(views.orders(spark, sf), names)


#: The greedy family split as a recursive query: one row for each family in order of weight.
_GREEDY = """RECURSIVE {0}, w AS (SELECT family_id, sum(tokens)::DOUBLE AS w FROM {1} GROUP BY 1),
r AS (SELECT family_id, w, row_number() OVER (ORDER BY w DESC, sha256('0' || chr(0) || family_id)) AS n FROM w), t AS (SELECT sum(w) * 0.8 AS t0, sum(w) * 0.1 AS t1, sum(w) * 0.1 AS t2 FROM w),
g(n, c0, c1, c2, family_id, choice) AS (SELECT 0::BIGINT, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, NULL::VARCHAR, -1 UNION ALL SELECT n, CASE WHEN j = 0 THEN c0 + w ELSE c0 END, CASE WHEN j = 1 THEN c1 + w ELSE c1 END, CASE WHEN j = 2 THEN c2 + w ELSE c2 END, family_id, j FROM
 (SELECT *, CASE WHEN a <= b AND a <= c THEN 0 WHEN b <= c THEN 1 ELSE 2 END AS j FROM (SELECT r.n, r.w, r.family_id, c0, c1, c2,
  ((c0 + w - t0) / t0) ** 2 + ((c1 - t1) / t1) ** 2 + ((c2 - t2) / t2) ** 2 AS a, ((c0 - t0) / t0) ** 2 + ((c1 + w - t1) / t1) ** 2 + ((c2 - t2) / t2) ** 2 AS b, ((c0 - t0) / t0) ** 2 + ((c1 - t1) / t1) ** 2 + ((c2 + w - t2) / t2) ** 2 AS c
  FROM g JOIN r ON r.n = g.n + 1 CROSS JOIN t)))"""


@query(f"WITH {_GREEDY.format(views.ORDERS, 'ord')} SELECT family_id, choice FROM g WHERE n > 0")
def family_aware_split(spark: SparkSession, sf: str) -> DataFrame:
    return split.family_choices(views.orders(spark, sf), (0.8, 0.1, 0.1))


@query(f"""WITH {_GREEDY.format(views.ORDERS, 'ord')}, s AS (SELECT ord.*, ['train', 'validation', 'test'][choice + 1] AS now FROM ord JOIN g USING (family_id))
SELECT count(DISTINCT family_id) AS family_components, count(*) AS files, count(*) FILTER (now = 'train') AS files_train, count(*) FILTER (now = 'validation') AS files_validation, count(*) FILTER (now = 'test') AS files_test,
 sum(tokens) FILTER (now = 'train')::BIGINT AS tokens_train, sum(tokens) FILTER (now = 'validation')::BIGINT AS tokens_validation, sum(tokens) FILTER (now = 'test')::BIGINT AS tokens_test, count(*) FILTER (split <> now) AS file_reassignment_count, round(count(*) FILTER (split <> now) / count(*), 9) AS file_reassignment_ratio FROM s""")
def family_aware_split_audit(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(split.split_audit(split.family_aware_split(views.orders(spark, sf))), "file_reassignment_ratio")


@query(f"""WITH {views.ORDERS}, n AS (SELECT count(*) AS n FROM ord), c AS (SELECT floor(0.8 * n) + n - floor(0.8 * n) - floor(0.1 * n) - floor(0.1 * n) AS a, floor(0.1 * n) AS b FROM n),
r AS (SELECT id, row_number() OVER (ORDER BY sha256('3' || chr(0) || id), id) AS k FROM ord) SELECT id, CASE WHEN k <= a THEN 'train' WHEN k <= a + b THEN 'validation' ELSE 'test' END AS split FROM r, c""")
def file_level_split(spark: SparkSession, sf: str) -> DataFrame:
    return split.file_split(views.orders(spark, sf).drop("split"), seed=3).select("id", "split")


@query(f"""WITH {views.ORDERS}, c AS (SELECT family_id AS component, count(*) AS size, row_number() OVER (ORDER BY sha256('component' || chr(0) || family_id), family_id) - 1 AS index FROM ord GROUP BY family_id), n AS (SELECT count(*) AS n FROM ord),
o AS (SELECT component, size, sum(size) OVER (ORDER BY size DESC, (index::HUGEINT * 2654435761 + 7) % 4294967296, index ROWS UNBOUNDED PRECEDING) AS total FROM c)
SELECT component, size, CASE WHEN total <= n - 2 * floor(0.1 * n) THEN 0 WHEN total <= n - floor(0.1 * n) THEN 1 ELSE 2 END AS choice FROM o, n""")
def component_threshold_split(spark: SparkSession, sf: str) -> DataFrame:
    o = views.orders(spark, sf)
    comps = o.groupBy(F.col("family_id").alias("component")).agg(F.count("*").alias("size"))
    hashed = comps.withColumn("_h", stable("component", F.col("component")))  # numbers of components in ranges of their hashes
    numbered = split.global_rank(hashed, "_h", [F.col("_h"), F.col("component")], "index").withColumn("index", F.col("index") - 1).drop("_h")
    return split.component_choices(numbered, o.count(), seed=7)


_SIZES = "sizes AS (SELECT count(*) AS family_size FROM ord GROUP BY family_id)"


@query(f"WITH {views.ORDERS}, {_SIZES} SELECT family_size, count(*) AS families, round(1 - pow(0.2::DOUBLE, family_size) - pow(0.9::DOUBLE, family_size) + pow(0.1::DOUBLE, family_size), 9) AS cross_probability, round(1 - pow(0.2::DOUBLE, family_size - 1), 9) AS test_member_has_train_sibling FROM sizes GROUP BY family_size")
def analytic_census(spark: SparkSession, sf: str) -> DataFrame:
    sizes = views.orders(spark, sf).groupBy("family_id").agg(F.count("*").alias("family_size"))
    return rounded(census.analytic_by_size(sizes), "cross_probability", "test_member_has_train_sibling")


@query(f"WITH {views.ORDERS}, {_SIZES} SELECT round(sum(1 - pow(0.2::DOUBLE, family_size) - pow(0.9::DOUBLE, family_size) + pow(0.1::DOUBLE, family_size)) / sum(1 - pow(0.9::DOUBLE, family_size)), 9) AS test_family_contamination_rate, round(sum(family_size * 0.1::DOUBLE * (1 - pow(0.2::DOUBLE, family_size - 1))) / sum(family_size * 0.1::DOUBLE), 9) AS test_file_contamination_rate FROM sizes")
def analytic_rates(spark: SparkSession, sf: str) -> DataFrame:
    sizes = views.orders(spark, sf).groupBy("family_id").agg(F.count("*").alias("family_size"))
    return rounded(census.analytic_rates(sizes), "test_family_contamination_rate", "test_file_contamination_rate")


@query(f"""WITH {views.ORDERS}, d AS (SELECT run, family_id, ('0x' || substr(sha256('0' || chr(0) || run::VARCHAR || chr(0) || id), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM ord, range(20) t(run)),
f AS (SELECT run, family_id, count(*) FILTER (u >= 0.9::DOUBLE) AS t, bool_or(u < 0.8::DOUBLE) AS train FROM d GROUP BY ALL),
r AS (SELECT run, count(*) FILTER (t > 0) AS tf, sum(t) AS tn, count(*) FILTER (t > 0 AND train) AS cf, coalesce(sum(t) FILTER (t > 0 AND train), 0) AS cn FROM f GROUP BY run)
SELECT count(*) FILTER (tn = 0) AS undefined_zero_denominator_seeds, round(avg(cf / tf), 9) AS family_mean, round(quantile_cont(cf / tf, 0.025), 9) AS family_q025, round(quantile_cont(cf / tf, 0.975), 9) AS family_q975, round(avg((cn / tn)::DOUBLE), 9) AS file_mean, round(quantile_cont((cn / tn)::DOUBLE, 0.025), 9) AS file_q025, round(quantile_cont((cn / tn)::DOUBLE, 0.975), 9) AS file_q975 FROM r""")
def monte_carlo_census(spark: SparkSession, sf: str) -> DataFrame:
    out = census.monte_carlo(views.orders(spark, sf).select("id", "family_id"))
    return rounded(out, *out.columns[1:])


@query("""WITH RECURSIVE e AS (SELECT DISTINCT 2 * l_orderkey AS a, 2 * l_partkey + 1 AS b FROM lineitem), bi AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
cc(node, root) USING KEY (node) AS (SELECT a, min(least(a, b)) FROM bi GROUP BY a UNION SELECT x.node, x.root FROM (SELECT bi.a AS node, min(c.root) AS root FROM bi JOIN cc c ON c.node = bi.b GROUP BY bi.a) x JOIN recurring.cc p ON p.node = x.node WHERE x.root < p.root)
SELECT node, root FROM cc""")
def components_bipartite(spark: SparkSession, sf: str) -> DataFrame:
    e = views.table(spark, sf, "lineitem").select((2 * F.col("l_orderkey")).alias("a"), (2 * F.col("l_partkey") + 1).alias("b"))
    return graph.connected_components(e)


@query(f"""WITH {views.FILES}, f AS (SELECT family_id, count(*) AS n FROM files GROUP BY 1) SELECT sum(n)::BIGINT AS files, count(*) AS families, count(*) FILTER (n > 1) AS multi_member_families, sum(n) FILTER (n > 1)::BIGINT AS multi_member_files, max(n) AS largest_family, (sum(n) - count(*))::BIGINT AS edges FROM f""")
def graph_summary(spark: SparkSession, sf: str) -> DataFrame:
    rows = views.files(spark, sf)
    return graph.graph_summary(rows, graph.identical_edges(rows, "family_id"))


@query(f"""WITH {views.ORDERS}, h AS (SELECT count(*) AS component_size FROM ord GROUP BY family_id) SELECT count(*) AS families, sum(component_size)::BIGINT AS files, count(*) FILTER (component_size > 1) AS multi_member_families, sum(component_size) FILTER (component_size > 1)::BIGINT AS multi_member_files, sum(component_size * (component_size - 1) // 2)::BIGINT AS reference_pairs, max(component_size) AS largest_family FROM h""")
def size_distribution_census(spark: SparkSession, sf: str) -> DataFrame:
    h = audit.size_histogram(views.orders(spark, sf)).select(F.col("family_size").alias("component_size"), F.col("families").alias("family_count"))
    return audit.census_from_sizes(h)


@query(f"""WITH {views.PREDICTED}, c AS (SELECT family_id, coalesce('g' || grp, 'n' || id) AS label, grp IS NOT NULL AS inside, count(*) AS n FROM pred GROUP BY ALL),
f AS (SELECT family_id, sum(n) AS n, count(*) AS labels FROM c GROUP BY 1 HAVING sum(n) > 1), o AS (SELECT count(*) AS multi, count(*) FILTER (labels = 1) AS rec, count(*) FILTER (labels > 1) AS frag, sum(n * (n - 1) // 2)::DOUBLE AS rp FROM f),
g AS (SELECT label, sum(n) AS n, count(*) AS fams, sum(n * (n - 1) // 2) AS tp FROM c WHERE inside GROUP BY 1), t AS (SELECT count(*) AS groups, count(*) FILTER (fams > 1) AS over_, sum(n * (n - 1) // 2)::DOUBLE AS pp, sum(tp)::DOUBLE AS tp FROM g)
SELECT round(rec / multi, 9) AS reference_family_recovery_rate, round(tp / pp, 9) AS pairwise_relation_precision, round(tp / rp, 9) AS pairwise_same_family_recall, round(2 * (tp / pp) * (tp / rp) / (tp / pp + tp / rp), 9) AS pairwise_relation_f1,
 over_ AS over_merge_component_count, round(over_ / groups, 9) AS over_merge_component_rate, frag AS under_split_reference_family_count, round(frag / multi, 9) AS under_split_rate FROM o, t""")
def relation_metrics(spark: SparkSession, sf: str) -> DataFrame:
    out = audit.relation_metrics(views.predicted(spark, sf))
    return rounded(out, *(c for c in out.columns if "count" not in c))


@query(f"""WITH {views.PREDICTED}, s AS (SELECT family_id, CASE split WHEN 'train' THEN 0 WHEN 'validation' THEN 1 ELSE 2 END AS split, CASE status WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS original FROM pred),
f AS (SELECT family_id, bool_or(split = 2) AS t, bool_or(split < 2) AS o, count(*) FILTER (split = 2) AS n FROM s GROUP BY 1), a AS (SELECT count(*) FILTER (t AND o) AS fams, count(*) FILTER (t) AS tf, coalesce(sum(n) FILTER (t AND o), 0) AS bf, sum(n) AS tn FROM f),
b AS (SELECT count(*) AS n, (count(*) FILTER (split = 0)) / count(*) AS r0, (count(*) FILTER (split = 1)) / count(*) AS r1, (count(*) FILTER (split = 2)) / count(*) AS r2, avg((split <> original)::INT) AS re FROM s)
SELECT fams AS residual_known_cross_split_family_count, round(fams / greatest(tf, 1), 9) AS residual_contaminated_test_family_rate, round((bf / greatest(tn, 1))::DOUBLE, 9) AS residual_contaminated_test_file_rate, round(r0, 9) AS split_train_ratio, round(r1, 9) AS split_validation_ratio, round(r2, 9) AS split_test_ratio,
 round(greatest(abs(r0 - 0.8::DOUBLE), abs(r1 - 0.1::DOUBLE), abs(r2 - 0.1::DOUBLE)), 9) AS split_abs_ratio_error, round(abs(r0 - 0.8::DOUBLE) + abs(r1 - 0.1::DOUBLE) + abs(r2 - 0.1::DOUBLE), 9) AS split_ratio_l1_error, round(re, 9) AS reassignment_fraction_vs_file_split FROM a, b""")
def split_evaluation(spark: SparkSession, sf: str) -> DataFrame:
    o = views.orders(spark, sf)
    s = o.select("family_id", F.when(F.col("split") == "train", 0).when(F.col("split") == "validation", 1).otherwise(2).alias("split"), F.when(F.col("status") == "F", 0).when(F.col("status") == "O", 1).otherwise(2).alias("original"))
    out = audit.split_evaluation(s)
    return rounded(out, *out.columns[1:])


@query(f"""WITH {views.PREDICTED}, g AS (SELECT grp, count(*) AS n FROM pred WHERE grp IS NOT NULL GROUP BY 1) SELECT (count(*) + (SELECT count(*) FROM pred) - sum(n))::BIGINT AS inferred_component_count, count(*) AS inferred_nontrivial_component_count, max(n) AS largest_inferred_component, quantile_cont(n, 0.5)::DOUBLE AS component_size_median, quantile_cont(n, 0.95)::DOUBLE AS component_size_p95 FROM g""")
def component_sizes(spark: SparkSession, sf: str) -> DataFrame:
    p = views.predicted(spark, sf)
    return audit.component_sizes(p.where("group is not null").select(F.col("group").alias("root")), p.count())


@query(f"""WITH {views.PREDICTED}, p AS (SELECT family_id AS work, coalesce(grp, 'n' || id) AS component FROM pred), c AS (SELECT work, component, count(*) AS n FROM p GROUP BY ALL), a AS (SELECT sum(n * (n - 1) // 2)::BIGINT AS pp FROM (SELECT count(*) AS n FROM p GROUP BY component)),
w AS (SELECT sum(n * (n - 1) // 2)::BIGINT AS hit, sum(n)::BIGINT AS n FROM c GROUP BY work HAVING sum(n) > 1), b AS (SELECT sum(hit)::BIGINT AS tp, sum(n * (n - 1) // 2)::BIGINT AS pos, avg(hit / (n * (n - 1) / 2)) AS ma, quantile_cont(hit / (n * (n - 1) / 2), 0.5) AS me, count(*) FILTER (hit = 0) AS missed, count(*) AS works FROM w)
SELECT pp AS predicted_pairs, tp AS true_positive_pairs, pp - tp AS false_positive_pairs, pos AS positive_pairs, round(tp / pp, 9) AS precision, round(tp / pos, 9) AS recall, round(2 * (tp / pp) * (tp / pos) / (tp / pp + tp / pos), 9) AS f1, round(ma, 9) AS macro_work_recall, round(me, 9) AS median_work_recall, missed AS missed_works, works FROM a, b""")
def work_pair_metrics(spark: SparkSession, sf: str) -> DataFrame:
    p = views.predicted(spark, sf).select("id", F.col("family_id").alias("work"), F.coalesce("group", F.concat(F.lit("n"), "id")).alias("component"))
    return rounded(audit.group_pair_metrics(p), "precision", "recall", "f1", "macro_work_recall", "median_work_recall")


@query("""WITH r AS (SELECT l_orderkey::VARCHAR || '-' || l_linenumber::VARCHAR AS id, CASE WHEN l_partkey % 97 = 0 THEN ' ' ELSE l_partkey::VARCHAR END AS family_id, CASE WHEN l_suppkey % 50 = 0 THEN 0.0 ELSE l_quantity END AS tokens FROM lineitem)
SELECT 'duplicate file ID' AS violation, id AS subject FROM r GROUP BY id HAVING count(*) > 1 UNION ALL SELECT 'malformed family id', id FROM r WHERE trim(family_id) = '' UNION ALL SELECT 'non-positive token count', id FROM r WHERE tokens <= 0""")
def row_violations(spark: SparkSession, sf: str) -> DataFrame:
    r = views.table(spark, sf, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id"), F.when(F.col("l_partkey") % 97 == 0, " ").otherwise(F.col("l_partkey").cast("string")).alias("family_id"), F.when(F.col("l_suppkey") % 50 == 0, 0.0).otherwise(F.col("l_quantity")).alias("tokens"))
    return validate.row_violations(r, tokens=True)


@query("""WITH r AS (SELECT DISTINCT doc_id % 60 AS family_id, CASE quality WHEN 1 THEN 'treated' ELSE 'control' END AS split FROM labels), m AS (SELECT doc_id % 64 AS family_id, CASE toxic WHEN 1 THEN 'treated' WHEN 0 THEN 'control' END AS split FROM labels GROUP BY ALL),
t AS (SELECT family_id, count(*) AS n, count(DISTINCT split) AS k FROM m GROUP BY 1 HAVING count(*) > 1), s AS (SELECT family_id, count(DISTINCT split) AS k, min(split) AS seen FROM r GROUP BY 1), w AS (SELECT family_id, min(split) AS told FROM m GROUP BY 1), b AS (SELECT family_id, k, seen, told FROM s FULL JOIN w USING (family_id))
SELECT CASE WHEN k > 1 THEN 'several manifest splits' ELSE 'duplicate manifest family' END AS violation, family_id::VARCHAR AS subject FROM t UNION ALL SELECT 'family without rows', family_id::VARCHAR FROM b WHERE k IS NULL UNION ALL SELECT 'family not in manifest', family_id::VARCHAR FROM b WHERE told IS NULL UNION ALL SELECT 'several analysis cohorts', family_id::VARCHAR FROM b WHERE k > 1 UNION ALL SELECT 'split differs from manifest', family_id::VARCHAR FROM b WHERE k = 1 AND told <> seen""")
def manifest_violations(spark: SparkSession, sf: str) -> DataFrame:
    lab = views.table(spark, sf, "labels")
    rows = lab.select((F.col("doc_id") % 60).alias("family_id"), F.when(F.col("quality") == 1, "treated").otherwise("control").alias("split")).distinct()
    manifest = lab.select((F.col("doc_id") % 64).alias("family_id"), F.when(F.col("toxic") == 1, "treated").when(F.col("toxic") == 0, "control").alias("split")).distinct()
    return validate.manifest_violations(rows, manifest)


@query(f"""WITH {views.ORDERS} SELECT id, family_id, tokens FROM ord WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey::VARCHAR = ord.family_id AND c_nationkey < 5) AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey::VARCHAR = ord.id AND l_quantity >= 50)""")
def protected_anti_join(spark: SparkSession, sf: str) -> DataFrame:
    families = views.table(spark, sf, "customer").where("c_nationkey < 5").select(F.col("c_custkey").cast("string").alias("family_id"))
    ids = views.table(spark, sf, "lineitem").where("l_quantity >= 50").select(F.col("l_orderkey").cast("string").alias("id"))
    return contamination.protected_rows(views.orders(spark, sf).select("id", "family_id", "tokens"), families, ids)


@query(f"""WITH {views.FILES}, p AS (SELECT id, tokens FROM files WHERE split = 'train'), d AS (SELECT id AS donor, tokens FROM files WHERE split = 'test')
SELECT donor, removed, absolute_difference FROM (SELECT donor, p.id AS removed, abs(p.tokens - d.tokens) AS absolute_difference, row_number() OVER (PARTITION BY donor ORDER BY abs(p.tokens - d.tokens), sha256('0' || chr(0) || p.id), p.id) AS n FROM d, p) WHERE n = 1""")
def nearest_token_match(spark: SparkSession, sf: str) -> DataFrame:
    f = views.files(spark, sf)
    return contamination.nearest_with_replacement(f.where("split = 'test'").select("id", "tokens"), f.where("split = 'train'").select("id", "tokens"))


@query()
def donor_match_without_replacement(spark: SparkSession, sf: str) -> DataFrame:
    f = views.files(spark, sf)
    return contamination.match_donors(f.where("split = 'test'"), f.where("split = 'train'"))


@query("""WITH a AS (SELECT conv_id AS slot, text AS body, 'clean' AS condition FROM conversations WHERE turn = 0), b AS (SELECT conv_id AS slot, text AS body, 'leak' AS condition FROM conversations WHERE turn = 1 AND conv_id % 2 = 0) SELECT a.slot, CASE WHEN b.slot IS NULL THEN a.body ELSE b.body END AS body, CASE WHEN b.slot IS NULL THEN a.condition ELSE b.condition END AS condition FROM a LEFT JOIN b ON a.slot = b.slot""")
def stream_override(spark: SparkSession, sf: str) -> DataFrame:
    c = views.table(spark, sf, "conversations")
    pick = lambda n, name: c.where(F.col("turn") == n).select(F.col("conv_id").alias("slot"), F.col("text").alias("body"), F.lit(name).alias("condition"))
    return contamination.override_slots(pick(0, "clean"), pick(1, "leak").where("slot % 2 = 0"))


@query(f"""WITH {views.FILES}, d AS (SELECT min(id) AS id, family_id, any_value(tokens) AS tokens FROM files GROUP BY family_id), e AS (SELECT id, family_id, {views.SPLIT_SQL.format('id')} AS split FROM d), m AS (SELECT id, family_id, {views.SPLIT_SQL.format('family_id')} AS split FROM files), n AS (SELECT count(*) AS k FROM files GROUP BY family_id)
SELECT 'file' AS scheme, count(*) AS files, (SELECT count(*) FROM (SELECT family_id FROM files GROUP BY 1 HAVING count(DISTINCT split) > 1)) AS cross_split_families FROM files UNION ALL SELECT 'exact_dedup', count(*), (SELECT count(*) FROM (SELECT family_id FROM e GROUP BY 1 HAVING count(DISTINCT split) > 1)) FROM e UNION ALL SELECT 'family_aware', count(*), (SELECT count(*) FROM (SELECT family_id FROM m GROUP BY 1 HAVING count(DISTINCT split) > 1)) FROM m UNION ALL SELECT 'delete_multi_member', coalesce(sum(k) FILTER (k = 1), 0)::BIGINT, 0 FROM n""")
def mitigation_comparison(spark: SparkSession, sf: str) -> DataFrame:
    """File split, exact deduplication before the split, split by family, and deletion of all multi-member families."""
    f = views.files(spark, sf)
    one = f.groupBy("family_id").agg(F.min("id").alias("id")).withColumn("split", split.hash_bucket(F.col("id")))
    whole = f.withColumn("split", split.hash_bucket(F.col("family_id")))
    alone = f.join(f.groupBy("family_id").count().where("count = 1"), "family_id", "left_semi")

    def line(name: str, rows: DataFrame) -> DataFrame:
        cross = rows.groupBy("family_id").agg(F.count("*").alias("n"), F.count_distinct("split").alias("k"))
        return cross.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("files"), F.count_if(F.col("k") > 1).alias("cross_split_families")).select(F.lit(name).alias("scheme"), "files", "cross_split_families")

    return line("file", f).unionByName(line("exact_dedup", one)).unionByName(line("family_aware", whole)).unionByName(line("delete_multi_member", alone))


@query()
def guarded_components(spark: SparkSession, sf: str) -> DataFrame:
    """Orders and parts as a graph scored by price, merged under a limit of 20 nodes."""
    e = views.table(spark, sf, "lineitem").groupBy((2 * F.col("l_orderkey")).alias("a"), (2 * F.col("l_partkey") + 1).alias("b")).agg(F.max("l_extendedprice").alias("score"))
    return graph.guarded_components(e.withColumn("idx", F.col("a") * 1_000_003 + F.col("b")))


@query()
def imperfect_inference(spark: SparkSession, sf: str) -> DataFrame:
    """Orders of customers as families joined in stars: the whole grid of 29 conditions, two seeds each, summarised."""
    o = views.orders(spark, sf)
    nodes = materialise(files.dense_ids(o.select("id")).join(o.select("id", "family_id"), "id").select("node", "family_id"))
    edges = materialise(graph.identical_edges(nodes, "family_id", "node"))
    rows = simulation.simulate(nodes, edges, simulation.grid(), (0, 1))
    metrics = ["reference_family_recovery_rate", "pairwise_relation_precision", "pairwise_same_family_recall", "residual_contaminated_test_family_rate", "split_abs_ratio_error", "largest_inferred_component"]
    return stats.condition_summary(rows, ["condition", "variant", "edge_recall_target", "fp_injection_ratio_target"], metrics)
