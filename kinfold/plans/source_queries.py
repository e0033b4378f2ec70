"""Queries over sources, sinks, checks, pairs and the design of contaminated sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold import validate
from kinfold.operators import audit, contamination, effects, graph
from kinfold.plans import views
from kinfold.plans.catalogue import query
from kinfold.runtime import scratch_dir
from kinfold.sources import files


def _place(spark: SparkSession, name: str) -> str:
    """A folder of shared scratch that the query's sink writes and its source reads."""
    return f"{scratch_dir(spark)}/kinfold-round-trip-{name}"


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders")
def jsonl_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """All orders written as JSON lines and read back with a declared schema."""
    path = _place(spark, "jsonl")
    files.write_jsonl(views.table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"), path, "gzip")
    return files.read_jsonl(spark, path, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double")


@query("SELECT l_orderkey::VARCHAR AS l_orderkey, l_linenumber::VARCHAR AS l_linenumber, l_quantity, l_returnflag FROM lineitem")
def csv_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """All of lineitem written as compressed CSV and read back as text, one column of it as numbers."""
    path = _place(spark, "csv")
    files.write_table(views.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag"), path, "gzip")
    return files.numbers(files.read_table(spark, path), ["l_quantity"])


@query(f"WITH {views.FILES} SELECT id, family_id FROM files")
def json_map_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """The family map of all documents as a JSON object and back."""
    path = _place(spark, "map")
    files.write_json_map(views.files(spark, sf), path, compression="gzip")
    return files.read_json_map(spark, path)


@query("SELECT role AS condition, conv_id::VARCHAR AS slot_index, max(turn)::VARCHAR AS last_turn FROM conversations WHERE role IS NOT NULL AND conv_id IS NOT NULL GROUP BY ALL")
def slot_file_last_line(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations as a slot file in order of turns: of repeated (condition, slot_index) the last line holds."""
    path = _place(spark, "slots")
    c = views.table(spark, sf, "conversations").where("role is not null and conv_id is not null")
    files.write_table(c.select(F.col("role").alias("condition"), F.col("conv_id").alias("slot_index"), F.col("turn").alias("last_turn")).orderBy("turn"), path)
    return files.read_slots(spark, path).select("condition", "slot_index", "last_turn")


@query("SELECT DISTINCT least('m_' || lower(r_name), lower(n_name)) AS a, greatest('m_' || lower(r_name), lower(n_name)) AS b FROM nation JOIN region ON n_regionkey = r_regionkey")
def relation_file_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Regions as anchors and their nations as members of a relation file; its edges by content id."""
    path = _place(spark, "relations")
    both = views.table(spark, sf, "nation").join(F.broadcast(views.table(spark, sf, "region")), F.col("n_regionkey") == F.col("r_regionkey"))  # 5 regions
    named = both.groupBy(F.concat(F.lit("Set__M_"), "r_name").alias("anchor")).agg(F.collect_list(F.concat(F.lit("x__"), "n_name")).alias("members"))
    named.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("anchor", "members")))).alias("value")).write.mode("overwrite").text(path)
    return files.relation_edges(files.read_relations(spark, path))


@query("SELECT l_orderkey::INT AS slot, count(*)::INT AS prompt, string_agg((l_partkey % 30000)::VARCHAR, ',' ORDER BY l_partkey % 30000) AS tokens FROM lineitem GROUP BY l_orderkey")
def packed_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """The parts of each order as a packed stream, written and read back."""
    path = _place(spark, "packed")
    rows = views.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").cast("int").alias("slot")).agg(F.count("*").cast("int").alias("prompt"), F.sort_array(F.collect_list(F.col("l_partkey") % 30000)).alias("token_ids"))
    files.write_packed(rows, path)
    return files.read_packed(spark, path).select("slot", "prompt", F.concat_ws(",", F.col("token_ids").cast("array<string>")).alias("tokens"))


@query("SELECT c_custkey::VARCHAR AS id, (row_number() OVER (ORDER BY c_custkey::VARCHAR) - 1)::BIGINT AS node FROM customer")
def dense_numbers(spark: SparkSession, sf: str) -> DataFrame:
    return files.dense_ids(views.table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("id"))).select("id", F.col("node").cast("long").alias("node"))


@query("SELECT c_custkey AS id, least(2 * (n_nationkey % 7), 99)::BIGINT AS tokens, 'f' || (n_nationkey % 7)::VARCHAR AS family_id FROM customer JOIN nation ON c_nationkey = n_nationkey")
def family_map_attach(spark: SparkSession, sf: str) -> DataFrame:
    """All customers with the family of their nation from a map that must know every one."""
    rows = views.table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("nation"))
    known = views.table(spark, sf, "nation").select(F.col("n_nationkey").alias("nation"), F.concat(F.lit("f"), (F.col("n_nationkey") % 7).cast("string")).alias("family_id"))
    return graph.attach_families(rows, known, "nation").select("id", F.least(2 * F.regexp_extract("family_id", "[0-9]+", 0).cast("long"), F.lit(99)).cast("long").alias("tokens"), "family_id")


@query("""WITH e AS (SELECT l_orderkey % 3000 AS a, l_partkey % 3000 AS b FROM lineitem) SELECT 'unknown edge end' AS violation, id::VARCHAR AS subject FROM (SELECT DISTINCT id FROM (SELECT a AS id FROM e UNION ALL SELECT b FROM e) WHERE id NOT IN (SELECT c_custkey FROM customer))
UNION ALL SELECT 'repeated edge', least(a, b)::VARCHAR || '|' || greatest(a, b)::VARCHAR FROM e GROUP BY least(a, b), greatest(a, b) HAVING count(*) > 1""")
def edge_violations(spark: SparkSession, sf: str) -> DataFrame:
    e = views.table(spark, sf, "lineitem").select((F.col("l_orderkey") % 3000).alias("a"), (F.col("l_partkey") % 3000).alias("b"))
    return validate.edge_violations(views.table(spark, sf, "customer").select(F.col("c_custkey").alias("id")), e)


@query("SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b FROM (SELECT l_orderkey % 3000 AS a, l_suppkey AS b FROM lineitem) WHERE a IN (SELECT c_custkey FROM customer) AND b IN (SELECT c_custkey FROM customer)")
def universe_edges(spark: SparkSession, sf: str) -> DataFrame:
    e = views.table(spark, sf, "lineitem").select((F.col("l_orderkey") % 3000).alias("a"), F.col("l_suppkey").alias("b"))
    return graph.universe_edges(e, views.table(spark, sf, "customer").select(F.col("c_custkey").alias("id")))


@query(f"WITH {views.ORDERS} SELECT id AS node, min(id) OVER w AS root, count(*) OVER w AS size FROM ord WINDOW w AS (PARTITION BY family_id) QUALIFY size > 1")
def nontrivial_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Components of two orders or more, over two edge tables: stars of each customer's orders, once forwards and once back."""
    edges = graph.identical_edges(views.orders(spark, sf), "family_id")
    return graph.groups_of(edges, edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


_PAIRS = f"{views.PREDICTED}, pos AS (SELECT x.id AS a, y.id AS b FROM pred x JOIN pred y USING (family_id) WHERE x.id < y.id)"


@query(f"WITH {_PAIRS} SELECT a, b FROM pos")
def closure_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """All pairs of orders of one customer; a listing, so its size is that of its result."""
    return audit.closure_pairs(views.orders(spark, sf), "family_id")


@query(f"""WITH {_PAIRS}, said AS (SELECT x.id AS a, y.id AS b FROM pred x JOIN pred y USING (grp) WHERE x.id < y.id), n AS (SELECT count(*) AS p, count(*) FILTER (x.family_id = y.family_id) AS t FROM said JOIN pred x ON x.id = said.a JOIN pred y ON y.id = said.b), q AS (SELECT count(*) AS q FROM pos)
SELECT p AS predicted_pairs, t AS true_positive_pairs, p - t AS false_positive_pairs, q AS positive_pairs, round(t / p, 9) AS precision, round(t / q, 9) AS recall, round(2 * (t / p) * (t / q) / (t / p + t / q), 9) AS f1 FROM n, q""")
def pair_point_metrics(spark: SparkSession, sf: str) -> DataFrame:
    p = views.predicted(spark, sf)
    out = audit.pair_metrics(audit.closure_pairs(p.where("group is not null"), "group"), audit.closure_pairs(p, "family_id"))
    return out.withColumns({c: F.round(c, 9) for c in ("precision", "recall", "f1")})


@query("SELECT l_orderkey, l_linenumber, l_discount FROM lineitem WHERE abs(l_discount - 0.05::DOUBLE) < 1e-12::DOUBLE")
def tolerance_select(spark: SparkSession, sf: str) -> DataFrame:
    return views.table(spark, sf, "lineitem").where(validate.near(F.col("l_discount"), 0.05)).select("l_orderkey", "l_linenumber", "l_discount")


@query("SELECT c_mktsegment AS md5, count(DISTINCT c_nationkey) AS n FROM customer GROUP BY 1 HAVING count(DISTINCT c_nationkey) > 1")
def source_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    c = views.table(spark, sf, "customer")
    return validate.source_conflicts(c.select(F.col("c_mktsegment").alias("md5"), F.col("c_nationkey").alias("sha256")))


@query(f"WITH {views.ORDERS} SELECT family_id, count(DISTINCT status) AS cohorts FROM ord GROUP BY 1 HAVING count(DISTINCT status) > 1")
def cohort_overlaps(spark: SparkSession, sf: str) -> DataFrame:
    return contamination.cohort_overlaps(views.orders(spark, sf).select(F.col("status").alias("cohort"), "family_id"))


@query("""WITH e AS (SELECT user_id, event_type, event_id FROM events), f AS (SELECT user_id, event_type, min(event_id) AS h FROM e GROUP BY ALL ORDER BY h LIMIT 40) SELECT e.* FROM e JOIN f USING (user_id, event_type)""")
def first_groups(spark: SparkSession, sf: str) -> DataFrame:
    """All events of the forty groups of user and type that come first; the limit is the feature."""
    return effects.first_groups(views.table(spark, sf, "events").select("user_id", "event_type", "event_id"), ["user_id", "event_type"], "event_id", 40)


#: Customers of two orders or more: the two smallest orders are donor and receiver, the rest of the design comes from the order's hash split.
_DESIGN = f"""{views.ORDERS}, n AS (SELECT *, row_number() OVER (PARTITION BY family_id ORDER BY id) AS k, count(*) OVER (PARTITION BY family_id) AS size FROM ord), t AS (SELECT * FROM n WHERE family_id::BIGINT % 10 = 1 AND size > 1)"""


@query(f"""WITH {_DESIGN}, clean AS (SELECT id, family_id, tokens FROM ord WHERE family_id::BIGINT % 10 > 3 AND id NOT IN (SELECT id FROM t WHERE k <= 2)) SELECT id, family_id, tokens FROM clean""")
def contamination_clean_set(spark: SparkSession, sf: str) -> DataFrame:
    """The clean training set of a design over all orders: without cohorts, donors and receivers."""
    return _design(spark, sf).clean.select("id", "family_id", "tokens")


@query()
def contamination_leak_set(spark: SparkSession, sf: str) -> DataFrame:
    """The contaminated training set of the same design in the order of the clean set, each donor in the place of the file it replaces."""
    return contamination.in_place(_design(spark, sf))


def _design(spark: SparkSession, sf: str) -> contamination.Design:
    o = views.orders(spark, sf).select("id", "family_id", "tokens")
    fold = F.col("family_id").cast("long") % 10
    own = F.sort_array(F.collect_list(F.struct("id", "family_id", "tokens")))
    treated = o.where(fold == 1).groupBy("family_id").agg(own.alias("members")).where(F.size("members") > 1)
    cohorts = o.where(fold.between(1, 3)).select(F.element_at(F.array(*map(F.lit, ("treated", "control", "validation"))), fold.cast("int")).alias("cohort"), "family_id").distinct()
    pairs = treated.select("family_id", F.col("members")[0]["id"].alias("donor_id"), F.col("members")[1]["id"].alias("receiver_id"))
    return contamination.build(o.where(fold != 0), cohorts, treated, pairs)
