"""The test tables seen as files, families, results and notes; each view in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.operators.split import hash_bucket


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


SPLIT_SQL = "CASE WHEN ('0x' || substr(sha256('split' || chr(0) || {0}), 1, 8))::BIGINT % 10 < 6 THEN 'train' WHEN ('0x' || substr(sha256('split' || chr(0) || {0}), 1, 8))::BIGINT % 10 < 8 THEN 'validation' ELSE 'test' END"


def files(spark: SparkSession, sf: str) -> DataFrame:
    """Documents: id, family_id (hash of the text), tokens (characters), split by hash."""
    d = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("id"), F.sha2("text", 256).alias("family_id"), F.col("n_chars").alias("tokens"))
    return d.withColumn("split", hash_bucket(F.col("id")))


FILES = f"files AS (SELECT id, family_id, tokens, {SPLIT_SQL.format('id')} AS split FROM (SELECT doc_id::VARCHAR AS id, sha256(text) AS family_id, n_chars AS tokens FROM documents))"


def orders(spark: SparkSession, sf: str) -> DataFrame:
    """Orders: id, family_id (customer), tokens (whole price plus one), split by hash."""
    o = table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("id"), F.col("o_custkey").cast("string").alias("family_id"), (F.floor("o_totalprice") + 1).cast("bigint").alias("tokens"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"))
    return o.withColumn("split", hash_bucket(F.col("id")))


ORDERS = f"ord AS (SELECT *, {SPLIT_SQL.format('id')} AS split FROM (SELECT o_orderkey::VARCHAR AS id, o_custkey::VARCHAR AS family_id, (floor(o_totalprice) + 1)::BIGINT AS tokens, o_orderstatus AS status, o_orderpriority AS priority FROM orders))"


def predicted(spark: SparkSession, sf: str) -> DataFrame:
    """Orders with a predicted group: pairs of customers together, one priority in ten apart; open orders are in no group."""
    o = orders(spark, sf)
    group = F.concat_ws("-", (F.floor(F.col("family_id").cast("bigint") / 2)).cast("string"), F.when(F.col("priority").startswith("1"), "u").otherwise("r"))
    return o.withColumn("group", F.when(F.col("status") != "O", group))


PREDICTED = ORDERS + ", pred AS (SELECT *, CASE WHEN status <> 'O' THEN (family_id::BIGINT // 2)::VARCHAR || '-' || CASE WHEN priority LIKE '1%' THEN 'u' ELSE 'r' END END AS grp FROM ord)"


def results(spark: SparkSession, sf: str) -> DataFrame:
    """Result rows from events: seed, condition, family_id, split, nll (mean value of the cell)."""
    e = table(spark, sf, "events").where("event_type in ('view', 'click')")
    split = F.element_at(F.array(F.lit("treated"), F.lit("control"), F.lit("clean_validation")), (F.col("user_id") % 3 + 1).cast("int"))
    cell = e.select((F.col("event_id") % 3).alias("seed"), F.when(F.col("event_type") == "view", "clean").otherwise("family_leak").alias("condition"), F.col("user_id").cast("string").alias("family_id"), split.alias("split"), "value")
    return cell.groupBy("seed", "condition", "split", "family_id").agg(F.avg("value").alias("nll"))


RESULTS = """res AS (SELECT event_id % 3 AS seed, CASE WHEN event_type = 'view' THEN 'clean' ELSE 'family_leak' END AS condition, user_id::VARCHAR AS family_id,
 CASE user_id % 3 WHEN 0 THEN 'treated' WHEN 1 THEN 'control' ELSE 'clean_validation' END AS split, avg(value) AS nll FROM events WHERE event_type IN ('view', 'click') GROUP BY ALL),
full_fam AS (SELECT split, family_id FROM res GROUP BY ALL HAVING count(DISTINCT (seed, condition)) = 2 * (SELECT count(DISTINCT seed) FROM res)),
complete AS (SELECT res.* FROM res JOIN full_fam USING (split, family_id)),
delta AS (SELECT seed, split, family_id, max(nll) FILTER (condition = 'clean') AS clean, max(nll) FILTER (condition = 'family_leak') AS leak, max(nll) FILTER (condition = 'family_leak') - max(nll) FILTER (condition = 'clean') AS delta FROM complete GROUP BY ALL),
fam AS (SELECT split, family_id, avg(delta) AS delta, avg(clean) AS clean FROM delta GROUP BY ALL)"""


def notes(spark: SparkSession, sf: str) -> DataFrame:
    """Events as notes: piece = user, quarter beats of 15 minutes since the user's first event."""
    e = table(spark, sf, "events").select("user_id", "event_id", F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'2000-01-01 00:00:00', ts)").alias("s"), F.regexp_extract("props", "[0-9]+", 0).cast("int").alias("k"))
    first = e.groupBy("user_id").agg(F.min("s").alias("s0"))
    return e.join(first, "user_id").select(
        F.col("user_id").alias("piece"),
        "event_id",
        (F.floor((F.col("s") - F.col("s0")) / 900) / 4.0).alias("onset"),
        ((F.col("k") % 16 + 1) / 8.0).alias("duration"),
        (F.col("k") + 24).alias("pitch"),
        (F.col("event_id") % 127 + 1).cast("int").alias("velocity"),
        (F.col("event_id") % 8).cast("int").alias("program"),
        (F.col("event_id") % 2).cast("int").alias("track"),
    )


NOTES = """ev AS (SELECT user_id, event_id, date_diff('second', TIMESTAMP '2000-01-01 00:00:00', ts) AS s, regexp_extract(props, '[0-9]+')::INT AS k FROM events),
notes AS (SELECT user_id AS piece, event_id, ((s - min(s) OVER (PARTITION BY user_id)) // 900) / 4.0::DOUBLE AS onset, (k % 16 + 1) / 8.0::DOUBLE AS duration, k + 24 AS pitch, (event_id % 127 + 1)::INT AS velocity, (event_id % 8)::INT AS program, (event_id % 2)::INT AS track FROM ev),
slots AS (SELECT piece, round_even(onset * 4, 0)::INT AS slot, max(pitch) AS melody, min(pitch) AS bass FROM notes GROUP BY ALL),
steps AS (SELECT piece, seq, greatest(-36, least(36, m)) AS melody, greatest(-36, least(36, b)) AS bass, least(greatest(round_even(gap * 12, 0)::INT, 0), 192) AS rhythm, gap FROM
 (SELECT piece, row_number() OVER w - 1 AS seq, lead(melody) OVER w - melody AS m, lead(bass) OVER w - bass AS b, (lead(slot) OVER w - slot) / 4.0::DOUBLE AS gap FROM slots WINDOW w AS (PARTITION BY piece ORDER BY slot)) WHERE gap IS NOT NULL)"""
