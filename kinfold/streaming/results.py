"""Result rows as a stream: windowed losses with late data, and an append-only metric log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_results(spark: SparkSession, path: str, schema: str, files_at_once: int = 100) -> DataFrame:
    """New JSON-lines files of a folder as they appear."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).json(path)


def windowed_nll(rows: DataFrame, width: str = "10 minutes", late: str = "10 minutes", time: str = "ts", loss: str = "loss", tokens: str = "tokens") -> DataFrame:
    """Token-weighted loss of each condition and window; rows later than `late` are left out once their window has closed."""
    stamped = rows.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", late)
    sums = stamped.groupBy(F.window("_t", width), "condition").agg(F.sum(F.col(loss) * F.col(tokens)).alias("_l"), F.sum(tokens).alias("tokens"))
    return sums.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "condition", (F.col("_l") / F.col("tokens")).alias("nll"), "tokens")


def log_metrics(stream: DataFrame, path: str, checkpoint: str):
    """Starts appending finished windows to a folder of JSON lines, each exactly once; ends when what is there is read."""
    return stream.writeStream.outputMode("append").format("json").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
