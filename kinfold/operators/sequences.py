"""Token sequences: bar-position encoding, windows, packed offsets, stream totals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinfold.hashing import int_array_hash
from kinfold.sources import midi


def encode(notes: DataFrame) -> DataFrame:
    """(piece, bar, tokens): the ids of each bar, a BAR id and then five ids a note. notes: (piece, bar, position, family, pitch, duration, velocity)."""
    row = F.struct("position", "family", "pitch", "duration", "velocity")
    per = notes.groupBy("piece", "bar").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    five = F.transform("rows", lambda r: F.array(midi.POSITION + r["position"], midi.PROGRAM + r["family"], midi.PITCH + r["pitch"], midi.DURATION - 1 + r["duration"], midi.VELOCITY + r["velocity"]))
    return per.select("piece", "bar", F.concat(F.array(F.lit(midi.BAR)), F.flatten(five)).alias("tokens"))


def windows(bars: DataFrame, max_bars: int = 16, prompt_bars: int = 4, context: int = 1024) -> DataFrame:
    """(piece, start_bar, end_bar, prompt_bars, token_count, prompt_token_count, token_ids): from every fourth bar, the longest span of at most
    max_bars bars whose ids, with BOS and EOS, fit the context. The first bar and the first bar after the prompt must have notes, and something must follow the prompt.

    bars: (piece, bar, tokens). An end bar without notes ends where the next bar with notes begins, or with the piece.
    """
    order = Window.partitionBy("piece").orderBy("bar")
    placed = bars.withColumn("n", F.size("tokens")).withColumn("offset", F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    whole = placed.groupBy("piece").agg((F.max("bar") + 1).alias("bars"), F.sum("n").alias("all"))
    starts = placed.where(F.col("bar") % prompt_bars == 0).select("piece", F.col("bar").alias("start_bar"), F.col("offset").alias("begin"))
    follow = placed.select("piece", (F.col("bar") - prompt_bars).alias("start_bar"), F.col("offset").alias("prompt_end"))
    whole_starts = starts.join(follow, ["piece", "start_bar"]).join(whole, "piece").where(F.col("start_bar") < F.col("bars") - prompt_bars)
    ends = F.sequence(F.col("start_bar") + prompt_bars + 1, F.least("bars", F.col("start_bar") + max_bars))
    options = whole_starts.where(F.col("start_bar") + prompt_bars + 1 <= F.least("bars", F.col("start_bar") + max_bars)).withColumn("end_bar", F.explode(ends))
    bar_ends = placed.select("piece", F.col("bar").alias("at"), F.col("offset").alias("at_offset"))
    stop = options.join(bar_ends, "piece").where("at >= end_bar and at <= end_bar + 1000000").groupBy("piece", "start_bar", "end_bar").agg(F.min("at_offset").alias("stop"))
    sized = options.join(stop, ["piece", "start_bar", "end_bar"], "left").withColumn("stop", F.coalesce("stop", "all"))
    sized = sized.withColumn("token_count", F.col("stop") - F.col("begin") + 2).withColumn("prompt_token_count", F.col("prompt_end") - F.col("begin") + 1)
    fit = sized.where((F.col("token_count") <= context) & (F.col("prompt_token_count") < F.col("token_count") - 1))
    best = fit.groupBy("piece", "start_bar").agg(F.max_by(F.struct("end_bar", "token_count", "prompt_token_count", "begin", "stop"), "end_bar").alias("w")).select("piece", "start_bar", "w.*")
    inside = best.join(placed.select("piece", "bar", "offset", "tokens"), "piece").where("offset >= begin and offset < stop")
    ids = F.concat(F.array(F.lit(midi.BOS)), F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("bar", "tokens"))), lambda x: x["tokens"])), F.array(F.lit(midi.EOS)))
    out = inside.groupBy("piece", "start_bar", "end_bar", "token_count", "prompt_token_count").agg(ids.alias("token_ids"))
    return out.select("piece", "start_bar", "end_bar", F.lit(prompt_bars).alias("prompt_bars"), "token_count", "prompt_token_count", "token_ids")


def packed_offsets(rows: DataFrame, stream: str, order: str, size: str = "n") -> DataFrame:
    """rows with start and stop of each row in its stream's flat sequence."""
    w = Window.partitionBy(stream).orderBy(order)
    return rows.withColumn("stop", F.sum(size).over(w)).withColumn("start", F.col("stop") - F.col(size))


def stream_identity(rows: DataFrame, stream: str, order: str, ids: str = "token_ids") -> DataFrame:
    """(stream, windows, tokens, identity): totals and the hash of the row hashes in order."""
    keyed = rows.select(stream, order, F.size(ids).alias("n"), int_array_hash(F.col(ids)).alias("h"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "h"))), lambda x: x["h"]), "\x00")
    return keyed.groupBy(stream).agg(F.count("*").alias("windows"), F.sum("n").alias("tokens"), F.sha2(joined, 256).alias("identity"))


def unpack(flat: DataFrame, spans: DataFrame) -> DataFrame:
    """(slot, token_ids) of spans (slot, start, stop) over one flat sequence (token_ids)."""
    return spans.crossJoin(F.broadcast(flat)).select("slot", F.expr("slice(token_ids, cast(start + 1 as int), cast(stop - start as int))").alias("token_ids"))  # flat is one row


def exact_windows(specs: DataFrame, windows_: DataFrame) -> DataFrame:
    """specs joined to windows on (md5, start_bar, end_bar), with a mismatch column naming what differs."""
    both = specs.alias("s").join(windows_.alias("w"), ["md5", "start_bar", "end_bar"], "left")
    why = F.when(F.col("w.token_count").isNull(), "missing window").when(F.col("s.token_count") != F.col("w.token_count"), "token count").when(F.col("s.prompt_token_count") != F.col("w.prompt_token_count"), "prompt token count")
    return both.select("md5", "start_bar", "end_bar", "w.token_ids", why.alias("mismatch"))


def phase_fields(row, text_fields: list[str]):
    """The named columns as a struct, empty strings as null."""
    return F.struct(*(F.nullif(F.col(c), F.lit("")).alias(c) if c in text_fields else F.col(c) for c in row))
