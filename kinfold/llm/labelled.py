"""Bounded, deterministic training samples of labelled documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fold(id_col: str, folds: int):
    """crc32 of the id as text, modulo folds; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % folds


def sample(docs: DataFrame, labels: DataFrame, label: str, train, per_class: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, y, text) of at most per_class labelled rows of each class among those where train holds.

    Rows with a null label or id are left out; an id with several labels has the largest. The choice follows a hash of the
    id. The chosen ids, at most 2 * per_class, are what is broadcast to read the texts in one pass.
    """
    one = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label)).alias("y")).where(train(F.col("id")))
    order = F.xxhash64("id")
    chosen = one.where("y = 1").orderBy(order, "id").limit(per_class).unionByName(one.where("y = 0").orderBy(order, "id").limit(per_class))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("id is not null")
    return texts.join(F.broadcast(chosen), "id").select("id", "y", "text")
