"""Bounded samples of labelled documents, the same on every run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(doc_id: Column | str, modulus: int) -> Column:
    """crc32 of the doc_id as text, modulo ``modulus``; null for a null doc_id."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(col.cast("string").cast("binary")) % modulus


def labelled(docs: DataFrame, labels: DataFrame, label: str, allowed: Column, per_class: int) -> DataFrame:
    """(doc_id, y, text) of the documents that at most ``per_class`` doc_ids of either class have; a repeated id has all its rows.

    ``allowed`` is a condition on ``doc_id``. The choice goes by a hash of doc_id, so it
    neither depends on file order nor grows with the input; 2 * per_class ids are broadcast.
    """
    known = labels.select("doc_id", F.col(label).cast("int").alias("y")).where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1)).where(allowed)
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = known.where("y = 1").orderBy(*order).limit(per_class).unionByName(known.where("y = 0").orderBy(*order).limit(per_class)).groupBy("doc_id").agg(F.max("y").alias("y"))
    return docs.select("doc_id", "text").where("text is not null").join(F.broadcast(chosen), "doc_id").select("doc_id", "y", "text")
