"""Bounded samples of labelled rows, and the folds of document ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(doc_id: str | Column, folds: int) -> Column:
    """crc32 of the id's text form modulo `folds`; a null id counts as the empty string."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % folds


def sample_ids(labels: DataFrame, label: str, most: int, folds: int = 3, held: int = 1) -> DataFrame:
    """At most `most` rows (doc_id, label) of the learning folds, chosen by a hash of the id; of repeated ids the greatest label counts."""
    rows = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & (fold("doc_id", folds) != held))
    rows = rows.groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    return rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
