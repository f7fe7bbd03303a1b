"""Scanning, change detection and keyed writes over inventories of source items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FIELDS = ("size_bytes", "sha256", "media_type", "relative_path")


def classify_changes(before: DataFrame, now: DataFrame, key: str = "item_id", fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """(key, status): current (new), unchanged, changed or deleted; one join on the key."""
    old = before.select(F.col(key), F.struct(*fields).alias("_old"))
    new = now.select(F.col(key), F.struct(*fields).alias("_new"))
    status = F.when(F.col("_new").isNull(), "deleted").when(F.col("_old").isNull(), "current").when(F.col("_old") == F.col("_new"), "unchanged").otherwise("changed")
    return old.join(new, key, "full_outer").select(key, status.alias("status"))


def running(df: DataFrame, group: str, order: str, size: str) -> DataFrame:
    """Running count and bytes along `order` within each group."""
    w = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("running_files", F.count(F.lit(1)).over(w)).withColumn("running_bytes", F.sum(size).over(w))


def safeguard(df: DataFrame, group: str, order: str, size: str, max_files: int, max_bytes: int) -> DataFrame:
    """Per group the verdict of a scan that stops at the first item over a limit: ok, or deferred with the amounts needed at least."""
    seen = running(df, group, order, size)
    return (
        seen.groupBy(group)
        .agg(F.min(F.when(F.col("running_files") > max_files, F.col("running_files"))).alias("needed_files"), F.min(F.when(F.col("running_bytes") > max_bytes, F.col("running_bytes"))).alias("needed_bytes"))
        .withColumn("status", F.when(F.col("needed_files").isNull() & F.col("needed_bytes").isNull(), "ok").otherwise("deferred"))
    )


def modal(df: DataFrame, group: list[str], value: str, name: str) -> DataFrame:
    """The most frequent value per group, the least of equals: two partial aggregations, no window."""
    counts = df.groupBy(*group, value).count()
    return counts.groupBy(*group).agg(F.min_by(value, F.struct(-F.col("count"), F.col(value))).alias(name))


def upsert(old: DataFrame, new: DataFrame, key: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """old with the rows of new by key, last writer wins; the columns in `keep` stay as first written."""
    a, b = old.alias("a"), new.alias("b")
    pick = lambda c: (F.coalesce(f"a.{c}", f"b.{c}") if c in keep else F.when(F.col(f"b.{key}").isNotNull(), F.col(f"b.{c}")).otherwise(F.col(f"a.{c}"))).alias(c)
    return a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full_outer").select(*(F.coalesce(f"a.{c}", f"b.{c}").alias(c) if c == key else pick(c) for c in old.columns))


def insert_ignore(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    return old.unionByName(new.join(old.select(key), key, "left_anti").select(old.columns))


def replace_children(old: DataFrame, new: DataFrame, parent: str) -> DataFrame:
    """All children of the parents in new give way to new's."""
    return old.join(new.select(parent).distinct(), parent, "left_anti").select(old.columns).unionByName(new)


def digest(df: DataFrame, group: list[str], order: Column, row: Column, prefix: str) -> DataFrame:
    """A content digest per group: the hash of the rows' hashes in order; a row's part is 64 bytes however wide it is."""
    leaf = F.struct(order.alias("o"), F.sha2(row, 256).alias("h"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(leaf)), lambda x: x["h"]), "")
    return df.groupBy(*group).agg(F.sha2(F.concat(F.lit(prefix), joined), 256).alias("watermark"), F.count(F.lit(1)).alias("n_rows"))
