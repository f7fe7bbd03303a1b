"""Versioned Parquet tables: each write is a new folder, and a pointer row says which is current."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.operators.inventory import upsert
from lodestrata.schema import TABLES, struct


class Catalog:
    """The tables of both datasets under one folder that driver and executors share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _log(self, dataset: str, table: str) -> str:
        return f"{self.folder}/{dataset}/{table}/_versions"

    def _path(self) -> object:
        return self.spark._jvm.org.apache.hadoop.fs.Path

    def _exists(self, path: str) -> bool:
        p = self._path()(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def read(self, dataset: str, table: str) -> DataFrame:
        """The current version; empty before the first write."""
        schema = struct(dataset, table)
        if not self._exists(self._log(dataset, table)):
            return self.spark.createDataFrame([], schema)
        log = self.spark.read.schema("gen long, path string").json(self._log(dataset, table))
        return self.spark.read.schema(schema).parquet(log.orderBy(F.desc("gen"), F.desc("path")).first()["path"])

    def write(self, dataset: str, table: str, df: DataFrame) -> None:
        """A new version: the data first, then its line in the log, so a reader never sees half a write."""
        path = f"{self.folder}/{dataset}/{table}/{uuid.uuid4().hex}"
        df.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in struct(dataset, table))).write.parquet(path)
        gen = 1
        if self._exists(self._log(dataset, table)):
            gen += self.spark.read.schema("gen long, path string").json(self._log(dataset, table)).agg(F.max("gen")).first()[0] or 0
        self.spark.createDataFrame([(gen, path)], "gen long, path string").coalesce(1).write.mode("append").json(self._log(dataset, table))

    def upsert(self, dataset: str, table: str, df: DataFrame, keep: tuple[str, ...] = ()) -> None:
        self.write(dataset, table, upsert(self.read(dataset, table), df, TABLES[dataset, table][0], keep))

    def status(self) -> dict[str, str]:
        return {f"{d}.{t}": "current" if self._exists(self._log(d, t)) else "missing" for d, t in TABLES}

    def wipe_cache(self) -> None:
        """The cache goes; the state stays."""
        p = self._path()(f"{self.folder}/cache")
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)
