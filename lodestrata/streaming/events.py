"""Structured Streaming over the events table: windows, sessions, duplicates and incremental upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.operators.inventory import upsert


def event_stream(spark: SparkSession, folder: str, per_trigger: int = 16) -> DataFrame:
    """Parquet files of events as they arrive; the schema is read from what is there."""
    schema = spark.read.parquet(folder).schema
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger)
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isFile():  # one file is a folder's only match
        folder, name = folder.rsplit("/", 1)
        source = source.option("pathGlobFilter", name)
    rows = source.parquet(folder)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed(events: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Counts and sums per type and tumbling window; state of windows older than the watermark is let go."""
    return (
        events.withWatermark("ts", late)
        .groupBy(F.window("ts", width), "event_type")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
        .select(F.col("window.start").alias("start"), "event_type", "n", "total")
    )


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "user_id", "n")


def deduplicated(events: DataFrame, late: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def drain(stream: DataFrame, folder: str, checkpoint: str, mode: str = "complete") -> DataFrame:
    """All that is there now goes through the stream into Parquet files: in complete mode the last batch's are the result, else every batch's."""
    spark, batches = stream.sparkSession, []

    def keep(df: DataFrame, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{folder}/{batch_id}")  # a batch that is run again replaces its files
        batches.append(batch_id)

    stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    wanted = sorted(set(batches))[-1:] if mode == "complete" else sorted(set(batches))
    if not wanted:
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).parquet(*(f"{folder}/{b}" for b in wanted))


def upsert_into(stream: DataFrame, read, write, key: str, checkpoint: str):
    """Each micro-batch is upserted by key into the table that read() gives; write(df, batch_id) stores the next version."""

    def batch(df: DataFrame, batch_id: int) -> None:
        write(upsert(read(), df.dropDuplicates([key]), key), batch_id)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
