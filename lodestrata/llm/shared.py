"""What the operators of this subpackage share: durable intermediate tables, Arrow mapping and components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python worker looks at together; larger batches are cut, a longer text comes alone.
SLICE_BYTES = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset a local master gets one of our own, a cluster an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not found:
            if not spark.sparkContext.master.startswith("local["):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            found = tempfile.mkdtemp(prefix="lodestrata-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet to the shared folder and read again: lineage is cut, and a lost executor loses nothing of it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lodestrata/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.stored_at = path
    return table


def dropped(*tables: DataFrame) -> None:
    """Deletes the files of tables that stored() wrote, once what was made of them is stored itself."""
    for table in tables:
        jvm = table.sparkSession._jvm
        folder = jvm.org.apache.hadoop.fs.Path(table.stored_at)
        folder.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches end at 8 MB, so that long texts do not gather by the ten thousand."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > 2048:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2048")


def slices(batches: Iterator[pa.RecordBatch], text: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Each batch in pieces of at most `most` bytes of its binary column `text`, or of one row."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        col = batch.column(batch.schema.get_field_index(text))
        size = pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        total = np.concatenate([[0], np.cumsum(size)])
        at = 0
        while at < n:
            to = max(at + 1, int(np.searchsorted(total, total[at] + most, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to


def map_texts(df: DataFrame, f: Callable[[pa.RecordBatch], pa.RecordBatch | Iterator[pa.RecordBatch] | None], schema: str, text: str = "text") -> DataFrame:
    """f over slices of df, whose column `text` it gets as UTF-8 bytes; it gives one batch for a slice, or several one by one."""
    bounded_batches(df.sparkSession)

    def run(batches):
        for piece in slices(batches, text):
            out = f(piece)
            for got in [out] if out is None or isinstance(out, pa.RecordBatch) else out:
                if got is not None and got.num_rows:
                    yield got

    return df.mapInArrow(run, schema)


def packed(docs: DataFrame, text_col: str) -> list[Column]:
    """The columns but the text as a struct `row`, and the text's bytes, null where it is null: what a worker gets of whole documents."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c != text_col]
    return [F.struct(*(rest or [F.lit(None).cast("int").alias("none")])).alias("row"), F.col(text_col).cast("string").cast("binary").alias("text")]


def unpacked(docs: DataFrame, text_col: str, text: Column, changed: Column) -> list[Column]:
    """The columns of docs again, from `row` and a new text; n_chars follows a text that changed."""
    kind = {f.name: f.dataType for f in docs.schema}
    size = lambda c: F.when(changed, F.length(text)).otherwise(F.col("row.n_chars")).cast(kind[c])
    return [text.cast(kind[c]).alias(c) if c == text_col else size(c).alias(c) if c == "n_chars" else F.col(f"row.`{c}`").alias(c) for c in docs.columns]


def utf8(name: str = "text") -> Column:
    """A text column as bytes; null is empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit("")).cast("binary")


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component) for each id of edges (a, b): the smallest id reachable.

    Each round hooks every id to the least of its neighbours, jumps one pointer,
    and contracts the links; ids at least halve, so rounds are logarithmic.
    An id's links are only ever reduced by min(), with partial aggregation, and
    joined, where adaptive execution splits a hub's partition. Each round's
    tables are written to the shared folder.
    """
    slim = lambda e: e.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    links, labels = stored(slim(edges), "links"), None
    while not links.isEmpty():
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = stored(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("p")), "hooks")
        jump = up.join(up.select(F.col("a").alias("p"), F.col("p").alias("pp")), "p").select(F.col("a").alias("id"), F.col("pp").alias("component"))
        jump = stored(jump, "jumps")
        moved = links.join(jump.toDF("a", "pa"), "a").join(jump.toDF("b", "pb"), "b").select(F.col("pa").alias("a"), F.col("pb").alias("b"))
        links = stored(slim(moved), "links")
        if labels is None:
            labels = jump
        else:
            step = jump.toDF("component", "next")
            labels = stored(labels.join(step, "component", "left").select("id", F.coalesce("next", "component").alias("component")), "labels")
    return labels if labels is not None else links.select(F.col("a").alias("id"), F.col("b").alias("component"))


def merge_roots(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """parent with the links a-b joined in: every entry points at the least index of its set."""
    while len(a):
        ra, rb = parent[a], parent[b]
        open_ = ra != rb
        if not open_.any():
            break
        a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
        np.minimum.at(parent, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent = up
    return parent
