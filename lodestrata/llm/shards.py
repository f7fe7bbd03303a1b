"""Shards by extendible hashing, in DataFrame operations alone.

A document's key is hashed to 60 bits. The directory is indexed by a prefix of them;
a bucket over the byte limit, and no other, splits on the next bit until each fits.
One aggregation gives the bytes of the cells of a fine prefix, whose depth follows
from total and limit; the splits are then made on those sums, not on the rows. Cells
that are still too large go on for more bits, alone. What shares all 60 bits, such as
repeated rows, is paged by running size; a row over the limit has a page of its own.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.llm.shared import stored, utf8

BITS = 60
SHARD_BYTES = 16 << 20
#: Bits that one round looks ahead beyond the expected depth.
AHEAD = 6


def key_hash(*columns: Column) -> Column:
    """60 bits of SHA-256 over the key's text form."""
    key = F.concat_ws("\x1f", *(F.coalesce(c.cast("string"), F.lit("\x00")) for c in columns))
    return F.conv(F.substring(F.sha2(key, 256), 1, 15), 16, 10).cast("long")


def directory(sizes: DataFrame, limit: int) -> DataFrame:
    """The leaves (depth, prefix, shard_bytes) over (h, bytes); only prefixes over the limit are split.

    A leaf at depth 60 may exceed the limit: its rows share all bits and are paged.
    """
    total = sizes.agg(F.sum("bytes")).first()[0] or 0
    depth, leaves, open_ = 0, None, None
    step = max(0, math.ceil(math.log2(max(1, total / limit)))) + AHEAD
    while True:
        fine = min(BITS, depth + step)
        rows = sizes.withColumn("top", F.shiftright("h", BITS - depth))
        rows = rows if open_ is None else rows.join(open_.select(F.col("prefix").alias("top")), "top", "left_semi")
        cells = stored(rows.groupBy(F.shiftright("h", BITS - fine).alias("cell")).agg(F.sum("bytes").alias("bytes")), "shard-cells")
        levels = cells.select("cell", "bytes", F.explode(F.sequence(F.lit(depth), F.lit(fine))).alias("depth"))
        prefix = F.expr(f"shiftright(cell, {fine} - depth)").alias("prefix")
        sums = stored(levels.select("depth", prefix, "bytes").groupBy("depth", "prefix").agg(F.sum("bytes").alias("shard_bytes")), "shard-sums")
        split = sums.where(F.col("shard_bytes") > limit).select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("up"))
        born = sums.withColumn("up", F.shiftright("prefix", 1)).join(split, ["depth", "up"], "left_semi").select(sums.columns)
        if depth == 0:
            born = born.unionByName(sums.where("depth = 0"))
        fits = born.where((F.col("shard_bytes") <= limit) | (F.col("depth") == BITS))
        leaves = fits if leaves is None else leaves.unionByName(fits)
        open_ = sums.where((F.col("shard_bytes") > limit) & (F.col("depth") == fine))
        if fine == BITS or open_.isEmpty():
            return leaves
        depth, step = fine, AHEAD


def shard_documents(docs: DataFrame, limit: int = SHARD_BYTES, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id (the key), shard_id, shard_depth, shard_bytes, n_bytes, oversized.

    shard_id is the bucket's bits (none for one bucket of all), with "+page" where
    rows that share all bits are paged; shard_bytes is the sum of n_bytes, the UTF-8
    bytes of the texts, over the shard, null or empty texts being 0. A row over the
    limit by itself is a shard of its own, marked oversized, and splits no other. A
    null key is a key; repeated rows share a bucket or its pages; an empty table gives
    no rows; extra columns are ignored.
    """
    rows = docs.select(F.col(key).alias("doc_id"), key_hash(F.col(key)).alias("h"), F.length(utf8(text_col)).cast("long").alias("n_bytes"))
    rows = stored(rows, "shard-keys")
    small = rows.where(F.col("n_bytes") <= limit)
    leaves = stored(directory(small.select("h", F.col("n_bytes").alias("bytes")), limit), "shard-leaves")
    depths = sorted(r[0] for r in leaves.select("depth").distinct().collect())  # 61 at most
    tagged = small.withColumn("depth", F.explode(F.array(*map(F.lit, depths or [0])))).withColumn("prefix", F.expr(f"shiftright(h, {BITS} - depth)"))
    found = tagged.join(leaves, ["depth", "prefix"])
    digits = F.when(F.col("depth") == 0, "").otherwise(F.expr("lpad(conv(prefix, 10, 2), depth, '0')"))
    columns = ["doc_id", "shard_id", "depth", "shard_bytes", "n_bytes"]
    fit = found.where(F.col("shard_bytes") <= limit).withColumn("shard_id", digits)
    # rows that share all bits: dealt at random to heaps of about 64 shards, each paged by running size;
    # of rows of half a limit at most, a page starts within half a limit, so it fits
    heaps = F.ceil(F.col("shard_bytes") / F.lit(64 * limit))
    rest = found.where(F.col("shard_bytes") > limit).withColumn("heap", F.pmod(F.xxhash64(F.monotonically_increasing_id()), heaps)).withColumn("wide", F.col("n_bytes") > limit / 2)
    heap = Window.partitionBy("h", "heap", "wide").orderBy("n_bytes")
    before = F.coalesce(F.sum("n_bytes").over(heap.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    page = F.when(F.col("wide"), -F.row_number().over(heap)).otherwise(F.floor(before / F.lit(limit / 2)))
    paged = rest.withColumn("page", page).withColumn("shard_bytes", F.sum("n_bytes").over(Window.partitionBy("h", "heap", "page")))
    paged = paged.withColumn("shard_id", F.concat(digits, F.lit("+"), F.col("heap"), F.lit("."), F.col("page")))
    alone = rows.where(F.col("n_bytes") > limit).withColumn("depth", F.lit(BITS)).withColumn("prefix", F.col("h")).withColumn("shard_bytes", F.col("n_bytes"))
    alone = alone.withColumn("shard_id", F.concat(digits, F.lit("!"), F.xxhash64(F.monotonically_increasing_id())))
    both = fit.select(columns).unionByName(paged.select(columns)).unionByName(alone.select(columns))
    return both.select("doc_id", "shard_id", F.col("depth").cast("int").alias("shard_depth"), "shard_bytes", "n_bytes", (F.col("n_bytes") > limit).alias("oversized"))


#: The same over DuckDB for the default limit, to 24 bits (the driver's tables need no more, and repeat no key).
ORACLE = f"""
WITH r AS (SELECT doc_id, ('0x' || substr(sha256(coalesce(doc_id::VARCHAR, chr(0))), 1, 15))::BIGINT AS h, octet_length(encode(coalesce(text, '')))::BIGINT AS n_bytes FROM documents),
s AS (SELECT d, h >> (60 - d) AS prefix, sum(n_bytes)::BIGINT AS shard_bytes FROM r, (SELECT unnest(range(25)) AS d) WHERE n_bytes <= {SHARD_BYTES} GROUP BY ALL),
leaf AS (SELECT c.* FROM s c LEFT JOIN s p ON p.d = c.d - 1 AND p.prefix = c.prefix >> 1 WHERE c.shard_bytes <= {SHARD_BYTES} AND (c.d = 0 OR p.shard_bytes > {SHARD_BYTES}))
SELECT doc_id, CASE WHEN d = 0 THEN '' ELSE right(lpad(bin(prefix), 60, '0'), d) END AS shard_id, d::INTEGER AS shard_depth, shard_bytes, n_bytes, false AS oversized
FROM r JOIN leaf ON leaf.prefix = r.h >> (60 - leaf.d)
"""
