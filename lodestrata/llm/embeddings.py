"""Embedding near-duplicates: random-hyperplane sign hashing in several tables, exact cosines, components.

Equal vectors are one class with a count. Each class gets, per table, the signs of a
few random projections as its bucket; the number of bits follows from the number of
classes, so that buckets stay small, and the number of tables from the bits, so that
a pair at the threshold shares a bucket with the probability RECALL, and closer pairs
with a higher one. Within a bucket all cosines are computed in double precision. A
bucket of more than BLOCK classes is split into blocks, and every pair of blocks is a
task's unit of its own. A pair counts in the first table in which it meets. Units emit
a sum and one link per class, never pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.shared import connected_components, merge_roots, stored

THRESHOLD = 0.9
RECALL = 0.995
#: Classes of a bucket on average: large ones take fewer tables, and so fewer copies of a vector, for more products.
BUCKET = 512
BLOCK = 1024
#: Hot buckets that are broadcast at most; more are joined by a shuffle.
FEW_BUCKETS = 20_000


def tables_for(classes: int, threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[int, int]:
    """Bits a table and tables."""
    bits = min(30, max(4, math.ceil(math.log2(max(1, classes / BUCKET)))))
    meet = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(1 - recall) / math.log(1 - meet))


def hyperplanes(dim: int, count: int) -> np.ndarray:
    return np.random.default_rng([dim, 12345]).standard_normal((dim, count))


def _bytes(x: np.ndarray) -> bytes:
    """A vector's components: as floats where these say the same, else as doubles, behind their width."""
    with np.errstate(over="ignore"):
        short = x.astype("<f4")
    return b"\4" + short.tobytes() if (short == x).all() else b"\x08" + x.astype("<f8").tobytes()


def _vector(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<f{data[0]}", offset=1).astype(float)


def _keyed(batches):
    """(vec_id, h, v): v the bytes of a vector that can link, else null."""
    for b in batches:
        lists = b.column(1)
        x = lists.values.to_numpy(zero_copy_only=False).astype(float) + 0.0  # -0.0 is 0.0
        off = lists.offsets.to_numpy()
        bad, set_ = (np.concatenate([[0], np.cumsum(c)])[off] for c in (~np.isfinite(x), x != 0))
        good = lists.is_valid().to_numpy(zero_copy_only=False) & (np.diff(bad) == 0) & (np.diff(set_) > 0)
        v = [_bytes(x[s:e]) if g else None for g, s, e in zip(good.tolist(), off[:-1].tolist(), off[1:].tolist())]
        h = [xxhash.xxh3_128_digest(data) if data else None for data in v]
        yield pa.record_batch([b.column(0), pa.array(h, pa.binary()), pa.array(v, pa.binary())], names=["vec_id", "h", "v"])


def _signed(bits: int, tables: int):
    weights = 1 << np.arange(bits)

    def run(batches):
        planes: dict[int, np.ndarray] = {}
        for b in batches:
            out = []
            for data in b.column(2).to_pylist():
                x = _vector(data)
                if len(x) not in planes:
                    planes[len(x)] = hyperplanes(len(x), bits * tables)
                out.append(((x / np.abs(x).max() @ planes[len(x)] > 0).reshape(tables, bits) @ weights).astype(np.int32))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, tables * (len(out) + 1), tables), pa.int32()), pa.array(np.concatenate(out) if out else np.zeros(0, np.int32)))
            short = pa.array([s.astype("<u2" if bits <= 16 else "<u4").tobytes() for s in out], pa.binary())
            yield pa.record_batch([*b.columns, lists, short], names=["rep", "n", "v", "sigs", "signs"])

    return run


def _linked(threshold: float, bits: int):
    """Per unit of rows (t, key, i, j, block, rep, n, v, signs), sorted by the first four: (rep, w, root)."""
    schema = pa.schema([("rep", pa.int64()), ("w", pa.int64()), ("root", pa.int64())])

    def unit(rows):
        t, same = rows["t"][0], rows["i"][0] == rows["j"][0]
        out = []
        sizes = np.array([(len(v) - 1) // v[0] for v in rows["v"]])
        for size in np.unique(sizes):  # vectors of other dimensions don't compare
            at = np.flatnonzero(sizes == size)
            x = np.stack([_vector(rows["v"][k]) for k in at])
            x = x / np.abs(x).max(axis=1, keepdims=True)
            x = x / np.linalg.norm(x, axis=1, keepdims=True)
            block, n, rep = rows["block"][at], rows["n"][at], rows["rep"][at]
            sigs = np.stack([np.frombuffer(rows["signs"][k], "<u2" if bits <= 16 else "<u4") for k in at])
            left = np.arange(len(at)) if same else np.flatnonzero(block == rows["i"][0])
            right = left if same else np.flatnonzero(block == rows["j"][0])
            total, parent = np.zeros(len(at), np.int64), np.arange(len(at))
            for lo in range(0, len(left), 256):
                a, b = np.nonzero(x[left[lo : lo + 256]] @ x[right].T >= threshold)
                a, b = left[lo + a], right[b]
                if same:
                    a, b = a[a < b], b[a < b]
                if not len(a):
                    continue
                parent = merge_roots(parent, a, b)
                new = ~(sigs[a, :t] == sigs[b, :t]).any(axis=1) if t else np.ones(len(a), bool)
                a, b = a[new], b[new]
                total += np.bincount(a, n[b], len(at)).astype(np.int64) + np.bincount(b, n[a], len(at)).astype(np.int64)
            hit = np.flatnonzero((total > 0) | (parent != np.arange(len(at))))
            out.append((rep[hit], total[hit], rep[parent[hit]]))
        return [np.concatenate(c) for c in zip(*out)]

    def run(batches):
        held, done = None, [[], [], []]
        for b in batches:
            if not b.num_rows:
                continue
            cols = {k: b.column(b.schema.get_field_index(k)) for k in ("t", "key", "i", "j", "block", "rep", "n")}
            rows = {k: c.to_numpy(zero_copy_only=False) for k, c in cols.items()}
            for k in ("v", "signs"):
                rows[k] = np.array([*b.column(b.schema.get_field_index(k)).to_pylist(), None], object)[:-1]
            if held is not None:
                rows = {k: np.concatenate([held[k], rows[k]]) for k in rows}
            keys = np.stack([rows[k] for k in ("t", "key", "i", "j")])
            cuts = np.concatenate([[0], np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1])
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                if hi - lo > 1:
                    for d, c in zip(done, unit({k: r[lo:hi] for k, r in rows.items()})):
                        d.append(c)
            held = {k: r[cuts[-1] :] for k, r in rows.items()}
            if sum(map(len, done[0])) > 10_000:
                yield pa.record_batch([pa.array(np.concatenate(d)) for d in done], schema=schema)
                done = [[], [], []]
        if held is not None and len(held["t"]) > 1:
            for d, c in zip(done, unit(held)):
                d.append(c)
        if done[0]:
            yield pa.record_batch([pa.array(np.concatenate(d).astype(np.int64)) for d in done], schema=schema)

    return run


def embedding_links(vectors: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Null, empty and zero vectors and those with null or non-finite components link
    with nothing and are kept; vectors of different dimensions don't link; repeated
    rows are vectors of their own, linked with each other; an empty table gives no
    rows; labels and further columns play no part.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("x"))
    keyed = stored(rows.mapInArrow(_keyed, "vec_id long, h binary, v binary"), "vectors")
    classes = keyed.where("h is not null").groupBy("h").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n"), F.first("v").alias("v"))
    classes = stored(classes, "vector-classes")
    bits, tables = tables_for(classes.count(), threshold)
    signed = stored(classes.where("rep is not null").select("rep", "n", "v").mapInArrow(_signed(bits, tables), "rep long, n long, v binary, sigs array<int>, signs binary"), "vector-signs")
    hot = signed.select(F.posexplode("sigs").alias("t", "key")).groupBy("t", "key").count().where(F.col("count") > BLOCK)
    hot = stored(hot.select("t", "key", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks")), "hot-buckets")
    dealt = signed.select(F.posexplode("sigs").alias("t", "key"), "rep", "n", "v", "signs")
    # a bucket over BLOCK classes is one of N * tables / BLOCK at most: broadcast only where that is few
    few = hot.limit(FEW_BUCKETS + 1).count() <= FEW_BUCKETS
    dealt = dealt.join(F.broadcast(hot) if few else hot, ["t", "key"], "left")
    dealt = dealt.withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    units = dealt.select("t", "key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "rep", "n", "v", "signs")
    order = ["t", "key", "i", "j"]
    found = units.repartition(*order).sortWithinPartitions(*order).mapInArrow(_linked(threshold, bits), "rep long, w long, root long")
    found = stored(found, "vector-links")
    links = found.groupBy("rep").agg(F.sum("w").alias("w"))
    parts = connected_components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    told = classes.join(links, "rep", "left").join(parts.withColumnRenamed("id", "rep"), "rep", "left")
    told = told.select("h", (F.coalesce("w", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    out = keyed.where("h is not null").select("vec_id", "h").join(told, "h").select("vec_id", "n_links", "component_id")
    alone = keyed.where("h is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(alone).select("*", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"))


#: Every pair by brute force over DuckDB.
ORACLE = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.x, b.x) >= 0.9),
r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
c AS (SELECT a, least(a, min(b)) AS m FROM r GROUP BY a),
n AS (SELECT a, count(*) AS k FROM l GROUP BY a)
SELECT e.vec_id, coalesce(k, 0)::BIGINT AS n_links, coalesce(m, e.vec_id) AS component_id, coalesce(m, e.vec_id) = e.vec_id AS kept
FROM embeddings e LEFT JOIN c ON c.a = e.vec_id LEFT JOIN n ON n.a = e.vec_id
"""
