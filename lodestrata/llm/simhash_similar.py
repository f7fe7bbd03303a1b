"""SimHash near copies by similarity: documents whose word shingles have a Jaccard similarity of LEAST or more.

Two bits tell too little here: at a similarity of 0.8 two sets have a cosine of 0.89, so
a bit of their fingerprints differs with probability 0.15, and ten of 64 do. So a text
has 64 bits of fingerprint for the Gray-order tree and 192 more that choose where it
looks: each of several tables takes some of these as its masked pattern, and texts that
share it meet under that key. Bits a table follow from the number of texts, so that
keys stay small; tables follow from the bits, so that a pair at LEAST meets under one
with probability RECALL, closer pairs with more. Within a key the tree over Gray order
drops what differs in over MAX_BITS bits, and the rest is decided by the whole shingle
sets: nothing is linked that has not been verified.

What met under a key is first held against one or two leaders, which takes one
comparison a text and settles groups of copies; only keys whose texts are still of
several components are compared in full, in units of two blocks.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.shared import bounded_batches, connected_components, dropped, map_texts, merge_roots, stored, utf8
from lodestrata.llm.simhash import gray_rank, index_links
from lodestrata.llm.textkernel import mix

LEAST = 0.8
RECALL = 0.99
#: How often a bit agrees at LEAST, a little below 1 - acos(2 LEAST / (1 + LEAST)) / pi for the sake of short texts.
AGREE = 0.84
#: Differing bits of the 64 within which pairs are verified: their mean at LEAST is 10, their deviation 3.
MAX_BITS = 19
POOL_WORDS = 3
#: Texts of a key on average; keys of more than SMALL are searched one by one.
BUCKET, SMALL = 64, 256
#: Shingle sets of a block.
BLOCK_SETS = 512


def shingle_set(text: bytes, size: int = 5) -> np.ndarray:
    """XXH64 (seed 42) of the distinct word shingles in order; fewer words are one shingle, no words none."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(joined, 42)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-size] + 1])
    return np.unique(np.array([xxhash.xxh64_intdigest(joined[a:b], 42) for a, b in zip(starts.tolist(), ends[size - 1 :].tolist())], np.uint64))


def set_codes(sets: list[np.ndarray]) -> np.ndarray:
    """(sets, 1 + POOL_WORDS) SimHash words of sets that are not empty."""
    flat = np.concatenate(sets)
    size = np.array([len(s) for s in sets])
    first = np.cumsum(size) - size
    out = np.zeros((len(sets), 1 + POOL_WORDS), np.uint64)
    for w in range(1 + POOL_WORDS):
        h = flat if not w else mix(flat + np.uint64(0x9E3779B97F4A7C15 * w % (1 << 64)))
        ones = np.add.reduceat(np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1), first, axis=0, dtype=np.int32)
        out[:, w] = np.packbits(ones * 2 > size[:, None], axis=1).view(">u8").ravel()
    return out


def tables_for(classes: int) -> tuple[int, int]:
    """Bits a table and tables."""
    bits = min(40, max(4, math.ceil(math.log2(max(1, classes / BUCKET)))))
    return bits, math.ceil(math.log(1 - RECALL) / math.log(1 - AGREE**bits))


def table_keys(pool: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """(rows, tables) keys from the words of the pool."""
    every = np.unpackbits(pool.astype(">u8").view(np.uint8).reshape(len(pool), -1), axis=1)
    draw = np.random.default_rng(29)
    weights = 1 << np.arange(bits)
    return np.stack([every[:, draw.permutation(64 * POOL_WORDS)[:bits]] @ weights | t << 44 for t in range(tables)], axis=1)


def code_components(codes: np.ndarray, limit: int) -> np.ndarray:
    """For each code the least index of its component by links of at most `limit` bits; what has joined a component is not looked at again."""
    root = np.full(len(codes), -1)
    left = np.arange(len(codes))
    while len(left):
        top, front, left = left[0], left[:1], left[1:]
        root[top] = top
        while len(front) and len(left):
            near = np.zeros(len(left), bool)
            for c in codes[front]:
                rest = np.flatnonzero(~near)
                near[rest[np.bitwise_count(codes[left[rest]] ^ c) <= limit]] = True
                if near.all():
                    break
            front, left = left[near], left[~near]
            root[front] = top
    return root


def _meet(limit: int):
    """From rows (key, class, code) sorted by key: (gid, n, class) of each group within a key that the tree leaves together; groups of the same texts have the same gid."""
    schema = pa.schema([("gid", pa.int64()), ("n", pa.int64()), ("class", pa.int64())])

    def groups(key, cls, code):
        new = np.concatenate([[True], key[1:] != key[:-1]])
        group = np.cumsum(new) - 1
        size = np.bincount(group)[group]
        many = size > 1
        group, cls, code, size = group[many], cls[many], code[many], size[many]
        if not len(cls):
            return
        order = np.lexsort((gray_rank(code), group))
        group, cls, code, size = group[order], cls[order], code[order], size[order]
        parent = np.arange(len(cls))
        small = np.flatnonzero(size <= SMALL)
        if len(small):
            for i, j in index_links(group[small], code[small], limit):
                parent = merge_roots(parent, small[i], small[j])
        big = np.flatnonzero(size > SMALL)
        for lo in big[np.concatenate([[True], group[big[1:]] != group[big[:-1]]])] if len(big) else ():
            parent[lo : lo + size[lo]] = lo + code_components(code[lo : lo + size[lo]], limit)
        order = np.argsort(parent, kind="stable")
        root, cls = parent[order], cls[order]
        at = np.flatnonzero(np.concatenate([[True], root[1:] != root[:-1]]))
        n = np.diff(np.concatenate([at, [len(root)]]))
        gid = mix(np.bitwise_xor.reduceat(mix(cls.view(np.uint64)), at) + n.astype(np.uint64))
        gid, n = np.repeat(gid, n), np.repeat(n, n)
        keep = n > 1
        if keep.any():
            yield pa.record_batch([pa.array(gid[keep].view(np.int64)), pa.array(n[keep]), pa.array(cls[keep])], schema=schema)

    def run(batches):
        held: list = []
        for b in batches:
            if not b.num_rows:
                continue
            key, cls, code = (b.column(i).to_numpy() for i in range(3))
            held.append((key, cls, code.view(np.uint64)))
            if sum(len(h[0]) for h in held) < 1 << 16 or key[0] == key[-1] == held[0][0][0]:
                continue  # not while one key goes on
            key, cls, code = (np.concatenate(c) for c in zip(*held))
            cut = int(np.searchsorted(key, key[-1]))
            yield from groups(key[:cut], cls[:cut], code[:cut])
            held = [(key[cut:], cls[cut:], code[cut:])]
        if held:
            yield from groups(*(np.concatenate(c) for c in zip(*held)))

    return run


def alike(a: np.ndarray, b: np.ndarray, least: float) -> bool:
    """Whether two sorted sets have a Jaccard similarity of `least` or more."""
    if min(len(a), len(b)) < least * max(len(a), len(b)):
        return False
    both = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
    return both >= least * (len(a) + len(b) - both) - 1e-9


def _verified(least: float):
    """The rows (a, b) of (a, b, sa, sb) whose sets are alike."""

    def run(batches):
        for batch in batches:
            good = pa.array([alike(np.frombuffer(x.as_buffer(), np.uint32), np.frombuffer(y.as_buffer(), np.uint32), least) for x, y in zip(batch.column(2), batch.column(3))], pa.bool_())
            out = pa.record_batch([batch.column(0), batch.column(1)], names=["a", "b"]).filter(good)
            if out.num_rows:
                yield out

    return run


def set_links(sets: list[np.ndarray], component: np.ndarray, least: float = LEAST) -> np.ndarray:
    """For each set the least index of its component, by the components given and links of similarity `least` or more; within one nothing is compared."""
    sizes = np.array([len(s) for s in sets])
    flat = np.concatenate(sets)
    first = np.cumsum(sizes) - sizes
    _, start, back = np.unique(component, return_index=True, return_inverse=True)
    parent = start[back]
    for i in range(len(sets) - 1):
        other = np.flatnonzero((parent[i + 1 :] != parent[i]) & (np.minimum(sizes[i + 1 :], sizes[i]) >= least * np.maximum(sizes[i + 1 :], sizes[i]))) + i + 1
        if not len(other):
            continue
        n = sizes[other]
        begin = np.cumsum(n) - n
        values = flat[np.arange(n.sum()) + np.repeat(first[other] - begin, n)]
        at = np.minimum(np.searchsorted(sets[i], values), sizes[i] - 1)
        both = np.add.reduceat((sets[i][at] == values).astype(np.int64), begin)
        near = other[both >= least * (n + sizes[i] - both) - 1e-9]
        parent = merge_roots(parent, np.full(len(near), i), near)
    return parent


def _units(least: float):
    """From rows (gid, i, j, class, component, shingles) sorted by the first three: links from a class to the least of its component within the unit."""

    def run(batches):
        unit, ids, comps, sets = None, [], [], []

        def out():
            if len(ids) > 1 and len(set(comps)) > 1:
                before = np.array(comps)
                parent = set_links(sets, before, least)
                names = np.array(ids, np.int64)
                moved = np.flatnonzero(before[parent] != before)
                if len(moved):
                    yield pa.record_batch([pa.array(names[moved]), pa.array(names[parent[moved]])], names=["a", "b"])

        for b in batches:
            for g, i, j, c, comp, s in zip(*(b.column(k).to_pylist() for k in range(5)), b.column(5)):
                if (g, i, j) != unit:
                    yield from out()
                    unit, ids, comps, sets = (g, i, j), [], [], []
                ids.append(c)
                comps.append(comp)
                sets.append(np.frombuffer(s.as_py(), np.uint32))
        yield from out()

    return run


def similar_rows(docs: DataFrame, size: int = 5, least: float = LEAST) -> DataFrame:
    """(doc_id, th, class, component) of each row with an id: th is xxhash64 of its text, class its shingle set's name, component the least class reachable."""
    bounded_batches(docs.sparkSession)
    text = utf8()
    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text"))

    def signed(b):
        sets = [shingle_set(t, size) for t in b.column(2).to_pylist()]
        full = np.array([len(s) > 0 for s in sets])
        words = np.zeros((len(sets), 1 + POOL_WORDS), np.uint64)
        if full.any():
            words[full] = set_codes([s for s in sets if len(s)])
        names = np.array([xxhash.xxh64_intdigest(s.tobytes(), 7) for s in sets], np.uint64).view(np.int64)
        shingles = pa.array([np.unique((s >> np.uint64(32)).astype(np.uint32)).tobytes() if len(s) else None for s in sets], pa.binary())
        columns = [pa.array(words[:, w].view(np.int64)) for w in range(1 + POOL_WORDS)]
        return pa.record_batch([b.column(0), b.column(1), pa.array(names), *columns, shingles], names=["doc_id", "th", "class", *(f"w{w}" for w in range(1 + POOL_WORDS)), "shingles"])

    words = [f"w{w}" for w in range(1 + POOL_WORDS)]
    signs = stored(map_texts(rows, signed, f"doc_id long, th long, class long, {', '.join(f'{w} long' for w in words)}, shingles binary"), "near-signs")
    classes = signs.where("shingles is not null").groupBy("class").agg(*(F.first(w).alias(w) for w in words))
    bits, tables = tables_for(signs.agg(F.approx_count_distinct("class")).first()[0])

    def dealt(batches):
        for b in batches:
            if b.num_rows:
                w = np.stack([b.column(1 + k).to_numpy() for k in range(1 + POOL_WORDS)], axis=1).view(np.uint64)
                keys = table_keys(w[:, 1:], bits, tables)
                many = lambda c: pa.array(np.repeat(c, tables))
                yield pa.record_batch([pa.array(keys.ravel()), many(b.column(0).to_numpy()), many(w[:, 0].view(np.int64))], names=["key", "class", "code"])

    keyed = classes.mapInArrow(dealt, "key long, class long, code long").repartition("key").sortWithinPartitions("key")
    met = stored(keyed.mapInArrow(_meet(MAX_BITS), "gid long, n long, class long").distinct(), "near-met")
    sets = signs.select("class", "shingles").join(met.select("class").distinct(), "class", "left_semi").groupBy("class").agg(F.first("shingles").alias("shingles"))
    sets = stored(sets, "near-sets")
    chosen = [F.min_by("class", F.xxhash64("class", F.lit(r))).alias(f"l{r}") for r in (0, 1)]
    leaders = met.join(met.groupBy("gid").agg(*chosen), "gid").groupBy("class").agg(*(F.min_by(f"l{r}", F.when(F.col(f"l{r}") != F.col("class"), F.xxhash64(f"l{r}"))).alias(f"l{r}") for r in (0, 1)))
    pairs = met.where("n = 2").groupBy("gid").agg(F.min("class").alias("a"), F.max("class").alias("b")).select("a", "b")
    for r in (0, 1):
        pairs = pairs.unionByName(leaders.where(f"l{r} <> class").select(F.least("class", f"l{r}").alias("a"), F.greatest("class", f"l{r}").alias("b")))
    pairs = pairs.distinct().join(sets.toDF("a", "sa"), "a").join(sets.toDF("b", "sb"), "b").select("a", "b", "sa", "sb")
    links = stored(pairs.mapInArrow(_verified(least), "a long, b long"), "near-links")
    parts = connected_components(links)
    told = met.where("n > 2").join(parts.withColumnRenamed("id", "class"), "class", "left").withColumn("component", F.coalesce("component", "class"))
    open_ = told.groupBy("gid").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.ceil(F.count(F.lit(1)) / BLOCK_SETS).cast("int").alias("blocks")).where("x <> y").select("gid", "blocks")
    units = told.join(open_, "gid").withColumn("block", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    units = units.select("gid", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "class", "component").join(sets, "class").select("gid", "i", "j", "class", "component", "shingles")
    more = stored(units.repartition("gid", "i", "j").sortWithinPartitions("gid", "i", "j").mapInArrow(_units(least), "a long, b long"), "near-links")
    if not more.isEmpty():
        parts = connected_components(links.unionByName(more))
    dropped(met, sets, more)
    return signs.select("doc_id", "th", "class").join(parts.withColumnRenamed("id", "class"), "class", "left").select("doc_id", "th", "class", F.coalesce("component", "class").alias("component"))


def simhash_dedup(docs: DataFrame, size: int = 5, least: float = LEAST) -> DataFrame:
    """The documents without near copies: of each group the row with the least doc_id stays, and of its equals one.

    Texts are alike if their distinct word shingles have a Jaccard similarity of
    `least` or more; texts without words are alike. Rows without an id stay; rows of
    one id and unlike texts are judged by their texts alone. All columns stay; an empty
    table gives no rows.
    """
    first = similar_rows(docs, size, least).groupBy("component").agg(F.min(F.struct("doc_id", "th")).alias("one"))
    keep = first.select(F.col("one.doc_id").alias("kept_id"), F.col("one.th").alias("kept_th"))
    rows = docs.select("*", F.xxhash64(utf8()).alias("_th"), F.col("doc_id").cast("long").alias("_id"))
    kept = rows.join(keep, (F.col("_id") == F.col("kept_id")) & (F.col("_th") == F.col("kept_th")), "left_semi").dropDuplicates(["_id", "_th"])
    return kept.unionByName(rows.where("doc_id is null")).select(*(F.col(f"`{c}`") for c in docs.columns))
