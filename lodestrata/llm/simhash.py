"""SimHash near-duplicates by a hierarchical index over fingerprints in Gray order.

Fingerprints within two bits are equal in one of three blocks of 21 or 22 bits at least,
so each distinct one goes to three keys: the roots of the index, whose mask is a block
and whose pattern its value. Below a root the fingerprints are sorted by Gray rank, and
a node holds the bits that all below it share and no node above it has. A search adds
up its differences from the root on, and leaves a node with all below it as soon as
they exceed the limit. A fingerprint has at most 2,080 others within two bits, so links
are bounded by the distinct fingerprints; a root tells one link per fingerprint at
most, to the least of its local component.

Near copies by similarity need more bits than two: see simhash_similar.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.shared import connected_components, map_texts, merge_roots, stored, utf8

MAX_BITS = 2
FANOUT = 8
#: Queries that descend the tree together.
BLOCK = 1 << 13
#: The first bits and the widths of the blocks: one more than MAX_BITS.
BLOCKS = ((0, 21), (21, 21), (42, 22))


def fingerprints(texts: list[bytes], size: int = 3) -> np.ndarray:
    """The SimHash of each text over XXH64 (seed 42) of its word shingles, repeats included; no words: zero."""
    hashes: list[int] = []
    counts = np.zeros(len(texts), np.int64)
    h = xxhash.xxh64_intdigest
    for i, text in enumerate(texts):
        words = text.lower().split()
        if len(words) <= size:
            got = [h(b" ".join(words), 42)] if words else []
        else:
            joined = b" ".join(words)
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
            starts = np.concatenate([[0], ends[: -size] + 1])
            got = [h(joined[a:b], 42) for a, b in zip(starts.tolist(), ends[size - 1 :].tolist())]
        counts[i] = len(got)
        hashes += got
    out = np.zeros(len(texts), np.uint64)
    if not hashes:
        return out
    bits = np.unpackbits(np.array(hashes, ">u8").view(np.uint8).reshape(-1, 8), axis=1)
    full = np.flatnonzero(counts)
    first = (np.cumsum(counts) - counts)[full]
    ones = np.add.reduceat(bits, first, axis=0, dtype=np.int32)
    out[full] = np.packbits(ones * 2 > counts[full][:, None], axis=1).view(">u8").ravel()
    return out


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """The place of each code in the Gray sequence."""
    r = codes.copy()
    for s in (1, 2, 4, 8, 16, 32):
        r ^= r >> np.uint64(s)
    return r


class Tree:
    """Nodes over patterns and masks that come by group, in Gray order: levels from the roots, one a group, to the given ones."""

    def __init__(self, group: np.ndarray, pattern: np.ndarray, mask: np.ndarray):
        levels = [(None, group, pattern, mask)]  # first child of each node, its group, common bits
        while True:
            _, g, pat, own = levels[-1]
            new = np.concatenate([[True], g[1:] != g[:-1]])
            if new.all() and len(levels) > 1:
                break
            place = np.arange(len(g)) - np.flatnonzero(new)[np.cumsum(new) - 1]
            at = np.flatnonzero(place % FANOUT == 0)
            both = np.bitwise_and.reduceat(own, at) & ~(np.bitwise_or.reduceat(pat & own, at) ^ np.bitwise_and.reduceat(pat | ~own, at))
            levels.append((at, g[at], pat[at] & both, both))
            if len(at) == len(g):
                break
        self.levels = levels[::-1]
        self.groups = self.levels[0][1]

    def descend(self, group: np.ndarray, codes: np.ndarray, limit: int):
        """Yields blocks (i, node) of the codes and the given nodes of their group whose patterns they differ from in at most `limit` bits."""
        for lo in range(0, len(codes), BLOCK):
            q = np.arange(lo, min(len(codes), lo + BLOCK))
            start = np.minimum(np.searchsorted(self.groups, group[q]), len(self.groups) - 1)
            there = self.groups[start] == group[q]
            q, node = q[there], start[there]
            diff, above = np.zeros(len(q), np.uint8), np.zeros(len(q), np.uint64)
            for depth, (_, _, pat, mask) in enumerate(self.levels):
                if depth:
                    up = self.levels[depth - 1][0]
                    first = up[node]
                    many = np.concatenate([up[1:], [len(pat)]])[node] - first
                    rep = np.repeat(np.arange(len(q)), many)
                    node = first[rep] + np.arange(len(rep)) - np.repeat(np.cumsum(many) - many, many)
                    q, diff, above = q[rep], diff[rep], above[rep]
                own = mask[node] & ~above
                diff = diff + np.bitwise_count((codes[q] ^ pat[node]) & own)
                keep = diff <= limit
                q, node, diff, above = q[keep], node[keep], diff[keep], (above | own)[keep]
            if len(q):
                yield q, node


def index_links(group: np.ndarray, codes: np.ndarray, limit: int = MAX_BITS):
    """Yields blocks (i, j), i < j, of rows of one group whose codes differ in at most `limit` bits.

    Rows come sorted by group, then by Gray rank.
    """
    tree = Tree(group, codes, np.full(len(codes), np.uint64(0xFFFFFFFFFFFFFFFF)))
    for q, node in tree.descend(group, codes, limit):
        keep = q < node
        if keep.any():
            yield q[keep], node[keep]


def _edges(limit: int):
    """Links within each key, from rows (key, fp, rep) sorted by it."""

    def links(key, fp, rep):
        group = np.cumsum(np.concatenate([[False], key[1:] != key[:-1]]))
        many = np.bincount(group)[group] > 1
        group, fp, rep = group[many], fp[many], rep[many]
        if not len(fp):
            return
        order = np.lexsort((gray_rank(fp), group))
        group, fp, rep = group[order], fp[order], rep[order]
        parent = np.arange(len(fp))
        for i, j in index_links(group, fp, limit):
            parent = merge_roots(parent, i, j)
        moved = parent != np.arange(len(fp))
        if moved.any():
            yield pa.record_batch([pa.array(rep[moved]), pa.array(rep[parent[moved]])], names=["a", "b"])

    def run(batches):
        held: list[tuple] = []
        for b in batches:
            if not b.num_rows:
                continue
            key, fp, rep = (b.column(i).to_numpy() for i in range(3))
            held.append((key, fp.view(np.uint64), rep))
            if sum(len(h[0]) for h in held) < 1 << 17 or key[-1] == held[0][0][0]:
                continue  # not while one key goes on
            key, fp, rep = (np.concatenate(c) for c in zip(*held))
            cut = int(np.searchsorted(key, key[-1]))
            yield from links(key[:cut], fp[:cut], rep[:cut])
            held = [(key[cut:], fp[cut:], rep[cut:])]
        if held:
            yield from links(*(np.concatenate(c) for c in zip(*held)))

    return run


def simhash_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3) -> DataFrame:
    """(doc_id, fp) per row; fp is the fingerprint's 64 bits as a long."""

    def run(b):
        fp = fingerprints(b.column(1).to_pylist(), size)
        return pa.record_batch([b.column(0), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), utf8(text_col).alias("text"))
    return map_texts(rows, run, "doc_id long, fp long")


def simhash_components(fps: DataFrame) -> DataFrame:
    """(fp, component_id) for each distinct fp of (doc_id, fp); component_id is the least doc_id reachable by links of at most MAX_BITS bits.

    A null doc_id takes no part: its row is linked with nothing and has no component but its class's.
    """
    classes = stored(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")), "simhash-classes")
    keys = [F.lit(c << 60).bitwiseOR(F.shiftrightunsigned("fp", first).bitwiseAND(F.lit((1 << width) - 1))) for c, (first, width) in enumerate(BLOCKS)]
    dealt = classes.where("rep is not null").select(F.explode(F.array(*keys)).alias("key"), "fp", "rep")
    edges = dealt.repartition("key").sortWithinPartitions("key").mapInArrow(_edges(MAX_BITS), "a long, b long")
    found = connected_components(edges)
    return classes.join(found.withColumnRenamed("id", "rep"), "rep", "left").select("fp", F.coalesce("component", "rep").alias("component_id"))


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id.

    A null or empty text has fingerprint zero and is linked like any other; repeated
    rows give repeated rows; a row without an id is of the component of its fingerprint
    and gives none its id; an empty table gives none; other columns are ignored,
    whatever their names.
    """
    fps = stored(simhash_fingerprints(docs, id_col, text_col, size), "simhash-fps")
    hexed = F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint")
    return fps.join(simhash_components(fps), "fp").select("doc_id", hexed, "component_id")
