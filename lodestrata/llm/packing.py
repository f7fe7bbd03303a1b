"""Packing token pieces into sequences: non-negative least squares over shallow length combinations.

Documents are cut into pieces of a window's length and one remainder. Combinations of
two and three lengths that fill a window exactly are the columns of a non-negative
least squares problem whose target is the histogram of the remainders' lengths; the
repeat counts are rounded down, and what they leave, a number of pieces bounded by the
number of combinations and not by the data, is packed greedily. All of this looks at
the histogram alone: 1,023 numbers. A piece then finds its sequence from its length
and its rank among the pieces of that length.
"""

from __future__ import annotations

import json
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.llm.shared import map_texts, stored, utf8

WINDOW = 1024
#: Pieces of one length that are ranked together.
RANKED = 200_000


@lru_cache(2)
def encoder(path: str):
    """A tokenizers file as a function from text to ids, as the library encodes without special tokens of its own.

    The vocabulary and merge order of a byte-level BPE file drive tiktoken's engine, which gives the
    same ids several times faster (tests/llm compares them): an added token that
    stands in a text is one id, what lies between is encoded alone. Files of other
    kinds, or whose added tokens strip or need word borders, go to the library itself.
    """
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, pre, added = spec["model"], spec.get("pre_tokenizer") or {}, spec.get("added_tokens", [])
    plain = model.get("type") == "BPE" and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and not spec.get("normalizer")
    if plain and not any(t.get(k) for t in added for k in ("single_word", "lstrip", "rstrip")):
        import tiktoken

        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in shown]
        back = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
        special = {t["content"]: t["id"] for t in added}
        ranks = {bytes(back[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        engine = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
        return lambda text: engine.encode(text, allowed_special="all")
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    return lambda text: found.encode(text, add_special_tokens=False).ids


def token_pieces(docs: DataFrame, vocabulary: str, window: int = WINDOW) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens) of each piece; a document's ids end with 0."""

    def run(b):
        encode, out = encoder(vocabulary), [[], [], [], [], []]
        for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            ids = np.array([*encode(text.decode("utf-8", "replace")), 0], "<u4")
            for s in range(0, len(ids), window):
                piece = ids[s : s + window]
                for col, x in zip(out, (doc, s, len(piece), zlib.crc32(piece.tobytes()), len(ids))):
                    col.append(x)
        return pa.record_batch([pa.array(c, pa.int64()) for c in out], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8().alias("text"))
    return map_texts(rows, run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def combinations(window: int) -> np.ndarray:
    """The lengths (a >= b >= c, c may be 0) that fill a window exactly, two or three at a time."""
    a, b = np.meshgrid(np.arange(1, window), np.arange(1, window), indexing="ij")
    c = window - a - b
    keep = (a >= b) & (b >= c) & (c >= 0)
    return np.stack([a[keep], b[keep], c[keep]], axis=1)


def nnls_counts(hist: np.ndarray, combos: np.ndarray, rounds: int = 300) -> np.ndarray:
    """Repeat counts x >= 0 with least |A x - hist|, by accelerated projected gradients; column j of A counts combos[j]'s lengths."""
    n = len(hist)

    def times(x):
        out = sum(np.bincount(combos[:, k], x, n) for k in range(combos.shape[1]))
        out[0] = 0
        return out

    def back(r):
        r = r.copy()
        r[0] = 0
        return sum(r[combos[:, k]] for k in range(combos.shape[1]))

    v = np.ones(len(combos))
    for _ in range(12):
        v = back(times(v))
        norm = np.linalg.norm(v)
        v /= norm
    step = 1 / (1.05 * norm)
    scale = max(1.0, hist.max())
    target = hist / scale
    x = y = np.zeros(len(combos))
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(0, y - step * back(times(y) - target))
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / t2 * (new - x)
        x, t = new, t2
    return x * scale


def plan_patterns(hist: dict[int, int], window: int = WINDOW) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of lengths, longest first, with their numbers of sequences; together they use each length hist times."""
    left = np.zeros(window + 1, np.int64)
    for length, n in hist.items():
        left[length] += n
    plan = [((window,), int(left[window]))] if left[window] else []
    left[window] = 0
    if left.any():
        combos = combinations(window)
        combos = combos[((left[combos] > 0) | (combos == 0)).all(axis=1)]
        if len(combos):
            x = nnls_counts(left[:window].astype(float), combos)
            for j in np.argsort(-x, kind="stable"):
                n = int(x[j] + 1e-6)
                if not n:
                    break
                lengths, many = np.unique(combos[j][combos[j] > 0], return_counts=True)
                n = min(n, int((left[lengths] // many).min()))
                if n:
                    left[lengths] -= n * many
                    plan.append((tuple(int(v) for v in combos[j] if v), n))
    while left.any():  # best fit, the longest first; a pair that fills the gap exactly comes before the longest that fits
        have = np.flatnonzero(left)
        lengths = [int(have[-1])]
        left[have[-1]] -= 1
        gap = window - lengths[0]
        while gap and (fit := np.flatnonzero(left[: gap + 1])).size:
            if left[gap]:
                took = [gap]
            else:
                pairs = fit[(left[gap - fit] > 0) & ((gap - fit != fit) | (left[fit] > 1)) & (fit < gap)]
                took = [int(pairs[-1]), gap - int(pairs[-1])] if pairs.size else [int(fit[-1])]
            for v in took:
                left[v] -= 1
                gap -= v
                lengths.append(v)
        values, many = np.unique(lengths, return_counts=True)
        more = int((left[values] // many).min())
        left[values] -= more * many
        plan.append((tuple(lengths), 1 + more))
    return plan


def slots(plan: list[tuple[tuple[int, ...], int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted keys (length << 44 | first rank), with the sequence of that rank and the offset: what a piece looks up."""
    used: dict[int, int] = {}
    rows, base = [], 0
    for lengths, n in plan:
        offset = 0
        for v in lengths:
            rows.append((v << 44 | used.get(v, 0), base, offset))
            used[v] = used.get(v, 0) + n
            offset += v
        base += n
    rows.sort()
    return tuple(np.array(c, np.int64) for c in (zip(*rows) if rows else ([], [], [])))


def pack_pieces(pieces: DataFrame, window: int = WINDOW) -> DataFrame:
    """pieces with sequence_id and offset.

    Pieces of one length are ranked in buckets of a hash, about 200,000 each, so that
    no length, however common, is ranked in one task. Repeated pieces tie; each gets a
    rank of its own.
    """
    spark = pieces.sparkSession
    hist = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # `window` rows at most
    keys, bases, offsets = sent = slots(plan_patterns(hist, window))
    if not len(keys):
        return pieces.select("*", F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    many = F.create_map(*(F.lit(x) for k, n in hist.items() if n > RANKED for x in (k, -(-n // RANKED)))) if max(hist.values()) > RANKED else None
    bucket = F.pmod(F.xxhash64("doc_id", "start"), F.coalesce(F.try_element_at(many, "length"), F.lit(1)) if many is not None else F.lit(1))
    dealt = pieces.withColumn("bucket", bucket.cast("long"))
    counts = dealt.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("length", "bucket", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("first"))
    place = Window.partitionBy("length", "bucket").orderBy("doc_id", "start")
    ranked = dealt.withColumn("rank", F.row_number().over(place) - 1).join(first, ["length", "bucket"])
    ranked = ranked.select(*pieces.columns, (F.col("first") + F.col("rank")).cast("long").alias("rank"))
    table = spark.sparkContext.broadcast(sent)  # bounded by the combinations, not by the data
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long"
    at = pieces.columns.index("length")

    def assign(batches):
        keys, bases, offsets = table.value
        for b in batches:
            key = b.column(at).to_numpy(zero_copy_only=False) << 44 | b.column(b.num_columns - 1).to_numpy(zero_copy_only=False)
            i = np.searchsorted(keys, key, "right") - 1
            yield pa.record_batch([*b.columns[:-1], pa.array(bases[i] + key - keys[i]), pa.array(offsets[i])], names=[*b.schema.names[:-1], "sequence_id", "offset"])

    return ranked.mapInArrow(assign, schema)


def pack_documents(docs: DataFrame, vocabulary: str, window: int = WINDOW) -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null text is empty, and an empty one is the id 0 alone; repeated rows are packed
    as often as they occur; a very long text makes many pieces of a window's length;
    an empty table gives no rows; other columns are ignored.
    """
    return pack_pieces(stored(token_pieces(docs, vocabulary, window), "pieces"), window)
