"""Benchmark decontamination: a broadcast hash set of the test items' word windows, scanned over all documents.

Words are runs of letters, digits and non-ASCII characters, lower-cased in A-Z. The
windows' hashes go to every worker in chunks of a bounded size; a benchmark beyond
the bound takes one further pass a chunk, without a shuffle, and one chunk is held at
a time. A hash that is found is verified word for word before it counts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.shared import dropped, map_texts, packed, stored, unpacked, utf8
from lodestrata.llm.textkernel import ALNUM, LOWER, buffer, mix, powers, rows_of, span_hashes, spans

WINDOW = 8
#: Windows that one broadcast holds, and their bytes, at most.
CHUNK_WINDOWS, CHUNK_BYTES = 400_000, 48 << 20

WINDOW_SCHEMA = "item_id string, size int, hash long, words binary"


def word_hashes(raw, off):
    """Lower-cased bytes, word starts, ends, each row's first word, and the words' hashes."""
    raw = LOWER[raw]
    starts, ends, first = spans(raw, off, ALNUM)
    return raw, starts, ends, first, span_hashes(raw, starts, ends)


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """A hash of each `size` words in a row."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    p, inv = powers(len(words) + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * p[:-1])])
    return mix((total[size:] - total[:n]) * inv[:n] + np.uint64(size))


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """The distinct (item_id, size, hash, words) of all items; one of fewer words than `window`, but not none, is one window."""

    def run(b):
        raw, starts, ends, first, hashes = word_hashes(*buffer(b.column(1)))
        data, ids, out = raw.tobytes(), b.column(0).to_pylist(), []
        for i, item in enumerate(ids):
            lo, hi = first[i], first[i + 1]
            size = min(window, hi - lo)
            if size and item is not None:
                found = window_hashes(hashes[lo:hi], size).view(np.int64).tolist()
                words = [data[s:e] for s, e in zip(starts[lo:hi], ends[lo:hi])]
                out += [(item, int(size), h, b" ".join(words[k : k + size])) for k, h in enumerate(found)]
        cols = list(zip(*out)) or [[], [], [], []]
        return pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int32(), pa.int64(), pa.binary()))], names=["item_id", "size", "hash", "words"])

    rows = benchmark.select(F.col(id_col).cast("string").alias("item_id"), utf8(text_col).alias("text"))
    return map_texts(rows, run, WINDOW_SCHEMA).distinct()


class _Set:
    """One chunk of windows: for each size the sorted hashes behind a bit table, and what verifies them."""

    def __init__(self, rows):
        self.by: dict[int, tuple[np.ndarray, np.ndarray, int]] = {}
        self.items: dict[tuple[int, bytes], list[str]] = {}
        of: dict[int, list[int]] = {}
        for r in rows:
            self.items.setdefault((r["size"], bytes(r["words"])), []).append(r["item_id"])
            of.setdefault(r["size"], []).append(r["hash"])
        for size, found in of.items():
            hashes = np.unique(np.array(found, np.int64).view(np.uint64))
            width = int(min(24, max(16, np.ceil(np.log2(64 * len(hashes))))))
            table = np.zeros(1 << width, bool)
            table[hashes >> np.uint64(64 - width)] = True
            self.by[size] = hashes, table, width

    def scan(self, raw, starts, ends, first, words, hit: np.ndarray, found: list[set]):
        """Marks the words inside occurring windows in `hit` and adds their items to `found`, by row."""
        row = rows_of(first)
        data = None
        for size, (hashes, table, width) in self.by.items():
            h = window_hashes(words, size)
            at = np.flatnonzero(table[h >> np.uint64(64 - width)])
            at = at[row[at] == row[at + size - 1]]
            place = np.minimum(np.searchsorted(hashes, h[at]), len(hashes) - 1)
            at = at[hashes[place] == h[at]]
            if len(at) and data is None:
                data = raw.tobytes()
            for i in at.tolist():
                text = b" ".join(data[s:e] for s, e in zip(starts[i : i + size].tolist(), ends[i : i + size].tolist()))
                if items := self.items.get((size, text)):
                    hit[i : i + size] = True
                    found[row[i]].update(items)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, chunk_windows: int = CHUNK_WINDOWS, text_col: str = "text", cut: bool = True) -> DataFrame:
    """Per document, and in its order: row (a struct of its other columns), n_words, n_hit, items, changed, text.

    items: the ids of test items with occurring windows; text: the text without the
    runs of hit words, or null throughout if `cut` is false. A null text or one
    without words has no words and no hits, and stays; an item that is null or without
    words has no windows; repeated rows are scanned like any other, and repeated items
    count once; an empty benchmark hits nothing; a table without rows gives none.

    One chunk of windows is alive at a time: a benchmark of several chunks has each
    pass but the last stored, and its broadcast released, before the next begins.
    """
    spark = docs.sparkSession
    windows = stored(benchmark_windows(benchmark, window), "benchmark-windows")
    n, size = windows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("words") + 24), F.lit(0))).first()
    chunks = max(1, -(-n // chunk_windows), -(-size // CHUNK_BYTES))
    rows = docs.select(*packed(docs, text_col), F.lit(None).cast("binary").alias("hits"), F.array().cast("array<string>").alias("items"))
    kind = rows.schema["row"].dataType.simpleString()
    for c in range(chunks):
        sent = spark.sparkContext.broadcast(_Set(windows.where(F.pmod("hash", F.lit(chunks)) == c).toLocalIterator()))
        if c == chunks - 1:
            return map_texts(rows, _pass(sent, True, cut), f"row {kind}, n_words long, n_hit long, items array<string>, changed boolean, text binary")
        before, rows = rows, stored(map_texts(rows, _pass(sent, False, cut), f"row {kind}, text binary, hits binary, items array<string>"), "benchmark-pass")
        sent.unpersist()
        if c:
            dropped(before)


def _pass(sent, last: bool, cut: bool):
    def run(b):
        given = b.column(1)
        raw, starts, ends, first, words = word_hashes(*buffer(pc.fill_null(given, b"")))
        hit, found = np.zeros(len(words), bool), [set(x) for x in b.column(3).to_pylist()]
        for i, bits in enumerate(b.column(2).to_pylist()):
            if bits:
                hit[first[i] : first[i + 1]] = np.unpackbits(np.frombuffer(bits, np.uint8), count=int(first[i + 1] - first[i])).astype(bool)
        sent.value.scan(raw, starts, ends, first, words, hit, found)
        items = pa.array([sorted(x) for x in found], pa.list_(pa.string()))
        if not last:
            bits = [np.packbits(hit[first[i] : first[i + 1]]).tobytes() if found[i] else None for i in range(b.num_rows)]
            return pa.record_batch([b.column(0), given, pa.array(bits, pa.binary()), items], names=["row", "text", "hits", "items"])
        total = np.concatenate([[0], np.cumsum(hit)])
        n_hit = total[first[1:]] - total[first[:-1]]
        left = given
        if not cut:
            left = pa.nulls(b.num_rows, pa.binary())
        elif hit.any():
            texts, at = given.to_pylist(), 0
            for i, text in enumerate(texts):
                if n_hit[i]:
                    own = hit[first[i] : first[i + 1]]
                    edge = first[i] + np.flatnonzero(np.diff(np.concatenate([[0], own.view(np.int8), [0]])))
                    froms = [0, *(ends[edge[1::2] - 1] - at).tolist()]
                    texts[i] = b"".join(text[x:y] for x, y in zip(froms, [*(starts[edge[::2]] - at).tolist(), len(text)]))
                at += len(text or b"")
            left = pa.array(texts, pa.binary())
        return pa.record_batch([b.column(0), pa.array(np.diff(first), pa.int64()), pa.array(n_hit, pa.int64()), items, pa.array(n_hit > 0), left], names=["row", "n_words", "n_hit", "items", "changed", "text"])

    return run


def contamination_report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated (two items or more).

    Null texts and ids, repeated rows and empty tables as in contamination(); other
    columns are ignored, whatever their names.
    """
    found = contamination(docs.select("doc_id", "text"), benchmark, cut=False)
    return found.select(
        F.col("row.doc_id").alias("doc_id"),
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        (F.size("items") >= 2).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, most_items: int = 1, text_col: str = "text") -> DataFrame:
    """The documents without test content: those with windows of more than `most_items` items go, the others lose the runs of hit words.

    All columns stay, n_chars follows a changed text; a null text stays null; ids play no part.
    """
    found = contamination(docs, benchmark, text_col=text_col)
    return found.where(F.size("items") <= most_items).select(*unpacked(docs, text_col, F.col("text").cast("string"), F.col("changed")))
