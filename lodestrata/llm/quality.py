"""Quality by co-training: a view of the text's content and one of the page's metadata teach each other.

Both views are additive models over binned measures: the content view's come from the
text alone, the metadata view's from the language, the source and the size. All
documents are measured once. In each round either view scores every unlabelled
document; those beyond its confidence thresholds, which are quantiles over all of
them, are pseudo-labelled, and the other view is fitted on the labelled rows and a
bounded number of these. At the end a logistic calibration on labelled documents kept
aside weighs the two views' log-odds into one probability.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.labelled import fold, sample_ids
from lodestrata.llm.shared import dropped, map_texts, packed, stored, unpacked, utf8
from lodestrata.llm.textkernel import LOWER, NOT_SPACE, buffer, mix, rows_of, span_hashes, spans

#: Labelled documents that the views are fitted on, and pseudo-labelled ones of a view, a class and a round, at most.
SAMPLE, PSEUDO = 12_000, 1_500
ROUNDS = 4
BINS = 12
THRESHOLD = 0.5

CONTENT = ["upper", "digit", "symbol", "stop", "ascii", "word_length", "repeats", "distinct_pairs", "top_word", "word_symbols", "one_letter", "spread", "n_lines", "line_length", "longest_line", "blank_lines"]
META = ["n_bytes", "lang", "source"]
#: Shares at which a measure is cut into bins, the tails further.
SHARES = [0.005, 0.02, *(k / BINS for k in range(1, BINS)), 0.98, 0.995]
_BUCKETS = 64

_CLASS = np.zeros(256, np.int64)  # 1 upper, 2 digit, 3 symbol, 4 stop, 5 lower, 6 other
_CLASS[65:91], _CLASS[48:58], _CLASS[97:123], _CLASS[128:] = 1, 2, 5, 6
_CLASS[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 3
_CLASS[[ord(c) for c in ".,;:?'\"-()"]] = 4


def measures(texts: pa.Array, langs: list, sources: list) -> np.ndarray:
    """A row per text: the content measures, then the metadata measures; all shares are 0 for empty texts."""
    raw, off = buffer(texts)
    n = len(off) - 1
    size = np.diff(off)
    row = np.repeat(np.arange(n), size)
    count = np.bincount(row * 8 + _CLASS[raw], minlength=8 * n).reshape(n, 8).astype(float)
    chars = np.maximum(1, count[:, 1:7].sum(axis=1))
    starts, ends, first = spans(raw, off, NOT_SPACE)
    at = rows_of(first)
    words = span_hashes(LOWER[raw], starts, ends)
    n_words = np.maximum(1, np.diff(first))

    def runs(key, row):  # distinct values per row, and the largest count
        if not len(key):
            return np.zeros(n), np.zeros(n)
        mixed = np.sort(key & np.uint64((1 << 44) - 1) | row.astype(np.uint64) << np.uint64(44))
        new = np.flatnonzero(np.concatenate([[True], mixed[1:] != mixed[:-1]]))
        many, owner = np.diff(np.concatenate([new, [len(mixed)]])), (mixed[new] >> np.uint64(44)).astype(np.int64)
        top = np.zeros(n, np.int64)
        np.maximum.at(top, owner, many)
        return np.bincount(owner, minlength=n).astype(float), top.astype(float)

    _, top = runs(words, at)
    same = at[1:] == at[:-1]
    repeats = np.bincount(at[1:], same & (words[1:] == words[:-1]), n)
    pairs, _ = runs(mix(words[:-1] * np.uint64(3) + words[1:])[same], at[:-1][same])
    symbols = np.concatenate([[0], np.cumsum(_CLASS[raw] == 3)])
    marked = np.bincount(at, symbols[ends] > symbols[starts], n)
    length = (ends - starts).astype(float)
    mean = np.bincount(at, length, n) / n_words
    spread = np.sqrt(np.maximum(0, np.bincount(at, length**2, n) / n_words - mean**2))
    lines = np.bincount(row, raw == 10, n) + 1
    breaks = np.flatnonzero(raw == 10)
    edges = np.unique(np.concatenate([breaks, off[:-1] - 0, off[1:]])) if len(raw) else np.zeros(0, np.int64)
    longest, blank = np.zeros(n), np.zeros(n)
    if len(edges) > 1:
        width, owner = np.diff(edges), row[np.minimum(edges[:-1], len(row) - 1)]
        np.maximum.at(longest, owner, width)
        blank = np.bincount(owner, width <= 1, n)
    import zlib

    bucket = lambda xs: np.array([zlib.crc32(str(x).encode()) % _BUCKETS if x is not None else _BUCKETS for x in xs], float)
    content = [count[:, 1] / chars, count[:, 2] / chars, count[:, 3] / chars, count[:, 4] / chars, count[:, 5] / chars, mean, repeats / n_words, pairs / np.maximum(1, n_words - 1), (top - 1) / n_words, marked / n_words, np.bincount(at, length == 1, n) / n_words, spread, np.log2(lines), np.log2(size / lines + 1), np.log2(longest + 1), blank / lines]
    meta = [np.log2(size + 1), bucket(langs), bucket(sources)]
    return np.stack(content + meta, axis=1)


class View:
    """An additive logistic model over binned measures."""

    def __init__(self, columns: list[int], named: set[int]):
        self.columns, self.named = columns, named
        self.edges: list[np.ndarray] = []
        self.w = np.zeros(0)

    def cut(self, quantiles: dict[int, list[float]]) -> None:
        """Bins by each column's quantiles; names are bins of their own."""
        self.edges = [np.arange(_BUCKETS) + 0.5 if c in self.named else np.unique(quantiles[c]) for c in self.columns]
        self.start = np.concatenate([[0], np.cumsum([len(e) + 1 for e in self.edges])])

    def places(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, c], "left") + s for e, c, s in zip(self.edges, self.columns, self.start)], axis=1)

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, l2: float = 2.0, rounds: int = 400) -> None:
        at, size = self.places(x), int(self.start[-1]) + 1
        w, v = np.zeros(size), np.zeros(size)
        rate = 4.0 / (len(self.columns) + 1) / max(1e-9, weight.sum())
        for t in range(1, rounds + 1):
            look = w + t / (t + 3) * v
            g = weight * (1 / (1 + np.exp(-np.clip(look[at].sum(axis=1) + look[-1], -35, 35))) - y)
            grad = sum(np.bincount(at[:, k], g, size) for k in range(at.shape[1]))
            grad[-1] = g.sum()
            grad[:-1] += l2 * look[:-1]
            new = look - rate * grad
            v, w = new - w, new
        self.w = w

    def odds(self, x: np.ndarray) -> np.ndarray:
        return self.w[self.places(x)].sum(axis=1) + self.w[-1]


def new_views(quantiles: dict[int, list[float]]) -> tuple[View, View]:
    k = len(CONTENT)
    views = View(list(range(k)), set()), View(list(range(k, k + len(META))), {k + META.index("lang"), k + META.index("source")})
    for v in views:
        v.cut(quantiles)
    return views


def calibrated(views: tuple[View, View], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """(content weight, metadata weight, bias) of a logistic calibration on rows kept aside."""
    z = np.stack([*(v.odds(x) for v in views), np.ones(len(y))], axis=1)
    start, hold = np.array([1.0, 0.2, 0.0]), np.array([1.0, 1.0, 0.1])
    w = start
    for _ in range(30):  # Newton, held near the start
        p = 1 / (1 + np.exp(-np.clip(z @ w, -35, 35)))
        w = w - np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + np.diag(hold), z.T @ (p - y) + hold * (w - start))
    return w


def _told(rows: DataFrame, views: tuple[View, View]) -> DataFrame:
    """(uid, content, metadata): both views' log-odds of rows (x, uid)."""

    def run(batches):
        for b in batches:
            if b.num_rows:
                x = b.column(0).flatten().to_numpy().reshape(b.num_rows, -1)
                yield pa.record_batch([b.column(1), *(pa.array(v.odds(x)) for v in views)], names=["uid", "content", "metadata"])

    return rows.mapInArrow(run, "uid long, content double, metadata double")


def confident(rows: DataFrame, views: tuple[View, View], share: float, most: int, turn: int, taken: list[set]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each view the measures and pseudo-labels of at most `most` documents a class, out of all that it is surest of.

    Sure of a class are the outer twentieth of all documents, in the classes' shares,
    and log-odds beyond log 9. taken: the uids that each view has labelled before.
    """
    scored = stored(_told(rows, views), "quality-odds")
    names, ends = ("content", "metadata"), [(1 - share) / 20, 1 - share / 20]
    limits = scored.agg(*(F.percentile_approx(c, ends, 10_000).alias(c) for c in names)).first()
    picks = []
    for i, c in enumerate(names):
        low, high = (min(limits[c][0], -np.log(9)), max(limits[c][1], np.log(9))) if limits[c] else (0.0, 0.0)
        for label, sure in ((0.0, F.col(c) <= low), (1.0, F.col(c) >= high)):
            order = scored.where(sure).orderBy(F.xxhash64("uid", F.lit(turn)), "uid")
            picks.append(order.limit(most + len(taken[i])).select("uid", F.lit(i).alias("view"), F.lit(label).alias("label")))
    every = F.broadcast(picks[0].unionByName(picks[1]).unionByName(picks[2]).unionByName(picks[3]))  # 4 (most + taken) rows at most
    got = rows.join(every, "uid").toPandas().sort_values("uid", kind="stable")
    dropped(scored)
    out = []
    for i in range(2):
        xs, ys = [], []
        for label in (0.0, 1.0):
            own = got[(got["view"] == i) & (got["label"] == label) & ~got["uid"].isin(taken[i])][:most]
            taken[i].update(own["uid"])
            xs += own["x"].tolist()
            ys += [label] * len(own)
        out.append((np.array(xs).reshape(len(xs), len(CONTENT) + len(META)), np.array(ys)))
    return out


def _measured(docs: DataFrame, keep: list) -> DataFrame:
    columns = ["lang", "source"]
    rows = docs.select(utf8().alias("text"), *(F.col(c).cast("string").alias(c) if c in docs.columns else F.lit(None).cast("string").alias(c) for c in columns), *keep)

    def run(b):
        m = measures(b.column(0), b.column(1).to_pylist(), b.column(2).to_pylist())
        lists = pa.FixedSizeListArray.from_arrays(pa.array(m.ravel()), m.shape[1]).cast(pa.list_(pa.float64()))
        return pa.record_batch([lists, *b.columns[3:]], names=["x", *b.schema.names[3:]])

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[3:])
    return map_texts(rows, run, f"x array<double>, {types}")


def fit_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = SAMPLE, pseudo: int = PSEUDO, rounds: int = ROUNDS):
    """The co-trained model (content view, metadata view, calibration), or None where the labels don't hold both classes.

    It is fitted on `most` labelled rows and `pseudo` pseudo-labelled ones of a view, a
    class and a round at most; bins and thresholds follow from all documents. Rows
    with a null id are measured and not learnt from; of repeated ids the greatest label
    counts, and each row of them; other columns are ignored, whatever their names.
    """
    import zlib

    measured = stored(_measured(docs, [F.col("doc_id").cast("long").alias("doc_id")]).withColumn("uid", F.monotonically_increasing_id()), "quality-measures")
    width = len(CONTENT) + len(META)
    asked = [F.percentile_approx(F.col("x")[c], SHARES, 10_000).alias(f"q{c}") for c in range(width)]
    quantiles = measured.agg(*asked).first()
    picked = F.broadcast(sample_ids(labels, label, most))  # `most` rows at most
    got = measured.join(picked, "doc_id").orderBy(F.xxhash64("doc_id"), F.xxhash64("x")).limit(2 * most).toPandas()  # repeated ids count in full up to as many again
    y = got["label"].to_numpy(float)
    if len(set(y)) < 2:
        dropped(measured)
        return None
    x = np.array(got["x"].tolist())
    aside = np.array([zlib.crc32(str(i).encode()) // 3 % 5 == 0 for i in got["doc_id"].to_numpy()])
    views = new_views({c: quantiles[c] for c in range(width)})
    sets = [(x[~aside], y[~aside], np.ones(int((~aside).sum()))) for _ in views]
    for v, s in zip(views, sets):
        v.fit(*s)
    known = labels.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    pool = stored(measured.where("doc_id is not null").join(known, "doc_id", "left_anti").select("x", "uid"), "quality-pool")
    taken: list[set] = [set(), set()]
    for turn in range(rounds):
        for i, (px, py) in enumerate(confident(pool, views, y.mean(), pseudo, turn, taken)):
            a, b, w = sets[1 - i]
            sets[1 - i] = np.concatenate([a, px]), np.concatenate([b, py]), np.concatenate([w, np.full(len(py), 0.5)])
        for v, s in zip(views, sets):
            v.fit(*s)
    dropped(measured, pool)
    held, truth = (x[aside], y[aside]) if len(set(y[aside])) == 2 else (x, y)
    return *views, calibrated(views, held, truth)


def scored(docs: DataFrame, model, threshold: float = THRESHOLD, kept: bool = False) -> DataFrame:
    """row (a struct of the other columns), text, content_odds, metadata_odds, score and keep per document.

    With `kept` only documents with at least the threshold come back, with their texts;
    otherwise all, and the text is null.

    Without a model every document scores 1. Null and empty texts have measures of 0;
    repeated rows score alike; an empty table gives no rows.
    """
    given = packed(docs, "text")
    if model is None:
        return docs.select(*given, F.lit(0.0).alias("content_odds"), F.lit(0.0).alias("metadata_odds"), F.lit(1.0).alias("score"), F.lit(True).alias("keep"))
    columns = [F.col(c).cast("string") if c in docs.columns else F.lit(None).cast("string") for c in ("lang", "source")]
    rows = docs.select(*given, columns[0].alias("lang"), columns[1].alias("source"))

    def run(b):
        content, meta, w = model
        x = measures(pc.fill_null(b.column(1), b""), b.column(2).to_pylist(), b.column(3).to_pylist())
        a, m = content.odds(x), meta.odds(x)
        p = 1 / (1 + np.exp(-np.clip(w[0] * a + w[1] * m + w[2], -35, 35)))
        keep = p >= threshold
        out = pa.record_batch([b.column(0), b.column(1) if kept else pa.nulls(b.num_rows, pa.binary()), pa.array(a), pa.array(m), pa.array(p), pa.array(keep)], names=["row", "text", "content_odds", "metadata_odds", "score", "keep"])
        return out.filter(pa.array(keep)) if kept else out

    return map_texts(rows, run, f"row {rows.schema['row'].dataType.simpleString()}, text binary, content_odds double, metadata_odds double, score double, keep boolean")


def quality_scores(docs: DataFrame, model, threshold: float = THRESHOLD) -> DataFrame:
    """Per document: doc_id, held_out (a fold whose labels aren't learnt from), content_odds, metadata_odds, score, keep."""
    found = scored(docs.select("doc_id", "text", *(c for c in ("lang", "source") if c in docs.columns)), model, threshold)
    return found.select(F.col("row.doc_id").alias("doc_id"), (fold("row.doc_id", 3) == 1).alias("held_out"), "content_odds", "metadata_odds", "score", "keep")


def quality_filter(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score at least the threshold, with all their columns."""
    return scored(docs, fit_quality(docs, labels), threshold, kept=True).select(*unpacked(docs, "text", F.col("text").cast("string"), F.lit(False)))
