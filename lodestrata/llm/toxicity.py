"""Toxicity by FTRL-proximal logistic regression over hashed words, stems, bigrams and skip-grams.

Each coordinate has its own rate; the L1 term leaves a few thousand weights at most
of the 2^20, which go to every worker as a sorted table. Features are present or
absent in a text, so its length doesn't move the score.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.labelled import fold, sample_ids
from lodestrata.llm.shared import map_texts, utf8
from lodestrata.llm.textkernel import ALNUM, LOWER, buffer, mix, rows_of, span_hashes, spans

BITS = 20
#: Labelled documents that the model is fitted on at most.
SAMPLE = 8_000
EPOCHS = 20
STEMS = (4, 5)
#: A coordinate is picked where its gradient leaves so many standard deviations, and this sum at least.
SIGMAS, LEAST = 5.0, 3.5
THRESHOLD = 0.7


def hashed_features(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Rows and coordinates of all words, their stems, bigrams and one-word skip-grams of the lower-cased texts, repeats included."""
    raw, off = buffer(col)
    raw = LOWER[raw]
    starts, ends, first = spans(raw, off, ALNUM)
    words, row = span_hashes(raw, starts, ends), rows_of(first)
    rows, coords = [row], [words >> np.uint64(64 - BITS)]
    for stem in STEMS:  # inflected forms share their first bytes
        long = np.flatnonzero(ends - starts > stem)
        rows.append(row[long])
        coords.append(mix(span_hashes(raw, starts[long], starts[long] + stem) + np.uint64(stem)) >> np.uint64(64 - BITS))
    for gap, salt in ((1, 0x9E6C63D0676A9A99), (2, 0xD1B54A32D192ED03)):
        if len(words) > gap:
            inside = row[gap:] == row[:-gap]
            pair = mix(words[:-gap] * np.uint64(3) + words[gap:] + np.uint64(salt))
            rows.append(row[:-gap][inside])
            coords.append((pair >> np.uint64(64 - BITS))[inside])
    return np.concatenate(rows), np.concatenate(coords).astype(np.int64)


def ftrl(examples: list[np.ndarray], labels: np.ndarray, epochs: int, l1, alpha: float = 1.0, beta: float = 1.0, l2: float = 0.01) -> tuple[np.ndarray, np.ndarray, float]:
    """Sorted coordinates of non-zero weights, the weights, and the bias.

    examples are sets of coordinates; l1 is one number or one per coordinate.
    """
    size = 1 << BITS
    z, n, w0, n0 = np.zeros(size), np.zeros(size), 0.0, 0.0
    l1 = np.broadcast_to(np.asarray(l1, float), size)
    order = np.random.default_rng(7)
    for _ in range(epochs):
        for i in order.permutation(len(examples)):
            x = examples[i]
            zx, nx, lx = z[x], n[x], l1[x]
            root = np.sqrt(nx)
            w = np.where(np.abs(zx) <= lx, 0.0, (np.sign(zx) * lx - zx) / ((beta + root) / alpha + l2))
            g = 1 / (1 + np.exp(-max(-35.0, min(35.0, w0 + w.sum())))) - labels[i]
            new = nx + g * g
            z[x] = zx + g - (np.sqrt(new) - root) / alpha * w
            n[x] = new
            n0 += g * g
            w0 -= 0.5 / (1 + np.sqrt(n0)) * g
    keep = np.flatnonzero(np.abs(z) > l1)
    w = (np.sign(z[keep]) * l1[keep] - z[keep]) / ((beta + np.sqrt(n[keep])) / alpha + l2)
    return keep, w, float(w0)


def sparse_fit(examples: list[np.ndarray], labels: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """One pass whose L1 follows each coordinate's spread under no effect, then a fit of what it left."""
    seen = np.bincount(np.concatenate(examples), minlength=1 << BITS)
    share = labels.mean()
    picked, _, _ = ftrl(examples, labels, 1, np.maximum(SIGMAS * np.sqrt(seen * share * (1 - share)), LEAST))
    left = np.zeros(1 << BITS, bool)
    left[picked] = True
    return ftrl([x[left[x]] for x in examples], labels, EPOCHS, 0.3, alpha=2.0)


def odds(examples: list[np.ndarray], model) -> np.ndarray:
    dense = np.zeros(1 << BITS)
    dense[model[0]] = model[1]
    return model[2] + np.array([dense[x].sum() for x in examples])


def fit(examples: list[np.ndarray], labels: np.ndarray, folds: int = 3) -> tuple[np.ndarray, np.ndarray, float]:
    """A sparse model whose bias puts the threshold where the documents left out of each fold are told apart best."""
    model = sparse_fit(examples, labels)
    out = np.zeros(len(labels))
    for k in range(folds):
        test = np.arange(len(labels)) % folds == k
        if len(set(labels[~test])) < 2:
            return model
        out[test] = odds([x for x, t in zip(examples, test) if t], sparse_fit([x for x, t in zip(examples, test) if not t], labels[~test]))
    order = np.argsort(-out, kind="stable")
    cut, hits = out[order], np.cumsum(labels[order])
    f1 = 2 * hits / (np.arange(1, len(cut) + 1) + labels.sum())
    f1[:-1][cut[:-1] == cut[1:]] = 0  # no cut between equals
    best = int(np.argmax(f1))
    at = (cut[best] + cut[min(best + 1, len(cut) - 1)]) / 2
    return model[0], model[1], model[2] - at + float(np.log(THRESHOLD / (1 - THRESHOLD)))


def fit_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", most: int = SAMPLE) -> tuple[np.ndarray, np.ndarray, float]:
    """A model from at most `most` labelled documents of the learning folds; without both classes, one that scores 0."""
    picked = sample_ids(labels, label, most)  # a broadcast of `most` rows at most
    rows = docs.select("doc_id", utf8().alias("text")).join(F.broadcast(picked), "doc_id").select("doc_id", "text", "label")

    def run(b):
        row, coord = hashed_features(b.column(1))
        key = np.unique(row << BITS | coord)
        cut = np.searchsorted(key >> BITS, np.arange(b.num_rows + 1))
        return pa.record_batch([b.column(0), b.column(2), pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array((key & ((1 << BITS) - 1)).astype(np.int32)))], names=["doc_id", "label", "x"])

    got = map_texts(rows, run, "doc_id long, label int, x array<int>").toArrow().combine_chunks()
    order = np.argsort(got["doc_id"].to_numpy(), kind="stable")
    y = got["label"].to_numpy()[order].astype(float)
    if len(set(y)) < 2:
        return np.zeros(0, np.int64), np.zeros(0), -35.0
    lists = got["x"].combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    flat, cut = lists.values.to_numpy(), lists.offsets.to_numpy()
    return fit([flat[cut[i] : cut[i + 1]] for i in order], y)


def toxicity_scores(docs: DataFrame, model, threshold: float = THRESHOLD) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted, n_signals (features of the model in the text).

    A null or empty text has the score of the bias; repeated rows score alike.
    """
    coords, weights, bias = model
    sent = docs.sparkSession.sparkContext.broadcast((coords, weights))  # 2^20 at most, by the hashing

    def run(b):
        coords, weights = sent.value
        dense = np.zeros(1 << BITS, np.float32)
        dense[coords] = weights
        row, coord = hashed_features(b.column(1))
        hit = np.flatnonzero(dense[coord])
        key = np.unique(row[hit] << BITS | coord[hit])
        n = b.num_rows
        total = bias + np.bincount(key >> BITS, dense[key & ((1 << BITS) - 1)], n)
        score = 1 / (1 + np.exp(-np.clip(total, -35, 35)))
        return pa.record_batch([b.column(0), b.column(2), pa.array(score), pa.array((score >= threshold).astype(np.int32)), pa.array(np.bincount(key >> BITS, minlength=n).astype(np.int64))], names=["doc_id", "held_out", "score", "predicted", "n_signals"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8().alias("text"), (fold("doc_id", 3) == 1).alias("held_out"))
    return map_texts(rows, run, "doc_id long, held_out boolean, score double, predicted int, n_signals long")
