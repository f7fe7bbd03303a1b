"""Language-model scoring by context-tree weighting over binary-decomposed bytes.

A text is its lower-cased words joined by single spaces, with one end byte. Each byte
is eight binary choices; each choice, within each context of 0 to DEPTH preceding
bytes, is a node with counts of zeros and ones and a Krichevsky-Trofimov estimate.
Bottom up, a node's weighted probability is the mean of its own estimate's and of the
product of its children's, one byte deeper; the posterior share of its own estimate
then mixes the prediction down the path of a byte to be scored. Where the path leaves
the tree, what is left of the weight stays with the deepest node.

The counts of all (context, byte) runs of the learning documents are a Spark
aggregation. Subtrees below three bytes of context are weighted in parallel; the nodes
above, of which 65,536 contexts of 255 places are the most there can be, on the driver.
Every (context, byte) run that any document holds then gets its probability once, where
its subtree is: the whole tree scores, whatever its size. Scorers get the TABLE most
frequent runs' as a broadcast table; rarer runs are joined by a shuffle.

The base score needs a count for every word. Frequent words, at most FREQUENT of
them, are broadcast; the others' counts are joined by the same shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.labelled import fold
from lodestrata.llm.shared import bounded_batches, slices, stored, utf8
from lodestrata.llm.textkernel import LOWER, NOT_SPACE, buffer, mix, rows_of, span_hashes, spans

DEPTH = 5
#: Runs and words that are broadcast at most; they bound no result, but what is joined.
TABLE, FREQUENT = 3_000_000, 400_000
#: Bytes of context by which subtrees are dealt.
CUT = 3
#: Bytes of text that are scored together.
SLICE = 1 << 20
END = 10
#: The hash of the end token; a word's hash is that of its bytes.
END_TOKEN = np.uint64(0x5851F42D4C957F2D)


def normal_bytes(raw: np.ndarray, off: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The texts' normal forms in one buffer, each with its end byte and parted by `depth` of them; their starts, and their ends after the end byte."""
    starts, ends, first = spans(raw, off, NOT_SPACE)
    n = len(off) - 1
    words = np.diff(first)
    length = np.zeros(n, np.int64)
    row = rows_of(first)
    width = ends - starts
    length = np.bincount(row, width, n).astype(np.int64) + np.maximum(0, words - 1)
    begin = depth + np.concatenate([[0], np.cumsum(length + depth)])[:-1]
    out = np.full(int(begin[-1] + length[-1] + depth) if n else depth, END, np.uint8)
    if len(starts):
        # a word goes to the text's start, behind the words before it and a space each
        before = np.cumsum(width + 1) - (width + 1)
        place = before - before[np.minimum(first[:-1], len(before) - 1)][row] + begin[row]
        shift = np.repeat(place - starts, width)
        inside = np.repeat(starts - np.concatenate([[0], np.cumsum(width)[:-1]]), width) + np.arange(width.sum())
        gaps = place + width
        last = np.zeros(len(starts), bool)
        last[first[1:][words > 0] - 1] = True
        out[gaps[~last]] = 32
        out[inside + shift] = LOWER[raw[inside]]
    return out, begin, begin + length + 1


def grams(text: np.ndarray, depth: int) -> np.ndarray:
    """At each place the byte with the `depth` before it, the latest lowest, as one number."""
    x = text.astype(np.uint64)
    key = x[depth:].copy()
    for k in range(1, depth + 1):
        key |= x[depth - k : len(x) - k] << np.uint64(8 * k)
    return key


def _places(begin, end, size, depth):
    """Which of grams()'s places are a byte of a text or its end."""
    step = np.zeros(size + 1, np.int64)
    np.add.at(step, begin, 1)
    np.add.at(step, end, -1)
    return np.cumsum(step[:-1])[depth:] > 0


def lgamma(x: np.ndarray) -> np.ndarray:
    """log Gamma for x >= 0.5, to about 1e-11."""
    y = x + 7
    rise = x * (x + 1) * (x + 2) * (x + 3) * (x + 4) * (x + 5) * (x + 6)
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7) - np.log(rise)


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    return lgamma(zeros + 0.5) + lgamma(ones + 0.5) - 1.1447298858494002 - lgamma(zeros + ones + 1.0)


def _sum_by(key: np.ndarray, *columns: np.ndarray):
    order = np.argsort(key, kind="stable")
    key = key[order]
    at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return key[at], *(np.add.reduceat(c[order], at) if len(key) else c for c in columns)


def level(keys: np.ndarray, counts: np.ndarray, depth: int):
    """The nodes of one depth from its (context, byte) counts: key (context << 8 | place in the byte's tree), zeros, ones."""
    context, sym = keys >> np.uint64(8), keys & np.uint64(255)
    nodes, zeros, ones = [], [], []
    for j in range(8):
        bit = (sym >> np.uint64(7 - j)) & np.uint64(1)
        nodes.append(context << np.uint64(8) | np.uint64(1 << j) | sym >> np.uint64(8 - j))
        ones.append(counts * bit.astype(float))
        zeros.append(counts - ones[-1])
    return _sum_by(np.concatenate(nodes), np.concatenate(zeros), np.concatenate(ones))


def weigh(keys: np.ndarray, counts: np.ndarray, depth: int, top: int):
    """(depth, key, zeros, ones, log weighted probability, own share) of all nodes of depths `depth` to `top`, deepest first."""
    below = None
    for d in range(depth, top - 1, -1):
        keys, counts = _sum_by(keys & np.uint64((1 << 8 * (d + 1)) - 1), counts)
        node, zeros, ones = level(keys, counts, d)
        own = log_kt(zeros, ones)
        if below is None:
            weighted, share = own, np.ones(len(own))
        else:
            up, total = _sum_by(below[0] & np.uint64((1 << 8 * (d + 1)) - 1), below[1])
            weighted, share = mixed(own, total)
        below = node, weighted
        yield d, node, zeros, ones, weighted, share


def mixed(own: np.ndarray, children: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.logaddexp(own, children) - np.log(2), 1 / (1 + np.exp(np.clip(children - own, -700, 700)))


def _count(depth: int):
    """Of a task's texts (text, held_out), flushed as they grow: how often each gram (kind 0) occurs in learning documents (n) and in all (m), and each word (kind 1) in the former."""
    schema = pa.schema([("kind", pa.int32()), ("key", pa.int64()), ("n", pa.int64()), ("m", pa.int64())])

    def told(kind, key, n, m):
        for at in range(0, len(key), 200_000):
            cut = slice(at, at + 200_000)
            yield pa.record_batch([pa.array(np.full(len(key[cut]), kind, np.int32)), pa.array(key[cut].view(np.int64)), pa.array(n[cut]), pa.array(m[cut])], schema=schema)

    def run(batches):
        held = {0: [], 1: []}
        size = {0: 0, 1: 0}
        for b in slices(batches, "text", SLICE):
            raw, off = buffer(b.column(0))
            learn = ~b.column(1).to_numpy(zero_copy_only=False).astype(bool)
            text, begin, end = normal_bytes(raw, off, depth)
            marked, many = np.unique(np.concatenate([(grams(text, depth)[_places(begin[own], end[own], len(text), depth)] << np.uint64(1)) | np.uint64(flag) for flag, own in ((0, ~learn), (1, learn))]), return_counts=True)
            got = {0: (marked >> np.uint64(1), many * (marked & np.uint64(1)).astype(np.int64), many)}
            lowered = LOWER[raw]
            starts, ends, first = spans(lowered, off, NOT_SPACE)
            words, many = np.unique(np.concatenate([span_hashes(lowered, starts, ends)[learn[rows_of(first)]], np.full(learn.sum(), END_TOKEN)]), return_counts=True)
            got[1] = words, many, many
            for kind, columns in got.items():
                held[kind].append(columns)
                size[kind] += len(columns[0])
                if size[kind] > 1_500_000:
                    held[kind] = [_sum_by(*(np.concatenate(c) for c in zip(*held[kind])))]
                    size[kind] = len(held[kind][0][0])
                    if size[kind] > 1_000_000:
                        yield from told(kind, *held[kind][0])
                        held[kind], size[kind] = [], 0
        for kind, parts in held.items():
            if parts:
                yield from told(kind, *_sum_by(*(np.concatenate(c) for c in zip(*parts))))

    return run


class Level:
    """The nodes of one depth: sorted keys, the estimate of a one, the own share."""

    def __init__(self, node: np.ndarray, zeros: np.ndarray, ones: np.ndarray, share: np.ndarray):
        self.node, self.one, self.share = node, (ones + 0.5) / (zeros + ones + 1), share


def log2_of(key: np.ndarray, levels: list[Level]) -> np.ndarray:
    """log2 of the probability of each gram's byte after its context, given all levels from the root on."""
    context, sym = key >> np.uint64(8), key & np.uint64(255)
    total = np.zeros(len(key))
    for j in range(8):
        place = np.uint64(1 << j) | sym >> np.uint64(8 - j)
        bit = (sym >> np.uint64(7 - j) & np.uint64(1)).astype(bool)
        p, weight, last = np.zeros(len(key)), np.ones(len(key)), np.full(len(key), 0.5)
        open_ = np.arange(len(key))
        for d, x in enumerate(levels):
            if not len(open_) or not len(x.node):
                break
            want = (context[open_] & np.uint64((1 << 8 * d) - 1)) << np.uint64(8) | place[open_]
            at = np.minimum(np.searchsorted(x.node, want), len(x.node) - 1)
            there = x.node[at] == want
            open_, at = open_[there], at[there]
            last[open_] = np.where(bit[open_], x.one[at], 1 - x.one[at])
            p[open_] += weight[open_] * x.share[at] * last[open_]
            weight[open_] *= 1 - x.share[at]
        total += np.log2(np.maximum(p + weight * last, 1e-12))
    return total


def _dealt(batches):
    """The grams of a partition that holds whole groups of their latest bytes, with n and m."""
    parts = [tuple(c.to_numpy() for c in b.columns) for b in batches if b.num_rows]
    if parts:
        key, n, m = (np.concatenate(c) for c in zip(*parts))
        return key.view(np.uint64), n.astype(float), m
    return None


def _roots(depth: int, cut: int):
    """What the subtrees give the nodes above them: (key, zeros, ones, weighted)."""

    def run(batches):
        got = _dealt(batches)
        if got is None:
            return
        key, n, _ = got
        for d, node, zeros, ones, weighted, _ in weigh(key[n > 0], n[n > 0], depth, cut):
            if d == cut:
                out = _sum_by(node & np.uint64((1 << 8 * cut) - 1), zeros, ones, weighted) if cut else (node, zeros, ones, weighted)
                for at in range(0, len(out[0]), 100_000):
                    yield pa.record_batch([pa.array(out[0][at : at + 100_000].view(np.int64)), *(pa.array(c[at : at + 100_000]) for c in out[1:])], names=["key", "zeros", "ones", "weighted"])

    return run


def _scored(depth: int, cut: int, sent):
    """(key, m, v): v is log2 of the probability of every gram of the partition."""

    def run(batches):
        got = _dealt(batches)
        if got is None:
            return
        key, n, m = got
        levels = [Level(node, zeros, ones, share) for _, node, zeros, ones, _, share in weigh(key[n > 0], n[n > 0], depth, cut)]
        levels = sent.value + levels[::-1]
        for at in range(0, len(key), 100_000):
            some = slice(at, at + 100_000)
            yield pa.record_batch([pa.array(key[some].view(np.int64)), pa.array(m[some]), pa.array(log2_of(key[some], levels).astype(np.float32))], names=["key", "m", "v"])

    return run


def gram_scores(counts: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(key, m, v) for each gram of (key, n, m): v is log2 of its byte's probability in the tree weighted over all n; grams with n = 0 are scored and not learnt from."""
    cut = min(CUT, depth)
    group = F.shiftright("key", 8).bitwiseAND(F.lit((1 << 8 * cut) - 1))
    dealt = counts.select("key", "n", "m").repartition(group)
    # 2^(8 (cut - 1)) contexts of 255 places at most
    got = dealt.mapInArrow(_roots(depth, cut), "key long, zeros double, ones double, weighted double").groupBy("key").agg(F.sum("zeros"), F.sum("ones"), F.sum("weighted")).toArrow()
    node = got.column(0).to_numpy().astype(np.int64).view(np.uint64)
    zeros, ones, below = (got.column(i).to_numpy().astype(float) for i in (1, 2, 3))
    node, zeros, ones, below = _sum_by(node, zeros, ones, below)
    top: list[Level] = []
    for d in range(cut - 1, -1, -1):
        weighted, share = mixed(log_kt(zeros, ones), below)
        top.append(Level(node, zeros, ones, share))
        node, zeros, ones, below = _sum_by(node & np.uint64((1 << 8 * d) - 1), zeros, ones, weighted) if d else (node, zeros, ones, weighted)
    return dealt.mapInArrow(_scored(depth, cut, counts.sparkSession.sparkContext.broadcast(top[::-1])), "key long, m long, v float")


class Table:
    """An open hash table from 64-bit keys to numbers, for arrays of keys at once."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(np.ceil(np.log2(2 * len(keys) + 1))))
        mask = (1 << self.bits) - 1
        self.keys, self.values, self.used = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, values.dtype), np.zeros(1 << self.bits, bool)
        slot, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            free = left[~self.used[slot[left]]]
            self.keys[slot[free]] = keys[free]  # of several the last stays
            self.used[slot[free]] = True
            won = self.keys[slot[left]] == keys[left]
            self.values[slot[left[won]]] = values[left[won]]
            left = left[~won]
            slot[left] = (slot[left] + 1) & mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (mix(keys) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values, and which keys are there."""
        slot = self._slot(keys)
        out, there = self.values[slot], (self.keys[slot] == keys) & self.used[slot]
        left = np.flatnonzero(~there & self.used[slot])
        while len(left):
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)
            hit = (self.keys[slot[left]] == keys[left]) & self.used[slot[left]]
            out[left[hit]] = self.values[slot[left[hit]]]
            there[left[hit]] = True
            left = left[~hit & self.used[slot[left]]]
        return out, there


def _least(rows: DataFrame, count: str, most: int) -> int:
    """The least count at which no more than `most` rows reach it; by a histogram, in steps of a sixteenth beyond small counts."""
    step = F.when(F.col(count) < 256, F.col(count)).otherwise(F.floor(F.log2(count) * 16 + 128)).cast("long")
    hist = sorted(((r[0], r[1], r[2]) for r in rows.groupBy(step.alias("step")).agg(F.count(F.lit(1)), F.min(count)).collect()), reverse=True)
    least = 1 << 62
    for _, many, low in hist:
        most -= many
        if most < 0:
            break
        least = low
    return least


def _table(rows: DataFrame) -> Table:
    got = rows.toArrow()
    return Table(got.column(0).to_numpy().astype(np.int64).view(np.uint64), got.column(1).to_numpy())


def _hard(row: np.ndarray, keys: np.ndarray, n: int):
    """Per row the distinct keys and how often each occurs, as two list columns."""
    order = np.lexsort((keys, row))
    row, keys = row[order], keys[order]
    new = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (keys[1:] != keys[:-1])])) if len(row) else np.zeros(0, np.int64)
    many = np.diff(np.concatenate([new, [len(row)]]))
    cut = pa.array(np.searchsorted(row[new], np.arange(n + 1)).astype(np.int32))
    return pa.ListArray.from_arrays(cut, pa.array(keys[new].view(np.int64))), pa.ListArray.from_arrays(cut, pa.array(many.astype(np.int64)))


def lm_scores(docs: DataFrame, depth: int = DEPTH, folds: int = 7, held: int = 2, table: int = TABLE, frequent: int = FREQUENT) -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte.

    score is the tree's log10 probability of the text's normal form and end, base_score
    that of a unigram model with add-one smoothing over words. A null or empty text is
    the end alone; a null doc_id counts as the empty string for the fold; repeated rows
    learn and score as often as they occur; without learning documents every byte costs
    eight bits; an empty table gives no rows; other columns are ignored. `table` and
    `frequent` bound the broadcasts and change no result.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select(utf8().alias("text"), F.col("doc_id").cast("long").alias("doc_id"), (fold("doc_id", folds) == held).alias("held_out"))
    partial = rows.select("text", "held_out").mapInArrow(_count(depth), "kind int, key long, n long, m long")
    counts = stored(partial.groupBy("kind", "key").agg(F.sum("n").alias("n"), F.sum("m").alias("m")), "lm-counts")
    scores = stored(gram_scores(counts.where("kind = 0"), depth), "lm-grams")
    words = counts.where("kind = 1").select("key", "n")
    total, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    often, word_least = _least(scores, "m", table), _least(words, "n", frequent)
    top = scores.where(F.col("m") >= often).select("key", "v")  # `table` rows at most
    sent = spark.sparkContext.broadcast((_table(top), _table(words.where(F.col("n") >= word_least).select("key", F.log10(F.col("n") + 1.0)))))

    def run(batches):
        by_gram, by_word = sent.value
        part, at = TaskContext.get().partitionId(), 0
        for b in slices(batches, "text", SLICE):
            raw, off = buffer(b.column(0))
            n = b.num_rows
            text, begin, end = normal_bytes(raw, off, depth)
            inside = _places(begin, end, len(text), depth)
            key = grams(text, depth)
            value, there = by_gram.find(key)
            got = np.concatenate([[0.0], np.cumsum(np.where(there & inside, value.astype(float), 0.0))])
            bits = got[end - depth] - got[begin - depth]
            missed = np.flatnonzero(inside & ~there)
            gram_lists = _hard(np.searchsorted(begin - depth, missed, "right") - 1, key[missed], n)
            lowered = LOWER[raw]
            starts, ends, first = spans(lowered, off, NOT_SPACE)
            words = np.concatenate([span_hashes(lowered, starts, ends), np.full(n, END_TOKEN)])
            row = np.concatenate([rows_of(first), np.arange(n)])
            value, known = by_word.find(words)
            sums = np.bincount(row[known], value[known], n).astype(float)
            yield pa.record_batch(
                [pa.array(np.arange(at, at + n) + (part << 40)), b.column(1), b.column(2), pa.array(np.diff(first) + 1), pa.array(np.bincount(row[known], minlength=n)), pa.array(sums), pa.array(bits), pa.array((end - begin).astype(np.int64)), *gram_lists, *_hard(row[~known], words[~known], n)],
                names=["uid", "doc_id", "held_out", "n_tokens", "n_often", "s_often", "bits", "n_bytes", "keys0", "tfs0", "keys1", "tfs1"],
            )
            at += n

    lists = ", ".join(f"keys{k} array<long>, tfs{k} array<long>" for k in (0, 1))
    found = stored(rows.mapInArrow(run, f"uid long, doc_id long, held_out boolean, n_tokens long, n_often long, s_often double, bits double, n_bytes long, {lists}"), "lm-scores")
    each = [found.where(F.size(f"keys{k}") > 0).select("uid", F.lit(k).alias("kind"), F.explode(F.arrays_zip(f"keys{k}", f"tfs{k}")).alias("w")).select("uid", "kind", F.col(f"w.keys{k}").alias("key"), F.col(f"w.tfs{k}").alias("tf")) for k in (0, 1)]
    rare = scores.where(F.col("m") < often).select(F.lit(0).alias("kind"), "key", F.col("v").cast("double").alias("v"))
    rare = rare.unionByName(words.where(F.col("n") < word_least).select(F.lit(1).alias("kind"), "key", F.log10(F.col("n") + 1.0).alias("v")))
    more = each[0].unionByName(each[1]).join(rare, ["kind", "key"]).groupBy("uid").agg(
        F.sum(F.when(F.col("kind") == 1, F.col("tf"))).alias("n_rare"), F.sum(F.when(F.col("kind") == 1, F.col("tf") * F.col("v"))).alias("s_rare"), F.sum(F.when(F.col("kind") == 0, F.col("tf") * F.col("v"))).alias("b_rare")
    )
    size = float(np.log10(total + distinct + 1))
    known = F.col("n_often") + F.coalesce("n_rare", F.lit(0))
    base = F.col("s_often") + F.coalesce("s_rare", F.lit(0.0)) - F.col("n_tokens") * F.lit(size)
    bits = F.col("bits") + F.coalesce("b_rare", F.lit(0.0))
    told = found.drop("keys0", "tfs0", "keys1", "tfs1").join(more, "uid", "left")
    return told.select("doc_id", "held_out", "n_tokens", known.alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), base.alias("base_score"), (bits * F.lit(float(np.log10(2)))).alias("score"), (-bits / F.col("n_bytes")).alias("bits_per_byte"))
