import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from lodestrata.llm.ctw import Table, lgamma, lm_scores


def normal(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return words, " ".join(words).encode() + b"\n"


def brute(rows, depth):
    train = [normal(t) for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2]
    tokens = Counter(w for words, _ in train for w in [*words, None])
    total, distinct = sum(tokens.values()), len(tokens)
    count = defaultdict(lambda: [0, 0])

    def choices(data, i):
        padded = b"\n" * depth + data
        for j in range(8):
            yield [padded[i + depth - d : i + depth] for d in range(depth + 1)], (data[i] | 256) >> (8 - j), data[i] >> (7 - j) & 1

    for _, data in train:
        for i in range(len(data)):
            for contexts, place, bit in choices(data, i):
                for c in contexts:
                    count[c, place][bit] += 1
    kids = defaultdict(set)
    for c, place in count:
        if c:
            kids[c[1:], place].add((c, place))
    memo = {}

    def weighted(node):
        if node not in memo:
            a, b = count[node]
            own = math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.log(math.pi) - math.lgamma(a + b + 1)
            if len(node[0]) == depth:
                memo[node] = own, 1.0
            else:
                below = sum(weighted(k)[0] for k in kids[node])
                memo[node] = np.logaddexp(own, below) - math.log(2), 1 / (1 + math.exp(min(700, below - own)))
        return memo[node]

    out = []
    for i, t in rows:
        words, data = normal(t)
        bits = 0.0
        for k in range(len(data)):
            for contexts, place, bit in choices(data, k):
                p, left, last = 0.0, 1.0, 0.5
                for c in contexts:
                    if (c, place) not in count:
                        break
                    n = count[c, place]
                    last, share = (n[bit] + 0.5) / (sum(n) + 1), weighted((c, place))[1]
                    p, left = p + left * share * last, left * (1 - share)
                bits += math.log2(p + left * last)
        known = sum(w in tokens for w in [*words, None])
        base = sum(math.log10((tokens[w] + 1) / (total + distinct + 1)) for w in [*words, None])
        out.append((-1 if i is None else i, zlib.crc32(str(i).encode()) % 7 == 2, len(words) + 1, known, total, base, bits * math.log10(2)))
    return sorted(out)


def close(got, want):
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert tuple(g[:5]) == w[:5]
        assert g[5] == pytest.approx(w[5], rel=1e-9) and g[6] == pytest.approx(w[6], rel=1e-4)


@pytest.mark.parametrize("frequent,table", [(1_000_000, 1_000_000), (3, 50)])
def test_scores_equal_brute_force(spark, awkward, no_docs, frequent, table):
    rows = [(r.doc_id, r.text) for r in awkward.where("length(text) < 5000 or text is null").collect()] + [(i, f"alpha beta{i % 3} gamma x{i}") for i in range(20, 60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(tuple(r) for r in lm_scores(df, depth=3, frequent=frequent, table=table).drop("bits_per_byte").collect())
    close(got, brute(rows, 3))
    assert lm_scores(no_docs).count() == 0


def test_without_learning_documents_a_byte_costs_eight_bits(spark):
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    r = lm_scores(spark.createDataFrame([(held, "ab  c")], "doc_id long, text string")).collect()[0]
    assert r.train_tokens == 0 and r.bits_per_byte == pytest.approx(8) and r.score == pytest.approx(-5 * 8 * math.log10(2))


def test_the_size_of_the_broadcast_table_changes_no_score(docs):
    full, small = (lm_scores(docs, **k).toPandas().sort_values("doc_id") for k in ({}, {"table": 2_000, "frequent": 10}))
    assert len(full) == docs.count() and full[full.held_out].bits_per_byte.mean() < 3.5
    for c in ("n_known", "n_tokens"):
        assert (full[c].to_numpy() == small[c].to_numpy()).all()
    assert np.allclose(full.score, small.score, rtol=1e-6) and np.allclose(full.base_score, small.base_score, rtol=1e-6)


def test_table():
    rng = np.random.default_rng(2)
    keys = np.unique(rng.integers(0, 1 << 63, 5000, dtype=np.uint64))
    values = np.arange(len(keys), dtype=np.float32)
    got, there = Table(keys[::2], values[::2]).find(keys)
    assert (there == (np.arange(len(keys)) % 2 == 0)).all() and (got[there] == values[::2]).all()
    assert not Table(keys[:0], values[:0]).find(keys)[1].any()
    assert Table(np.zeros(1, np.uint64), np.ones(1)).find(np.arange(3, dtype=np.uint64))[1].tolist() == [True, False, False]


def test_lgamma():
    x = np.array([0.5, 1.0, 1.5, 3.0, 10.5, 1e3, 1e9])
    assert np.allclose(lgamma(x), [math.lgamma(v) for v in x], rtol=1e-10, atol=1e-10)
