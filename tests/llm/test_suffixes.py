import hashlib
from collections import Counter

import numpy as np
import pytest

from lodestrata.llm.suffixes import Shard, anchor_runs, neighbour_prefixes, string_report, suffix_array


def brute(rows, w):
    data = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(d[k : k + w] for _, d in data for k in range(len(d) - w + 1))
    out = []
    for i, d in data:
        gone = np.zeros(len(d), bool)
        for k in range(len(d) - w + 1):
            if seen[d[k : k + w]] > 1:
                gone[k : k + w] = True
        kept = bytes(c for c, g in zip(d, gone) if not g)
        spans = int((np.diff(np.concatenate([[0], gone.view(np.int8)])) == 1).sum())
        out.append((i, len(d), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def test_suffix_array_and_prefixes():
    rng = np.random.default_rng(0)
    text = rng.integers(0, 3, 3000).astype(np.uint8)
    text[1000:1600] = text[:600]
    order = suffix_array(text, 64)
    keys = [text[i : i + 64].tobytes() for i in range(len(text))]
    assert sorted(range(len(text))) == sorted(order.tolist())
    assert [keys[i] for i in order] == sorted(keys)
    valid = order[order < len(text) - 64]
    got = neighbour_prefixes(text, valid, np.array([0, 1200]), np.array([1200, len(text) - 64 - 1200]), 64)
    for k in range(1, len(valid)):
        a, b = keys[valid[k - 1]], keys[valid[k]]
        assert got[k] == next((i for i in range(64) if a[i] != b[i]), 64)


def test_shards_merge_by_binary_search():
    rng = np.random.default_rng(1)
    word = lambda n: rng.integers(97, 123, n).astype(np.uint8).tobytes()
    common = word(90)
    contexts = [word(30) + common[: 40 + i] + word(20 + i) for i in range(12)]
    one = Shard(contexts, 50)
    parts = [Shard(contexts[:5], 50), Shard(contexts[5:9], 50), Shard(contexts[9:], 50)]
    for i, x in enumerate(parts):
        for y in parts[:i]:
            x.merge(y)
    assert one.repeated.any() and np.array_equal(one.repeated, np.concatenate([p.repeated for p in parts]))


@pytest.mark.parametrize("settings", [{}, {"shard": 300}, {"hot": 1}])
def test_report_equals_brute_force(spark, settings):
    rng = np.random.default_rng(4)
    text = lambda n: "".join(rng.choice(list("abcdefgé "), n))
    passage, other = text(150), text(80)
    rows = [(i, text(60) + passage[: 60 + 9 * i] + text(40) + other[i:]) for i in range(10)]
    rows += [(20, None), (21, ""), (22, "ab" * 200), (23, "z" * 100), (24, rows[0][1]), (25, text(30) + passage + passage), (26, text(39)), (27, "z" * 40), (20, None), (0, rows[0][1])]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, th int").repartition(3)
    assert sorted(map(tuple, string_report(df, 40, gram=8, **settings).collect())) == brute(rows, 40)


def test_hot_passages_are_dealt_by_longer_cores(spark):
    rng = np.random.default_rng(5)
    text = lambda n: "".join(rng.choice(list("abcdefgh"), n))
    passage = text(36)
    tails = [text(12) for _ in range(4)]
    rows = [(i, text(70) + tails[i % 4][:3] + passage + tails[i % 3] + text(50)) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    expected = brute(rows, 40)
    assert sum(r[2] for r in expected)
    for hot in (1, 6, 1000):
        assert sorted(map(tuple, string_report(df, 40, gram=8, hot=hot).collect())) == expected


def test_stretches_with_a_period_are_told_once(spark):
    raw = np.frombuffer(b"ab" * 5000 + b"c" * 9000, np.uint8)
    found = list(anchor_runs(raw, np.array([0, len(raw)]), 400, 32))
    assert sum(len(f[0]) for f in found) < 1200 and sum(int((f[2] * f[3]).sum()) for f in found) == len(raw) - 399
    rows = [(1, "a" * 8_000_000), (2, "x" * 300 + "ab" * 3000), (3, "ba" * 200), (4, "a" * 400), (5, "b" * 400), (6, "xyz" * 2000 + "x" * 500)]
    got = {r.doc_id: r for r in string_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    small = {r[0]: r for r in brute([(1, "a" * 2000), *rows[1:]], 400)}
    assert got[1].n_removed == 8_000_000 and got[1].n_spans == 1
    assert all(tuple(got[i]) == small[i] for i in range(2, 7))


def test_copies_of_a_text_with_many_neighbours(spark):
    rng = np.random.default_rng(6)
    text = lambda n: "".join(rng.choice(list("abcdefgh "), n))
    common, passage = text(900), text(450)
    rows = [(i, common) for i in range(10_000)] + [(20_000 + i, text(50) + passage[i:] + text(60)) for i in range(20)] + [(30_000, common[:700] + text(300))]
    got = {r.doc_id: tuple(r) for r in string_report(spark.createDataFrame(rows, "doc_id long, text string").repartition(8)).collect()}
    assert len(got) == len(rows) and all(got[i][2] == 900 for i in range(10_000))
    few = brute([rows[0], rows[1], *rows[10_000:]], 400)
    assert all(got[r[0]] == r for r in few)


def test_report_of_documents(docs, awkward, no_docs):
    for df in (docs, awkward):
        rows = [(r.doc_id, r.text) for r in df.collect()]
        assert sorted(map(tuple, string_report(df).collect())) == brute(rows, 400)
    assert string_report(no_docs).count() == 0
