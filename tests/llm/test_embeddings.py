import numpy as np
import pytest

from lodestrata.llm import embeddings
from lodestrata.llm.embeddings import embedding_links, tables_for


def brute(rows, threshold=0.9):
    good = []
    for i, x in rows:
        a = np.array([np.nan if c is None else c for c in x], float) if x else None
        good.append((i, a if a is not None and len(a) and np.isfinite(a).all() and a.any() else None))
    label, n = {i: i for i, _ in good}, {}
    links = [(p, q) for p in range(len(good)) for q in range(p) if good[p][1] is not None and good[q][1] is not None and len(good[p][1]) == len(good[q][1]) and good[p][1] @ good[q][1] / np.linalg.norm(good[p][1]) / np.linalg.norm(good[q][1]) >= threshold]
    for p, q in links:
        for k in (p, q):
            n[k] = n.get(k, 0) + 1
    changed = True
    while changed:
        changed = False
        for p, q in links:
            a, b = label[good[p][0]], label[good[q][0]]
            if a != b:
                label[good[p][0]] = label[good[q][0]] = min(a, b)
                changed = True
    return sorted((i, n.get(k, 0), label[i], label[i] == i) for k, (i, _) in enumerate(good))


def test_awkward_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(9, [1.0, 0.0]), (3, [2.0, 0.1]), (4, [0.0, 0.0]), (5, None), (6, []), (7, [1.0, None]), (8, [nan, 1.0]), (10, [inf, 1.0]), (11, [1.0, 0.0]), (12, [-1.0, 0.0]), (13, [1.0, 0.0, 0.0]), (14, [-0.0, 3.0]), (15, [0.0, 3.0]), (16, [1e300, 1e300]), (17, [1.0, 1.0])]
    df = spark.createDataFrame([(i, x, 1, "q") for i, x in rows], "vec_id long, embedding array<double>, n_links int, h string")
    assert sorted(map(tuple, embedding_links(df).collect())) == brute([(i, [1.0, 1.0] if i == 16 else x) for i, x in rows])
    assert embedding_links(df.limit(0)).count() == 0
    twice = embedding_links(df.where("vec_id = 9").union(df.where("vec_id = 9"))).collect()
    assert [tuple(r) for r in twice] == [(9, 1, 9, True)] * 2


@pytest.mark.parametrize("block", [1024, 16])
def test_links_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(embeddings, "BLOCK", block)
    rng = np.random.default_rng(5)
    base = rng.standard_normal((60, 16))
    near = np.concatenate([base, base[rng.integers(0, 60, 150)] + 0.15 * rng.standard_normal((150, 16)), base[:1] + 0.1 * rng.standard_normal((120, 16)), np.repeat(base[1:2], 40, axis=0)])
    rows = [(int(i), x.tolist()) for i, x in enumerate(near)]
    got = {r[0]: tuple(r) for r in embedding_links(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    want = {r[0]: r for r in brute(rows)}
    found, there = sum(r[1] for r in got.values()), sum(r[1] for r in want.values())
    assert all(got[i][1] <= want[i][1] for i in want) and found >= 0.99 * there


def test_tables_reach_the_recall():
    for n in (100, 10_000, 10**8):
        bits, tables = tables_for(n)
        assert 1 - (1 - (1 - np.arccos(0.9) / np.pi) ** bits) ** tables >= 0.995
