import random

import numpy as np

import corpus_pipeline
from lodestrata.llm.simhash_similar import LEAST, alike, code_components, set_codes, set_links, shingle_set, simhash_dedup, table_keys, tables_for


def jaccard(a, b):
    x, y = set(shingle_set(a.encode()).tolist()), set(shingle_set(b.encode()).tolist())
    return len(x & y) / len(x | y) if x | y else 1.0


def test_the_stage_removes_edited_copies_and_keeps_others(spark):
    rng = random.Random(5)
    rows, gone = [], set()
    for g in range(60):
        words = [f"w{rng.randrange(10**6)}" for _ in range(300)]
        rows.append((10 * g, " ".join(words)))
        for k, edits in enumerate((1, 3, 5, 40)):
            copy = list(words)
            for at in rng.sample(range(300), edits):
                copy[at] = "x"
            rows.append((10 * g + k + 1, " ".join(copy)))
            if jaccard(rows[-1][1], rows[-1 - k - 1][1]) >= 0.8:
                gone.add(10 * g + k + 1)
    assert len(gone) == 180
    rows += [(None, rows[0][1]), (None, "alone"), (5000, ""), (5001, None), (5002, "A b"), (5003, "a B")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [r.doc_id for r in dict(corpus_pipeline.STAGES)["near_duplicates"](spark, docs, "").collect()]
    assert sorted(x for x in got if x is not None) == sorted({r[0] for r in rows[:300]} - gone | {5000, 5002}) and got.count(None) == 2


def test_stage_equals_brute_force(docs):
    rows = [(r.doc_id, r.text or "") for r in docs.collect() if r.doc_id is not None]
    label = {i: i for i, _ in rows}
    links = [(a, b) for n, (a, x) in enumerate(rows) for b, y in rows[n + 1 :] if jaccard(x, y) >= 0.8]
    for _ in rows:
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    assert sorted(r.doc_id for r in simhash_dedup(docs).collect()) == sorted(set(label.values()))


def test_links_within_a_key_are_all_found():
    rng = np.random.default_rng(1)
    base = [np.unique(rng.integers(0, 10**9, 100)).astype(np.uint64) for _ in range(4)]
    sets = [np.unique(np.concatenate([b[k:], rng.integers(0, 10**9, k).astype(np.uint64)])) for b in base for k in (0, 5, 40)]
    alone = np.arange(12)
    assert set_links(sets, alone).tolist() == [0, 0, 2, 3, 3, 5, 6, 6, 8, 9, 9, 11]
    joined = np.array([0, 1, 2, 3, 4, 5, 2, 7, 8, 9, 10, 11])
    assert set_links(sets, joined).tolist() == [0, 0, 2, 3, 3, 5, 2, 2, 8, 9, 9, 11]


def test_components_of_codes():
    rng = np.random.default_rng(2)
    codes = rng.integers(0, 1 << 63, 30, dtype=np.uint64)
    codes = np.concatenate([codes, codes[:10] ^ np.uint64(0b111), codes[:10] ^ np.uint64(0b111111), codes[20:21]])
    want = np.arange(len(codes))
    for _ in range(8):
        for i in range(len(codes)):
            near = np.bitwise_count(codes ^ codes[i]) <= 3
            want[near] = want[i] = want[near].min()
    assert code_components(codes, 3).tolist() == want.tolist()


def test_pairs_at_the_threshold_meet_as_often_as_planned():
    rng = np.random.default_rng(3)
    met = 0
    bits, tables = tables_for(200_000)
    for _ in range(300):
        n = int(rng.integers(40, 400))
        base = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        edits = int(n * (1 - LEAST) / (1 + LEAST))
        other = np.concatenate([base[edits:], rng.integers(0, 1 << 63, edits, dtype=np.uint64)])
        assert alike(np.unique(base), np.unique(other), LEAST)
        codes = set_codes([np.unique(base), np.unique(other)])
        keys = table_keys(codes[:, 1:], bits, tables)
        met += (keys[0] == keys[1]).any() and int(codes[0, 0] ^ codes[1, 0]).bit_count() <= 19
    assert met / 300 > 0.97


def test_rows_of_one_id_and_other_texts_stay(spark, awkward, no_docs):
    rows = [(1, "a b c d e f g"), (1, "h i j k l m n"), (1, "a b c d e f g"), (2, "A b c d e f g"), (None, "a b c d e f g")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(simhash_dedup(docs).collect(), key=str) == sorted(docs.limit(2).collect() + [docs.collect()[4]], key=str)
    kept = simhash_dedup(awkward)
    assert kept.dtypes == awkward.dtypes
    got = sorted(r.doc_id for r in kept.collect())
    assert 7 in got and 8 not in got and got.count(6) == 0 and got.count(5) == 1 and 1 in got and 2 not in got
    assert simhash_dedup(no_docs).count() == 0
