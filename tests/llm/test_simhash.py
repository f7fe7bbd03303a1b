import re

import numpy as np
import xxhash

from lodestrata.llm.shared import connected_components
from lodestrata.llm.simhash import gray_rank, index_links, simhash_components, simhash_groups


def brute_fp(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def brute(rows):
    fps = [brute_fp(t) for _, t in rows]
    label = {i: i for i, _ in rows}
    changed = True
    while changed:
        changed = False
        for (a, _), x in zip(rows, fps):
            for (b, _), y in zip(rows, fps):
                if (x ^ y).bit_count() <= 2 and label[a] != label[b]:
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    return sorted((i, f"{f:016x}", label[i]) for (i, _), f in zip(rows, fps))


def test_groups_of_awkward_rows(awkward, no_docs):
    rows = [(r.doc_id, r.text) for r in awkward.collect()]
    assert sorted(map(tuple, simhash_groups(awkward).collect())) == brute(rows)
    assert simhash_groups(no_docs).count() == 0


def test_groups_equal_brute_force(docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(map(tuple, simhash_groups(docs).collect())) == brute(rows)


def test_index_finds_every_link_and_no_other():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    near = [b ^ (np.uint64(1) << rng.integers(0, 64, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, dtype=np.uint64)) for b in base for _ in range(12)]
    codes = np.unique(np.concatenate([base, near]))
    group = rng.integers(0, 3, len(codes))
    order = np.lexsort((gray_rank(codes), group))
    codes, group = codes[order], group[order]
    found = {(int(i), int(j)) for a, b in index_links(group, codes) for i, j in zip(a, b)}
    assert found == {(i, j) for i in range(len(codes)) for j in range(i + 1, len(codes)) if group[i] == group[j] and int(codes[i] ^ codes[j]).bit_count() <= 2}


def test_gray_neighbours_differ_in_one_bit():
    codes = np.arange(4096, dtype=np.uint64)
    codes = codes[np.argsort(gray_rank(codes))]
    assert (np.bitwise_count(codes[1:] ^ codes[:-1]) == 1).all()


def test_components_of_a_path_a_star_and_a_ring(spark):
    links = [(i, i + 1) for i in range(10, 60)] + [(100, i) for i in range(101, 150)] + [(200, 201), (201, 202), (202, 200), (300, 300)]
    found = dict(connected_components(spark.createDataFrame(links, "a long, b long")).collect())
    want = {i: 10 for i in range(10, 61)} | {i: 100 for i in range(100, 150)} | dict.fromkeys((200, 201, 202), 200)
    assert found == want


def test_rows_without_an_id(spark):
    rows = [(None, "a b c d"), (3, "a b c d"), (None, "alone it is"), (4, "other words here now")]
    got = simhash_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), str(r.component_id)) for r in got) == [("3", "3"), ("4", "4"), ("None", "3"), ("None", "None")]


def test_components_hold_every_link(spark):
    rng = np.random.default_rng(8)
    base = rng.integers(-(1 << 63), 1 << 63, 150)
    codes = sorted({int(b) ^ int(x) for b in base for x in [0, *(1 << rng.integers(0, 63, 3)), *((1 << rng.integers(0, 63, 3)) | (1 << rng.integers(0, 63, 3)))]})
    label = {i: i for i in range(len(codes))}
    arr = np.array(codes, np.int64).view(np.uint64)
    for _ in range(20):
        for i in range(len(arr)):
            near = np.flatnonzero(np.bitwise_count(arr ^ arr[i]) <= 2)
            low = min(label[j] for j in near)
            for j in near:
                label[int(j)] = low
    fps = spark.createDataFrame(list(enumerate(codes)), "doc_id long, fp long")
    got = {r.fp: r.component_id for r in simhash_components(fps).collect()}
    assert got == {c: label[i] for i, c in enumerate(codes)}
