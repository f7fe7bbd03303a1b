from collections import defaultdict

import pytest

from lodestrata.llm.shards import shard_documents


@pytest.mark.parametrize("limit", [20_000, 60_000, 1 << 30])
def test_shards_fit_and_only_full_buckets_split(docs, limit):
    rows = shard_documents(docs, limit).collect()
    sizes = {r.doc_id: len(r.text.encode()) for r in docs.collect()}
    assert sorted(r.doc_id for r in rows) == sorted(sizes)
    shards = defaultdict(list)
    for r in rows:
        assert r.n_bytes == sizes[r.doc_id] and r.oversized == (r.n_bytes > limit)
        shards[r.shard_id].append(r)
    plain = {k: sum(r.n_bytes for r in v) for k, v in shards.items() if not v[0].oversized}
    for k, v in shards.items():
        assert {r.shard_bytes for r in v} == {sum(r.n_bytes for r in v)} and (v[0].shard_bytes <= limit or len(v) == 1)
    for k in plain:  # the bucket that was split held more than the limit
        if k:
            assert sum(b for x, b in plain.items() if x.startswith(k[:-1])) > limit
            assert not any(x != k and x.startswith(k) for x in plain)


def test_repeated_keys_are_paged_and_awkward_rows_kept(spark, awkward, no_docs):
    rows = [(1, "x" * 100)] * 500 + [(i, "y" * 10) for i in range(2, 200)] + [(300, "z" * 5000), (301, None), (None, "n"), (1, "w" * 700)]
    got = shard_documents(spark.createDataFrame(rows, "doc_id long, text string"), 1000).collect()
    assert len(got) == len(rows)
    total = defaultdict(int)
    for r in got:
        total[r.shard_id] += r.n_bytes
    assert all(total[r.shard_id] == r.shard_bytes and (r.shard_bytes <= 1000 or r.doc_id == 300) for r in got)
    assert shard_documents(awkward).count() == awkward.count()
    assert shard_documents(no_docs).count() == 0
