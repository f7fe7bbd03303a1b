import re

import corpus_pipeline
import xxhash

from lodestrata.llm.pii import base_spans
from lodestrata.llm.quality import fit_quality, quality_scores
from lodestrata.llm.simhash import fingerprints
from lodestrata.llm.simhash_similar import shingle_set
from tests.llm.test_decontaminate import brute as brute_hits
from tests.llm.test_packing import check

SF = "/root/testdata/sf0.001"


def test_stages_one_after_the_other(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels, bench = spark.read.parquet(f"{SF}/labels.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "near_duplicates", "benchmark_decontamination", "personal_data", "packing"]
    step = dict(corpus_pipeline.STAGES)

    first = step["quality"](spark, docs, SF).cache()
    keep = {r.doc_id for r in quality_scores(docs, fit_quality(docs, labels)).where("keep").collect()}
    assert first.columns == docs.columns and {r.doc_id for r in first.collect()} == keep

    second = step["near_duplicates"](spark, first, SF).cache()
    rows = sorted((r.doc_id, set(shingle_set(r.text.encode()).tolist())) for r in first.collect())
    label = {i: i for i, _ in rows}
    links = [(i, j) for n, (i, x) in enumerate(rows) for j, y in rows[n + 1 :] if len(x & y) >= 0.8 * len(x | y)]
    for _ in range(len(rows)):
        before = dict(label)
        for i, j in links:
            label[i] = label[j] = min(label[i], label[j])
        if label == before:
            break
    assert second.columns == docs.columns and {r.doc_id for r in second.collect()} == set(label.values())

    third = step["benchmark_decontamination"](spark, second, SF).cache()
    hits = brute_hits([(r.doc_id, r.text) for r in second.collect()], [(r.item_id, r.text) for r in bench.collect()])
    assert third.dtypes == docs.dtypes and {r.doc_id for r in third.collect()} == {h[0] for h in hits if not h[5]}
    before = {r.doc_id: r.text for r in second.collect()}
    clean = {h[0] for h in hits if not h[2]}
    assert all((r.text == before[r.doc_id]) == (r.doc_id in clean) for r in third.collect())

    fourth = step["personal_data"](spark, third, SF).cache()
    before = {r.doc_id: r.text for r in third.collect()}
    assert fourth.dtypes == docs.dtypes and fourth.count() == third.count()
    for r in fourth.collect():
        assert not base_spans(r.text) and r.n_chars == len(r.text)
        if not re.search("[0-9@]", before[r.doc_id]):
            assert r.text == before[r.doc_id]

    check(step["packing"](spark, fourth, SF), {r.doc_id: r.text for r in fourth.collect()})
    assert corpus_pipeline.run(spark, SF).count() == step["packing"](spark, fourth, SF).count()


def test_stages_over_awkward_and_empty_tables(spark, awkward, no_docs):
    step = dict(corpus_pipeline.STAGES)
    for name in ("near_duplicates", "benchmark_decontamination", "personal_data"):
        kept = step[name](spark, awkward, SF)
        assert kept.dtypes == awkward.dtypes and 0 < kept.count() <= awkward.count()
        assert step[name](spark, no_docs, SF).count() == 0
    assert step["packing"](spark, no_docs, SF).count() == 0
    null = step["personal_data"](spark, awkward.where("doc_id = 1"), SF).collect()
    assert [(r.doc_id, r.text, r.n_chars) for r in null] == [(1, None, None)]


def test_five_word_shingles():
    text = b"a b c d e f"
    hs = [xxhash.xxh64_intdigest(s, 42) for s in (b"a b c d e", b"b c d e f")]
    assert int(fingerprints([text], 5)[0]) == hs[0] & hs[1]
