import zlib

import numpy as np
import pytest

from lodestrata.llm.quality import fit_quality, quality_filter, quality_scores
from lodestrata.llm.toxicity import fit_toxicity, ftrl, toxicity_scores

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def test_toxicity_on_held_out_labels(spark, corpus):
    docs, labels = corpus
    got = toxicity_scores(docs, fit_toxicity(docs, labels)).join(labels, "doc_id").toPandas()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 3 == 1 for i in got.doc_id]).all()
    held = got[got.held_out]
    assert ((held.score >= 0.7) == (held.predicted == 1)).all()
    assert held[held.toxic == 1].predicted.mean() > 0.5 and held[held.toxic == 0].predicted.mean() < 0.05


def test_toxicity_learns_no_held_out_label(spark, corpus):
    docs, labels = corpus
    flipped = labels.toPandas()
    held = np.array([zlib.crc32(str(i).encode()) % 3 == 1 for i in flipped.doc_id])
    flipped.loc[held, "toxic"] = 1 - flipped.loc[held, "toxic"]
    for a, b in zip(fit_toxicity(docs, labels), fit_toxicity(docs, spark.createDataFrame(flipped))):
        assert np.array_equal(a, b)


def test_scores_of_awkward_rows(spark, awkward, no_docs, corpus):
    docs, labels = corpus
    model = fit_toxicity(docs, labels)
    rows = toxicity_scores(awkward, model).collect()
    assert len(rows) == awkward.count() and all(0 <= r.score <= 1 for r in rows)
    assert toxicity_scores(no_docs, model).count() == 0
    none = toxicity_scores(awkward, fit_toxicity(no_docs, labels)).collect()
    assert {r.predicted for r in none} == {0}
    odd = spark.createDataFrame([(1, None, 1), (None, 1, 0), (7, 1, 1), (7, 0, 0)], "doc_id long, quality int, toxic int")
    assert toxicity_scores(awkward, fit_toxicity(awkward, odd)).count() == awkward.count()


def test_quality_on_held_out_labels(corpus):
    docs, labels = corpus
    got = quality_scores(docs, fit_quality(docs, labels)).join(labels, "doc_id").toPandas()
    held = got[got.held_out]
    assert (held.keep == (held.score >= 0.5)).all()
    assert held[held.quality == 1].keep.mean() > 0.95 and held[held.quality == 0].keep.mean() < 0.3


def test_quality_of_awkward_rows(awkward, no_docs, corpus):
    docs, labels = corpus
    model = fit_quality(docs, labels)
    assert quality_scores(awkward, model).where("score between 0 and 1").count() == awkward.count()
    assert quality_scores(no_docs, model).count() == 0
    assert fit_quality(no_docs, labels) is None
    kept = quality_filter(awkward, labels.limit(0))
    assert kept.dtypes == awkward.dtypes and kept.count() == awkward.count()


def test_ftrl_equals_a_plain_version():
    rng = np.random.default_rng(4)
    examples = [np.unique(rng.integers(0, 40, 6)) for _ in range(60)]
    labels = np.array([float(3 in x or 7 in x) for x in examples])
    coords, weights, bias = ftrl(examples, labels, 3, 0.5)
    z, n, w0, n0 = {}, {}, 0.0, 0.0

    def weight(i):
        if abs(z.get(i, 0.0)) <= 0.5:
            return 0.0
        return -(z[i] - np.sign(z[i]) * 0.5) / ((1.0 + np.sqrt(n[i])) / 1.0 + 0.01)

    order = np.random.default_rng(7)
    for _ in range(3):
        for k in order.permutation(len(examples)):
            w = {int(i): weight(int(i)) for i in examples[k]}
            g = 1 / (1 + np.exp(-(w0 + sum(w.values())))) - labels[k]
            for i, wi in w.items():
                z[i] = z.get(i, 0.0) + g - (np.sqrt(n.get(i, 0.0) + g * g) - np.sqrt(n.get(i, 0.0))) * wi
                n[i] = n.get(i, 0.0) + g * g
            n0 += g * g
            w0 -= 0.5 / (1 + np.sqrt(n0)) * g
    want = {i: weight(i) for i in z if weight(i)}
    assert coords.tolist() == sorted(want) and np.allclose(weights, [want[i] for i in sorted(want)]) and bias == pytest.approx(w0)


def test_confident_documents_come_from_the_whole_pool(spark):
    from lodestrata.llm.quality import CONTENT, META, confident, new_views

    rng = np.random.default_rng(9)
    x = rng.random((400, len(CONTENT) + len(META)))
    views = new_views({c: np.quantile(x[:, c], [0.25, 0.5, 0.75]).tolist() for c in range(x.shape[1])})
    y = (x[:, 0] > 0.5).astype(float)
    for v in views:
        v.fit(x, y, np.ones(400))
    pool = spark.createDataFrame([(r.tolist(), i) for i, r in enumerate(x)], "x array<double>, uid long")
    taken = [set(), set()]
    (rows, labels), _ = confident(pool, views, 0.5, 8, 0, taken)
    odds = views[0].odds(x)
    sure = {i for i in range(400) if odds[i] >= max(np.log(9), np.sort(odds)[int(400 * 0.975) - 2]) or odds[i] <= min(-np.log(9), np.sort(odds)[int(400 * 0.025) + 2])}
    assert taken[0] <= sure and len(rows) == len(labels) == len(taken[0]) and (labels == 1).sum() <= 8
    again, _ = confident(pool, views, 0.5, 8, 1, taken)
    assert len(again[0]) <= 16
