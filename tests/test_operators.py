"""Golden values and properties of the operators."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrata.functions import columns as C
from lodestrata.functions.embedders import summary_udf
from lodestrata.operators import index as indexes
from lodestrata.operators import inventory as I
from lodestrata.operators import lexical as L
from lodestrata.operators import passages
from lodestrata.operators import ranking as K
from lodestrata.operators import relations as R
from lodestrata.operators import routing
from lodestrata.operators.index import LexicalIndex
from lodestrata.operators.querylang import matches
from lodestrata.plans import registry
from lodestrata.sources.store import Catalog


def one(spark, column, **values):
    row = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items()))
    return row.select(column).first()[0]


@pytest.mark.parametrize("n, most, want", [(1, 20, 1), (10, 20, 3), (100, 20, 5), (10_000, 20, 9), (10**12, 20, 20), (10**12, 5, 5)])
def test_entry_budget(spark, n, most, want):
    assert one(spark, C.entry_budget("n", most), n=n) == want


def test_budget_keeps_reserved_units_and_rolls_up_the_rest(spark):
    rows = [("root", "r", "root_summary", 4, None), ("album", "r", "album_summary", 2, 0.1), ("c_high", "r", "cluster", 2, 0.9), ("c_mid", "r", "cluster", 1, 0.5), ("c_low", "r", "cluster", 1, 0.1)]
    units = spark.createDataFrame(rows, "summary_id string, root_id string, kind string, source_count long, importance double").withColumn("coverage", F.lit(0.5)).withColumn("scope_id", F.lit("s")).withColumn("title", F.col("summary_id"))
    sel = K.budgeted(units)
    assert {r.summary_id for r in sel.where("kept").collect()} == {"root", "album", "c_high"}
    r = K.rollup_dropped(sel).first()
    assert (r.summary_id, r.titles, r.source_count, r.importance) == ("neg_r", ["c_low", "c_mid"], 2, 0.05)


def test_reciprocal_ranks(spark):
    rows = [("shared", "fts", 1), ("fts-only", "fts", 2), ("semantic-only", "semantic", 1), ("shared", "semantic", 2)]
    got = {r.key: r for r in R.rrf(spark.createDataFrame(rows, "key string, backend string, rank long")).collect()}
    assert got["shared"].score == pytest.approx(1 / 61 + 1 / 62) and got["shared"].backends == ["fts", "semantic"]
    assert max(got.values(), key=lambda r: r.score).key == "shared"


@pytest.mark.parametrize("text, want", [("a\nIMPORTANCE: 0.9", 0.9), ("none", None), ("importance=1.5", 1.0), ("IMPORTANCE: 0.1\nIMPORTANCE: 0.4", 0.4)])
def test_importance(spark, text, want):
    assert one(spark, C.importance("x"), x=text) == want


def test_scalars(spark):
    assert one(spark, F.lower(F.trim("x")), x="  N.W. Salvage  ") == "n.w. salvage"
    assert one(spark, C.human_bytes("x"), x=1536) == "1.5 KiB" and one(spark, C.human_bytes("x"), x=10) == "10 B"
    assert one(spark, C.slug("x"), x=" Search Text! ") == "search-text"
    assert one(spark, C.extension("x"), x="a/.hidden") == "[none]" and one(spark, C.stem("x"), x="a/b_c.tar.gz") == "b_c.tar"
    assert one(spark, C.parse_ref("x"), x="a..b") is None and one(spark, C.parse_ref("x"), x="a.b.c").row_id == "c"
    assert one(spark, C.collapse_ws("x"), x=" a \n  b ") == "a b"
    assert one(spark, C.matches_any("x", ["**/node_modules/**"]), x="src/node_modules/x.js") and not one(spark, C.matches_any("x", ["*.md"]), x="a.txt")
    assert one(spark, C.evidence_ref("corpus_cache", "document_objects", "x"), x="obj_123") == "corpus_cache.document_objects.obj_123"


def test_bytes_are_rounded_as_python_rounds_them(spark):
    sizes = [0, 1023, 1024, 360704, 568576, 51 * 1024 // 4 * 4 + 256, 1048575, 1048576 + 786432, 5 << 28, (1 << 40) - 1, 1 << 40, (1 << 53) + 1]
    rows = spark.createDataFrame([(x,) for x in [*sizes, None]], "x long")
    power = lambda x, most: min(max((x.bit_length() - 1) // 10, 0), most)
    for most, last in ((4, "TiB"), (3, "GiB")):
        want = {x: f"{x} B" if x < 1024 else f"{x / 1024.0 ** power(x, most):.1f} {['', 'KiB', 'MiB', 'GiB', 'TiB'][power(x, most)]}" for x in sizes} | {None: None}
        assert dict(map(tuple, rows.select("x", C.human_bytes("x", last)).collect())) == want


def test_report_bars_keep_their_fractions(spark, tmp_path):
    spark.createDataFrame([(1, "A"), (2, "B"), (3, "A"), (4, "C")], "n_nationkey long, n_name string").write.parquet(f"{tmp_path}/nation.parquet")
    spark.createDataFrame([(i, k) for i, k in enumerate([1, 1, 3, 2, 9])], "s_suppkey long, s_nationkey long").write.parquet(f"{tmp_path}/supplier.parquet")
    got = sorted(map(tuple, registry.queries()["report_bars"](spark, str(tmp_path)).collect()))
    assert got == [("A", 3, 100.0), ("B", 1, 1 / 3 * 100)]


def test_hamming_pairs_equal_brute_force(spark):
    rng = np.random.default_rng(1)
    h = rng.integers(0, 1 << 60, 60)
    h = np.concatenate([h, h ^ (1 << rng.integers(0, 60, 60)), h[:20] ^ 0b11111, h[:5]]).tolist()
    df = spark.createDataFrame(list(enumerate(h)), "k long, h long")
    for limit in (3, 5):
        got = sorted(map(tuple, R.hamming_pairs(df, "k", "h", limit).collect()))
        rep = {x: h.index(x) for x in h}
        one = sorted(rep.values())
        want = [(i, j, (h[i] ^ h[j]).bit_count(), h.count(h[i]), h.count(h[j])) for i in one for j in one if i < j and (h[i] ^ h[j]).bit_count() <= limit]
        assert got == sorted(want)
    links = {r.k: (r.class_id, r.n_links) for r in R.hamming_links(df, "k", "h", 3).collect()}
    assert links == {i: (rep[x], sum((x ^ y).bit_count() <= 3 for y in h) - 1) for i, x in enumerate(h)}


def test_hamming_pairs_do_not_broadcast_the_dealt_classes(spark):
    df = spark.createDataFrame([(i, i * 77) for i in range(9)], "k long, h long")
    out = R.hamming_pairs(df, "k", "h")
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_hamming_pairs_tell_the_members_of_classes(spark, tmp_path):
    rng = np.random.default_rng(2)
    v = rng.standard_normal((4, 64))
    v[3] = v[0] * [-1, *[1] * 63]  # one bit from the first
    rows = [(i, v[k].tolist()) for i, k in enumerate([0, 1, 0, 2, 3, 0, 3])] + [(9, None), (10, None)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("label", F.lit(0)).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = sorted(map(tuple, registry.queries()["hamming_pairs"](spark, str(tmp_path)).select("a", "b", "distance", "n_a", "n_b").collect()))
    assert got == [(0, 2, 0, 3, 3), (0, 4, 1, 3, 2), (0, 5, 0, 3, 3), (4, 6, 0, 2, 2)]


def test_simhash_of_tokens_keeps_edited_copies_together(spark):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in rng.integers(0, 10**6, 400)]
    edited = [w if i % 200 else "x" for i, w in enumerate(words)]
    rows = [(1, w) for w in words] + [(2, w) for w in edited] + [(3, f"v{i}") for i in range(400)] + [(4, w) for w in reversed(words)]
    h = {r.k: r.h for r in R.simhash(spark.createDataFrame(rows, "k long, w string"), "k", "w").collect()}
    assert h[1] == h[4] and (h[1] ^ h[2]).bit_count() <= 8 and (h[1] ^ h[3]).bit_count() > 15


def test_near_dupes_tell_documents_without_tokens(spark, tmp_path):
    rows = [(1, "red fox"), (2, None), (3, ""), (4, " .\n"), (5, "red fox"), (6, "x" * 50)]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.class_id, r.n_links) for r in registry.queries()["near_dupes"](spark, str(tmp_path)).collect()}
    assert got == {1: (1, 1), 5: (1, 1), 2: (2, 3), 3: (2, 3), 4: (2, 3), 6: (2, 3)}


@pytest.mark.parametrize("words", [["b", "c"], ["a", "b", "a"], ["zz"], ["a", "a"]])
def test_index_gives_what_the_texts_give(spark, tmp_path, words):
    rows = [("s", 1, "a b a b a, B c"), ("s", 2, "a a a"), ("t", 3, "b  c\nb-c a"), ("t", 4, None), ("t", 5, "")]
    docs = spark.createDataFrame(rows, "source string, doc_id long, text string")
    index = LexicalIndex(spark, str(tmp_path), 4).build(docs)
    plain = sorted(map(tuple, L.phrase(docs, words).collect()))
    assert sorted(map(tuple, index.phrase(words).collect())) == plain
    assert sorted(map(tuple, index.bm25(words).collect())) == sorted(map(tuple, L.bm25(docs, words).collect()))
    assert sorted(map(tuple, index.bm25(words, ["t"]).collect())) == sorted(map(tuple, L.bm25(docs.where("source = 't'"), words).collect()))
    assert {r.scope: r.n for r in index.scopes().collect()} == {"s": 2, "t": 3}


def test_index_is_built_in_slices_without_a_shuffle(spark, monkeypatch, tmp_path):
    rows = [("st"[i % 2], i, f"a b{i % 3} c{i} " * (i % 5) + "É_x " + "y" * 41) for i in range(40)] + [("t", 40, None)]
    docs = spark.createDataFrame(rows, "source string, doc_id long, text string").repartition(3)
    words = ["a", "b1", "é", "none"]
    for most in (1, 100, indexes.SLICE_BYTES):
        monkeypatch.setattr(indexes, "SLICE_BYTES", most)
        index = LexicalIndex(spark, f"{tmp_path}/{most}", 4)
        assert "Exchange" not in index.inverted(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
        index.build(docs)
        assert sorted(map(tuple, index.bm25(words).collect())) == sorted(map(tuple, L.bm25(docs, words).collect()))
        whole = L.bm25(docs.withColumn("all", F.lit("all")), words, "all").select("doc_id", "score")
        assert sorted(map(tuple, index.bm25(words, islands=False).select("doc_id", "score").collect())) == sorted(map(tuple, whole.collect()))
        assert sorted(map(tuple, index.phrase(["a", "b2"]).collect())) == sorted(map(tuple, L.phrase(docs, ["a", "b2"]).collect()))
        assert {r.scope: (r.n, r.dl) for r in index.scopes().collect()} == {s: (sum(r[0] == s for r in rows), sum(3 * (r[1] % 5) + 2 for r in rows if r[0] == s and r[2])) for s in "st"}


def test_summaries_take_no_arrow_batches_of_texts(spark):
    def generate(prompt):
        return prompt[: 6 // (len(prompt) - 3)]  # a prompt of three letters fails

    out = spark.createDataFrame([(1, "abcdefgh"), (2, "abc"), (3, None), (4, "")], "id long, text string").select("id", summary_udf(generate)("text").alias("s"))
    assert {r.id: r.s for r in out.collect()} == {1: "a", 2: None, 3: None, 4: ""}
    assert "ArrowEvalPython" not in out._jdf.queryExecution().executedPlan().toString()


def test_nearest_vectors_with_ties_and_odd_rows(spark):
    rng = np.random.default_rng(5)
    v = rng.integers(-2, 3, (60, 4)).astype(float)
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(60, None), (61, [1.0, None, 0.0, 2.0]), (62, [1.0])]
    df = spark.createDataFrame(rows, "k long, v array<float>").repartition(3)
    asked = df.where("k % 10 = 0").select(F.col("k").alias("q"), F.col("v").alias("x"))
    for own in (True, False):
        got = sorted(map(tuple, R.nearest(df, asked, "k", "v", "q", "x", 5, exclude_self=own).where("query < 60").collect()))
        want = []
        for q in range(0, 60, 10):
            best = sorted((float(((x - v[q]) ** 2).sum()), i) for i, x in enumerate(v) if not own or i != q)[:5]
            want += [(q, i, d, r + 1) for r, (d, i) in enumerate(best)]
        assert got == sorted(want)


@pytest.mark.parametrize("most", [1 << 20, 40])
def test_passages_within_texts(spark, monkeypatch, most):
    monkeypatch.setattr(passages, "MAX_BYTES", most)
    docs = spark.createDataFrame([(1, "the quick brown fox jumps over it"), (2, "a"), (3, None), (4, "")], "doc_id long, text string")
    parts = spark.createDataFrame([("the quick brown fox jumps",), ("a",), ("",), ("quick",), ("the quick brown fox sleeps",), ("quick",)], "part string")
    assert sorted(map(tuple, passages.containing(docs, parts).collect())) == [(1, "quick"), (1, "the quick brown fox jumps"), (2, "a")]


@pytest.mark.parametrize("message, kind", [("Incorrect password", "pdf_password_required"), ("std::bad_alloc", "resource_exhausted_memory"), ("password needed", "docling_convert_failed"), ("ConversionTimeout", "document_timeout"), ("page limit", "document_too_many_pages"), ("file size limit", "document_too_large"), ("Skipped", "docling_skipped"), ("cannot be opened", "docling_input_invalid"), (None, "docling_convert_failed")])
def test_kinds_of_failures(spark, message, kind):
    assert spark.createDataFrame([(message,)], "m string").select(C.error_kind("m")).first()[0] == kind


@pytest.mark.parametrize("path, kind", [("a/b.TAR.GZ", "application/x-tar"), ("b.tgz", "application/x-tar"), ("m.glb", "model/gltf-binary"), ("x.css", "text/css"), ("x.svg", "image/svg+xml"), ("noext", "application/octet-stream"), (".txt", "application/octet-stream"), ("p.JPG", "image/jpeg")])
def test_media_types(spark, path, kind):
    assert one(spark, C.media_type("x"), x=path) == kind


def test_query_language(spark):
    rows = [(1, "the quick brown fox", "en"), (2, "quick fox", "fr"), (3, "brown dog", "en"), (4, None, "de")]
    df = spark.createDataFrame(rows, "id long, text string, lang string")
    ask = lambda q: sorted(r.id for r in df.where(matches(q, {"": "text", "lang": "lang"})).collect())
    assert ask("quick dog") == [1, 2, 3]
    assert ask('"quick brown"') == [1] and ask("+quick -brown") == [2] and ask("brown AND fox") == [1]
    assert ask("lang:fr") == [2] and ask("(quick OR dog) NOT the") == [2, 3] and ask("quick^2 )(") == [1, 2]


def test_bm25_prefers_the_rarer_term(spark):
    df = spark.createDataFrame([("s", 1, "common rare"), ("s", 2, "common common"), ("s", 3, "common other"), ("s", 4, None)], "source string, doc_id long, text string")
    got = {r.doc_id: r.score for r in L.bm25(df, ["common", "rare"]).collect()}
    assert got[1] > got[2] > 0 and 4 not in got


def test_changes_and_digest(spark):
    f = "item_id string, size_bytes long, sha256 string, media_type string, relative_path string"
    old = spark.createDataFrame([("a", 1, "x", "t", "p"), ("b", 1, "x", "t", "p"), ("c", 1, "x", None, "p")], f)
    new = spark.createDataFrame([("a", 1, "x", "t", "p"), ("b", 2, "x", "t", "p"), ("c", 1, "x", None, "p"), ("d", 1, "x", "t", "p")], f)
    assert dict(I.classify_changes(old, new).collect()) == {"a": "unchanged", "b": "changed", "c": "unchanged", "d": "current"}
    assert I.digest(old, ["media_type"], F.col("item_id"), F.col("sha256"), "v").collect() == I.digest(old.orderBy(F.desc("item_id")), ["media_type"], F.col("item_id"), F.col("sha256"), "v").collect()


def test_medoids_one_from_each_cluster():
    x = np.array([[1, 0, 0], [0.9, 0.1, 0], [0.95, 0, 0.05], [0, 1, 0], [0, 0.9, 0.1]])
    got = routing.medoid_ids(x, np.arange(5))
    assert len(got) == 2 and got[0] < 3 <= got[1]


def test_catalog_versions_and_wipe(spark, tmp_path):
    cat = Catalog(spark, str(tmp_path))
    assert cat.read("state", "entities").count() == 0
    e = spark.createDataFrame([("e1", "person", "A", "proposed", None)], "entity_id string, kind string, name string, status string, created_at timestamp")
    cat.write("state", "entities", e)
    cat.upsert("state", "entities", e.withColumn("status", F.lit("accepted")).union(e.withColumn("entity_id", F.lit("e2"))))
    assert {(r.entity_id, r.status) for r in cat.read("state", "entities").collect()} == {("e1", "accepted"), ("e2", "proposed")}
    cat.write("cache", "scopes", spark.createDataFrame([("s", "r", "l")], "scope_id string, root_id string, label string"))
    cat.wipe_cache()
    assert cat.status()["state.entities"] == "current" and cat.status()["cache.scopes"] == "missing"
