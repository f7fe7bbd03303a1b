"""Each call of the engine, with its statuses."""

import json

import pytest

from lodestrata.__main__ import main
from lodestrata.api import Engine, Settings
from lodestrata.api.settings import clamp, given


@pytest.fixture(scope="module")
def corpus(tmp_path_factory):
    root = tmp_path_factory.mktemp("corpus") / "alpha"
    (root / "nested" / "node_modules").mkdir(parents=True)
    (root / "README.md").write_text("The renewal contract\nis signed by N.W. Salvage")
    (root / "nested" / "page.html").write_text("<html><script>x = 'renewal'</script><p>An invoice receipt</p></html>")
    (root / "nested" / "node_modules" / "x.txt").write_text("renewal renewal")
    (root / "scan.pdf").write_bytes(b"%PDF")
    (root / "photo.png").write_bytes(b"png")
    return root


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory, corpus):
    made = Engine(spark, str(tmp_path_factory.mktemp("catalog")))
    assert made.search.text("renewal")["status"] == "deferred" and made.index.build()["error_kind"] == "no_indexable_text"
    first = made.inventory.scan(str(corpus))
    assert first["status"] == "ok" and first["counts"] == {"files": 4, "bytes": first["counts"]["bytes"], "created": 4, "changed": 0, "unchanged": 0, "deleted": 0}
    again = made.inventory.scan(str(corpus))
    assert again["counts"]["unchanged"] == 4 and again["root_id"] == first["root_id"]
    parsed = made.inventory.parse(str(corpus))
    assert parsed["status"] == "partial" and parsed["counts"] == {"parsed": 2, "failed": 1}
    assert [(f["relative_path"], f["error_kind"]) for f in parsed["failures"]] == [("scan.pdf", "docling_input_invalid")]
    for kind in ("lexical", "semantic"):
        assert made.index.build(kind)["rebuilt"] and not made.index.build(kind)["rebuilt"] and made.index.build(kind, force=True)["rebuilt"]
    return made


def test_scan_refuses_what_it_must(engine, corpus, tmp_path):
    assert engine.inventory.scan(str(tmp_path / "none"))["error_kind"] == "source_missing"
    assert engine.inventory.scan(str(corpus / "README.md"))["error_kind"] == "source_not_folder"
    over = engine.inventory.scan(str(corpus), max_files=1)
    assert over["status"] == "deferred" and over["safeguard"] == {"kind": "max_files", "limit": 1, "needed_at_least": 4}
    assert engine.inventory.parse(str(tmp_path))["error_kind"] == "source_not_scanned"


def test_deleted_and_changed_files(spark, tmp_path):
    made, root = Engine(spark, str(tmp_path / "tables")), tmp_path / "files"
    root.mkdir()
    for n in "abc":
        (root / f"{n}.txt").write_text(n)
    made.inventory.scan(str(root))
    (root / "a.txt").unlink()
    (root / "b.txt").write_text("other")
    counts = made.inventory.scan(str(root))["counts"]
    assert (counts["created"], counts["changed"], counts["unchanged"], counts["deleted"]) == (0, 1, 1, 1)
    assert made.tables.read("cache", "source_items").where("status = 'deleted'").count() == 1
    assert made.inventory.scan(str(root))["counts"]["deleted"] == 0


def test_searches(engine):
    got = engine.search.text("Renewal, contract!", limit=5)
    assert got["status"] == "ok" and [h["relative_path"] for h in got["hits"]] == ["README.md"] and got["trace"]["status"] == "routed"
    assert engine.resolve(got["hits"][0]["ref"])["text"] == "The renewal contract"
    none = engine.search.text("nosuchword")
    assert none["hits"] == [] and none["trace"]["status"] == "fallback_all_scopes" and none["suggestions"][0]["label"] == "alpha"
    assert engine.search.text("x", budget="huge")["error_kind"] == "invalid_budget" and engine.search.text(" !")["hits"] == []
    near = engine.search.semantic("the renewal contract", limit=1)
    assert near["hits"][0]["relative_path"] == "README.md" and near["hits"][0]["score"] == pytest.approx(1)
    both = engine.search.hybrid("renewal contract", limit=2)
    assert both["hits"][0]["backends"] == ["fts", "semantic"] and both["status"] == "ok"
    turned = engine.search.hybrid("renewal contract", limit=2, reranker=lambda q, hits: [h["chunk_id"] for h in reversed(hits)])
    assert [h["chunk_id"] for h in turned["hits"]] == [h["chunk_id"] for h in reversed(both["hits"])]
    assert engine.search.hybrid("renewal", reranker=lambda q, hits: 1 / 0)["status"] == "partial"


def test_entities(engine):
    assert engine.entities.add("X", "alien")["error_kind"] == "invalid_entity_kind"
    made = engine.entities.add("N.W. Salvage", "organization")
    ent = made["entity_id"]
    assert made["entity"]["status"] == "proposed" and engine.entities.list(kind="organization")["counts"]["entities_returned"] == 1
    assert engine.entities.alias("ent_none", "x")["status"] == "not_found" and engine.entities.alias(ent, "  N.W. Salvage  ")["status"] == "ok"
    assert engine.entities.link(ent, "corpus_cache.document_objects.none")["error_kind"] == "evidence_ref_not_found"
    first, second = (engine.entities.find(ent, "salvage", propose=True) for _ in range(2))
    assert len(first["proposed"]) == 1 and second["proposed"] == []
    shown = engine.entities.show(ent)
    assert [a["normalised"] for a in shown["aliases"]] == ["n.w. salvage"] and len(shown["review_tasks"]) == 1
    assert "Salvage" in shown["links"][0]["evidence"]["text"]
    link = shown["links"][0]["link_id"]
    assert engine.entities.review(link, "accept")["review_status"] == "accepted" and engine.entities.show(ent)["links"][0]["status"] == "accepted"
    assert engine.entities.review(link, "maybe")["error_kind"] == "invalid_decision" and engine.entities.review("x_1", "defer")["error_kind"] == "unknown_target_kind"
    assert engine.entities.review("link_none", "reject")["status"] == "not_found" and engine.entities.show("ent_none")["status"] == "not_found"


def test_catalog_health_and_commands(engine, capsys):
    assert engine.catalog.status()["status"] == "stale" and engine.catalog.create()["status"] == "created"
    assert engine.catalog.create()["status"] == engine.catalog.status()["status"] == "current" and engine.health()["status"] == "ok"
    assert main(["search", "text", "renewal", "--limit", "1"], engine) == 0
    assert len(json.loads(capsys.readouterr().out)["hits"]) == 1
    assert main(["entity", "show", "ent_none"], engine) == 1 and main(["entity", "add", "X"], engine) == 1
    with pytest.raises(SystemExit):
        main(["nothing"], engine)


def test_settings(tmp_path):
    path = tmp_path / "s.json"
    path.write_text('{"search_limit": 5, "exclude": ["*.tmp"]}')
    assert Settings.load(str(path), rrf_k=10) == Settings(search_limit=5, exclude=("*.tmp",), rrf_k=10)
    with pytest.raises(ValueError):
        Settings.load(nonsense=1)
    assert [clamp(x, 30) for x in (None, 0, -3, "7", "x")] == [30, 30, 1, 7, 30] and given(None, None) is None and given("3", 5) == 3 and given(None, 5) == 5
