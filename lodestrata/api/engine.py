"""Catalog, inventory, parsing, indexes, search and entities over one folder that driver and executors share."""

from __future__ import annotations

import importlib.util
import platform
import re
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.api.settings import Settings, clamp, given
from lodestrata.functions import columns as C
from lodestrata.functions.embedders import embedder_udf, hashing_model
from lodestrata.operators import inventory as I
from lodestrata.operators import relations as R
from lodestrata.operators.index import LexicalIndex
from lodestrata.operators.routing import FANOUT
from lodestrata.schema import TABLES
from lodestrata.sources.store import Catalog

#: The closed vocabularies of entities.
ENTITY_KINDS = ("person", "organization", "place", "event", "object", "document", "account", "concept", "collection", "unknown", "other")
ENTITY_STATUSES = ("proposed", "active", "merged", "rejected", "archived")
ALIAS_KINDS = ("name", "label", "identifier", "handle", "filename_hint", "abbreviation", "other")
LINK_ROLES = ("mention", "identifier", "visual_match", "location", "source", "support", "contradiction", "context", "other")
LINK_STATUSES = ("proposed", "accepted", "rejected", "deferred")
DECISIONS = {"accept": "accepted", "reject": "rejected", "defer": "deferred"}
#: What a target's prefix reviews: the table and its key.
_TARGETS = {"ent": ("entities", "entity_id"), "alias": ("entity_aliases", "alias_id"), "link": ("entity_links", "link_id"), "task": ("review_tasks", "task_id")}
_DATASETS = {"corpus_cache": "cache", "state": "state"}


def failed(kind: str, status: str = "failed", **more) -> dict:
    return {"status": status, "error_kind": kind, **more}


def _invalid(field: str, value, allowed) -> dict:
    return failed(f"invalid_{field}", value=value, allowed=list(allowed))


def plain_text(data: bytes, path: str) -> str:
    """The built-in converter: text as it is, markup without its tags; other formats are refused."""
    if not re.search(r"\.(txt|md|markdown|csv|json|html?|xml)$", path.lower()):
        raise ValueError("input is not valid for the built-in converter")
    text = data.decode("utf-8", "replace")
    if re.search(r"\.(html?|xml)$", path.lower()):
        text = re.sub(r"<[^>]*>", " ", re.sub(r"(?is)<(script|style)\b.*?</\1\s*>", " ", text))
    return text


class Engine:
    """The calls; `embed` is a function that loads a model from text to vectors, `convert` one from bytes and path to text."""

    def __init__(self, spark: SparkSession, folder: str, settings: Settings | None = None, convert: Callable[[bytes, str], str] = plain_text, embed: Callable[[], Callable] = hashing_model):
        self.spark, self.folder, self.settings = spark, folder.rstrip("/"), settings or Settings()
        self.convert, self.embed = convert, embed
        self.tables = Catalog(spark, self.folder)
        self.catalog, self.inventory, self.index, self.search, self.entities = _Catalog(self), _Inventory(self), _Index(self), _Search(self), _Entities(self)

    def health(self) -> dict:
        """What is installed and what is there; nothing is an error."""
        found = [{"name": n, "status": "ok" if importlib.util.find_spec(n) else "missing"} for n in ("pyarrow", "pandas", "numpy", "ahocorasick", "yaml")]
        status = self.tables.status()
        return {"status": "ok", "python": platform.python_version(), "spark": self.spark.version, "checks": found, "tables": {"current": sum(s == "current" for s in status.values()), "missing": sum(s == "missing" for s in status.values())}}

    def chunks(self) -> DataFrame:
        """Objects with text, with their scope and reference."""
        docs = self.tables.read("cache", "documents").where("status = 'parsed'").select("doc_id", "item_id")
        items = self.tables.read("cache", "source_items").where("status <> 'deleted'").select("item_id", "root_id", "relative_path")
        scopes = self.tables.read("cache", "scopes").select("root_id", "scope_id")
        rows = self.tables.read("cache", "document_objects").join(docs, "doc_id").join(items, "item_id").join(scopes, "root_id")
        rows = rows.select(C.stable_id("chunk", "object_id").alias("chunk_id"), "scope_id", "doc_id", "relative_path", C.content_type("object_type").alias("content_type"), C.collapse_ws("text").alias("body"), C.evidence_ref("corpus_cache", "document_objects", "object_id").alias("ref"))
        return rows.where("body <> ''")

    def resolve(self, ref: str) -> dict | None:
        """The row that a reference dataset.table.key names, or none."""
        parts = (ref or "").split(".")
        known = (_DATASETS.get(parts[0]), parts[1]) if len(parts) == 3 else None
        if known not in TABLES:
            return None
        row = self.tables.read(*known).where(F.col(TABLES[known][0]) == parts[2]).first()
        return row.asDict() if row else None


class _Part:
    def __init__(self, engine: Engine):
        self.engine, self.spark, self.tables, self.settings = engine, engine.spark, engine.tables, engine.settings


class _Catalog(_Part):
    def create(self) -> dict:
        """Every table has a first version; those that are there stay."""
        missing = [k for k in TABLES if self.tables.status()[f"{k[0]}.{k[1]}"] == "missing"]
        for dataset, table in missing:
            self.tables.write(dataset, table, self.tables.read(dataset, table))
        return {"status": "created" if missing else "current", "tables": len(TABLES)}

    def status(self) -> dict:
        found = set(self.tables.status().values())
        return {"status": "current" if found == {"current"} else "missing" if found == {"missing"} else "stale", "tables": self.tables.status()}

    def wipe_cache(self) -> dict:
        self.tables.wipe_cache()
        return {"status": "ok"}


class _Inventory(_Part):
    def _files(self, path: str) -> tuple[DataFrame | None, dict]:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(p):
            return None, failed("source_missing", path=path)
        if not fs.getFileStatus(p).isDirectory():
            return None, failed("source_not_folder", path=path)
        root = fs.makeQualified(p).toString().rstrip("/")
        files = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
        bare = lambda c: F.regexp_replace(c, "^[a-z0-9]+:/+", "/")
        relative = F.substring(bare(F.col("path")), len(re.sub("^[a-z0-9]+:/+", "/", root)) + 2, 1 << 30)
        return files.withColumn("relative_path", relative), {"root_uri": root, "root_id": "root_" + uuid.uuid5(uuid.NAMESPACE_URL, root).hex}

    def scan(self, path: str, max_files: int | None = None, max_bytes: int | None = None, max_depth: int | None = None) -> dict:
        """A folder's files against the inventory: new, unchanged, changed and deleted ones, written by key.

        A folder beyond the limits is deferred with the amounts it would need, and
        nothing is written. Sizes are judged from the listing; content is read once,
        for the hash.
        """
        files, root = self._files(path)
        if files is None:
            return root
        depth = given(max_depth, self.settings.max_depth)
        files = files.where(~C.matches_any("relative_path", list(self.settings.exclude)))
        if depth is not None:
            files = files.where(F.size(F.split("relative_path", "/")) <= depth)
        n, size = files.agg(F.count(F.lit(1)), F.coalesce(F.sum("length"), F.lit(0))).first()
        for what, found, most in (("max_files", n, given(max_files, self.settings.max_files)), ("max_bytes", size, given(max_bytes, self.settings.max_bytes))):
            if found > most:
                return {"status": "deferred", "safeguard": {"kind": what, "limit": most, "needed_at_least": found}, **root}
        root_id = root["root_id"]
        now = files.select(
            C.stable_id("item", F.lit(root_id), F.lower("relative_path")).alias("item_id"), F.lit(root_id).alias("root_id"), F.lit(None).cast("string").alias("parent_id"), F.lit("file").alias("kind"),
            "relative_path", C.media_type("relative_path").alias("media_type"), F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("sha256"), F.lit("current").alias("status"),
        )
        before = self.tables.read("cache", "source_items")
        mine = before.where((F.col("root_id") == root_id) & (F.col("status") != "deleted"))
        changes = I.classify_changes(mine, now).groupBy("status").count().collect()
        gone = mine.join(now, "item_id", "left_anti").withColumn("status", F.lit("deleted"))
        self.tables.upsert("cache", "source_items", now.unionByName(gone.select(now.columns)))
        scope_id = f"scope_{root_id[5:]}"
        label = root["root_uri"].rsplit("/", 1)[-1]
        self.tables.upsert("cache", "scopes", self.spark.createDataFrame([(scope_id, root_id, label)], "scope_id string, root_id string, label string"))
        stamp = self.spark.createDataFrame([(root_id, "folder", label, root["root_uri"])], "root_id string, kind string, label string, uri string")
        self.tables.upsert("cache", "source_roots", stamp.withColumn("first_seen_at", F.current_timestamp()).withColumn("last_seen_at", F.current_timestamp()), keep=("first_seen_at",))
        counts = {r["status"]: r["count"] for r in changes}
        return {"status": "ok", **root, "scope_id": scope_id, "counts": {"files": n, "bytes": size, "created": counts.get("current", 0), **{k: counts.get(k, 0) for k in ("changed", "unchanged", "deleted")}}}

    def parse(self, path: str, limit: int | None = None, max_file_size: int | None = None) -> dict:
        """The scanned root's documents through the converter; a failure is a row of its own, with its kind, and leaves what was parsed before."""
        files, root = self._files(path)
        if files is None:
            return root
        items = self.tables.read("cache", "source_items").where((F.col("root_id") == root["root_id"]) & (F.col("status") != "deleted"))
        if items.isEmpty():
            return failed("source_not_scanned", **root)
        todo = items.where(~F.col("media_type").rlike("^(image|video|audio|model)/")).select("item_id", "relative_path", "size_bytes")
        if limit is not None:
            todo = todo.orderBy("relative_path").limit(clamp(limit, 1))
        most, convert = given(max_file_size, self.settings.max_file_size), self.engine.convert

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                out = []
                for item, name, size, data in zip(b["item_id"], b["relative_path"], b["size_bytes"], b["content"]):
                    text = error = None
                    try:
                        if most is not None and size > most:
                            raise ValueError("max_file_size")
                        text = convert(data, name)
                    except Exception as e:  # one document's failure is its own row's
                        error = f"{type(e).__name__} {e}"
                    out.append((item, name, text, error))
                yield pd.DataFrame(out, columns=["item_id", "relative_path", "text", "error"])

        done = todo.join(files.select("relative_path", "content"), "relative_path").select("item_id", "relative_path", "size_bytes", "content")
        done = done.mapInPandas(run, "item_id string, relative_path string, text string, error string").withColumn("doc_id", C.stable_id("doc", "item_id"))
        kept = f"{self.engine.folder}/tmp/parsed-{uuid.uuid4().hex}"  # converters run once
        done.write.parquet(kept)
        done = self.spark.read.schema(done.schema).parquet(kept)
        good = done.where("error IS NULL")
        lines = good.select("doc_id", F.posexplode(F.split("text", "\n")).alias("order_index", "text")).where(F.trim("text") != "")
        objects = lines.select(C.stable_id("obj", "doc_id", "order_index").alias("object_id"), "doc_id", F.lit("paragraph").alias("object_type"), "order_index", "text", F.lit("{}").alias("attributes"))
        count = objects.groupBy("doc_id").agg(F.count(F.lit(1)).alias("object_count"))
        docs = good.join(count, "doc_id", "left").select("doc_id", "item_id", C.stem("relative_path").alias("title"), F.lit(None).cast("string").alias("language"), F.lit("parsed").alias("status"), F.current_timestamp().alias("parsed_at"), F.coalesce("object_count", F.lit(0)).alias("object_count"))
        old = self.tables.read("cache", "document_objects")
        self.tables.write("cache", "document_objects", old.join(docs.select("doc_id"), "doc_id", "left_anti").select(old.columns).unionByName(objects.select(old.columns)))
        self.tables.upsert("cache", "documents", docs)
        bad = done.where("error IS NOT NULL").select("relative_path", C.error_kind("error").alias("error_kind"), F.col("error").alias("message"))
        n_good, n_bad = good.count(), bad.count()
        failures = [r.asDict() for r in bad.orderBy("relative_path").limit(100).collect()]
        status = "ok" if not n_bad else "partial" if n_good else "failed"
        return {"status": status, **root, "counts": {"parsed": n_good, "failed": n_bad}, "failures": failures, "failures_truncated": n_bad > len(failures)}


class _Index(_Part):
    def lexical(self) -> LexicalIndex:
        return LexicalIndex(self.spark, f"{self.engine.folder}/cache/lexical")

    def build(self, kind: str = "lexical", force: bool = False) -> dict:
        """The lexical or the semantic index over all chunks; one whose content has not changed since stays, unless forced."""
        if kind not in ("lexical", "semantic"):
            return _invalid("index_kind", kind, ("lexical", "semantic"))
        chunks = self.engine.chunks()
        profile = "text" if kind == "lexical" else self.settings.embedding
        marks = I.digest(chunks, ["scope_id"], F.col("chunk_id"), F.col("body"), profile).collect()
        if not marks:
            return failed("no_indexable_text", "deferred")
        table, key = ("lexical_indexes", "index_id") if kind == "lexical" else ("vector_stores", "store_id")
        known = {(r["scope_id"], r["watermark"]) for r in self.tables.read("cache", table).where(F.col("profile") == profile).collect()}
        counts = {"scopes": len(marks), "rows": sum(r["n_rows"] for r in marks)}
        if not force and known == {(r["scope_id"], r["watermark"]) for r in marks}:
            return {"status": "ok", "rebuilt": False, "counts": counts}
        if kind == "lexical":
            self.lexical().build(chunks, "scope_id", "chunk_id", "body")
        else:
            vectors = chunks.select("chunk_id", "scope_id", F.lit(profile).alias("profile"), embedder_udf(self.engine.embed)("body").alias("vector"))
            others = self.tables.read("cache", "vectors").where(F.col("profile") != profile)
            self.tables.write("cache", "vectors", others.unionByName(vectors))
        dimension = len(self.engine.embed()([""])[0]) if kind == "semantic" else 0
        rows = [(f"{kind}_{r['scope_id']}", r["scope_id"], profile, r["watermark"], "current", r["n_rows"] if kind == "lexical" else dimension) for r in marks]
        old = self.tables.read("cache", table)
        fresh = self.spark.createDataFrame(rows, f"{key} string, scope_id string, profile string, watermark string, status string, {'row_count' if kind == 'lexical' else 'dimension'} long")
        self.tables.write("cache", table, old.where(F.col("profile") != profile).unionByName(fresh.select(old.columns)))
        return {"status": "ok", "rebuilt": True, "counts": counts}


class _Search(_Part):
    def _hits(self, ranked: DataFrame, backend: str, limit: int) -> list[dict]:
        """The best rows of (chunk_id, score) with their references; what has gone since is left out."""
        top = ranked.select("chunk_id", "score").orderBy(F.desc("score"), "chunk_id").limit(limit)
        rows = top.join(self.engine.chunks(), "chunk_id").select("chunk_id", "score", "scope_id", "relative_path", "ref", "content_type", C.truncate("body", 240).alias("preview")).collect()
        rows.sort(key=lambda r: (-r["score"], r["chunk_id"]))
        return [r.asDict() | {"rank": i + 1, "backend": backend} for i, r in enumerate(rows)]

    def _terms(self, query: str) -> list[str]:
        return sorted({w for w in re.split(r"[\W_]+", query.lower()) if w and len(w.encode()) <= 40})

    def _scopes(self, terms: list[str], budget: str) -> list[str]:
        """The scopes whose best chunks rank first: 1, 4 or 8 of them by the budget."""
        best = self.engine.index.lexical().bm25(terms, None, "scope_id", "chunk_id").groupBy("scope_id").agg(F.max("score").alias("s"))
        return [r[0] for r in best.orderBy(F.desc("s"), "scope_id").limit(FANOUT[budget]).collect()]

    def text(self, query: str, limit: int | None = None, budget: str | None = None, routed: bool = True) -> dict:
        """BM25 over the scopes that routing selects, or over all of them where it selects none; a search without hits comes with suggestions."""
        budget, limit = budget or self.settings.budget, clamp(limit, self.settings.search_limit)
        if budget not in FANOUT:
            return _invalid("budget", budget, tuple(FANOUT))
        if not self.engine.index.lexical().exists():
            return failed("index_missing", "deferred", hits=[])
        terms = self._terms(query)
        if not terms:
            return {"status": "ok", "hits": [], "trace": {"status": "empty_query"}}
        scopes = self._scopes(terms, budget) if routed else []
        hits = self._hits(self.engine.index.lexical().bm25(terms, scopes, "scope_id", "chunk_id"), "fts", limit)
        trace = {"status": "routed" if scopes else "fallback_all_scopes" if routed else "exhaustive", "budget": budget, "selected": scopes}
        out = {"status": "ok", "hits": hits, "trace": trace}
        if not hits:
            labels = self.tables.read("cache", "scopes").orderBy("label").limit(self.settings.route_top_k).collect()
            out["suggestions"] = [{"scope_id": r["scope_id"], "label": r["label"]} for r in labels]
        return out

    def _semantic(self, query: str) -> DataFrame | None:
        rows = self.tables.read("cache", "vectors").where(F.col("profile") == self.settings.embedding)
        if rows.isEmpty():
            return None
        q = [float(x) for x in self.engine.embed()([query])[0]]
        distance = C.l2("vector", F.array(*map(F.lit, q)))
        return rows.select("chunk_id", F.round(1 / (1 + distance), 9).alias("score"))

    def semantic(self, query: str, limit: int | None = None) -> dict:
        ranked = self._semantic(query)
        if ranked is None:
            return failed("index_missing", "deferred", hits=[])
        return {"status": "ok", "hits": self._hits(ranked, "semantic", clamp(limit, self.settings.search_limit))}

    def hybrid(self, query: str, limit: int | None = None, candidate_limit: int | None = None, rrf_k: int | None = None, reranker: Callable[[str, list[dict]], list[str]] | None = None) -> dict:
        """Candidates of both backends fused by reciprocal ranks; one that is missing makes the result partial, a reranker's failure leaves the fused order."""
        limit = clamp(limit, self.settings.search_limit)
        most = max(limit, clamp(candidate_limit, self.settings.candidate_limit))
        lists = {"fts": self.text(query, most, routed=False), "semantic": self.semantic(query, most)}
        skipped = [{"backend": b, "error_kind": r["error_kind"]} for b, r in lists.items() if r["status"] != "ok"]
        if len(skipped) == len(lists):
            return failed("no_backend", backends_skipped=skipped, hits=[])
        known = {h["chunk_id"]: h for r in lists.values() for h in r["hits"]}
        ranked = [(h["chunk_id"], b, h["rank"]) for b, r in lists.items() for h in r["hits"]]
        fused = R.rrf(self.spark.createDataFrame(ranked, "key string, backend string, rank long"), k=clamp(rrf_k, self.settings.rrf_k)).orderBy(F.desc("score"), "best_rank", "key").limit(limit).collect()
        hits = [known[r["key"]] | {"score": r["score"], "backends": r["backends"], "rank": i + 1} for i, r in enumerate(fused)]
        out = {"status": "partial" if skipped else "ok", "hits": hits, "backends_skipped": skipped}
        if reranker and hits:
            try:
                order = {k: i for i, k in reversed(list(enumerate(reranker(query, hits))))}
                out["hits"] = sorted(hits, key=lambda h: (order.get(h["chunk_id"], len(order)), h["rank"]))
            except Exception as e:  # the fused order stands
                out |= {"status": "partial", "rerank_error": f"{type(e).__name__} {e}"}
        return out


class _Entities(_Part):
    def _add(self, table: str, row: dict) -> None:
        old = self.tables.read("state", table)
        values = tuple(row.get(c) for c in old.columns)
        fresh = self.spark.createDataFrame([values], old.schema)
        self.tables.write("state", table, old.unionByName(fresh.withColumn("created_at", F.current_timestamp()) if "created_at" in old.columns else fresh))

    def _row(self, table: str, key: str, value: str) -> dict | None:
        row = self.tables.read("state", table).where(F.col(key) == value).first()
        return row.asDict() if row else None

    def add(self, name: str, kind: str, status: str = "proposed") -> dict:
        """A new entity, always; equal names are different entities."""
        if kind not in ENTITY_KINDS:
            return _invalid("entity_kind", kind, ENTITY_KINDS)
        if status not in ENTITY_STATUSES:
            return _invalid("entity_status", status, ENTITY_STATUSES)
        entity_id = f"ent_{uuid.uuid4().hex}"
        self._add("entities", {"entity_id": entity_id, "kind": kind, "name": name, "status": status})
        return {"status": "ok", "entity_id": entity_id, "entity": self._row("entities", "entity_id", entity_id)}

    def list(self, kind: str | None = None, status: str | None = None, limit: int | None = None) -> dict:
        rows = self.tables.read("state", "entities")
        for c, v in (("kind", kind), ("status", status)):
            rows = rows.where(F.col(c) == v) if v is not None else rows
        found = [r.asDict() for r in rows.orderBy(F.desc("created_at"), "entity_id").limit(clamp(limit, self.settings.entity_limit)).collect()]
        return {"status": "ok", "entities": found, "counts": {"entities_returned": len(found)}}

    def show(self, entity_id: str) -> dict:
        """One entity with all that hangs on it; references are resolved by reading what they name."""
        entity = self._row("entities", "entity_id", entity_id)
        if entity is None:
            return failed("entity_not_found", "not_found", entity_id=entity_id)
        of = lambda table, cond: [r.asDict() for r in self.tables.read("state", table).where(cond).orderBy(TABLES["state", table][0]).collect()]
        mine = F.col("entity_id") == entity_id
        links = [x | {"evidence": self.engine.resolve(x["ref"])} for x in of("entity_links", mine)]
        ends = (F.col("subject_id") == entity_id) | (F.col("object_id") == entity_id)
        targets = [x["link_id"] for x in links]
        return {"status": "ok", "entity": entity, "aliases": of("entity_aliases", mine), "links": links, "relationships": of("entity_relationships", ends), "review_tasks": of("review_tasks", F.col("target_id").isin(entity_id, *targets))}

    def alias(self, entity_id: str, text: str, kind: str = "name") -> dict:
        if kind not in ALIAS_KINDS:
            return _invalid("alias_kind", kind, ALIAS_KINDS)
        if self._row("entities", "entity_id", entity_id) is None:
            return failed("entity_not_found", "not_found", entity_id=entity_id)
        alias_id = f"alias_{uuid.uuid4().hex}"
        self._add("entity_aliases", {"alias_id": alias_id, "entity_id": entity_id, "alias": text, "normalised": text.strip().lower()})
        return {"status": "ok", "alias_id": alias_id}

    def link(self, entity_id: str, ref: str, role: str = "mention", status: str = "proposed") -> dict:
        """An entity bound to a row by its reference, which must resolve."""
        if role not in LINK_ROLES:
            return _invalid("link_role", role, LINK_ROLES)
        if status not in LINK_STATUSES:
            return _invalid("link_status", status, LINK_STATUSES)
        if self._row("entities", "entity_id", entity_id) is None:
            return failed("entity_not_found", "not_found", entity_id=entity_id)
        if self.engine.resolve(ref) is None:
            return failed("evidence_ref_not_found", evidence_ref=ref)
        link_id = f"link_{uuid.uuid4().hex}"
        self._add("entity_links", {"link_id": link_id, "entity_id": entity_id, "ref": ref, "role": role, "status": status})
        return {"status": "ok", "link_id": link_id}

    def review(self, target_id: str, decision: str) -> dict:
        """accept, reject or defer an entity, alias, link or task; aliases have no status, and their decision is an event alone."""
        if decision not in DECISIONS:
            return _invalid("decision", decision, DECISIONS)
        target = _TARGETS.get(target_id.split("_", 1)[0])
        if target is None:
            return failed("unknown_target_kind", target_id=target_id)
        table, key = target
        if self._row(table, key, target_id) is None:
            return failed("target_not_found", "not_found", target_id=target_id)
        rows = self.tables.read("state", table)
        if table in ("entity_links", "review_tasks"):
            self.tables.write("state", table, rows.withColumn("status", F.when(F.col(key) == target_id, DECISIONS[decision]).otherwise(F.col("status"))))
        self._add("review_events", {"event_id": f"event_{uuid.uuid4().hex}", "target_id": target_id, "decision": DECISIONS[decision]})
        return {"status": "ok", "target_id": target_id, "review_status": DECISIONS[decision]}

    def find(self, entity_id: str, query: str, limit: int | None = None, propose: bool = False, role: str = "mention") -> dict:
        """A search on an entity's behalf; with `propose` each hit that no link has yet becomes a proposed link with a task, so a second run adds nothing."""
        if role not in LINK_ROLES:
            return _invalid("link_role", role, LINK_ROLES)
        if self._row("entities", "entity_id", entity_id) is None:
            return failed("entity_not_found", "not_found", entity_id=entity_id)
        found = self.engine.search.text(query, limit)
        hits, made = found.get("hits", []), []
        if propose and hits:
            linked = {r["ref"] for r in self.tables.read("state", "entity_links").where(F.col("entity_id") == entity_id).select("ref").collect()}
            for ref in dict.fromkeys(h["ref"] for h in hits if h["ref"] not in linked):
                got = self.link(entity_id, ref, role)
                if got["status"] == "ok":
                    made.append(got["link_id"])
                    self._add("review_tasks", {"task_id": f"task_{uuid.uuid4().hex}", "target_id": got["link_id"], "status": "open"})
        return {"status": found["status"], "entity_id": entity_id, "hits": hits, "proposed": made} | ({"error_kind": found["error_kind"]} if "error_kind" in found else {})
