"""Joins, set operations, sorting and limits: sections 2.3, 2.6 and 2.7 of the survey."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestrata.operators import relations as R
from lodestrata.plans.registry import query
from lodestrata.sources.views import duck

_CHUNK = "chunk_id, doc_id, ref, scope_id, content_type, body"


@query("doc_chunks", duck(f"SELECT {_CHUNK}, order_index FROM chunks WHERE body <> ''", "chunks"))
def doc_chunks(t):
    return t.chunks().where("body <> ''").select(*_CHUNK.split(", "), "order_index")


_OBS = "obs AS (SELECT conv_id, max_by(text, turn) FILTER (role = 'user') AS caption, max_by(text, turn) FILTER (role = 'assistant') AS media_kind, count(*) AS n FROM conversations GROUP BY conv_id)"


def _observed(t):
    last = lambda role: F.max_by(F.when(F.col("role") == role, F.col("text")), F.when(F.col("role") == role, F.col("turn")))
    return t.conversations.groupBy("conv_id").agg(last("user").alias("caption"), last("assistant").alias("media_kind"), F.count(F.lit(1)).alias("n"))


@query("media_chunks", f"WITH {_OBS} SELECT vec_id, coalesce(caption, media_kind, 'image ' || vec_id) AS body, CASE WHEN caption IS NOT NULL THEN 'media_caption' ELSE 'media_metadata' END AS content_type FROM embeddings LEFT JOIN obs ON conv_id = vec_id")
def media_chunks(t):
    both = t.embeddings.select("vec_id").join(_observed(t).withColumnRenamed("conv_id", "vec_id"), "vec_id", "left")
    return both.select("vec_id", F.coalesce("caption", "media_kind", F.concat(F.lit("image "), "vec_id")).alias("body"), F.when(F.col("caption").isNotNull(), "media_caption").otherwise("media_metadata").alias("content_type"))


@query("media_assets_wide", f"WITH {_OBS} SELECT vec_id, label, caption, media_kind, coalesce(n, 0) AS n_observations, p_name FROM embeddings LEFT JOIN obs ON conv_id = vec_id LEFT JOIN part ON p_partkey = vec_id")
def media_assets_wide(t):
    part = t.part.select(F.col("p_partkey").alias("vec_id"), "p_name")
    wide = t.embeddings.select("vec_id", "label").join(_observed(t).withColumnRenamed("conv_id", "vec_id"), "vec_id", "left").join(part, "vec_id", "left")
    return wide.select("vec_id", "label", "caption", "media_kind", F.coalesce("n", F.lit(0).cast("long")).alias("n_observations"), "p_name")


@query("current_summaries", duck("SELECT summary_id, u.root_id, r.root_id AS root_key, kind, round(coalesce(importance, 0), 6) AS importance, 'Root: ' || u.root_id || chr(10) || title AS routing_payload FROM units u JOIN roots r ON r.root_label = u.root_id WHERE trim(title, ' ') <> ''", "units", "roots"))
def current_summaries(t):
    roots = F.broadcast(t.roots().select(F.col("root_label"), F.col("root_id").alias("root_key")))  # one row a source
    u = t.units().where(F.trim("title") != "").join(roots, F.col("root_id") == F.col("root_label"))
    return u.select("summary_id", "root_id", "root_key", "kind", F.round(F.coalesce("importance", F.lit(0.0)), 6).alias("importance"), F.concat(F.lit("Root: "), "root_id", F.lit("\n"), "title").alias("routing_payload"))


@query("overview_roots", duck("SELECT r.root_label, coalesce(n, 0) AS files, coalesce(b, 0)::BIGINT AS bytes FROM roots r LEFT JOIN (SELECT root_id, count(*) AS n, sum(size_bytes) AS b FROM items WHERE media_type = 'text/plain' GROUP BY root_id) s ON s.root_id = r.root_id ORDER BY r.root_label", "roots", "items"))
def overview_roots(t):
    s = t.items().where("media_type = 'text/plain'").groupBy("root_id").agg(F.count(F.lit(1)).alias("n"), F.sum("size_bytes").alias("b"))
    return t.roots().join(s, "root_id", "left").select("root_label", F.coalesce("n", F.lit(0).cast("long")).alias("files"), F.coalesce("b", F.lit(0).cast("long")).alias("bytes")).orderBy("root_label")


@query("entity_propose", "SELECT DISTINCT o_custkey AS entity_id, 'orders.' || o_orderkey AS ref FROM orders WHERE o_orderstatus = 'O' AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def entity_propose(t):
    linked = t.lineitem.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    hits = t.orders.where("o_orderstatus = 'O'").join(linked, "o_orderkey", "left_anti")
    return hits.select(F.col("o_custkey").alias("entity_id"), F.concat(F.lit("orders."), "o_orderkey").alias("ref")).dropDuplicates(["entity_id", "ref"])


_EDGES = "edges AS (SELECT c_nationkey AS s, s_nationkey AS o, count(*) AS n FROM customer JOIN supplier ON c_custkey % 25 = s_nationkey GROUP BY ALL)"


@query("entity_relationships", f"WITH {_EDGES} SELECT DISTINCT n_nationkey AS entity_id, s, o, n FROM nation JOIN edges ON n_nationkey = s OR n_nationkey = o")
def entity_relationships(t):
    """Either end: two equi-joins united, not one disjunctive loop; both sides are counted before they meet."""
    c = t.customer.groupBy(F.col("c_nationkey").alias("s"), (F.col("c_custkey") % 25).cast("int").alias("o")).agg(F.count(F.lit(1)).alias("nc"))
    s = t.supplier.groupBy(F.col("s_nationkey").alias("o")).agg(F.count(F.lit(1)).alias("ns"))
    edges = c.join(s, "o").select("s", "o", (F.col("nc") * F.col("ns")).alias("n"))
    ends = edges.select(F.col("s").alias("entity_id"), "s", "o", "n").union(edges.select(F.col("o").alias("entity_id"), "s", "o", "n")).distinct()
    return ends.join(F.broadcast(t.nation.select(F.col("n_nationkey").alias("entity_id"))), "entity_id", "left_semi")


@query("entity_show", "SELECT c_custkey AS entity_id, c_name AS name, n_name AS nation, coalesce(list_sort(o.os), []) AS orders, coalesce(o.total, 0) AS total FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN (SELECT o_custkey, list(o_orderkey) AS os, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_custkey) o ON o_custkey = c_custkey")
def entity_show(t):
    o = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.array_sort(F.collect_list("o_orderkey")).alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    n = F.broadcast(t.nation.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("nation")))
    rows = t.customer.join(n, "c_nationkey").join(o, "c_custkey", "left")
    return rows.select(F.col("c_custkey").alias("entity_id"), F.col("c_name").alias("name"), "nation", F.coalesce("orders", F.array().cast("array<bigint>")).alias("orders"), F.coalesce("total", F.lit(0.0)).alias("total"))


_LISTS = "lists AS (SELECT doc_id AS key, 'fts' AS backend, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS rank FROM documents WHERE lang = 'en' UNION ALL SELECT doc_id, 'semantic', row_number() OVER (ORDER BY n_chars % 997, doc_id) FROM documents WHERE source IN ('src1', 'src2', 'src3', 'src4'))"


def ranked_lists(t, limit: int = 60):
    """Two ranked lists of documents, cut to the candidates; a literal limit keeps the sort to the best rows of each task."""
    a = t.documents.where("lang = 'en'").orderBy(F.desc("n_chars"), "doc_id").limit(limit).select(F.col("doc_id").alias("key"), F.struct((-F.col("n_chars")).alias("x"), "doc_id").alias("o"), F.lit("fts").alias("backend"))
    b = t.documents.where(F.col("source").isin("src1", "src2", "src3", "src4")).orderBy(F.col("n_chars") % 997, "doc_id").limit(limit).select(F.col("doc_id").alias("key"), F.struct((F.col("n_chars") % 997).alias("x"), "doc_id").alias("o"), F.lit("semantic").alias("backend"))
    w = Window.partitionBy("backend").orderBy("o")
    return a.unionByName(b).select("key", "backend", F.row_number().over(w).cast("long").alias("rank"))


_RANK60 = f"{_LISTS}, cut AS (SELECT * FROM lists WHERE rank <= 60)"


@query("rank_hits", f"WITH {_RANK60} SELECT * FROM cut")
def rank_hits(t):
    return ranked_lists(t)


@query("hybrid_rrf", f"WITH {_RANK60} SELECT key, max(rank) FILTER (backend = 'fts') AS fts_rank, max(rank) FILTER (backend = 'semantic') AS semantic_rank, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM cut GROUP BY key")
def hybrid_rrf(t):
    r = ranked_lists(t)
    f = r.where("backend = 'fts'").select("key", F.col("rank").alias("fts_rank"))
    s = r.where("backend = 'semantic'").select("key", F.col("rank").alias("semantic_rank"))
    part = lambda c: F.coalesce(1.0 / (60 + F.col(c)), F.lit(0.0))
    return f.join(s, "key", "full_outer").withColumn("score", F.round(part("fts_rank") + part("semantic_rank"), 9))


@query("rrf_sum", f"WITH {_RANK60} SELECT key, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score, list_sort(list(DISTINCT backend)) AS backends, min(rank) AS best_rank FROM cut GROUP BY key")
def rrf_sum(t):
    return R.rrf(ranked_lists(t))


@query("hybrid_order", f"WITH {_RANK60} SELECT key, row_number() OVER (ORDER BY score DESC, f, s, key) AS position FROM (SELECT key, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score, coalesce(max(rank) FILTER (backend = 'fts'), 1000000) AS f, coalesce(max(rank) FILTER (backend = 'semantic'), 1000000) AS s FROM cut GROUP BY key) ORDER BY position LIMIT 30")
def hybrid_order(t):
    rows = hybrid_rrf(t).orderBy(F.desc("score"), F.coalesce("fts_rank", F.lit(1000000)), F.coalesce("semantic_rank", F.lit(1000000)), "key").limit(30)
    w = Window.orderBy(F.desc("score"), F.coalesce("fts_rank", F.lit(1000000)), F.coalesce("semantic_rank", F.lit(1000000)), "key")  # over the 30 rows
    return rows.select("key", F.row_number().over(w).cast("long").alias("position"))


_HASH = "h AS (SELECT vec_id AS k, list_sum([CASE WHEN embedding[i] > 0 THEN (1::BIGINT << (i - 1)) ELSE 0::BIGINT END for i in range(1, 61)])::BIGINT AS h FROM embeddings)"


def _hashes(t):
    # the first component is the lowest bit
    return t.embeddings.select("vec_id", F.aggregate(F.reverse(F.transform(F.slice("embedding", 1, 60), lambda x: F.when(x > 0, F.lit(1).cast("long")).otherwise(F.lit(0).cast("long")))), F.lit(0).cast("long"), lambda s, b: s * 2 + b).alias("h"))


@query("hamming_pairs", f"WITH {_HASH}, c AS (SELECT h, min(k) AS k, count(*) AS n FROM h GROUP BY h) SELECT x.k AS a, y.k AS b, bit_count(xor(x.h, y.h)) AS distance, x.n AS n_a, y.n AS n_b FROM c x JOIN c y ON x.k < y.k AND bit_count(xor(x.h, y.h)) <= 5 UNION ALL SELECT c.k, h.k, bit_count(xor(c.h, h.h)), c.n, c.n FROM c JOIN h ON c.h = h.h AND c.k < h.k")
def hamming_pairs(t):
    """Pairs of the vectors' classes of equal hashes, by their least members, with the classes' sizes; and each class's other members beside its least, at distance 0."""
    hashes = _hashes(t)
    return R.hamming_pairs(hashes, "vec_id", "h").unionByName(R.class_members(hashes, "vec_id", "h"))


_L2 = "list_sum([(a.embedding[i]::DOUBLE - b.embedding[i]::DOUBLE) ** 2 for i in range(1, 65)])"


@query("knn_exact", f"SELECT query, vec_id, distance, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY distance, vec_id) AS rank FROM (SELECT b.vec_id AS query, a.vec_id, round({_L2}, 6) AS distance FROM embeddings a, embeddings b WHERE b.vec_id % 100 = 0)) WHERE rank <= 10")
def knn_exact(t):
    """The queries are all vectors whose id is divisible by 100."""
    return R.nearest(t.embeddings, t.embeddings.where("vec_id % 100 = 0").select(F.col("vec_id").alias("q"), F.col("embedding").alias("qv")), "vec_id", "embedding", "q", "qv", 10)


@query("medoid_assign", "SELECT vec_id, medoid, similarity FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY similarity DESC, medoid) AS rn FROM (SELECT a.vec_id, b.vec_id AS medoid, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS similarity FROM embeddings a, embeddings b WHERE b.vec_id < 8)) WHERE rn = 1")
def medoid_assign(t):
    return R.assign(t.embeddings, t.embeddings.where("vec_id < 8").select(F.col("vec_id").alias("medoid"), F.col("embedding").alias("mv")), "vec_id", "embedding", "medoid", "mv")


@query("scoped_search", "SELECT doc_id, source FROM documents WHERE source IN ('src2', 'src9') AND contains(lower(text), 'license')")
def scoped_search(t):
    """Scopes restrict by a semi join; an empty list of scopes restricts nothing."""
    scopes = ["src2", "src9"]
    hits = t.documents.where(F.contains(F.lower("text"), F.lit("license")))
    return (hits.where(F.col("source").isin(scopes)) if scopes else hits).select("doc_id", "source")


@query("medoid_vectors", "SELECT label AS album, vec_id AS medoid, round(embedding[1]::DOUBLE, 6) AS x FROM (SELECT label, unnest([min(vec_id), max(vec_id), -1]) AS m FROM embeddings GROUP BY label) JOIN embeddings USING (label) WHERE vec_id = m")
def medoid_vectors(t):
    albums = t.embeddings.groupBy("label").agg(F.array(F.min("vec_id"), F.max("vec_id"), F.lit(-1).cast("long")).alias("ms")).select("label", F.explode("ms").alias("vec_id"))
    return albums.join(t.embeddings, ["label", "vec_id"]).select(F.col("label").alias("album"), F.col("vec_id").alias("medoid"), F.round(F.element_at("embedding", 1).cast("double"), 6).alias("x")).distinct()


@query("inventory_order", duck("SELECT * FROM (SELECT DISTINCT 0 AS kind, root_label, split_part(relative_path, '/', 1) AS path FROM items UNION ALL SELECT 1, root_label, relative_path FROM items) ORDER BY kind, len(string_split(path, '/')), path, root_label", "items"))
def inventory_order(t):
    i = t.items()
    folders = i.select(F.lit(0).alias("kind"), "root_label", F.substring_index("relative_path", "/", 1).alias("path")).distinct()
    return folders.union(i.select(F.lit(1), "root_label", "relative_path")).orderBy("kind", F.size(F.split("path", "/")), "path", "root_label")


@query("truncate_report", "SELECT source, count(*) AS total, list_slice(list_sort(list(doc_id)), 1, 100) AS first, count(*) > 100 AS truncated FROM documents GROUP BY source")
def truncate_report(t):
    """The least 100 per group with the totals: ranks cut the rows before they are gathered."""
    w = Window.partitionBy("source").orderBy("doc_id")
    first = t.documents.select("source", "doc_id").withColumn("rn", F.row_number().over(w)).where("rn <= 100").groupBy("source").agg(F.array_sort(F.collect_list("doc_id")).alias("first"))
    total = t.documents.groupBy("source").agg(F.count(F.lit(1)).alias("total"))
    return total.join(first, "source").select("source", "total", "first", (F.col("total") > 100).alias("truncated"))


@query("all_chunks", duck("SELECT chunk_id AS id, body, content_type FROM chunks UNION ALL SELECT 'conv_' || conv_id || '_' || turn, text, 'media_caption' FROM conversations", "chunks"))
def all_chunks(t):
    media = t.conversations.select(F.concat_ws("_", F.lit("conv"), "conv_id", "turn").alias("id"), F.col("text").alias("body"), F.lit("media_caption").alias("content_type"))
    return t.chunks().select(F.col("chunk_id").alias("id"), "body", "content_type").unionByName(media, allowMissingColumns=True)


@query("set_difference", "SELECT c_custkey AS k FROM customer EXCEPT ALL SELECT o_custkey FROM orders")
def set_difference(t):
    return t.customer.select(F.col("c_custkey").alias("k")).exceptAll(t.orders.select(F.col("o_custkey").alias("k")))


@query("set_intersect", "SELECT c_custkey AS k FROM customer WHERE c_acctbal > 0 INTERSECT SELECT o_custkey FROM orders")
def set_intersect(t):
    return t.customer.where("c_acctbal > 0").select(F.col("c_custkey").alias("k")).intersect(t.orders.select(F.col("o_custkey").alias("k")))


@query("distinct_refs", "SELECT o_custkey, list_sort(list(DISTINCT o_orderpriority)) AS refs FROM orders GROUP BY o_custkey")
def distinct_refs(t):
    return t.orders.groupBy("o_custkey").agg(F.array_sort(F.collect_set("o_orderpriority")).alias("refs"))
