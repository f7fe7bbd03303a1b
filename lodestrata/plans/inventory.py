"""Sources, sinks, predicates and identity: sections 2.1 and 2.2 of the survey."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrata.functions import columns as C
from lodestrata.operators import inventory as I
from lodestrata.plans.registry import query
from lodestrata.sources.views import duck, sid


@query("scan_inventory", duck("SELECT root_id, item_id, relative_path, size_bytes, sha256, media_type FROM items", "items"))
def scan_inventory(t):
    return t.items().select("root_id", "item_id", "relative_path", "size_bytes", "sha256", "media_type")


@query("scan_counters", duck("SELECT root_label, count(*) AS files, count(DISTINCT split_part(relative_path, '/', 1)) AS folders, count_if(media_type = 'text/html') AS excluded, count_if(size_bytes > 20000) AS too_large, sum(size_bytes)::BIGINT AS bytes FROM items GROUP BY ALL", "items"))
def scan_counters(t):
    folder = F.substring_index("relative_path", "/", 1)
    return t.items().groupBy("root_label").agg(F.count(F.lit(1)).alias("files"), F.countDistinct(folder).alias("folders"), F.count_if(F.col("media_type") == "text/html").alias("excluded"), F.count_if(F.col("size_bytes") > 20000).alias("too_large"), F.sum("size_bytes").alias("bytes"))


@query(
    "safeguard_budget",
    duck(
        """SELECT root_label, needed_files, needed_bytes, CASE WHEN needed_files IS NULL AND needed_bytes IS NULL THEN 'ok' ELSE 'deferred' END AS status FROM (
SELECT root_label, min(rf) FILTER (rf > 60) AS needed_files, min(rb)::BIGINT FILTER (rb > 120000) AS needed_bytes FROM (
SELECT root_label, count(*) OVER w AS rf, (sum(size_bytes) OVER w)::BIGINT AS rb FROM items WINDOW w AS (PARTITION BY root_label ORDER BY relative_path ROWS UNBOUNDED PRECEDING)) GROUP BY root_label)""".replace("min(rb)::BIGINT FILTER (rb > 120000)", "min(rb) FILTER (rb > 120000)"),
        "items",
    ),
)
def safeguard_budget(t):
    return I.safeguard(t.items(), "root_label", "relative_path", "size_bytes", 60, 120_000)


@query("glob_filter", duck(r"SELECT relative_path, root_label, regexp_matches(lower(relative_path), '^(.*/)?en/.*$') AS included, regexp_matches(lower(relative_path), '^(.*/)?.*1\.txt$') AS excluded FROM items", "items"))
def glob_filter(t):
    p = "relative_path"
    return t.items().select(p, "root_label", C.matches_any(p, ["**/en/**", "en/**"]).alias("included"), C.matches_any(p, ["**/*1.txt"]).alias("excluded"))


@query("content_sha256", "SELECT doc_id, sha256(text) AS sha256, octet_length(encode(text))::BIGINT AS size_bytes FROM documents")
def content_sha256(t):
    return t.documents.select("doc_id", F.sha2("text", 256).alias("sha256"), F.octet_length("text").cast("long").alias("size_bytes"))


_NAMES = ["a/photo.PNG", "clip.mp4", "part.obj", "notes.txt", "x.unknown", "noext", "b.tar.gz", "m.stl", "s.mp3", "p.pdf", "q/w.WEBP"]
_EXT = "CASE WHEN regexp_extract(lower(name), '[^/](\\.[^./]+)$', 1) = '' THEN '[none]' ELSE regexp_extract(lower(name), '[^/](\\.[^./]+)$', 1) END"
_MEDIA = f"CASE {_EXT} WHEN '.txt' THEN 'text/plain' WHEN '.png' THEN 'image/png' WHEN '.mp4' THEN 'video/mp4' WHEN '.obj' THEN 'model/obj' WHEN '.stl' THEN 'model/stl' WHEN '.mp3' THEN 'audio/mpeg' WHEN '.pdf' THEN 'application/pdf' WHEN '.gz' THEN 'application/x-tar' WHEN '.webp' THEN 'image/webp' ELSE 'application/octet-stream' END"
_FILES = f"files AS (SELECT doc_id, ([{', '.join(repr(n) for n in _NAMES)}])[(doc_id % {len(_NAMES)}) + 1] AS name FROM documents), media AS (SELECT *, {_EXT} AS extension, {_MEDIA} AS media_type FROM files)"


def _media(t):
    name = F.element_at(F.array(*map(F.lit, _NAMES)), (F.col("doc_id") % len(_NAMES) + 1).cast("int"))
    files = t.documents.select("doc_id", name.alias("name"))
    return files.select("doc_id", "name", C.extension("name").alias("extension"), C.media_type("name").alias("media_type"))


@query("media_type_infer", f"WITH {_FILES} SELECT * FROM media")
def media_type_infer(t):
    return _media(t)


@query("select_documents", f"WITH {_FILES} SELECT doc_id, name FROM media WHERE NOT regexp_matches(media_type, '^(image|video|audio|model)/')")
def select_documents(t):
    return _media(t).where(~F.col("media_type").rlike("^(image|video|audio|model)/")).select("doc_id", "name")


@query("select_media", f"WITH {_FILES} SELECT doc_id, name, split_part(media_type, '/', 1) AS media_class FROM media WHERE regexp_matches(media_type, '^(image|video|model)/')")
def select_media(t):
    return _media(t).where(F.col("media_type").rlike("^(image|video|model)/")).select("doc_id", "name", F.substring_index("media_type", "/", 1).alias("media_class"))


@query("select_images", f"WITH {_FILES} SELECT doc_id, {sid('asset', 'doc_id', 'name')} AS asset_id FROM media WHERE media_type LIKE 'image/%'")
def select_images(t):
    return _media(t).where(F.col("media_type").startswith("image/")).select("doc_id", C.stable_id("asset", "doc_id", "name").alias("asset_id"))


@query(
    "parse_documents",
    r"""SELECT page_id, trim(regexp_replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '\s+', ' ', 'g'), ' ') AS title,
trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'), ' ') AS body FROM pages""",
)
def parse_documents(t):
    """The built-in HTML converter: markup and scripts go, white space collapses."""
    bare = F.regexp_replace(F.regexp_replace("html", r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " "), "<[^>]*>", " ")
    one = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    return t.pages.select("page_id", one(F.regexp_extract("html", "<title>([^<]*)</title>", 1)).alias("title"), one(bare).alias("body"))


@query("parse_preflight", "SELECT doc_id, CASE WHEN octet_length(encode(text)) > 8000 THEN 'document_too_large' WHEN length(text) - length(replace(text, chr(10), '')) > 20 THEN 'document_too_many_pages' ELSE 'ok' END AS verdict FROM documents")
def parse_preflight(t):
    lines = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit("")))
    return t.documents.select("doc_id", F.when(F.octet_length("text") > 8000, "document_too_large").when(lines > 20, "document_too_many_pages").otherwise("ok").alias("verdict"))


@query("gps_decimal", "SELECT doc_id, round((CASE WHEN doc_id % 2 = 0 THEN -1 ELSE 1 END) * ((doc_id % 90) + (doc_id % 60) / 60.0::DOUBLE + (n_chars % 60) / 3600.0::DOUBLE), 7) AS latitude, round(n_chars * 1000.0::DOUBLE / 1e6, 3) AS megapixels FROM documents")
def gps_decimal(t):
    d = F.col("doc_id")
    sign = F.when(d % 2 == 0, -1).otherwise(1)
    return t.documents.select("doc_id", F.round(sign * (d % 90 + (d % 60) / F.lit(60.0) + (F.col("n_chars") % 60) / F.lit(3600.0)), 7).alias("latitude"), F.round(F.col("n_chars") * 1000.0 / 1e6, 3).alias("megapixels"))


@query("video_fields", "SELECT event_id, round(value * 1000 / 1000.0, 3) AS duration_s, strftime(ts, '%Y-%m-%d %H:%M:%S')::TIMESTAMP AS captured_at, CASE WHEN event_type = 'view' THEN 'Video' END AS track FROM events")
def video_fields(t):
    shown = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    tracks = F.array(F.struct(F.lit("General").alias("type")), F.struct(F.when(F.col("event_type") == "view", "Video").otherwise("Audio").alias("type")))
    first = F.try_element_at(F.filter(tracks, lambda x: x["type"] == "Video"), F.lit(1))["type"]
    parsed = F.coalesce(F.try_to_timestamp(shown, F.lit("yyyy:MM:dd HH:mm:ss")), F.try_to_timestamp(shown, F.lit("yyyy-MM-dd HH:mm:ss")))
    return t.events.select("event_id", F.round(F.col("value") * 1000 / 1000.0, 3).alias("duration_s"), parsed.cast("timestamp_ntz").alias("captured_at"), first.alias("track"))


@query(
    "obj_stats",
    """WITH l AS (SELECT vec_id, unnest(['v ' || embedding[1]::DECIMAL(9,4) || ' ' || embedding[2]::DECIMAL(9,4) || ' 0', 'v 1 2 0', 'vn 0 0 1', 'vt 0 0', 'f 1 2 1']) AS line FROM embeddings)
SELECT vec_id, count_if(line LIKE 'v %') AS vertices, count_if(line LIKE 'vn %') AS normals, count_if(line LIKE 'f %') AS faces, round(min(split_part(line, ' ', 2)::DOUBLE) FILTER (line LIKE 'v %'), 6) AS min_x, round(max(split_part(line, ' ', 3)::DOUBLE) FILTER (line LIKE 'v %'), 6) AS max_y FROM l GROUP BY vec_id""",
)
def obj_stats(t):
    e = lambda i: F.element_at("embedding", i).cast("double").cast("decimal(9,4)").cast("string")
    text = F.concat(F.lit("v "), e(1), F.lit(" "), e(2), F.lit(" 0\nv 1 2 0\nvn 0 0 1\nvt 0 0\nf 1 2 1"))
    lines = t.embeddings.select("vec_id", F.explode(F.split(text, "\n")).alias("line"))
    part = lambda i: F.when(F.col("line").startswith("v "), F.try_element_at(F.split("line", " "), F.lit(i)).cast("double"))
    return lines.groupBy("vec_id").agg(F.count_if(F.col("line").startswith("v ")).alias("vertices"), F.count_if(F.col("line").startswith("vn ")).alias("normals"), F.count_if(F.col("line").startswith("f ")).alias("faces"), F.round(F.min(part(2)), 6).alias("min_x"), F.round(F.max(part(3)), 6).alias("max_y"))


@query("stl_stats", "SELECT vec_id, (1 + vec_id % 3)::BIGINT AS faces, (3 * (1 + vec_id % 3))::BIGINT AS vertices, true AS is_binary FROM embeddings")
def stl_stats(t):
    """Binary STL: 80 header bytes, a little-endian count n, and exactly 50 n bytes."""
    faces = F.col("vec_id") % 3 + 1
    raw = F.unhex(F.concat(F.repeat(F.lit("00"), F.lit(80)), F.lpad(F.hex(faces), 2, "0"), F.lit("000000"), F.repeat(F.lit("00"), (faces * 50).cast("int"))))
    n = F.conv(F.hex(F.substring(F.col("raw"), 81, 1)), 16, 10).cast("long")
    return t.embeddings.select("vec_id", raw.alias("raw")).select("vec_id", n.alias("faces"), (n * 3).alias("vertices"), (F.length("raw") == n * 50 + 84).alias("is_binary"))


@query("catalog_roundtrip", "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def catalog_roundtrip(t):
    return t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_name", "r_name")


_OLD = "old AS (SELECT c_custkey AS id, c_name AS name, c_acctbal AS balance, 1 AS created_gen FROM customer WHERE c_custkey % 3 <> 0), new AS (SELECT c_custkey AS id, c_name AS name, c_acctbal + 1 AS balance, 2 AS created_gen FROM customer WHERE c_custkey % 2 = 0)"


def _versions(t):
    c = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"))
    return c.where("id % 3 <> 0").withColumn("created_gen", F.lit(1)), c.where("id % 2 = 0").withColumn("balance", F.col("balance") + 1).withColumn("created_gen", F.lit(2))


@query("upsert_registry", f"WITH {_OLD} SELECT coalesce(o.id, n.id) AS id, coalesce(n.name, o.name) AS name, coalesce(n.balance, o.balance) AS balance, coalesce(o.created_gen, n.created_gen) AS created_gen FROM old o FULL JOIN new n ON o.id = n.id")
def upsert_registry(t):
    return I.upsert(*_versions(t), "id", keep=("created_gen",))


@query("insert_ignore", f"WITH {_OLD} SELECT * FROM old UNION ALL SELECT * FROM new WHERE id NOT IN (SELECT id FROM old)")
def insert_ignore(t):
    return I.insert_ignore(*_versions(t), "id")


@query("replace_children", "WITH new AS (SELECT l_orderkey, l_linenumber, l_quantity + 1 AS l_quantity FROM lineitem WHERE l_orderkey % 5 = 0 AND l_linenumber = 1) SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey NOT IN (SELECT l_orderkey FROM new) UNION ALL SELECT * FROM new")
def replace_children(t):
    old = t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity")
    new = old.where("l_orderkey % 5 = 0 AND l_linenumber = 1").withColumn("l_quantity", F.col("l_quantity") + 1)
    return I.replace_children(old, new, "l_orderkey")


@query("blob_dedupe", "SELECT 'blob_' || substr(sha256(text), 1, 32) AS blob_id, count(*) AS refs, min(doc_id) AS first_seen, max(doc_id) AS last_seen, max(octet_length(encode(text)))::BIGINT AS size_bytes, CASE WHEN max(octet_length(encode(text))) >= 32768 THEN 'zstd' ELSE 'none' END AS compression, CASE WHEN max(octet_length(encode(text))) > 524288 THEN 'external' ELSE 'inline' END AS storage_mode FROM documents GROUP BY sha256(text)")
def blob_dedupe(t):
    rows = t.documents.select("doc_id", F.sha2("text", 256).alias("sha"), F.octet_length("text").cast("long").alias("size"))
    size = F.max("size")
    return rows.groupBy("sha").agg(F.count(F.lit(1)).alias("refs"), F.min("doc_id").alias("first_seen"), F.max("doc_id").alias("last_seen"), size.alias("size_bytes")).select(F.concat(F.lit("blob_"), F.substring("sha", 1, 32)).alias("blob_id"), "refs", "first_seen", "last_seen", "size_bytes", F.when(F.col("size_bytes") >= 32768, "zstd").otherwise("none").alias("compression"), F.when(F.col("size_bytes") > 524288, "external").otherwise("inline").alias("storage_mode"))


@query("fts_postings", duck("SELECT source AS scope_id, term, doc_id, count(*) AS tf FROM toks GROUP BY ALL", "toks"))
def fts_postings(t):
    from lodestrata.operators.lexical import postings

    return postings(t.documents, "source", "doc_id", "text").select(F.col("source").alias("scope_id"), "term", "doc_id", "tf")


@query("vector_store_build", "SELECT vec_id, label AS scope_id, 'img64' AS profile, len(embedding) AS dimension, round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS norm FROM embeddings")
def vector_store_build(t):
    return t.embeddings.select("vec_id", F.col("label").alias("scope_id"), F.lit("img64").alias("profile"), F.size("embedding").cast("long").alias("dimension"), F.round(F.sqrt(C.dot("embedding", "embedding")), 6).alias("norm"))


@query("run_events_log", "SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, count_if(event_type = 'signup') AS started, count_if(event_type = 'purchase') AS completed, count(*) AS n FROM events GROUP BY ALL")
def run_events_log(t):
    return t.events.groupBy("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count_if(F.col("event_type") == "signup").alias("started"), F.count_if(F.col("event_type") == "purchase").alias("completed"), F.count(F.lit(1)).alias("n"))


@query("page_table", "SELECT *, (SELECT count(*) FROM customer WHERE c_name ILIKE '%1%' OR c_mktsegment ILIKE '%1%') AS total FROM (SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_name ILIKE '%1%' OR c_mktsegment ILIKE '%1%' ORDER BY c_name, c_custkey LIMIT 25 OFFSET 25)")
def page_table(t):
    """A page of a table: substring search over declared columns, sorted, with the total."""
    hits = t.customer.where(F.col("c_name").ilike("%1%") | F.col("c_mktsegment").ilike("%1%"))
    page = hits.select("c_custkey", "c_name", "c_mktsegment").orderBy("c_name", "c_custkey").offset(25).limit(25)
    return page.crossJoin(hits.agg(F.count(F.lit(1)).alias("total")))  # one row


@query("stable_ids", duck("SELECT root_label, root_id, scope_id FROM roots", "roots"))
def stable_ids(t):
    return t.roots().select("root_label", "root_id", "scope_id")


_REFS = "(SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'broken..ref' WHEN doc_id % 7 = 0 THEN 'a.b' ELSE 'corpus_cache.documents.' || doc_id END AS ref FROM documents)"


def _refs(t):
    d = F.col("doc_id")
    return t.documents.select("doc_id", F.when(d % 5 == 0, "broken..ref").when(d % 7 == 0, "a.b").otherwise(F.concat(F.lit("corpus_cache.documents."), d)).alias("ref"))


@query("ref_parse", rf"SELECT doc_id, ref, CASE WHEN ok THEN split_part(ref, '.', 1) END AS dataset, CASE WHEN ok THEN split_part(ref, '.', 2) END AS table_name, CASE WHEN ok THEN split_part(ref, '.', 3) END AS row_id FROM (SELECT *, regexp_full_match(ref, '[^.]+\.[^.]+\.[^.]+') AS ok FROM {_REFS})")
def ref_parse(t):
    p = C.parse_ref("ref")
    return _refs(t).select("doc_id", "ref", p["dataset"].alias("dataset"), p["table"].alias("table_name"), p["row_id"].alias("row_id"))


@query("ref_resolve", f"SELECT r.doc_id, ref, d.lang FROM {_REFS} r LEFT JOIN documents d ON r.ref = 'corpus_cache.documents.' || d.doc_id")
def ref_resolve(t):
    there = t.documents.select(F.concat(F.lit("corpus_cache.documents."), "doc_id").alias("ref"), "lang")
    return _refs(t).join(there, "ref", "left").select("doc_id", "ref", "lang")


@query("hit_refs", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'kept.' || doc_id WHEN doc_id % 4 <> 0 THEN 'corpus_cache.document_objects.obj_' || doc_id END AS ref FROM documents")
def hit_refs(t):
    d = F.col("doc_id")
    rows = t.documents.select("doc_id", F.when(d % 3 == 0, F.concat(F.lit("kept."), d)).otherwise("").alias("ref"), F.when(d % 4 != 0, F.concat(F.lit("obj_"), d)).otherwise("").alias("object_id"))
    return rows.select("doc_id", F.coalesce(F.nullif("ref", F.lit("")), C.evidence_ref("corpus_cache", "document_objects", "object_id")).alias("ref"))


_DIFF = "SELECT coalesce(p.item_id, n.item_id) AS item_id, CASE WHEN n.item_id IS NULL THEN 'deleted' WHEN p.item_id IS NULL THEN 'current' WHEN p.size_bytes = n.size_bytes AND p.sha256 = n.sha256 AND p.media_type = n.media_type THEN 'unchanged' ELSE 'changed' END AS status FROM items_before p FULL JOIN items n ON p.item_id = n.item_id"


@query("inventory_diff", duck(_DIFF, "items", "items_before"))
def inventory_diff(t):
    return I.classify_changes(t.items_before(), t.items())


@query("inventory_deleted", duck("SELECT item_id FROM items_before WHERE item_id NOT IN (SELECT item_id FROM items)", "items", "items_before"))
def inventory_deleted(t):
    return t.items_before().join(t.items(), "item_id", "left_anti").select("item_id")


@query("inventory_write_counts", duck(f"SELECT status, count(*) AS n FROM ({_DIFF}) GROUP BY status", "items", "items_before"))
def inventory_write_counts(t):
    return I.classify_changes(t.items_before(), t.items()).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("content_type_map", "WITH k AS (SELECT doc_id, (['paragraph','Figure','table','list','chart','codeblock'])[doc_id % 6 + 1] AS kind FROM documents) SELECT doc_id, CASE WHEN lower(kind) IN ('paragraph','section','table','codeblock','formula') THEN lower(kind) WHEN lower(kind) IN ('caption','figure','image','diagram','chart') THEN 'figure_caption' ELSE 'plain_text' END AS content_type FROM k")
def content_type_map(t):
    kind = F.element_at(F.array(*map(F.lit, ["paragraph", "Figure", "table", "list", "chart", "codeblock"])), (F.col("doc_id") % 6 + 1).cast("int"))
    return t.documents.select("doc_id", C.content_type(kind).alias("content_type"))


#: Messages of converters, one or more of each kind.
_ERRORS = [
    "ValueError Incorrect password", "PdfError file is encrypted, password needed", "the password field is empty", "std::bad_alloc", "MemoryError ", "RuntimeError Cannot allocate 3 GB", "ConversionTimeout gave up",
    "document processing time exceeded", "max_num_pages is 100", "over the page limit", "max_file_size is 20 MB", "file is over the size limit", "page limit and file size limit", "format skipped", "input is not valid", "the file cannot be opened", "weird", "",
]
_MESSAGES = f"e AS (SELECT doc_id, ([{', '.join(repr(e) for e in _ERRORS)}])[doc_id % {len(_ERRORS)} + 1] AS message FROM documents), k AS (SELECT *, lower(message) AS m FROM e)"
_ERR_SQL = f"""{_MESSAGES}, errors AS (SELECT doc_id, message, CASE
WHEN contains(m, 'password') AND (contains(m, 'incorrect') OR contains(m, 'encrypted')) THEN 'pdf_password_required'
WHEN regexp_matches(m, 'bad_alloc|memoryerror|out of memory|cannot allocate') THEN 'resource_exhausted_memory'
WHEN regexp_matches(m, 'timeout|document processing time') THEN 'document_timeout'
WHEN contains(m, 'max_num_pages') OR (contains(m, 'page') AND contains(m, 'limit')) THEN 'document_too_many_pages'
WHEN contains(m, 'max_file_size') OR (contains(m, 'file') AND contains(m, 'size') AND contains(m, 'limit')) THEN 'document_too_large'
WHEN contains(m, 'skipped') THEN 'docling_skipped'
WHEN regexp_matches(m, 'not valid|cannot be opened') THEN 'docling_input_invalid'
ELSE 'docling_convert_failed' END AS error_kind FROM k)"""


def _errors(t):
    message = F.element_at(F.array(*map(F.lit, _ERRORS)), (F.col("doc_id") % len(_ERRORS) + 1).cast("int"))
    return t.documents.select("doc_id", message.alias("message")).withColumn("error_kind", C.error_kind("message"))


@query("error_classify", f"WITH {_ERR_SQL} SELECT * FROM errors")
def error_classify(t):
    return _errors(t)


@query("failure_rows", f"WITH {_ERR_SQL} SELECT doc_id, error_kind, CASE WHEN error_kind IN ('pdf_password_required', 'docling_skipped', 'docling_input_invalid') THEN 'input' WHEN error_kind IN ('resource_exhausted_memory', 'document_timeout') THEN 'resource' WHEN error_kind = 'docling_convert_failed' THEN 'conversion' ELSE 'safeguard' END AS category, CASE WHEN error_kind IN ('resource_exhausted_memory', 'document_timeout', 'docling_convert_failed') THEN 'docling_fast_text' END AS retry_profile FROM errors")
def failure_rows(t):
    """Failures with their class and the profile to retry with, joined from a table of eight rows."""
    known = t.spark.createDataFrame([(k, *c) for k, c in C.FAILURE_CLASSES.items()], "error_kind string, category string, retry_profile string")
    return _errors(t).join(F.broadcast(known), "error_kind").select("doc_id", "error_kind", "category", "retry_profile")


@query("sanitize", r"SELECT page_id, substr(replace(trim(regexp_replace('Failed  at ' || url || ' :' || chr(10) || substr(html, 1, 400), '\s+', ' ', 'g'), ' '), url, 'page'), 1, 240) AS message FROM pages")
def sanitize(t):
    text = F.concat(F.lit("Failed  at "), "url", F.lit(" :\n"), F.substring("html", 1, 400))
    return t.pages.select("page_id", F.substring(F.replace(F.trim(F.regexp_replace(text, r"\s+", " ")), F.col("url"), F.lit("page")), 1, 240).alias("message"))


@query("kind_normalize", r"SELECT doc_id, CASE WHEN k IN ('the', 'is', 'and', 'of') THEN k ELSE 'other' END AS kind FROM (SELECT doc_id, regexp_extract(lower(text), '^\s*([a-z]+)', 1) AS k FROM documents)")
def kind_normalize(t):
    k = F.regexp_extract(F.lower("text"), r"^\s*([a-z]+)", 1)
    return t.documents.select("doc_id", F.when(k.isin("the", "is", "and", "of"), k).otherwise("other").alias("kind"))


@query("enum_validate", "SELECT o_orderkey, CASE WHEN o_orderstatus IN ('O', 'F') THEN o_orderstatus END AS status, CASE WHEN o_orderstatus NOT IN ('O', 'F') THEN 'invalid_status' END AS error_kind FROM orders")
def enum_validate(t):
    good = F.col("o_orderstatus").isin("O", "F")
    return t.orders.select("o_orderkey", F.when(good, F.col("o_orderstatus")).alias("status"), F.when(~good, "invalid_status").alias("error_kind"))


@query("alias_normalize", "SELECT c_custkey, lower(trim('  ' || c_name || ' ', ' ')) AS alias FROM customer")
def alias_normalize(t):
    return t.customer.select("c_custkey", F.lower(F.trim(F.concat(F.lit("  "), "c_name", F.lit(" ")))).alias("alias"))


@query("entity_list", "SELECT c_custkey AS entity_id, c_name AS name FROM customer WHERE c_mktsegment = 'BUILDING' ORDER BY c_custkey DESC LIMIT 100")
def entity_list(t):
    return t.customer.where("c_mktsegment = 'BUILDING'").orderBy(F.desc("c_custkey")).limit(100).select(F.col("c_custkey").alias("entity_id"), F.col("c_name").alias("name"))


@query("list_representatives", duck("SELECT root_id, count(*) AS n_units, string_agg(summary_id, ',' ORDER BY summary_id) AS units FROM units WHERE contains(root_id, 'src1') AND kind <> 'cluster' GROUP BY root_id", "units"))
def list_representatives(t):
    rows = t.units().where(F.contains("root_id", F.lit("src1")) & (F.col("kind") != "cluster"))
    return rows.groupBy("root_id").agg(F.count(F.lit(1)).alias("n_units"), F.array_join(F.array_sort(F.collect_list("summary_id")), ",").alias("units"))


_MARKS = "marks AS (SELECT source, sha256('v1' || string_agg(sha256(text), '' ORDER BY doc_id)) AS watermark, count(*) AS n_rows FROM documents GROUP BY source)"


def _marks(t):
    return I.digest(t.documents, ["source"], F.col("doc_id"), F.col("text"), "v1")


@query("high_watermark", f"WITH {_MARKS} SELECT * FROM marks")
def high_watermark(t):
    return _marks(t)


@query("stale_scopes", f"WITH {_MARKS}, registry AS (SELECT source, CASE WHEN right(source, 1) = '3' THEN 'old' ELSE watermark END AS stored, CASE WHEN right(source, 1) = '5' THEN 'failed' ELSE 'current' END AS status FROM marks WHERE source <> 'src7') SELECT source, CASE WHEN r.stored IS NULL THEN 'missing' WHEN status <> 'current' THEN status ELSE 'changed' END AS reason FROM marks m LEFT JOIN registry r USING (source) WHERE r.stored IS NULL OR status <> 'current' OR stored <> watermark")
def stale_scopes(t):
    marks = _marks(t)
    last = F.substring("source", -1, 1)
    registry = marks.where("source <> 'src7'").select("source", F.when(last == "3", "old").otherwise(F.col("watermark")).alias("stored"), F.when(last == "5", "failed").otherwise("current").alias("status"))
    both = marks.join(registry, "source", "left").where("stored IS NULL OR status <> 'current' OR NOT (stored <=> watermark)")
    return both.select("source", F.when(F.col("stored").isNull(), "missing").when(F.col("status") != "current", F.col("status")).otherwise("changed").alias("reason"))


@query("incremental_refresh", f"WITH {_MARKS} SELECT source, CASE WHEN right(source, 1) = '3' THEN n_rows ELSE 0 END AS rebuilt_rows FROM marks")
def incremental_refresh(t):
    """A rebuild writes the rows of changed scopes alone."""
    marks = _marks(t)
    stored = marks.select("source", F.when(F.substring("source", -1, 1) == "3", "old").otherwise(F.col("watermark")).alias("stored"))
    return marks.join(stored, "source").select("source", F.when(F.col("stored") == F.col("watermark"), 0).otherwise(F.col("n_rows")).cast("long").alias("rebuilt_rows"))


@query("weak_route", "SELECT source, list_filter(['few_hits', 'small_gap'], lambda r: (r = 'few_hits' AND n_refs < 3) OR (r = 'small_gap' AND gap < 0.1)) AS reasons FROM (SELECT source, count_if(doc_id % 20 = 0) AS n_refs, CASE WHEN count(*) > 1 THEN round((max(n_chars) - max(n_chars) FILTER (rn = 2)) / 10000.0::DOUBLE, 6) END AS gap FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rn FROM documents) GROUP BY source)")
def weak_route(t):
    from pyspark.sql import Window

    ranked = t.documents.withColumn("rn", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id")))
    rows = ranked.groupBy("source").agg(F.count_if(F.col("doc_id") % 20 == 0).alias("n_refs"), F.when(F.count(F.lit(1)) > 1, F.round((F.max("n_chars") - F.max(F.when(F.col("rn") == 2, F.col("n_chars")))) / F.lit(10000.0), 6)).alias("gap"))
    return rows.select("source", F.array_compact(F.array(F.when(F.col("n_refs") < 3, "few_hits"), F.when(F.col("gap") < 0.1, "small_gap"))).alias("reasons"))


@query("endpoint_policy", r"SELECT page_id, regexp_extract(url, '^[a-z]+://([^/:?#]*)', 1) AS host, regexp_extract(url, '^([a-z]+)://', 1) IN ('http', 'https') AND regexp_extract(url, '^[a-z]+://([^/:?#]*)', 1) IN ('localhost', '127.0.0.1', '::1') AS allowed FROM pages")
def endpoint_policy(t):
    host, scheme = F.try_parse_url("url", F.lit("HOST")), F.try_parse_url("url", F.lit("PROTOCOL"))
    return t.pages.select("page_id", host.alias("host"), (scheme.isin("http", "https") & host.isin("localhost", "127.0.0.1", "::1")).alias("allowed"))
