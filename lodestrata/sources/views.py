"""The engine's data model as lazy views over the stored tables; nothing is copied."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions.columns import collapse_ws, content_type, evidence_ref, media_type, stable_id


class Tables:
    """The tables of one folder, and the views over them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def index(self):
        """The lexical index of the documents; the first use builds it."""
        from lodestrata.operators.index import index_of

        return index_of(self.spark, f"{self.sf_dir}/documents.parquet")

    def roots(self) -> DataFrame:
        """root_label, root_id, scope_id of each source; one more for the pages."""
        labels = self.documents.select(F.col("source").alias("root_label")).distinct().union(self.spark.sql("SELECT 'pages'"))
        return labels.withColumn("root_id", stable_id("root", F.lit("folder"), "root_label")).withColumn("scope_id", stable_id("scope", "root_id", F.lit("root")))

    def items(self) -> DataFrame:
        """Source items: files of documents and pages, with identity, size, hash and type."""
        docs = self.documents.select(F.col("source").alias("root_label"), "doc_id", F.concat_ws("/", "lang", F.concat("doc_id", F.lit(".txt"))).alias("relative_path"), F.col("text").alias("body"))
        pages = self.pages.select(F.lit("pages").alias("root_label"), (-F.col("page_id") - 1).alias("doc_id"), F.concat(F.lit("Page/"), "page_id", F.lit(".html")).alias("relative_path"), F.col("html").alias("body"))
        rows = docs.unionByName(pages).withColumn("root_id", stable_id("root", F.lit("folder"), "root_label"))
        return rows.select(
            "root_label", "root_id", "doc_id", "relative_path",
            stable_id("item", "root_id", F.lower("relative_path")).alias("item_id"),
            F.octet_length("body").cast("long").alias("size_bytes"),
            F.sha2("body", 256).alias("sha256"),
            media_type("relative_path").alias("media_type"),
        )

    def items_before(self) -> DataFrame:
        """An earlier state of the items: some not there yet, some of another size, some gone since."""
        now = self.items().where(F.pmod("doc_id", F.lit(11)) != 0)
        changed = now.withColumn("size_bytes", F.when(F.pmod("doc_id", F.lit(7)) == 0, F.col("size_bytes") + 1).otherwise(F.col("size_bytes")))
        gone = self.items().where(F.pmod("doc_id", F.lit(13)) == 0).withColumn("item_id", F.concat("item_id", F.lit("x")))
        return changed.unionByName(gone)

    def objects(self) -> DataFrame:
        """The lines of documents as objects in order, typed by their shape."""
        lines = self.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("order_index", "text"))
        kind = F.when(F.contains("text", F.lit("|")), "table").when(F.length("text") < 20, "heading").otherwise("paragraph")
        return lines.where(F.trim("text") != "").select(stable_id("obj", "doc_id", "order_index").alias("object_id"), "doc_id", "order_index", "text", kind.alias("object_type"))

    def chunks(self) -> DataFrame:
        """Search units: objects with their document's item and root."""
        items = self.items().select("doc_id", "root_id", "root_label", "relative_path", F.col("sha256").alias("source_sha256"))
        rows = self.objects().join(items, "doc_id").join(F.broadcast(self.roots().select("root_id", "scope_id")), "root_id")  # sources are few: one row each
        return rows.select(
            stable_id("chunk", "object_id").alias("chunk_id"), "doc_id", "object_id", evidence_ref("corpus_cache", "document_objects", "object_id").alias("ref"),
            "scope_id", "root_label", "relative_path", "order_index", content_type("object_type").alias("content_type"), collapse_ws("text").alias("body"), "source_sha256",
        )

    def units(self) -> DataFrame:
        """Summary units of a root: some of the root or of an album, the others companions."""
        d = F.col("doc_id")
        kind = F.when(d % 50 == 0, "root_summary").when(d % 25 == 0, "album_summary").otherwise("cluster")
        return self.documents.select(
            F.concat(F.lit("u"), d).alias("summary_id"), F.col("source").alias("root_id"), F.col("lang").alias("scope_id"), kind.alias("kind"), F.substring("text", 1, 24).alias("title"), F.col("text").alias("summary"),
            (F.col("n_chars") % 40).alias("source_count"), F.when(d % 5 != 0, (d % 17) / F.lit(16.0)).alias("importance"), ((d % 13) / F.lit(12.0)).alias("coverage"),
        )


def sid(prefix: str, *parts: str) -> str:
    """stable_id() in DuckDB SQL."""
    return f"'{prefix}_' || substr(sha256({' || chr(0) || '.join(f'coalesce(({p})::VARCHAR, {chr(39) * 2})' for p in parts)}), 1, 32)"


_SPACE = r"[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
_CTES = {
    "roots": ((), f"SELECT root_label, root_id, {sid('scope', 'root_id', chr(39) + 'root' + chr(39))} AS scope_id FROM (SELECT root_label, {sid('root', chr(39) + 'folder' + chr(39), 'root_label')} AS root_id FROM (SELECT DISTINCT source AS root_label FROM documents UNION ALL SELECT 'pages'))"),
    "items": (
        (),
        f"""SELECT root_label, root_id, doc_id, relative_path, {sid("item", "root_id", "lower(relative_path)")} AS item_id, octet_length(encode(body))::BIGINT AS size_bytes, sha256(body) AS sha256, CASE WHEN relative_path LIKE '%.txt' THEN 'text/plain' ELSE 'text/html' END AS media_type
FROM (SELECT *, {sid("root", "'folder'", "root_label")} AS root_id FROM (SELECT source AS root_label, doc_id, lang || '/' || doc_id || '.txt' AS relative_path, text AS body FROM documents UNION ALL SELECT 'pages', -page_id - 1, 'Page/' || page_id || '.html', html FROM pages))""",
    ),
    "items_before": (
        ("items",),
        "SELECT root_label, root_id, doc_id, relative_path, item_id, size_bytes + CASE WHEN ((doc_id % 7) + 7) % 7 = 0 THEN 1 ELSE 0 END AS size_bytes, sha256, media_type FROM items WHERE ((doc_id % 11) + 11) % 11 <> 0 UNION ALL SELECT root_label, root_id, doc_id, relative_path, item_id || 'x', size_bytes, sha256, media_type FROM items WHERE ((doc_id % 13) + 13) % 13 = 0",
    ),
    "objects": (
        (),
        f"""SELECT {sid("obj", "doc_id", "order_index")} AS object_id, doc_id, order_index, text, CASE WHEN contains(text, '|') THEN 'table' WHEN length(text) < 20 THEN 'heading' ELSE 'paragraph' END AS object_type
FROM (SELECT doc_id, unnest(l) AS text, unnest(range(len(l)))::INTEGER AS order_index FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)) WHERE trim(text, ' ') <> ''""",
    ),
    "chunks": (
        ("roots", "items", "objects"),
        f"""SELECT {sid("chunk", "object_id")} AS chunk_id, o.doc_id, object_id, 'corpus_cache.document_objects.' || object_id AS ref, scope_id, i.root_label, relative_path, order_index, CASE object_type WHEN 'heading' THEN 'plain_text' ELSE object_type END AS content_type, trim(regexp_replace(text, '{_SPACE}', ' ', 'g'), ' ') AS body, sha256 AS source_sha256
FROM objects o JOIN items i ON i.doc_id = o.doc_id JOIN roots r ON r.root_id = i.root_id""",
    ),
    "units": (
        (),
        "SELECT 'u' || doc_id AS summary_id, source AS root_id, lang AS scope_id, CASE WHEN doc_id % 50 = 0 THEN 'root_summary' WHEN doc_id % 25 = 0 THEN 'album_summary' ELSE 'cluster' END AS kind, substr(text, 1, 24) AS title, text AS summary, n_chars % 40 AS source_count, CASE WHEN doc_id % 5 <> 0 THEN (doc_id % 17) / 16.0::DOUBLE END AS importance, (doc_id % 13) / 12.0::DOUBLE AS coverage FROM documents",
    ),
    "toks": ((), r"SELECT doc_id, source, unnest(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda t: t <> '' AND octet_length(encode(t)) <= 40)) AS term FROM documents"),
}


def duck(body: str, *needs: str) -> str:
    """body with the views it needs as common tables, in DuckDB SQL."""
    order: list[str] = []

    def add(name: str) -> None:
        for n in _CTES[name][0]:
            add(n)
        if name not in order:
            order.append(name)

    for n in needs:
        add(n)
    ctes = ", ".join(f"{n} AS (\n{_CTES[n][1]})" for n in order)
    body = body.strip()
    if not order:
        return body
    return f"WITH RECURSIVE {ctes}, {body[5:]}" if body.upper().startswith("WITH ") else f"WITH {ctes}\n{body}"
