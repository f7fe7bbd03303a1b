"""Streaming, extension points, admin and plumbing: sections 2.10 to 2.13 of the survey."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lodestrata import schema
from lodestrata.functions import columns as C
from lodestrata.functions.embedders import embedder_udf, hashing_model, summary_udf
from lodestrata.plans.inventory import _FILES, _media
from lodestrata.plans.registry import query
from lodestrata.session import shared_dir
from lodestrata.sources.views import _SPACE, duck, sid
from lodestrata.streaming import events as S


@query("x_stream_window", "SELECT date_trunc('day', ts)::TIMESTAMP AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def x_stream_window(t):
    """The stream drained once: its last result equals the batch's."""
    folder = f"{t.sf_dir}/events.parquet"
    to = f"{shared_dir(t.spark)}/stream-{uuid.uuid4().hex}"
    done = S.drain(S.windowed(S.event_stream(t.spark, folder)), f"{to}/windows", f"{to}/checkpoint")
    return done.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("udf_summary")
def udf_summary(t):
    """A stub generator behind the summary seam; every seventh prompt fails and stays null."""

    def generate(prompt: str) -> str:
        if len(prompt) % 7 == 0:
            raise ValueError("no answer")
        return prompt.split(".")[0][:60]

    return t.documents.select("doc_id", summary_udf(generate)("text").alias("summary"))


@query("udf_embed")
def udf_embed(t):
    return t.documents.select("doc_id", embedder_udf(hashing_model)("text").alias("vector"))


@query("observe_metrics", "SELECT count(*) AS planned, count_if(n_chars > 1000) AS large, sum(n_chars)::BIGINT AS chars FROM documents")
def observe_metrics(t):
    """Counters that the engine gathers while another action runs."""
    from pyspark.sql import Observation

    seen = Observation(f"progress-{uuid.uuid4().hex}")
    t.documents.observe(seen, F.count(F.lit(1)).alias("planned"), F.count_if(F.col("n_chars") > 1000).alias("large"), F.sum("n_chars").alias("chars")).write.format("noop").mode("overwrite").save()
    got = seen.get
    return t.spark.createDataFrame([(got["planned"], got["large"], got["chars"])], "planned long, large long, chars long")


@query("chunk_udtf", "SELECT doc_id, i::INTEGER AS pos, l[i + 1] AS line FROM (SELECT doc_id, l, unnest(range(len(l))) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))")
def chunk_udtf(t):
    """A row to rows, as a generator inside the JVM."""
    return t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))


@query("schema_registry", " UNION ALL ".join(f"SELECT '{d}' AS dataset, '{n}' AS table_name, {len(c)} AS n_columns, '{k}' AS key_column" for (d, n), (k, c) in schema.TABLES.items()))
def schema_registry(t):
    rows = [(d, n, len(schema.struct(d, n).fields), next(f.name for f in schema.struct(d, n) if not f.nullable)) for d, n in schema.TABLES]
    return t.spark.createDataFrame(rows, "dataset string, table_name string, n_columns int, key_column string")


@query("entity_link", f"SELECT {sid('link', 'o_custkey', 'o_orderkey')} AS link_id, o_custkey AS entity_id, 'orders.' || o_orderkey AS ref, CASE o_orderstatus WHEN 'O' THEN 'proposed' WHEN 'F' THEN 'accepted' ELSE 'deferred' END AS status FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def entity_link(t):
    known = t.customer.where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"))
    status = F.when(F.col("o_orderstatus") == "O", "proposed").when(F.col("o_orderstatus") == "F", "accepted").otherwise("deferred")
    return t.orders.join(known, "o_custkey", "left_semi").select(C.stable_id("link", "o_custkey", "o_orderkey").alias("link_id"), F.col("o_custkey").alias("entity_id"), F.concat(F.lit("orders."), "o_orderkey").alias("ref"), status.alias("status"))


@query("review_apply", "SELECT o_orderkey, CASE WHEN d.decision IS NOT NULL THEN d.decision ELSE o_orderstatus END AS status FROM orders LEFT JOIN (SELECT l_orderkey, max(CASE l_returnflag WHEN 'R' THEN 'rejected' WHEN 'A' THEN 'accepted' END) AS decision FROM lineitem WHERE l_linenumber = 1 GROUP BY l_orderkey) d ON l_orderkey = o_orderkey")
def review_apply(t):
    decided = F.when(F.col("l_returnflag") == "R", "rejected").when(F.col("l_returnflag") == "A", "accepted")
    d = t.lineitem.where("l_linenumber = 1").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max(decided).alias("decision"))
    return t.orders.join(d, "o_orderkey", "left").select("o_orderkey", F.coalesce("decision", "o_orderstatus").alias("status"))


@query("document_upsert", "SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN 'failed' ELSE 'parsed' END AS status, CASE WHEN doc_id % 9 = 0 THEN CASE WHEN doc_id % 2 = 0 THEN 'old' END ELSE lang END AS language, CASE WHEN doc_id % 9 = 0 THEN CASE WHEN doc_id % 2 = 0 THEN 1 END ELSE len(string_split(text, chr(10))) END::INTEGER AS object_count FROM documents")
def document_upsert(t):
    """A success replaces a document's row; a failure changes its status alone."""
    d = F.col("doc_id")
    old = t.documents.where(d % 2 == 0).select("doc_id", F.lit("old").alias("old_language"), F.lit(1).alias("old_count"))
    new = t.documents.select("doc_id", "lang", F.size(F.split("text", "\n")).alias("n"), (d % 9 == 0).alias("failed"))
    both = new.join(old, "doc_id", "left")
    return both.select("doc_id", F.when(F.col("failed"), "failed").otherwise("parsed").alias("status"), F.when(F.col("failed"), F.col("old_language")).otherwise(F.col("lang")).alias("language"), F.when(F.col("failed"), F.col("old_count")).otherwise(F.col("n")).alias("object_count"))


@query("title_preview", f"SELECT page_id, coalesce(nullif(trim(regexp_extract(html, '<title>([^<]*)</title>', 1), ' '), ''), 'page ' || page_id) AS title, substr(trim(regexp_replace(html, '{_SPACE}', ' ', 'g'), ' '), 1, 500) AS preview FROM pages")
def title_preview(t):
    title = F.nullif(F.trim(F.regexp_extract("html", "<title>([^<]*)</title>", 1)), F.lit(""))
    return t.pages.select("page_id", F.coalesce(title, F.concat(F.lit("page "), "page_id")).alias("title"), F.substring(C.collapse_ws("html"), 1, 500).alias("preview"))


@query("media_dispatch", f"WITH {_FILES} SELECT doc_id, split_part(media_type, '/', 1) AS media_class, CASE WHEN media_type = 'model/obj' THEN 'current' WHEN media_type LIKE 'model/%' THEN 'deferred' ELSE 'current' END AS status FROM media WHERE regexp_matches(media_type, '^(image|video|model)/')")
def media_dispatch(t):
    """Each item goes to one extractor by its class; formats without one wait."""
    kind = F.substring_index("media_type", "/", 1)
    rows = _media(t).withColumn("media_class", kind)
    readable = rows.where(F.col("media_class").isin("image", "video") | (F.col("media_type") == "model/obj")).withColumn("status", F.lit("current"))
    waiting = rows.where((F.col("media_class") == "model") & (F.col("media_type") != "model/obj")).withColumn("status", F.lit("deferred"))
    return readable.unionByName(waiting).select("doc_id", "media_class", "status")


@query("observation_upsert", f"SELECT {sid('obs', 'conv_id', 'role')} AS observation_id, conv_id, role, max_by(text, turn) AS value FROM conversations GROUP BY conv_id, role")
def observation_upsert(t):
    last = t.conversations.groupBy("conv_id", "role").agg(F.max_by("text", "turn").alias("value"))
    return last.select(C.stable_id("obs", "conv_id", "role").alias("observation_id"), "conv_id", "role", "value")


@query("representative_manifest", duck("SELECT store, row_count, (SELECT count(*) FROM units WHERE kind = 'album_summary') AS albums FROM (SELECT 'lexical' AS store, count(*) AS row_count FROM units UNION ALL SELECT 'semantic', count(*) FROM units UNION ALL SELECT 'visual', count(*) FROM embeddings)", "units"))
def representative_manifest(t):
    u = t.units().agg(F.count(F.lit(1)).alias("row_count"), F.count_if(F.col("kind") == "album_summary").alias("albums"))
    text = u.select(F.explode(F.array(F.lit("lexical"), F.lit("semantic"))).alias("store"), "row_count", "albums")
    visual = t.embeddings.agg(F.count(F.lit(1)).alias("row_count")).crossJoin(u.select("albums"))  # one row each
    return text.unionByName(visual.select(F.lit("visual").alias("store"), "row_count", "albums"))


@query("registry_lookup", "SELECT l_orderkey, l_linenumber, o_orderstatus AS state FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey AND o_orderkey % 3 = 0")
def registry_lookup(t):
    """Point lookups of a whole plan in one join."""
    state = t.orders.where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderstatus").alias("state"))
    return t.lineitem.join(state, "l_orderkey", "left").select("l_orderkey", "l_linenumber", "state")


@query("status_pick", "SELECT user_id, min_by(event_id, CASE event_type WHEN 'error' THEN 0 ELSE 1 END * 1e12 + event_id) AS primary_event, CASE WHEN count_if(event_type = 'error') > 0 THEN 'failed' ELSE 'deferred' END AS status FROM events GROUP BY user_id")
def status_pick(t):
    failed = F.col("event_type") == "error"
    return t.events.groupBy("user_id").agg(F.min_by("event_id", F.struct(~failed, F.col("event_id"))).alias("primary_event"), F.when(F.bool_or(failed), "failed").otherwise("deferred").alias("status"))


@query("calibration_state", "SELECT user_id, coalesce(round(avg(value) FILTER (value >= 50), 6), 50.0::DOUBLE) AS tokens_per_sec, count_if(value >= 50) AS samples FROM events GROUP BY user_id")
def calibration_state(t):
    good = F.when(F.col("value") >= 50, F.col("value"))
    return t.events.groupBy("user_id").agg(F.coalesce(F.round(F.avg(good), 6), F.lit(50.0)).alias("tokens_per_sec"), F.count(good).alias("samples"))


@query("album_attrs", "SELECT label AS album, count(*) AS n_assets, min(vec_id) AS first_asset, string_agg(DISTINCT (vec_id % 3)::VARCHAR, ',' ORDER BY (vec_id % 3)::VARCHAR) AS classes FROM embeddings GROUP BY label")
def album_attrs(t):
    return t.embeddings.groupBy(F.col("label").alias("album")).agg(F.count(F.lit(1)).alias("n_assets"), F.min("vec_id").alias("first_asset"), F.array_join(F.array_sort(F.collect_set((F.col("vec_id") % 3).cast("string"))), ",").alias("classes"))
