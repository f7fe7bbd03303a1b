"""The logical tables: names, datasets, columns and keys. Types are declared, never inferred."""

from __future__ import annotations

from pyspark.sql import types as T

_KINDS = {"text": T.StringType(), "enum": T.StringType(), "json": T.StringType(), "timestamp": T.TimestampType(), "integer": T.LongType(), "real": T.DoubleType(), "blob": T.BinaryType(), "vector": T.ArrayType(T.FloatType())}

#: (dataset, table): (key, {column: kind}). The cache can be built anew; the state is durable.
TABLES: dict[tuple[str, str], tuple[str, dict[str, str]]] = {
    ("cache", "source_roots"): ("root_id", {"root_id": "text", "kind": "enum", "label": "text", "uri": "text", "first_seen_at": "timestamp", "last_seen_at": "timestamp"}),
    ("cache", "source_items"): ("item_id", {"item_id": "text", "root_id": "text", "parent_id": "text", "kind": "enum", "relative_path": "text", "media_type": "text", "size_bytes": "integer", "sha256": "text", "status": "enum"}),
    ("cache", "scopes"): ("scope_id", {"scope_id": "text", "root_id": "text", "label": "text"}),
    ("cache", "documents"): ("doc_id", {"doc_id": "text", "item_id": "text", "title": "text", "language": "text", "status": "enum", "parsed_at": "timestamp", "object_count": "integer"}),
    ("cache", "document_objects"): ("object_id", {"object_id": "text", "doc_id": "text", "object_type": "enum", "order_index": "integer", "text": "text", "attributes": "json"}),
    ("cache", "media_assets"): ("asset_id", {"asset_id": "text", "item_id": "text", "media_class": "enum", "status": "enum"}),
    ("cache", "media_observations"): ("observation_id", {"observation_id": "text", "asset_id": "text", "kind": "enum", "value": "text", "created_at": "timestamp"}),
    ("cache", "blobs"): ("blob_id", {"blob_id": "text", "sha256": "text", "storage_mode": "enum", "compression": "enum", "payload": "blob", "size_bytes": "integer"}),
    ("cache", "lexical_indexes"): ("index_id", {"index_id": "text", "scope_id": "text", "profile": "text", "watermark": "text", "status": "enum", "row_count": "integer"}),
    ("cache", "vector_stores"): ("store_id", {"store_id": "text", "scope_id": "text", "profile": "text", "watermark": "text", "status": "enum", "dimension": "integer"}),
    ("cache", "vectors"): ("chunk_id", {"chunk_id": "text", "scope_id": "text", "profile": "text", "vector": "vector"}),
    ("cache", "summary_units"): ("summary_id", {"summary_id": "text", "root_id": "text", "scope_id": "text", "kind": "enum", "summary_text": "text", "source_count": "integer", "coverage": "real", "importance": "real"}),
    ("cache", "near_duplicates"): ("pair_id", {"pair_id": "text", "left_id": "text", "right_id": "text", "distance": "integer"}),
    ("cache", "root_stats"): ("root_id", {"root_id": "text", "file_count": "integer", "total_bytes": "integer", "mean_bytes": "real"}),
    ("state", "entities"): ("entity_id", {"entity_id": "text", "kind": "enum", "name": "text", "status": "enum", "created_at": "timestamp"}),
    ("state", "entity_aliases"): ("alias_id", {"alias_id": "text", "entity_id": "text", "alias": "text", "normalised": "text"}),
    ("state", "entity_links"): ("link_id", {"link_id": "text", "entity_id": "text", "ref": "text", "role": "enum", "status": "enum", "source_sha256": "text"}),
    ("state", "entity_relationships"): ("relationship_id", {"relationship_id": "text", "subject_id": "text", "object_id": "text", "kind": "enum", "status": "enum"}),
    ("state", "review_tasks"): ("task_id", {"task_id": "text", "target_id": "text", "status": "enum"}),
    ("state", "review_events"): ("event_id", {"event_id": "text", "target_id": "text", "decision": "enum", "created_at": "timestamp"}),
}


def struct(dataset: str, table: str) -> T.StructType:
    """The table's schema; each field's metadata holds its kind."""
    key, columns = TABLES[dataset, table]
    return T.StructType([T.StructField(c, _KINDS[k], c != key, {"kind": k}) for c, k in columns.items()])
