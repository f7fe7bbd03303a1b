"""lodestrata: provenance-aware retrieval and analytics as PySpark plans."""
