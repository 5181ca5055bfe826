"""Supplier-invoice ingestion, validation, deduplication and reporting as Spark jobs."""
