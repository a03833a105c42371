"""Catalogue analytics on Spark: ingest, review, finalize and report over product listings."""
