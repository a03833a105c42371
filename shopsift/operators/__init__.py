"""Relational operators of ingest, review, finalize and reports."""
