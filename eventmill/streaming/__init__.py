"""Incremental ingestion through the batch operators."""
