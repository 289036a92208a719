"""Structured Streaming forms of ingest, packing and running statistics."""
