"""Incremental processing: sessions over chat streams and ingest by micro-batches."""
