"""Schemas of the property graph as tables: change events, nodes, edges, chunks, vectors, topics, queue and logs."""

from __future__ import annotations

EVENTS = (
    "id string, source_type string, source_id string, operation string, text string, raw_bytes binary, mime_type string, meta map<string,string>, "
    "source_modified_at timestamp, enqueued_at timestamp, initial_scan boolean"
)
NODES = "label string, source_id string, source_type string, props map<string,string>"
EDGES = (
    "src_label string, src_id string, rel string, dst_label string, dst_id string, match_type string, confidence double, cross_source boolean, "
    "hint boolean, account string, created_at timestamp"
)
CHUNKS = "chunk_id string, source_id string, chunk_index int, text string"
VECTORS = "point_id string, source_type string, source_id string, chunk_index int, text string, date string, vector array<float>"
TOPICS = "name string, source string, description string, created_at timestamp"
QUEUE = "id string, source_type string, source_id string, operation string, status string, attempts int, error string, enqueued_at timestamp"
FAILURES = "id long, source_type string, source_id string, error string, failed_at timestamp"
HINTS = (
    "subject_id string, subject_label string, predicate string, object_id string, object_label string, object_props map<string,string>, "
    "subject_merge_key string, object_merge_key string, confidence double"
)
ENTITIES = "name string, type string, confidence double"
TRIPLES = "subject string, predicate string, object string"
