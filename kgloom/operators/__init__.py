"""Relational operators on nodes, edges, chunks and vectors: filters, joins, writers, queue, graph and identity."""
