"""Operators over the relations of an archive: scans, reads, aggregates, ingest, sealing, retention, rewriting, documents, checks, replication."""
