"""Bank-statement ingestion, deduplication and classification as Spark jobs."""
