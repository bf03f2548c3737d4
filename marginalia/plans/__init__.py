"""End-to-end jobs (ingest, ask) and the registered query catalogue."""
