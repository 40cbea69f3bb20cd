"""Scans, sinks and the ingest jobs."""
