"""Structured Streaming forms of ingest, counters, triage and alerts."""
