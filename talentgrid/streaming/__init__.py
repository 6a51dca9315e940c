"""Structured Streaming forms of ingest, windowed counts and feedback upserts."""
