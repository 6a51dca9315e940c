"""Readers and writers for the application's files (JSON offers, CV texts, CSV/JSON
training sources, annotations, feedback sessions, embeddings)."""
