"""Structured Streaming: ingest, hour maxima, sessions, incidents."""
