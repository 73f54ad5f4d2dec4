"""Readers and writers: journal CSV, dictionaries, weather JSON, upserts, exports."""
