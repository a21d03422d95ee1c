"""Readers and writers: files, landed payloads, the bar store, results."""
