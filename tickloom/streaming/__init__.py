"""Structured Streaming jobs: incremental landing and bar building."""
