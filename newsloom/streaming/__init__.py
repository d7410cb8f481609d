"""Structured Streaming forms of the incremental behaviours."""
