"""Composed jobs: full ingest, event board and the query catalogue."""
