"""Readers over landed files, import checks and sinks."""
