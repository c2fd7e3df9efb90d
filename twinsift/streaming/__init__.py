"""Incremental indexing of listings that arrive as a stream."""
