"""Check queries over the provided tables, each with an SQL counterpart."""
