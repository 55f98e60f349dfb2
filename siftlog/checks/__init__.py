"""The operators applied to the given tables, and the same answers as plain SQL."""
