"""Column expressions: buckets, text matching, clinical codes."""
