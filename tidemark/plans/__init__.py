"""The query API: every function returns a lazy DataFrame."""
