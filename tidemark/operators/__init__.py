"""Reusable relational operators: islands, ranks, dedup, confidence."""
