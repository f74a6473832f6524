"""Coded-observation analytics on Spark."""
