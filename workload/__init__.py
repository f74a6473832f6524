"""The package's operators run on the TPC-H-like test tables."""
