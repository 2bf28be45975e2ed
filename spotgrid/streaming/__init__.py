"""Incremental forms of the operators whose results can be merged."""
