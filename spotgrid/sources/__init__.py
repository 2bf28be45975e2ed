"""Readers: text files of the expression data set and tabular adapters."""
