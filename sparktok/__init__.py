"""Byte-level BPE tokenization and vocabulary analytics over Spark DataFrames."""

__version__ = "0.1.0"
