"""Sequence sketching, mapping and alignment on Spark DataFrames."""
