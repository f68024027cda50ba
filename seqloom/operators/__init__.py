"""Operators: sketches, seeds, chains, ranking, alignment, intervals."""
