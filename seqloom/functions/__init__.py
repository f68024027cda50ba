"""Scalar functions: Column expressions and numpy kernels."""
