"""Operators: DataFrame(s) in, DataFrame(s) out, lazy."""
