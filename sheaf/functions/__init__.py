"""Column expressions and ordered-data helpers shared by the operators."""
