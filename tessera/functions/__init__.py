"""Column expressions with NumPy's semantics."""
