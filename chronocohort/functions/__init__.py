"""Column expressions and the fixed code lists they use."""
