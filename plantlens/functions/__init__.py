"""Column expressions, fixed vocabularies and small vectorised helpers."""
