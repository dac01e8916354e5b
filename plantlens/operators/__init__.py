"""Operators: control charts, drift, capability, shifts, quality, retrieval, cases."""
