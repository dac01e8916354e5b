"""Readers, file clean-up and the relational case store."""
