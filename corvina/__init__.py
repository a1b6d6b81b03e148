"""Retrieval and analytics over text, code, notes and vectors, as DataFrame operators."""
