"""Relational, profiling, integrity and incremental-load operators."""
