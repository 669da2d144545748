"""Readers and writers: CSV, JDBC, catalog tables, batch loads, documents."""
