"""Readers and writers of tables and plain files."""
