"""Readers, table schemas, stores and sinks."""
