"""Readers and writers: log lines, XML records, indicator lists, event store, audit tables."""
