"""Readers of exported records, sinks, and sample views over the test tables."""
