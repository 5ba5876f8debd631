"""Readers, sinks, declared schemas and the test-table adapters."""
