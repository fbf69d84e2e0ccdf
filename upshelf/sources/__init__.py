"""Readers, sinks, canonical schemas and driver-table adapters."""
