"""Scans, adapters, connectors and sinks."""
