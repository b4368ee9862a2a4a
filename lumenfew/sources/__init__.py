"""Readers of heterogeneous measurement files, and sinks."""
