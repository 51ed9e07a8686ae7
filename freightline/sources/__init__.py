"""Readers for the driver tables, the derived logistics views, file sources and sinks."""
