"""Readers and parsers of the supported source formats, and keyed sinks."""
