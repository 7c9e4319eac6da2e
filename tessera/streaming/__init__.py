"""Streaming forms of the operators that make sense on arriving rows."""
