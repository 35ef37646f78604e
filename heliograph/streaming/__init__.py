"""Structured Streaming forms of live queries."""
