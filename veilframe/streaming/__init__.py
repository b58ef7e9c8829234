"""Structured Streaming versions of redaction and quota."""
