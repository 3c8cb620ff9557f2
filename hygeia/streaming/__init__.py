"""Structured Streaming: continuous validation of new execution documents (ST1-ST5)."""
