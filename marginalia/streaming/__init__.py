"""Structured Streaming forms of the outbox and of the late-fact guard."""
