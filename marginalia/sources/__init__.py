"""Readers and versioned table storage."""
