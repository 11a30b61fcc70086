"""Streaming index maintenance."""
