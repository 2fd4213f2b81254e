"""Structured Streaming versions of the per-session operators."""
