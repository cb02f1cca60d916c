"""Structured Streaming runs of the same operators (file/rate sources, watermarked windows)."""
