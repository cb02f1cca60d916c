"""Operators for text corpora that become training data. Nothing outside this folder imports it."""
