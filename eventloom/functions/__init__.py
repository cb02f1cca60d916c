"""Column-level functions: keyed draws, value generators, templates, formats, curves."""
