"""Session setup and plan-level helpers (size-checked broadcast, lineage cuts)."""
