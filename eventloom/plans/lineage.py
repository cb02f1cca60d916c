"""Lineage cuts for iterative or multi-level plans.

``checkpoint()`` writes to the shared folder named by ``spark.checkpoint.dir`` (reliable:
a lost executor does not lose it); executor-local checkpoints are never used.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from eventloom.plans.session import ensure_checkpoint_dir


def cut(df: DataFrame) -> DataFrame:
    """Materialize ``df`` (small, derived tables only) in the checkpoint folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
