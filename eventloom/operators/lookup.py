"""Equi left lookup with a default (mapping tables, labels, dimensions)."""

from __future__ import annotations

from typing import Mapping

from pyspark.sql import DataFrame, functions as F

from eventloom.plans.broadcast import maybe_broadcast

LOOKUP_BROADCAST_ROWS = 2_000_000


def lookup_with_default(df: DataFrame, lookup: DataFrame, key: str | list[str],
                        defaults: Mapping[str, object]) -> DataFrame:
    """Left-join ``lookup`` on ``key`` and fill its value columns with ``defaults``.

    The lookup side is broadcast only when its row count is within
    ``LOOKUP_BROADCAST_ROWS``; a larger one falls back to a shuffle join (AQE may still
    convert it at run time). The lookup must be unique on ``key``.
    """
    keys = [key] if isinstance(key, str) else list(key)
    right = maybe_broadcast(lookup.select(*keys, *defaults.keys()), LOOKUP_BROADCAST_ROWS)
    j = df.join(right, keys, "left")
    return j.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})
