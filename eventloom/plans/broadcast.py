"""Broadcast only what has a proven size bound."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

#: Largest row count we are willing to ship to every executor for a lookup/dimension side.
DEFAULT_MAX_BROADCAST_ROWS = 1_000_000


class TooLargeToBroadcast(ValueError):
    pass


def checked_broadcast(df: DataFrame, max_rows: int = DEFAULT_MAX_BROADCAST_ROWS) -> DataFrame:
    """Mark ``df`` for broadcast after counting it against ``max_rows``.

    The count runs over the (small, configuration-sized) side only. Callers that can
    fall back to a shuffle join should catch :class:`TooLargeToBroadcast`.
    """
    n = df.limit(max_rows + 1).count()
    if n > max_rows:
        raise TooLargeToBroadcast(f"side has more than {max_rows} rows; refusing to broadcast")
    return F.broadcast(df)


def maybe_broadcast(df: DataFrame, max_rows: int = DEFAULT_MAX_BROADCAST_ROWS) -> DataFrame:
    """Broadcast ``df`` if it is within ``max_rows``, else leave it to a shuffle join."""
    try:
        return checked_broadcast(df, max_rows)
    except TooLargeToBroadcast:
        return df
