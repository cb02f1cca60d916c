"""Keyed message loss (packet-loss anomalies).

The roll is an integer 0..99 drawn from ``(seed, key, 'loss')``; a message is lost when
``roll < percent``. Because the roll depends only on the key, Catalyst may (and does)
push the filter below rendering: lost messages are never rendered.
"""

from __future__ import annotations

import math
from typing import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from eventloom.functions import draws as D

LOSS_SALT = "loss"


def loss_roll(seed: int, key) -> Column:
    """Integer 0..99, keyed; the same roll is shared by every loss rule of a message."""
    return F.floor(D.draw(seed, key, LOSS_SALT) * F.lit(100.0))


def _active(p) -> bool:
    return p is not None and math.isfinite(float(p)) and float(p) > 0


def is_lost(seed: int, key, percents: float | Sequence[float], exact_percent: bool = False) -> Column:
    """True when any loss rule fires.

    With one seed all rules share the roll, so the effect is the largest percent.
    ``exact_percent=True`` compares the unit draw (fractional percents act exactly);
    the default compares the integer roll, as the reference does (0.5 % acts as 1 %).
    """
    ps = [float(p) for p in (percents if isinstance(percents, (list, tuple)) else [percents]) if _active(p)]
    if not ps:
        return F.lit(False)
    roll = D.draw(seed, key, LOSS_SALT) * F.lit(100.0) if exact_percent else loss_roll(seed, key)
    return roll < F.lit(max(ps))


def drop_lost(df: DataFrame, seed: int, key, percents, exact_percent: bool = False) -> DataFrame:
    return df.filter(~is_lost(seed, key, percents, exact_percent))


def sql_is_lost(seed: int, key_sql: str, percents) -> str:
    ps = [float(p) for p in (percents if isinstance(percents, (list, tuple)) else [percents]) if _active(p)]
    if not ps:
        return "FALSE"
    return f"(floor({D.sql_draw(seed, key_sql, LOSS_SALT)} * 100.0) < {max(ps)!r})"
