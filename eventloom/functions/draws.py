"""Keyed pseudo-random draws.

A draw is a pure function of ``(seed, key, salt)``: the same message key always gets
the same value, whatever the partitioning, task retries or other columns. We never
use ``rand()`` (its stream depends on the partition layout and is not replayable).

The default (exact) draw hashes ``"seed:key:salt"`` with MD5 and reads hex digits;
DuckDB and Spark agree on it bit for bit, which is what the SQL oracle needs.
The fast draw uses ``xxhash64`` (about 3x cheaper, Spark-only).
"""

from __future__ import annotations

from contextlib import contextmanager
from typing import Iterable

from pyspark.sql import Column, functions as F

TWO_52 = 4503599627370496.0
TWO_32 = 4294967296.0
TWO_16 = 65536.0


_MODE = ["exact"]


@contextmanager
def draw_mode(mode: str):
    """Build expressions with ``exact`` (MD5, reproducible in SQL engines) or ``fast``
    (xxhash64, Spark only, several times cheaper) draws. Read at expression-build time on
    the driver, so a plan never mixes modes by accident."""
    if mode not in ("exact", "fast"):
        raise ValueError(mode)
    _MODE.append(mode)
    try:
        yield
    finally:
        _MODE.pop()


def current_mode() -> str:
    return _MODE[-1]


def _keys(key) -> list[Column]:
    if isinstance(key, (list, tuple)):
        return [F.col(k) if isinstance(k, str) else k for k in key]
    return [F.col(key) if isinstance(key, str) else key]


def keyed_hex(seed: int, key, salt: str) -> Column:
    """32 lower-case hex digits that depend only on ``(seed, key, salt)``."""
    parts = [F.lit(str(int(seed)))] + [k.cast("string") for k in _keys(key)] + [F.lit(salt)]
    return F.md5(F.concat_ws(":", *parts))


def hex_unit(hexstr: Column, start: int, ndigits: int) -> Column:
    """Read ``ndigits`` hex digits at 1-based ``start`` as a double in [0, 1)."""
    denom = float(16 ** ndigits)
    return F.conv(F.substring(hexstr, start, ndigits), 16, 10).cast("bigint") / F.lit(denom)


def draw(seed: int, key, salt: str) -> Column:
    """Uniform double in [0, 1) with 52 bits, keyed on ``(seed, key, salt)``."""
    if current_mode() == "fast":
        return fast_draw(seed, key, salt)
    return hex_unit(keyed_hex(seed, key, salt), 1, 13)


def key_prefix(seed: int, key) -> Column:
    """What the exact draws of one seed and key hash in front of their salts."""
    return F.concat_ws(":", F.lit(str(int(seed))), *[k.cast("string") for k in _keys(key)])


def draw_after(prefix: Column, more: Iterable[Column], salt: str) -> Column:
    """:func:`draw` for the keys of a :func:`key_prefix` made once a row and further keys that are never null."""
    parts = [x for k in more for x in (F.lit(":"), k.cast("string"))]
    return hex_unit(F.md5(F.concat(prefix, *parts, F.lit(f":{salt}"))), 1, 13)


class KeyedBits:
    """Random material for one (seed, key, salt): unit lanes and 32 hex digits."""

    def __init__(self, seed: int, key, salt: str):
        self.seed, self.key, self.salt = seed, key, salt
        self.fast = current_mode() == "fast"
        self._hex = None

    def hex(self) -> Column:
        if self._hex is None:
            if self.fast:
                parts = [F.lpad(F.lower(F.hex(F.xxhash64(F.lit(int(self.seed)), *_keys(self.key), F.lit(f"{self.salt}#h{i}")))), 16, "0")
                         for i in range(2)]
                self._hex = F.concat(*parts)
            else:
                self._hex = keyed_hex(self.seed, self.key, self.salt)
        return self._hex

    def unit(self, i: int) -> Column:
        if self.fast:
            return fast_draw(self.seed, self.key, f"{self.salt}#{i}")
        return lane(self.hex(), i)


LANE_BITS = 26
_LANE_MASK = (1 << LANE_BITS) - 1


def _pair(hexstr: Column, p: int) -> Column:
    # 13 hex digits = 52 bits = two lanes; one conv() serves both (CSE shares it in a projection)
    return F.conv(F.substring(hexstr, 1 + 13 * p, 13), 16, 10).cast("bigint")


def lane(hexstr: Column, i: int) -> Column:
    """The i-th 26-bit uniform lane (i in 0..3) of a keyed hex string, in [0, 1)."""
    v = _pair(hexstr, i // 2)
    bits = v.bitwiseAND(F.lit(_LANE_MASK)) if i % 2 == 0 else F.shiftright(v, LANE_BITS)
    return bits / F.lit(float(1 << LANE_BITS))


def fast_draw(seed: int, key, salt: str) -> Column:
    """Uniform double in [0, 1) from ``xxhash64``; Spark-only, cheaper than :func:`draw`."""
    h = F.xxhash64(F.lit(int(seed)), *_keys(key), F.lit(salt))
    return F.pmod(h, F.lit(1 << 52)).cast("double") / F.lit(TWO_52)


def int_from_unit(u: Column, lo: int, hi: int) -> Column:
    """Inclusive integer in [lo, hi] from a unit draw; ``hi < lo`` gives ``lo``."""
    if hi < lo:
        return F.lit(int(lo)).cast("bigint")
    span = float(hi - lo + 1)
    v = F.lit(int(lo)) + F.floor(u * F.lit(span))
    return F.least(v, F.lit(int(hi))).cast("bigint")


def pick(values: Iterable, idx0: Column) -> Column:
    """``values[idx0]`` (0-based index column) over a literal list."""
    vals = list(values)
    return F.element_at(F.array(*[F.lit(v) for v in vals]), (idx0 + 1).cast("int"))


# ---------------------------------------------------------------- SQL (DuckDB) mirrors
# Used only to write oracle SQL for the correctness gate.

def sql_keyed_hex(seed: int, key_sql: str, salt: str) -> str:
    return f"md5(concat_ws(':', '{int(seed)}', CAST({key_sql} AS VARCHAR), '{salt}'))"


def sql_hex_unit(hex_sql: str, start: int, ndigits: int) -> str:
    denom = float(16 ** ndigits)
    return (f"(CAST(concat('0x', substr({hex_sql}, {start}, {ndigits})) AS BIGINT)"
            f" / {denom!r})")


def sql_draw(seed: int, key_sql: str, salt: str) -> str:
    return sql_hex_unit(sql_keyed_hex(seed, key_sql, salt), 1, 13)


def sql_lane(hex_sql: str, i: int) -> str:
    v = f"CAST(concat('0x', substr({hex_sql}, {1 + 13 * (i // 2)}, 13)) AS BIGINT)"
    bits = f"({v} & {_LANE_MASK})" if i % 2 == 0 else f"({v} >> {LANE_BITS})"
    return f"({bits} / {float(1 << LANE_BITS)!r})"


def sql_int_from_unit(u_sql: str, lo: int, hi: int) -> str:
    if hi < lo:
        return f"CAST({int(lo)} AS BIGINT)"
    span = float(hi - lo + 1)
    return f"CAST(least({int(lo)} + floor({u_sql} * {span!r}), {int(hi)}) AS BIGINT)"
