"""Load-shape rate curves and anomaly multipliers as Column expressions of time ``t`` (seconds).

Shapes and anomalies can be given as Python dicts (folded to literals) or read from a
struct column of a phases table (``load_shape``, ``anomalies``) so one plan serves many
phases with different curves.
"""

from __future__ import annotations

import math
from typing import Mapping, Sequence

from pyspark.sql import Column, functions as F

# ---- fixed defaults of the shapes --------------------------------------------------------
DEFAULT_SINE_PERIOD = 60.0
DEFAULT_BURST_EVERY = 10.0
DEFAULT_BURST_SECS = 1.0
# ------------------------------------------------------------------------------------------


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def _d(x) -> Column:
    return _c(x).cast("double")


def rate_constant(rate, base) -> Column:
    return F.greatest(F.coalesce(_d(rate), _d(base)), F.lit(0.0))


def rate_linear(t, duration, start_rate, end_rate) -> Column:
    tt = F.greatest(_d(t), F.lit(0.0))
    dur = _d(duration)
    frac = F.least(F.greatest(tt / dur, F.lit(0.0)), F.lit(1.0))
    r = F.when(dur <= 0, _d(end_rate)).otherwise(_d(start_rate) + (_d(end_rate) - _d(start_rate)) * frac)
    return F.greatest(r, F.lit(0.0))


def rate_sine(t, min_rate, max_rate, period=None) -> Column:
    tt = F.greatest(_d(t), F.lit(0.0))
    p = F.coalesce(_d(period), F.lit(DEFAULT_SINE_PERIOD))
    p = F.when(p <= 0, F.lit(1.0)).otherwise(p)
    mid = (_d(min_rate) + _d(max_rate)) / 2.0
    amp = (_d(max_rate) - _d(min_rate)) / 2.0
    r = mid - amp * F.cos(F.lit(2.0 * math.pi) * (tt / p))
    return F.greatest(r, F.lit(0.0))


def rate_burst(t, base_rate, burst_rate, every=None, burst_secs=None) -> Column:
    tt = F.greatest(_d(t), F.lit(0.0))
    cyc = F.coalesce(_d(every), F.lit(DEFAULT_BURST_EVERY))
    cyc = F.when(cyc <= 0, F.lit(1.0)).otherwise(cyc)
    bs = F.coalesce(_d(burst_secs), F.lit(DEFAULT_BURST_SECS))
    r = F.when(F.pmod(tt, cyc) < bs, _d(burst_rate)).otherwise(_d(base_rate))
    return F.greatest(r, F.lit(0.0))


def rate_at(t, shape: Mapping | Column | None, duration, base) -> Column:
    """Rate at ``t`` for a shape dict or a ``load_shape`` struct column (type + params)."""
    if shape is None:
        return rate_constant(None, base)
    if isinstance(shape, Mapping):
        typ = (shape.get("type") or "constant").lower()
        g = shape.get
        if typ == "linear":
            return rate_linear(t, duration, g("start_rate"), g("end_rate"))
        if typ == "sine":
            return rate_sine(t, g("min_rate"), g("max_rate"), g("period_secs"))
        if typ == "burst":
            return rate_burst(t, g("base_rate"), g("burst_rate"), g("every_secs"), g("burst_secs"))
        return rate_constant(g("rate"), base)
    s = shape
    typ = F.lower(F.coalesce(s["type"], F.lit("constant")))
    return (F.when(s.isNull(), rate_constant(None, base))
             .when(typ == "linear", rate_linear(t, duration, s["start_rate"], s["end_rate"]))
             .when(typ == "sine", rate_sine(t, s["min_rate"], s["max_rate"], s["period_secs"]))
             .when(typ == "burst", rate_burst(t, s["base_rate"], s["burst_rate"], s["every_secs"], s["burst_secs"]))
             .otherwise(rate_constant(s["rate"], base)))


def effective_base(shape: Mapping | Column | None, base) -> Column:
    """Peak (target) rate of a shape: constant → rate or base, linear → max(start, end),
    sine → max, burst → burst rate."""
    if shape is None:
        return _d(base)
    if isinstance(shape, Mapping):
        typ = (shape.get("type") or "constant").lower()
        g = shape.get
        if typ == "linear":
            return F.greatest(_d(g("start_rate")), _d(g("end_rate")))
        if typ == "sine":
            return _d(g("max_rate"))
        if typ == "burst":
            return _d(g("burst_rate"))
        return F.coalesce(_d(g("rate")), _d(base))
    s = shape
    typ = F.lower(F.coalesce(s["type"], F.lit("constant")))
    return (F.when(s.isNull(), _d(base))
             .when(typ == "linear", F.greatest(_d(s["start_rate"]), _d(s["end_rate"])))
             .when(typ == "sine", _d(s["max_rate"]))
             .when(typ == "burst", _d(s["burst_rate"]))
             .otherwise(F.coalesce(_d(s["rate"]), _d(base))))


def _finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))


def anomaly_factor(t, a) -> Column:
    """Multiplier of one anomaly (struct column or dict) at time ``t``; invalid → 1."""
    if isinstance(a, Mapping):
        a = F.struct(*[F.lit(v).alias(k) for k, v in a.items()])
    tt = _d(t)
    typ = F.lower(a["type"])
    m, iv, du, dv = _d(a["rate_multiplier"]), _d(a["interval_secs"]), _d(a["duration_secs"]), _d(a["rate_divisor"])
    burst_ok = _finite(iv) & (iv > 0) & _finite(du) & (du >= 0) & _finite(m) & (m > 0)
    burst = F.when(burst_ok & (F.pmod(tt, iv) < du), m).otherwise(F.lit(1.0))
    drip_ok = _finite(du) & (du > 0) & _finite(dv) & (dv > 1)
    drip = F.when(drip_ok & (tt < du), F.lit(1.0) / dv).otherwise(F.lit(1.0))
    return (F.when(typ == "burst-injection", burst)
             .when(typ == "slow-drip", drip)
             .otherwise(F.lit(1.0)))


ANOMALY_FIELDS = ["type", "rate_multiplier", "interval_secs", "duration_secs", "rate_divisor", "loss_percent"]


def anomaly_array(anomalies: Sequence[Mapping]) -> Column:
    """Literal ``array<struct>`` of anomaly rules with the full field set."""
    return F.array(*[F.struct(
        F.lit(a.get("type")).cast("string").alias("type"),
        *[F.lit(a.get(k)).cast("double").alias(k) for k in ANOMALY_FIELDS[1:]]) for a in anomalies])


def anomaly_multiplier(t, anomalies: Sequence[Mapping] | Column) -> Column:
    """Product of all anomaly multipliers at ``t`` (1.0 when there are none)."""
    arr = anomaly_array(anomalies) if not isinstance(anomalies, Column) else anomalies
    if not isinstance(anomalies, Column) and not anomalies:
        return F.lit(1.0)
    agg = F.aggregate(arr, F.lit(1.0), lambda acc, a: acc * anomaly_factor(t, a))
    return F.coalesce(agg, F.lit(1.0))


def seconds_since(ts: Column, origin: str) -> Column:
    """Seconds (double, microsecond precision) from a fixed origin timestamp to ``ts``."""
    return F.timestamp_diff("MICROSECOND", F.lit(origin).cast("timestamp_ntz"), ts).cast("double") / 1e6


# ---------------------------------------------------------------- SQL mirrors (oracle)

def sql_pmod(x: str, m: str) -> str:
    return f"((({x}) % ({m}) + ({m})) % ({m}))"


def _dl(x) -> str:
    return f"CAST({float(x)!r} AS DOUBLE)"


def sql_rate(t: str, shape: Mapping | None, duration: str = "0", base: str = "0") -> str:
    tt = f"greatest(CAST({t} AS DOUBLE), {_dl(0)})"
    z = _dl(0)
    if not shape:
        return f"greatest(CAST({base} AS DOUBLE), {z})"
    g = shape.get
    typ = (g("type") or "constant").lower()
    if typ == "linear":
        s, e = _dl(g("start_rate")), _dl(g("end_rate"))
        dur = f"CAST({duration} AS DOUBLE)"
        return (f"greatest(CASE WHEN {dur} <= 0 THEN {e} ELSE {s} + ({e} - {s}) * "
                f"least(greatest({tt} / {dur}, {z}), {_dl(1)}) END, {z})")
    if typ == "sine":
        lo, hi = _dl(g("min_rate")), _dl(g("max_rate"))
        p = float(g("period_secs") if g("period_secs") is not None else DEFAULT_SINE_PERIOD)
        p = 1.0 if p <= 0 else p
        return (f"greatest(({lo} + {hi}) / {_dl(2)} - ({hi} - {lo}) / {_dl(2)} * cos({_dl(2.0 * math.pi)} * "
                f"({tt} / {_dl(p)})), {z})")
    if typ == "burst":
        cyc = float(g("every_secs") if g("every_secs") is not None else DEFAULT_BURST_EVERY)
        cyc = 1.0 if cyc <= 0 else cyc
        bs = float(g("burst_secs") if g("burst_secs") is not None else DEFAULT_BURST_SECS)
        return (f"greatest(CASE WHEN {sql_pmod(tt, _dl(cyc))} < {_dl(bs)} THEN {_dl(g('burst_rate'))} "
                f"ELSE {_dl(g('base_rate'))} END, {z})")
    r = g("rate")
    return f"greatest({_dl(r)}, {z})" if r is not None else f"greatest(CAST({base} AS DOUBLE), {z})"


def sql_anomaly_multiplier(t: str, anomalies: Sequence[Mapping]) -> str:
    one = _dl(1)
    fs = []
    for a in anomalies:
        typ = (a.get("type") or "").lower()
        g = a.get
        if typ == "burst-injection":
            m, iv, du = g("rate_multiplier"), g("interval_secs"), g("duration_secs")
            ok = all(v is not None and math.isfinite(v) for v in (m, iv, du)) and iv > 0 and du >= 0 and m > 0
            fs.append(f"(CASE WHEN {sql_pmod(f'CAST({t} AS DOUBLE)', _dl(iv))} < {_dl(du)} THEN {_dl(m)} ELSE {one} END)"
                      if ok else one)
        elif typ == "slow-drip":
            dv, du = g("rate_divisor"), g("duration_secs")
            ok = all(v is not None and math.isfinite(v) for v in (dv, du)) and du > 0 and dv > 1
            fs.append(f"(CASE WHEN CAST({t} AS DOUBLE) < {_dl(du)} THEN {one} / {_dl(dv)} ELSE {one} END)" if ok else one)
        else:
            fs.append(one)
    return "(" + " * ".join([one] + fs) + ")"


def sql_seconds_since(ts: str, origin: str) -> str:
    return f"(CAST(date_diff('microsecond', TIMESTAMP '{origin}', {ts}) AS DOUBLE) / 1000000.0)"
