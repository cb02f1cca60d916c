"""Exact order statistics per group without gathering a group in one task.

``percentile``/``median`` keep a per-group map of all values, so one hot group (a third of
the rows) would sit in one task's memory. :func:`select_ranks` instead narrows each
requested rank to a value interval in rounds:

1. per group keep the intervals ``[lo, hi]`` that hold wanted ranks, each with its ranks and the
   number of values below it (at first one interval with all ranks of the group);
2. histogram the in-interval values into ``bins`` equal-width bins (a partial/final
   aggregate: one small row per bin), find the bins holding the ranks, and take a bin's
   actual min/max as the next interval (the bin function is monotone in the value, so
   "in bin b" and "within [min_b, max_b]" are the same rows);
3. stop when an interval holds at most ``final_max`` values (or one distinct value), then
   sort that bounded remainder once per interval and pick the elements.

Rounds needed ≈ log_bins(n / final_max) on evenly spread values; each round narrows an interval to at most
1/bins of its width, so the rounds end on any values. There is one path for groups of every size; NULL keys
are a group of their own, and key columns may have any names.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from typing import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from eventloom.plans.broadcast import maybe_broadcast
from eventloom.plans.lineage import cut

DEFAULT_BINS = 1024
DEFAULT_FINAL_MAX = 50_000
STATE_BROADCAST_ROWS = 1_000_000
#: Infinite values are binned with the largest finite one.
LARGEST = 1.7976931348623157e308


def _keyed(df: DataFrame, keys: Sequence[str], *others) -> DataFrame:
    """df with keys _key0, _key1, … and the other columns; without keys all rows are one group, 0."""
    cols = [F.col(f"`{c}`") for c in keys] or [F.lit(0)]
    return df.select(*[c.alias(f"_key{i}") for i, c in enumerate(cols)], *others)


def _same_keys(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join on the keys, where NULL equals NULL."""
    right = right.withColumnsRenamed({c: f"_r{c}" for c in keys})
    on = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_r{c}")) for c in keys])
    return left.join(right, on).drop(*[f"_r{c}" for c in keys])


def _bin(bins: int):
    """Equal-width bin of _v in [_lo, _hi], monotone in _v; halves, so that the width stays finite."""
    def half(name):
        return F.least(F.greatest(F.col(name), F.lit(-LARGEST)), F.lit(LARGEST)) / 2
    width = half("_hi") - half("_lo")
    at = F.floor((half("_v") - half("_lo")) / width * F.lit(float(bins)))
    return F.when(width > 0, F.when(F.col("_v") >= F.col("_hi"), F.lit(bins - 1)).otherwise(F.least(at, F.lit(bins - 1)))) \
        .otherwise((F.col("_v") > F.col("_lo")).cast("bigint")).cast("int")


def _narrow(v: DataFrame, keys: Sequence[str], state: DataFrame, bins: int, final_max: int) -> DataFrame:
    """keys, _rank, _value of every rank in ``state``: one row for each interval (keys, _lo, _hi, the number _cnt of
    values in it and _below under it) with all _ranks that lie in it, so an interval's values are read once."""
    span = [*keys, "_lo", "_hi"]
    inside = (F.col("_v") >= F.col("_lo")) & (F.col("_v") <= F.col("_hi"))
    wide = (F.col("_cnt") > final_max) & (F.col("_hi") > F.col("_lo"))
    while not state.filter(wide).isEmpty():
        open_ = state.filter(wide)
        h = _same_keys(v, maybe_broadcast(open_.select(*span), STATE_BROADCAST_ROWS), keys).filter(inside) \
            .groupBy(*span, _bin(bins).alias("_b")).agg(F.count(F.lit(1)).alias("bc"), F.min("_v").alias("blo"), F.max("_v").alias("bhi"))
        # the window runs over the bins of one interval, at most ``bins`` rows
        h = h.withColumn("_upto", F.sum("bc").over(Window.partitionBy(*span).orderBy("_b")))
        h = _same_keys(h, open_.select(*span, "_below", "_ranks"), span) \
            .withColumn("_under", F.col("_below") + F.col("_upto") - F.col("bc"))
        nxt = h.select(*keys, F.col("blo").alias("_lo"), F.col("bhi").alias("_hi"), F.col("bc").alias("_cnt"), F.col("_under").alias("_below"),
                       F.filter("_ranks", lambda r: (r["k"] >= F.col("_under")) & (r["k"] < F.col("_under") + F.col("bc"))).alias("_ranks")) \
            .filter(F.size("_ranks") > 0)
        state = cut(state.filter(~wide).unionByName(nxt))
    # an interval holding one distinct value answers directly, whatever its count
    flat = state.filter(F.col("_hi") == F.col("_lo")).select(*keys, F.explode("_ranks").alias("_rank"), F.col("_lo").alias("_value"))
    rest = state.filter(F.col("_hi") > F.col("_lo")).select(*span, "_below", "_ranks")
    fin = _same_keys(v, maybe_broadcast(rest, STATE_BROADCAST_ROWS), keys).filter(inside)
    sel = fin.groupBy(*span, "_below").agg(F.sort_array(F.collect_list("_v")).alias("_vals"), F.first("_ranks").alias("_ranks"))
    at = (F.col("_rank.k") - F.col("_below") + 1).cast("int")
    picked = sel.withColumn("_rank", F.explode("_ranks")).select(*keys, "_rank", F.element_at("_vals", at).alias("_value"))
    return picked.unionByName(flat)


def _values(df: DataFrame, names: Sequence[str], value: str):
    """Values by _key0, _key1, …, those names, and for each group its smallest, largest and number of values."""
    v = _keyed(df, names, F.col(value).cast("double").alias("_v")).filter(F.col("_v").isNotNull() & ~F.isnan("_v"))
    keys = [f"_key{i}" for i in range(len(names) or 1)]
    return v, keys, v.groupBy(*keys).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.count(F.lit(1)).alias("_cnt"))


def select_ranks(df: DataFrame, keys: Sequence[str], value: str, ranks: DataFrame, *, bins: int = DEFAULT_BINS,
                 final_max: int = DEFAULT_FINAL_MAX) -> DataFrame:
    """Exact ``k``-th smallest ``value`` (0-based ``k``) for each row of ``ranks``.

    ``ranks`` has the ``keys`` columns plus ``rank_id`` (any label) and ``k`` (bigint).
    Returns keys, rank_id, k, ``rank_value`` (double). NULL and NaN values are ignored.
    """
    names = list(keys)
    v, keys, stats = _values(df, names, value)
    asked = _keyed(ranks, names, F.struct("rank_id", F.col("k").cast("bigint").alias("k")).alias("_rank"))
    state = _same_keys(asked, stats, keys).filter((F.col("_rank.k") >= 0) & (F.col("_rank.k") < F.col("_cnt"))) \
        .groupBy(*keys, "_lo", "_hi", "_cnt").agg(F.collect_list("_rank").alias("_ranks")) \
        .withColumn("_below", F.lit(0).cast("bigint"))
    out = _narrow(v, keys, cut(state), bins, final_max)
    return out.select(*[F.col(k).alias(c) for k, c in zip(keys, names)], "_rank.rank_id", "_rank.k", F.col("_value").alias("rank_value"))


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, qs: Sequence[float], *, bins: int = DEFAULT_BINS,
                    final_max: int = DEFAULT_FINAL_MAX) -> DataFrame:
    """Exact continuous quantiles (linear interpolation between closest ranks, like
    ``percentile``/``quantile_cont``): one column ``q_<pct>`` per requested q.

    One stats pass gives every group's size and with it the two ranks around each quantile; all ranks of a group
    start in one interval.
    """
    names = list(keys)
    v, keys, stats = _values(df, names, value)

    def pos(q, n):
        return F.lit(float(q)) * (n - 1).cast("double")
    wanted = F.array(*[F.struct(F.lit(f"{i}_{end}").alias("rank_id"), side(pos(q, F.col("_cnt"))).cast("bigint").alias("k"),
                                F.col("_cnt").alias("n"))
                       for i, q in enumerate(qs) for end, side in (("lo", F.floor), ("hi", F.ceil))])
    state = cut(stats.select("*", F.lit(0).cast("bigint").alias("_below"), wanted.alias("_ranks")))
    ends = _narrow(v, keys, state, bins, final_max).groupBy(*keys).agg(F.first("_rank.n").alias("_n"), *[
        F.first(F.when(F.col("_rank.rank_id") == rid, F.col("_value")), ignorenulls=True).alias(f"_at{rid}")
        for i in range(len(qs)) for rid in (f"{i}_lo", f"{i}_hi")])
    outs = []
    for i, q in enumerate(qs):
        at = pos(q, F.col("_n"))
        lo, hi = F.col(f"_at{i}_lo"), F.col(f"_at{i}_hi")
        # between equal ends (infinite ones, too) there is nothing to interpolate
        outs.append(F.when(lo == hi, lo).otherwise(lo + (hi - lo) * (at - F.floor(at))).alias(_qname(q)))
    return ends.select(*[F.col(k).alias(c) for k, c in zip(keys, names)], *outs)


def _qname(q: float) -> str:
    s = f"{q * 100:g}".replace(".", "_")
    return f"q{s}"


def exact_median(df: DataFrame, keys: Sequence[str], value: str, **kw) -> DataFrame:
    """Exact median per group (mean of the two middle values when n is even)."""
    out = exact_quantiles(df, keys, value, [0.5], **kw)
    return out.withColumnRenamed("q50", "median")
