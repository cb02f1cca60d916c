"""Event sources and arrival schedules.

* :func:`expand_counts` turns "this row stands for n messages" into n rows without ever
  exploding a large n inside one task: it first explodes fixed-size blocks, spreads the
  blocks over partitions by hash, then explodes within each block.
* :func:`arrival_schedule` spaces messages by a rate curve: per tick it computes integer
  micro-messages (so Spark and SQL agree exactly), a running sum per phase (two-level
  prefix sum: block totals, then within-block windows), and the arrivals of each tick.
* :func:`bounded_source` / :func:`multi_phase_source` are the message sources.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from typing import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from eventloom.functions import curves as CV
from eventloom.plans.broadcast import maybe_broadcast
from eventloom.plans.lineage import cut

EXPAND_BLOCK = 100_000
PREFIX_BLOCK = 10_000
MICRO = 1_000_000


def expand_counts(df: DataFrame, n_col: str, seq_name: str = "seq", block: int = EXPAND_BLOCK,
                  partitions: int | None = None) -> DataFrame:
    """One output row per unit of ``n_col`` with ``seq_name`` = 1..n, other columns kept."""
    n = F.coalesce(F.col(n_col).cast("bigint"), F.lit(0))
    nblk = F.ceil(n / F.lit(float(block))).cast("bigint")
    b = (df.withColumn("_xn", n)
           .filter(F.col("_xn") > 0)
           .withColumn("_xblk", F.explode(F.sequence(F.lit(0).cast("bigint"), nblk - 1))))
    hashable = [f.name for f in df.schema.fields if "map<" not in f.dataType.simpleString()]
    keys = [F.col(c) for c in hashable] + [F.col("_xblk")]
    b = b.repartition(partitions, *keys) if partitions else b.repartition(*keys)
    lo = F.col("_xblk") * block + 1
    hi = F.least(F.col("_xn"), (F.col("_xblk") + 1) * block)
    return b.withColumn(seq_name, F.explode(F.sequence(lo, hi))).drop("_xn", "_xblk")


def prefix_sum(df: DataFrame, part: Sequence[str], order: str, value: str, out: str,
               block: int = PREFIX_BLOCK, depth: int = 0, max_depth: int = 3) -> DataFrame:
    """Running sum of ``value`` by ``order`` within ``part`` (integral ``order``).

    Rows are cut into blocks of ``block`` consecutive ``order`` values; block totals get
    their own (exclusive) running sum — recursively, up to ``max_depth`` levels — and each
    row adds the within-block running sum. No window partition ever holds more than one
    block of rows: three levels of 10 000 cover 10^12 rows per partition key.
    """
    part = list(part)
    pb = f"_pb{depth}"
    b = df.withColumn(pb, F.floor(F.col(order) / F.lit(block)).cast("bigint"))
    # block totals are small (rows / block): materialize them once so the levels above read
    # them instead of re-running the input; the input itself is scanned twice in total
    totals = cut(b.groupBy(*part, pb).agg(F.sum(value).alias("_bs")))
    if depth + 1 < max_depth:
        totals = prefix_sum(totals, part, pb, "_bs", "_incl", block, depth + 1, max_depth) \
            .withColumn("_before", F.col("_incl") - F.col("_bs")).drop("_incl", "_bs")
    else:
        w_blocks = Window.partitionBy(*part).orderBy(pb).rowsBetween(Window.unboundedPreceding, -1)
        totals = totals.withColumn("_before", F.coalesce(F.sum("_bs").over(w_blocks), F.lit(0))).drop("_bs")
    # null keys and null orders are values of their own here, so no row is lost in the join
    names = {c: f"_t{depth}_{i}" for i, c in enumerate([*part, pb])}
    totals = totals.withColumnsRenamed(names)
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(t)) for c, t in names.items()])
    j = b.join(maybe_broadcast(totals, 5_000_000), same, "inner").drop(*names.values())
    w_in = Window.partitionBy(*part, pb).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return j.withColumn(out, F.col("_before") + F.sum(value).over(w_in)).drop(pb, "_before")


def phase_ticks(phases: DataFrame, tick_secs: float = 1.0, shape=None, anomalies=None,
                shape_col: str | None = None, anomalies_col: str | None = None,
                duration: str = "duration_secs", base: str = "base_rate") -> DataFrame:
    """Ticks ``0..ceil(duration/Δ)-1`` per phase with rate, multiplier and micro-messages λ."""
    d = float(tick_secs)
    nt = F.ceil(F.col(duration).cast("double") / F.lit(d)).cast("bigint")
    blocks = expand_counts(phases.withColumn("_nt", nt), "_nt", "_tick1").drop("_nt")
    t = blocks.withColumn("tick", F.col("_tick1") - 1).drop("_tick1")
    tm = F.col("tick").cast("double") * F.lit(d) + F.lit(d / 2.0)
    sh = F.col(shape_col) if shape_col else shape
    an = F.col(anomalies_col) if anomalies_col else (anomalies or [])
    rate = CV.rate_at(tm, sh, F.col(duration), F.col(base) if base in phases.columns else F.lit(0.0))
    mult = CV.anomaly_multiplier(tm, an)
    lam = F.round(rate * mult * F.lit(d * MICRO)).cast("bigint")
    return t.withColumn("t_mid", tm).withColumn("rate", rate).withColumn("mult", mult).withColumn("lam", lam)


def arrival_schedule(phases: DataFrame, phase: str = "phase", tick_secs: float = 1.0, **kw) -> DataFrame:
    """Arrivals (phase, seq, t) spaced by ``rate(t) * multiplier(t)``; seq restarts per phase.

    Within a tick the n arrivals are evenly spaced from the tick start.
    """
    d = float(tick_secs)
    ticks = phase_ticks(phases, tick_secs, **kw).select(phase, "tick", "lam")
    # ticks per phase are duration / Δ: two levels (10^8 ticks per phase) are plenty
    c = prefix_sum(ticks, [phase], "tick", "lam", "_C", max_depth=2)
    c = (c.withColumn("_s0", F.floor((F.col("_C") - F.col("lam")) / F.lit(MICRO)).cast("bigint"))
          .withColumn("_n", F.floor(F.col("_C") / F.lit(MICRO)).cast("bigint") - F.col("_s0")))
    a = expand_counts(c.select(phase, "tick", "_s0", "_n"), "_n", "_j")
    t = F.col("tick").cast("double") * F.lit(d) + F.lit(d) * (F.col("_j") - 1).cast("double") / F.col("_n").cast("double")
    return a.select(phase, (F.col("_s0") + F.col("_j")).alias("seq"), t.alias("t"))


def bounded_source(spark: SparkSession, total: int | None, partitions: int | None = None) -> DataFrame:
    """``seq`` 1..total; with no total exactly one message."""
    n = 1 if total is None else int(total)
    return spark.range(1, n + 1, numPartitions=partitions).withColumnRenamed("id", "seq")


def multi_phase_source(phases: DataFrame, order: str, total: str = "total_messages", rate: str = "messages_per_second",
                       phase: str = "phase") -> DataFrame:
    """Phases one after another: seq restarts at 1 in each phase; ``t`` (seconds since the
    run start) = phase start offset + (seq - 1) / rate, where a phase lasts total / rate.

    The start offsets are a running sum over the (small) phases table.
    """
    dur = F.col(total).cast("double") / F.col(rate).cast("double")
    w = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    p = phases.withColumn("_start", F.coalesce(F.sum(dur).over(w), F.lit(0.0)))
    m = expand_counts(p, total, "seq")
    return m.withColumn("t", F.col("_start") + (F.col("seq") - 1).cast("double") / F.col(rate).cast("double")).drop("_start")


def stop_condition(seq: Column, t: Column, total: int | None, duration_secs: float | None) -> Column:
    """Keep while ``seq <= total`` and ``t < duration`` (each only when set; a duration of
    0 with a total means "total only")."""
    cond = F.lit(True)
    if total is not None:
        cond = cond & (seq <= F.lit(int(total)))
    if duration_secs:
        cond = cond & (t < F.lit(float(duration_secs)))
    return cond
