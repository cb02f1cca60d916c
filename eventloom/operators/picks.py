"""Weighted / Zipf picks over a large value domain (a table, not a literal list).

The domain table has one row per value with a weight. Cumulative bounds come from the
blocked running sum (no single-task window over the domain); each value's interval
[lo, hi) is exploded onto the equal-width buckets of [0, total) it touches (rows = values +
buckets); that table is broadcast up to a checked size, and each message joins on its
bucket and keeps the one interval holding ``u * total``. Zero-weight values have empty
intervals and are never picked.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from eventloom.functions import draws as D
from eventloom.operators.schedule import prefix_sum
from eventloom.plans.broadcast import maybe_broadcast

DEFAULT_BUCKETS = 1 << 16
BROADCAST_ROWS = 2_000_000


def zipf_weights(domain: DataFrame, rank: str, exponent: float = 1.0) -> DataFrame:
    """Weight 1 / rank^s for a 1-based rank column."""
    return domain.withColumn("_w", F.lit(1.0) / F.pow(F.col(rank).cast("double"), F.lit(float(exponent))))


def pick_table(domain: DataFrame, order: str, weight: str, buckets: int = DEFAULT_BUCKETS) -> DataFrame:
    """(bucket, lo, hi, total, domain columns…) rows for the bucketed range join."""
    w = domain.withColumn("_wt", F.greatest(F.coalesce(F.col(weight).cast("double"), F.lit(0.0)), F.lit(0.0))) \
        .withColumn("_one", F.lit(0))
    largest = w.agg(F.max("_wt")).first()[0] or 0.0          # one scalar
    # whole units of the largest weight / 2^52: their sums are exact in any order, so the intervals tile [0, total)
    units = F.when(F.col("_wt") > 0, F.greatest(F.lit(1.0), F.round(F.col("_wt") / F.lit(largest) * F.lit(2.0 ** 52)))).otherwise(F.lit(0.0))
    w = w.withColumn("_units", units.cast("decimal(20,0)"))
    c = prefix_sum(w, ["_one"], order, "_units", "_upto", max_depth=2)
    weight_of = lambda u: u.cast("double") / F.lit(2.0 ** 52) * F.lit(largest)
    total = c.agg(weight_of(F.max("_upto"))).first()[0] or 0.0  # one scalar
    c = (c.withColumn("_hi", weight_of(F.col("_upto"))).withColumn("_lo", weight_of(F.col("_upto") - F.col("_units")))
          .filter(F.col("_wt") > 0).drop("_units", "_upto"))
    scale = float(buckets) / total if total > 0 else 0.0
    b_lo = F.floor(F.col("_lo") * F.lit(scale)).cast("bigint")
    b_hi = F.least(F.floor(F.col("_hi") * F.lit(scale)).cast("bigint"), F.lit(buckets - 1))
    return (c.withColumn("_bucket", F.explode(F.sequence(b_lo, F.greatest(b_lo, b_hi))))
             .withColumn("_total", F.lit(float(total))).drop("_one", "_wt"))


def pick_by_weight(df: DataFrame, seed: int, key, salt: str, table: DataFrame, buckets: int = DEFAULT_BUCKETS,
                   keep: list[str] | None = None) -> DataFrame:
    """Join each row to the domain value whose interval holds ``draw * total``."""
    t = maybe_broadcast(table, BROADCAST_ROWS)
    total_row = table.select("_total").first()
    if total_row is None:
        raise ValueError("no value with a positive weight")
    total = float(total_row[0])
    x = D.draw(seed, key, salt) * F.lit(total)
    m = df.withColumn("_x", x).withColumn(
        "_bucket", F.least(F.floor(F.col("_x") * F.lit(float(buckets) / total)).cast("bigint"), F.lit(buckets - 1)))
    j = m.join(t, "_bucket", "inner").filter((F.col("_x") >= F.col("_lo")) & (F.col("_x") < F.col("_hi")))
    drop = ["_bucket", "_x", "_lo", "_hi", "_total"]
    return j.drop(*drop) if keep is None else j.select(*keep)
