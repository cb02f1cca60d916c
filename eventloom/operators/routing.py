"""Routing of messages to targets: round-robin, weighted, broadcast.

Targets are usually a small configuration table: then the messages stream through a broadcast hash join and are not
shuffled. Its rows and bytes are counted before anything is broadcast; a larger table (any number of targets, any
weights) is joined by key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from eventloom.operators.schedule import prefix_sum
from eventloom.plans.lineage import cut

#: A target table is broadcast up to so many rows and bytes (as JSON text).
MAX_TARGETS, MAX_TARGET_BYTES = 10_000, 32 << 20
#: Targets of one block of the fan-out; parts that its messages are spread over where blocks aren't broadcast.
FAN_BLOCK, FAN_PARTS = 1000, 64


def _target_size(targets: DataFrame, weight: Column):
    """(rows, total weight, small enough to broadcast) of a target table, from one job."""
    size = F.sum(F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in targets.columns])))) if targets.columns else F.lit(0)
    n, total, size = targets.agg(F.count(F.lit(1)), F.sum(weight), size).first()
    return n, int(total or 0), n <= MAX_TARGETS and (size or 0) <= MAX_TARGET_BYTES


def _slot_bounds(targets: DataFrame, weight: Column, order: str, small: bool) -> DataFrame:
    """Targets with the slots [_lo, _hi) that are theirs, in target order: a running sum, blocked for a large table."""
    t = targets.withColumn("_w", weight)
    if small:
        before = F.sum("_w").over(Window.orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
        return t.withColumn("_hi", before).withColumn("_lo", F.col("_hi") - F.col("_w")).drop("_w")
    t = cut(t.orderBy(order).withColumn("_at", F.monotonically_increasing_id()))   # ascending in target order
    return prefix_sum(t, [], "_at", "_w", "_hi").withColumn("_lo", F.col("_hi") - F.col("_w")).drop("_w", "_at")


def route_weighted(msgs: DataFrame, targets: DataFrame, seq: str = "seq", weight: str | None = "weight",
                   order: str = "target_idx") -> DataFrame:
    """Each message goes to slot ``(seq - 1) mod total_weight``; a target owns as many consecutive slots as its weight.

    Weights below 1 count as 1 (an all-zero table is rejected by the checks). The interval that holds a slot is found by
    an equi-join on slot ranges: as many ranges as targets, each target in every range that its interval meets (at most two
    rows a target in all), so a message meets two candidates on average, whatever the weights.
    """
    w = F.greatest(F.coalesce(F.col(weight).cast("bigint"), F.lit(1)), F.lit(1)) if weight else F.lit(1).cast("bigint")
    n_targets, total, small = _target_size(targets, w)
    if n_targets == 0:
        raise ValueError("no targets")
    width = -(-total // n_targets)
    bounds = _slot_bounds(targets, w, order, small)
    bounds = bounds.withColumn("_range", F.explode(F.sequence(F.expr(f"_lo div {width}L"), F.expr(f"(_hi - 1) div {width}L"))))
    keyed = msgs.withColumn("_slot", F.pmod(F.col(seq).cast("bigint") - 1, F.lit(total))).withColumn("_at_range", F.expr(f"_slot div {width}L"))
    own = (F.col("_at_range") == F.col("_range")) & (F.col("_slot") >= F.col("_lo")) & (F.col("_slot") < F.col("_hi"))
    return keyed.join(F.broadcast(bounds) if small else bounds, own, "inner").drop("_slot", "_at_range", "_range", "_lo", "_hi")


def route_round_robin(msgs: DataFrame, targets: DataFrame, seq: str = "seq", order: str = "target_idx") -> DataFrame:
    """Message ``seq`` goes to target ``(seq - 1) mod n`` in target order."""
    return route_weighted(msgs, targets, seq=seq, weight=None, order=order)


def route_broadcast(msgs: DataFrame, targets: DataFrame, target_cols: list[str] | None = None) -> DataFrame:
    """Every message to every target (fan-out by definition: |msgs| x |targets| rows).

    Targets are gathered in blocks of about ``FAN_BLOCK``; a message meets each block once and is exploded by it, so its
    text is built once and not shuffled while the blocks are small enough to broadcast. Larger blocks are joined by
    (block, part), a part being some of the messages' partitions.
    """
    cols = target_cols or targets.columns
    n, _, small = _target_size(targets.select(*cols), F.lit(1))
    blocks = max(-(-n // FAN_BLOCK), 1)
    rows = F.struct(*[F.col(f"`{c}`") for c in cols]).alias("_t")
    if blocks == 1:
        listed = targets.select(rows, F.lit(0).alias("_block"))
    else:
        listed = cut(targets.select(rows, F.monotonically_increasing_id().alias("_id"))) \
            .select("_t", F.pmod(F.xxhash64("_id"), F.lit(blocks)).cast("int").alias("_block"))
    listed = listed.groupBy("_block").agg(F.collect_list("_t").alias("_ts"))
    met = msgs.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))) if blocks > 1 else msgs.withColumn("_block", F.lit(0))
    if small:
        fan = met.join(F.broadcast(listed), "_block")
    else:
        listed = listed.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(FAN_PARTS - 1))))
        fan = met.withColumn("_part", F.pmod(F.spark_partition_id(), F.lit(FAN_PARTS))).join(listed, ["_block", "_part"])
    return fan.select(*[F.col(f"`{c}`") for c in msgs.columns], F.explode("_ts").alias("_t")) \
        .select(*[F.col(f"`{c}`") for c in msgs.columns], *[F.col(f"_t.`{c}`").alias(c) for c in cols])


def route_index(seq: Column, weights: list[int]) -> Column:
    """0-based target index for an in-line weight list (profile targets given as config)."""
    ws = [max(int(w or 0), 1) for w in weights]
    total = sum(ws)
    cum = []
    acc = 0
    for w in ws:
        acc += w
        cum.append(acc)
    slot = F.pmod(seq.cast("bigint") - 1, F.lit(total))
    return F.size(F.filter(F.array(*[F.lit(c) for c in cum]), lambda c: c <= slot)).cast("int")
