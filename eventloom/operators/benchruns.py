"""Benchmark-result analytics as DataFrame jobs: medians across runs, baseline comparison
with category thresholds, missing labels, variant decisions, per-cell measurements and
verdicts, the workload × run × tool matrix, aggregate status, integrity and report pivots."""

from __future__ import annotations

from typing import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from eventloom.operators.quantiles import exact_quantiles

# ---- fixed values (statuses, tolerances, texts) ------------------------------------------
STATUS_COMPLETED, STATUS_FAILED, STATUS_SKIPPED, STATUS_DRY_RUN, STATUS_NA = "completed", "failed", "skipped", "dry_run", "n_a"
RATE_TOLERANCE = 0.05
SIZE_TOLERANCE = 0.05
MIN_WINDOW_SECS = 0.001
SKIP_REASON = "no cell result (runner never executed or did not write)"
SIZE_CUT_MIN_PCT = 30.0
MAX_REGRESSION_PCT = 5.0
# -------------------------------------------------------------------------------------------


def _bound(value: Column, then) -> Column:
    """then(value), with value computed once a row."""
    return F.element_at(F.transform(F.array(value), then), 1)


def round_half_even(x: Column, digits: int) -> Column:
    """x to that many digits (0 to 3): the decimal nearest to the exact binary value, ties to the even digit.

    The fraction is taken as an integer of 2^-53, so that ties are decided exactly. Numbers from 2^52 on (and NaN,
    infinities, null) stay. The result is the double nearest to that decimal while |x| 10^digits < 2^53.
    """
    m, half = 10 ** digits, 1 << 52

    def near(x, whole, units, below):
        n = units * F.lit(m) + F.floor(below)
        q, rest = whole * F.lit(m) + F.shiftright(n, 53), n.bitwiseAND(F.lit((1 << 53) - 1))
        more = (rest > half) | ((rest == half) & ((below > F.floor(below)) | (q.bitwiseAND(F.lit(1)) == 1)))
        rounded = (q + more.cast("long")).cast("double") / F.lit(float(m))
        return F.when(F.abs(x) < half, F.when(x < 0, -rounded).otherwise(rounded)).otherwise(x)

    # each step is bound once, so that the expression doesn't grow with every use of the one before
    return _bound(x, lambda x: _bound(F.when(F.abs(x) < half, F.abs(x)).otherwise(F.lit(0.0)), lambda size: _bound(
        F.floor(size), lambda whole: _bound((size - whole) * F.lit(float(1 << 53)), lambda scaled: _bound(
            F.floor(scaled), lambda units: near(x, whole, units, (scaled - units) * F.lit(float(m))))))))


def median_runs(est: DataFrame, label: str, values: Sequence[str], first_by: Column,
                first_cols: Sequence[str] = ()) -> DataFrame:
    """Exact median of each value column by label (truncated to bigint), ``n_samples``, and
    ``first_cols`` taken from the earliest row by ``first_by``.

    The value columns are stacked into (label, metric, v) so one rank-selection job serves
    all of them; no label is ever gathered into a single task.
    """
    stacked = est.select(label, F.explode(F.array(*[F.struct(F.lit(v).alias("metric"), F.col(v).cast("double").alias("v"))
                                                     for v in values])).alias("_m")).select(label, "_m.metric", "_m.v")
    med = exact_quantiles(stacked, [label, "metric"], "v", [0.5])
    wide = med.groupBy(label).pivot("metric", list(values)).agg(F.first("q50"))
    meta = est.groupBy(label).agg(F.count(F.lit(1)).alias("n_samples"),
                                  *[F.min_by(c, first_by).alias(c) for c in first_cols])
    meta = meta.withColumnRenamed(label, "_label")
    return wide.join(meta, F.col(f"`{label}`").eqNullSafe(F.col("_label"))).select(
        label, *first_cols, *[F.col(v).cast("bigint").alias(v) for v in values],
        "n_samples")


def categorize(label: Column, rules: Sequence[tuple[str, str, str]], default: str = "other") -> Column:
    """Category of a label from ordered ``(kind, text, category)`` rules; kind is
    ``prefix`` or ``contains``. First matching rule wins."""
    expr = None
    for kind, text, cat in rules:
        cond = label.startswith(text) if kind == "prefix" else label.contains(text)
        expr = F.when(cond, F.lit(cat)) if expr is None else expr.when(cond, F.lit(cat))
    return expr.otherwise(F.lit(default)) if expr is not None else F.lit(default)


def compare_to_baseline(base: DataFrame, curr: DataFrame, label: str, value: str, category: Column,
                        thresholds: DataFrame) -> DataFrame:
    """Inner join on label (labels missing from current are ignored; zero baselines skipped),
    delta % vs baseline and a REGRESS / IMPROVE / none flag against the category threshold."""
    j = (base.select(label, F.col(value).alias("base_ns")).join(curr.select(label, F.col(value).alias("curr_ns")), label, "inner")
             .filter(F.col("base_ns") != 0)
             .withColumn("category", category))
    j = j.join(F.broadcast(thresholds), "category", "left")
    delta = (F.col("curr_ns") - F.col("base_ns")).cast("double") / F.col("base_ns").cast("double") * 100.0
    return j.withColumn("delta_pct", delta).withColumn(
        "verdict", F.when(F.col("delta_pct") > F.col("threshold"), "REGRESS")
                    .when(F.col("delta_pct") < -F.col("threshold"), "IMPROVE").otherwise("none"))


def gate(compared: DataFrame) -> DataFrame:
    """Overall pass flag: no regression beyond its threshold."""
    return compared.agg(F.count_if(F.col("verdict") == "REGRESS").alias("regressions"),
                        F.count_if(F.col("verdict") == "IMPROVE").alias("improvements")) \
        .withColumn("pass", F.col("regressions") == 0)


def missing_labels(base: DataFrame, head: DataFrame, label: str) -> DataFrame:
    return base.select(label).distinct().join(head.select(label), label, "left_anti")


def variant_decision(sizes: DataFrame, medians: DataFrame, variant: str, label: str, value: str,
                     base_variant: str, order: Sequence[str]) -> DataFrame:
    """Size cut ≥ 30 % vs the base variant and worst per-label slowdown ≤ 5 % → eligible;
    the eligible variant with the largest cut wins (strictly larger; earlier in ``order``
    wins a tie). ``sizes`` has one row per variant (a handful), so the whole-table windows
    below run over that handful only."""
    everything = Window.partitionBy()
    base_m = medians.filter(F.col(variant) == base_variant).select(label, F.col(value).alias("_b"))
    reg = (medians.filter(F.col(variant) != base_variant).join(base_m, label, "inner")
                  .groupBy(variant).agg(F.greatest(F.max((F.col(value) - F.col("_b")) / F.col("_b") * 100.0), F.lit(0.0))
                                        .alias("max_regress_pct")))
    s = (sizes.withColumn("_base", F.max(F.when(F.col(variant) == base_variant, F.col("size"))).over(everything))
              .filter(F.col(variant) != base_variant)
              .withColumn("reduction_pct", (F.col("_base") - F.col("size")) / F.col("_base") * 100.0)
              .join(reg, variant, "left")
              .withColumn("eligible", (F.col("reduction_pct") >= SIZE_CUT_MIN_PCT)
                          & (F.coalesce(F.col("max_regress_pct"), F.lit(0.0)) <= MAX_REGRESSION_PCT)))
    pos = F.array_position(F.array(*[F.lit(o) for o in order]), F.col(variant))
    key = F.when(F.col("eligible"), F.struct(F.col("reduction_pct"), -pos))
    best = F.max_by(F.col(variant), key).over(everything)
    return s.withColumn("winner", F.coalesce(F.col(variant) == best, F.lit(False))).drop("_base")


def receiver_totals(msgs: DataFrame, cell: Sequence[str], body_bytes: str, wire_bytes: str, error: str,
                    order_key: Column, t: Column) -> DataFrame:
    """Per cell: body bytes, wire bytes, messages, span seconds and the first error."""
    return msgs.groupBy(*cell).agg(
        F.sum(body_bytes).cast("bigint").alias("bytes"), F.sum(wire_bytes).cast("bigint").alias("wire_bytes"),
        F.count(F.lit(1)).alias("messages"),
        (F.max(t) - F.min(t)).alias("duration_secs"),
        F.min_by(F.col(error), F.when(F.col(error).isNotNull(), order_key)).alias("error"))


def cell_measures(totals: DataFrame, target_rate: Column, spec_size: Column) -> DataFrame:
    """window ≥ 1 ms; achieved rate, % of target, bytes per message, size deviation (zeros
    when nothing was received); rounding to 2/1/2/2 digits."""
    m = F.col("messages")
    window = F.greatest(F.lit(MIN_WINDOW_SECS), F.col("duration_secs").cast("double"))
    has = m > 0
    achieved = F.when(has, round_half_even(m / window, 2)).otherwise(F.lit(0.0))
    rate_pct = F.when(has, round_half_even(F.lit(100.0) * m / window / target_rate, 1)).otherwise(F.lit(0.0))
    bpm = F.when(has, round_half_even(F.col("bytes") / F.greatest(F.lit(1), m), 2)).otherwise(F.lit(0.0))
    return (totals.withColumn("window_secs", round_half_even(window, 3))
                  .withColumn("achieved_msg_per_sec", achieved)
                  .withColumn("rate_pct_of_target", rate_pct)
                  .withColumn("actual_bytes_per_msg", bpm)
                  .withColumn("size_pct_deviation", F.when(has, round_half_even(
                      F.lit(100.0) * F.abs(F.col("actual_bytes_per_msg") - spec_size) / spec_size, 2)).otherwise(F.lit(0.0))))


def cell_verdict(meas: DataFrame, exit_code: Column) -> DataFrame:
    """status + fail reasons in fixed order: exit code, receiver error, zero messages,
    rate below/above tolerance, size outside tolerance."""
    lo, hi = 100.0 * (1 - RATE_TOLERANCE), 100.0 * (1 + RATE_TOLERANCE)
    tol_r, tol_s = int(100 * RATE_TOLERANCE), int(100 * SIZE_TOLERANCE)
    m = F.col("messages")
    rp, sp = F.col("rate_pct_of_target").cast("string"), F.col("size_pct_deviation").cast("string")
    reasons = F.array(
        F.when(exit_code != 0, F.concat(F.lit("runner_exit_code="), exit_code.cast("string"))),
        F.when(F.col("error").isNotNull(), F.concat(F.lit("receiver_error="), F.col("error"))),
        F.when(m == 0, F.lit("zero_messages_received")),
        F.when((m > 0) & (F.col("rate_pct_of_target") < lo), F.concat(F.lit(f"rate_below_{tol_r}%_tolerance="), rp, F.lit("%"))),
        F.when((m > 0) & (F.col("rate_pct_of_target") > hi), F.concat(F.lit(f"rate_above_{tol_r}%_tolerance="), rp, F.lit("%"))),
        F.when((m > 0) & (F.col("size_pct_deviation") > 100.0 * SIZE_TOLERANCE),
               F.concat(F.lit(f"size_outside_{tol_s}%_tolerance="), sp, F.lit("%"))),
    )
    r = F.array_compact(reasons)
    return meas.withColumn("exit_code", exit_code).withColumn("fail_reasons", r).withColumn(
        "status", F.when(F.size(r) == 0, F.lit(STATUS_COMPLETED)).otherwise(F.lit(STATUS_FAILED)))


def cell_matrix(workloads: DataFrame, workload: str, max_run: Column, tools: Sequence[str], cells: DataFrame) -> DataFrame:
    """Every (workload, run, tool) with its cell, or a ``skipped`` row when none exists.

    Runs and tools are expanded per workload row (bounded configuration), then one left
    join against the cells.
    """
    grid = (workloads.select(workload).withColumn("run_idx", F.explode(F.sequence(F.lit(1), max_run)))
                     .withColumn("tool", F.explode(F.array(*[F.lit(t) for t in tools]))))
    j = grid.join(cells, [workload, "run_idx", "tool"], "left")
    missing = F.col("status").isNull()
    return j.withColumn("skip_reason", F.when(missing, F.lit(SKIP_REASON))) \
            .withColumn("has_measurements", ~missing) \
            .withColumn("status", F.coalesce(F.col("status"), F.lit(STATUS_SKIPPED)))


def aggregate_status(matrix: DataFrame) -> DataFrame:
    n = F.count(F.lit(1))
    done = F.count_if(F.col("status") == STATUS_COMPLETED)
    other = F.count_if(F.col("status").isin(STATUS_SKIPPED, STATUS_DRY_RUN, STATUS_NA))
    return matrix.agg(n.alias("cells"), done.alias("completed"), other.alias("not_run")).select(
        "cells", "completed", "not_run",
        F.when(F.col("cells") == 0, "schema_only").when(F.col("completed") == F.col("cells"), "complete")
         .when(F.col("not_run") == F.col("cells"), "dry_run").otherwise("partial").alias("status"))


def integrity(matrix: DataFrame, key: Column) -> DataFrame:
    """completed ⇒ has measurements; skipped / n_a ⇒ none. One row: ok, count, first offender."""
    bad = ((F.col("status") == STATUS_COMPLETED) & ~F.col("has_measurements")) | \
          (F.col("status").isin(STATUS_SKIPPED, STATUS_NA) & F.col("has_measurements"))
    return matrix.agg(F.count_if(bad).alias("violations"), F.min(F.when(bad, key)).alias("first_offender")) \
        .withColumn("ok", F.col("violations") == 0)


def fmt_cell(status: Column, skip_reason: Column, error: Column, fail_reasons: Column,
             na_reason: Column | None = None) -> Column:
    """Report text of a cell (reasons cut to 27 + '...' beyond 30; errors 37 + '...' beyond 40)."""
    def cut(x: Column, keep: int, limit: int) -> Column:
        return F.when(F.length(x) > limit, F.concat(F.left(x, F.lit(keep)), F.lit("..."))).otherwise(x)
    err = F.when(F.coalesce(error, F.lit("")) == "", F.coalesce(F.array_join(fail_reasons, "; "), F.lit(""))).otherwise(error)
    return (F.when(status == STATUS_COMPLETED, F.lit("completed"))
             .when(status == STATUS_SKIPPED, F.concat(F.lit("skipped ("), cut(F.coalesce(skip_reason, F.lit("")), 27, 30), F.lit(")")))
             .when(status == STATUS_DRY_RUN, F.lit("dry_run"))
             .when(status == STATUS_FAILED, F.concat(F.lit("failed ("), cut(err, 37, 40), F.lit(")")))
             .when(status == STATUS_NA, F.concat(F.lit("n/a ("), cut(F.coalesce(na_reason if na_reason is not None
                                                                         else F.lit(None).cast("string"), F.lit("")), 27, 30),
                                                 F.lit(")")))
             .otherwise(status))


def throughput_text(status: Column, rate: Column, messages: Column, received: Column) -> Column:
    """Throughput text of a cell: its rate with one digit, else its messages, else its bytes; '-' unless it is completed."""
    def shown(x: Column, unit: str) -> Column:
        return F.concat(x.cast("string"), F.lit(f" {unit}"))
    some = F.coalesce(shown(round_half_even(rate, 1).cast("decimal(20,1)"), "msg/s"), shown(messages.cast("bigint"), "msg"),
                      shown(received.cast("bigint"), "B"), F.lit("-"))
    return F.when(status == STATUS_COMPLETED, some).otherwise(F.lit("-"))


def report_pivot(matrix: DataFrame, workload: str, tools: Sequence[str], text: Column, order: Mapping[str, int]) -> DataFrame:
    """workload × tool table of the first run's cell text; '-' where a tool has no cell."""
    first = matrix.groupBy(workload, "tool").agg(F.min_by(text, F.col("run_idx")).alias("_t"))
    p = first.groupBy(workload).pivot("tool", list(tools)).agg(F.first("_t"))
    ordc = F.coalesce(F.create_map(*[x for k, v in order.items() for x in (F.lit(k), F.lit(v))])[F.col(workload)], F.lit(len(order)))
    return p.select(workload, ordc.alias("row_order"), *[F.coalesce(F.col(t), F.lit("-")).alias(t) for t in tools])
