"""Streaming queries over the events table replayed by the file source: the message
pipeline (render, keyed loss, weighted routing) is stateless; windows keep state under a
watermark. Each returns the final table, equal to its batch form when nothing is late."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventloom.catalog import SEED, register, table
from eventloom.catalog.q_metrics import D_SQL, LOSS_PCT
from eventloom.catalog.q_routing import region_targets
from eventloom.functions import formats as fm
from eventloom.operators import loss, metrics as MX, routing
from eventloom.sources.messages import events_as_messages
from eventloom.sources.sinks import scratch_path
from eventloom.streaming import runs as RS

WATERMARK = "2 hours"


def _stream_delivery(spark, sf_dir):
    """Streaming delivery log: same columns as the batch one, with an instant event time."""
    like = table(spark, sf_dir, "events")
    ev = RS.file_source(spark, f"{sf_dir.rstrip('/')}/events*.parquet", like)
    m = events_as_messages(ev).withColumn("latency", F.col("latency") / 1000.0)
    m = m.filter(~loss.is_lost(SEED, "seq", LOSS_PCT))
    m = m.withColumn("message", fm.rfc5424(F.col("body"), ts=F.col("ts"), facility=1, severity=F.col("severity"),
                                           hostname=F.col("hostname"), app_name=F.col("app_name")))
    r = routing.route_weighted(m, region_targets(spark, sf_dir), seq="seq", weight="weight", order="target_idx")
    return r.select("seq", RS.event_time_utc(F.col("ts")).alias("et"), F.col("app_name").alias("phase"), "target",
                    F.octet_length(fm.frame_lf(F.col("message"))).cast("bigint").alias("bytes"), "latency", "message")


@register("stream_sliding_rate",
          f"SELECT strftime(time_bucket(INTERVAL '15 minutes', ts) - k * INTERVAL '15 minutes', '%Y-%m-%d %H:%M:%S') AS window_start, "
          f"phase, count(*) AS n, count(*) / CAST(3600.0 AS DOUBLE) AS rate FROM {D_SQL}, (SELECT unnest(range(4)) AS k) kk GROUP BY ALL")
def stream_sliding_rate(spark, sf_dir):
    """1-hour windows every 15 minutes per phase, with a watermark, from a replayed stream."""
    d = _stream_delivery(spark, sf_dir).withWatermark("et", WATERMARK)
    agg = d.groupBy(F.window("et", "1 hour", "15 minutes").alias("w"), "phase").agg(F.count(F.lit(1)).alias("n"))
    agg = agg.select(F.date_format(RS.to_utc_ntz(F.col("w.start")), "yyyy-MM-dd HH:mm:ss").alias("window_start"), "phase", "n")
    out = RS.run_to_table(spark, agg, ["window_start", "phase"], "stream-rate")
    return out.withColumn("rate", F.col("n") / F.lit(3600.0))


@register("stream_counters",
          "SELECT strftime(time_bucket(INTERVAL '15 minutes', ts), '%Y-%m-%d %H:%M:%S') AS window_start, phase, target, count(*) AS messages, "
          f"CAST(sum(bytes) AS BIGINT) AS bytes FROM {D_SQL} GROUP BY ALL")
def stream_counters(spark, sf_dir):
    """Messages and bytes of every 15-minute tumbling window, per phase and target, kept as streaming state."""
    d = _stream_delivery(spark, sf_dir).withWatermark("et", WATERMARK)
    agg = d.groupBy(F.window("et", "15 minutes").alias("w"), "phase", "target").agg(F.count(F.lit(1)).alias("messages"), F.sum("bytes").alias("bytes"))
    agg = agg.select(F.date_format(RS.to_utc_ntz(F.col("w.start")), "yyyy-MM-dd HH:mm:ss").alias("window_start"), "phase", "target", "messages", "bytes")
    return RS.run_to_table(spark, agg, ["window_start", "phase", "target"], "stream-counters")


def _stream_hist_sql():
    bounds = sorted(MX.LATENCY_BUCKETS)
    parts = []
    for b in bounds + [None]:
        le = "+Inf" if b is None else MX._le_text(b)
        cond = "TRUE" if b is None else f"latency <= {float(b)!r}"
        parts.append(f"SELECT strftime(time_bucket(INTERVAL '6 hours', ts), '%Y-%m-%d %H:%M:%S') AS window_start, phase, '{le}' AS le, "
                     f"count(*) FILTER (WHERE {cond}) AS bucket_count FROM {D_SQL} GROUP BY ALL")
    return " UNION ALL ".join(parts)


@register("stream_histogram", _stream_hist_sql())
def stream_histogram(spark, sf_dir):
    """Cumulative latency buckets per 6-hour window and phase, kept as streaming state."""
    bounds = sorted(MX.LATENCY_BUCKETS)
    d = _stream_delivery(spark, sf_dir).withWatermark("et", WATERMARK)
    aggs = [F.sum(F.when(F.col("latency") <= F.lit(b), 1).otherwise(0)).cast("bigint").alias(f"b{i}") for i, b in enumerate(bounds)]
    agg = d.groupBy(F.window("et", "6 hours").alias("w"), "phase").agg(*aggs, F.count(F.lit(1)).alias("binf"))
    agg = agg.select(F.date_format(RS.to_utc_ntz(F.col("w.start")), "yyyy-MM-dd HH:mm:ss").alias("window_start"), "phase",
                     *[f"b{i}" for i in range(len(bounds))], "binf")
    out = RS.run_to_table(spark, agg, ["window_start", "phase"], "stream-hist")
    entries = [F.struct(F.lit(MX._le_text(b)).alias("le"), F.col(f"b{i}").alias("bucket_count")) for i, b in enumerate(bounds)]
    entries.append(F.struct(F.lit("+Inf").alias("le"), F.col("binf").alias("bucket_count")))
    return out.select("window_start", "phase", F.explode(F.array(*entries)).alias("e")).select(
        "window_start", "phase", "e.le", "e.bucket_count")


@register("stream_route",
          f"SELECT target, count(*) AS messages, CAST(sum(bytes) AS BIGINT) AS bytes FROM {D_SQL} GROUP BY target")
def stream_route(spark, sf_dir):
    """Stateless streaming fan-out: render, keyed loss and weighted routing per micro-batch,
    written to one folder per target (idempotent per batch); counts and bytes read back."""
    d = _stream_delivery(spark, sf_dir).select("seq", "target", "bytes")
    out = RS.run_to_table(spark, d, ["seq"], "stream-route", output_mode="append", partition_by=["target"])
    return out.groupBy("target").agg(F.count(F.lit(1)).alias("messages"), F.sum("bytes").cast("bigint").alias("bytes"))


@register("stream_fanout",
          "SELECT target, count(*) AS messages, CAST(sum(bytes) AS BIGINT) AS bytes, min(message) AS first_message, "
          f"max(message) AS last_message FROM {D_SQL} GROUP BY target")
def stream_fanout(spark, sf_dir):
    """The routed messages themselves, written by a stream to one folder for each target under a commit table, read back."""
    base = scratch_path(spark, "stream-fanout")
    q = RS.write_committed(_stream_delivery(spark, sf_dir), f"{base}/out", f"{base}/checkpoint")
    q.awaitTermination()
    if q.exception():
        raise q.exception()
    return RS.read_committed(spark, f"{base}/out").groupBy("target").agg(
        F.count(F.lit(1)).alias("messages"), F.sum(F.octet_length("message") + 1).cast("bigint").alias("bytes"),
        F.min("message").alias("first_message"), F.max("message").alias("last_message"))


def _stream_p95_sql(q: float = 0.95) -> str:
    bounds = sorted(MX.LATENCY_BUCKETS)
    counts = ", ".join(f"count(*) FILTER (WHERE latency <= {b!r}) AS c{i}" for i, b in enumerate(bounds))
    cases = []
    for i, b in enumerate(bounds):
        lo, below = (repr(bounds[i - 1]), f"CAST(c{i - 1} AS DOUBLE)") if i else ("0.0", "CAST(0 AS DOUBLE)")
        lo, hi = f"CAST({lo} AS DOUBLE)", f"CAST({b!r} AS DOUBLE)"
        cases.append(f"WHEN c{i} >= rnk THEN CASE WHEN c{i} = {below} THEN {hi} ELSE {lo} + ({hi} - {lo}) * (rnk - {below}) / (CAST(c{i} AS DOUBLE) - {below}) END")
    return (f"WITH d AS (SELECT ts, phase, latency FROM {D_SQL}), "
            f"b AS (SELECT time_bucket(INTERVAL '6 hours', ts) AS w, phase, count(latency) AS messages, {counts} FROM d WHERE latency IS NOT NULL GROUP BY ALL), "
            f"r AS (SELECT *, CAST({q!r} AS DOUBLE) * messages AS rnk FROM b) "
            f"SELECT strftime(w, '%Y-%m-%d %H:%M:%S') AS window_start, phase, messages, CASE {' '.join(cases)} ELSE CAST({bounds[-1]!r} AS DOUBLE) END AS p95 "
            "FROM r WHERE w + INTERVAL '6 hours' <= (SELECT max(ts) - INTERVAL '2 hours' FROM d)")


@register("stream_p95", _stream_p95_sql())
def stream_p95(spark, sf_dir):
    """p95 of latency from buckets for every 6-hour window that the watermark closed, per phase, by two chained stateful
    steps in one stream; equal to ``histogram_p95`` of the window's rows."""
    d = _stream_delivery(spark, sf_dir).withWatermark("et", WATERMARK)
    p95 = RS.window_quantile(d, "et", ["phase"], F.col("latency"), MX.LATENCY_BUCKETS, "6 hours", 0.95)
    p95 = p95.select(F.date_format(RS.to_utc_ntz(F.col("window_start")), "yyyy-MM-dd HH:mm:ss").alias("window_start"), "phase",
                     F.col("messages").cast("bigint").alias("messages"), F.col("quantile").alias("p95"))
    return RS.run_to_table(spark, p95, ["window_start", "phase"], "stream-p95", output_mode="append")
