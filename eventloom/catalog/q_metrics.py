"""Metric queries over a delivery log built from events: counters, bytes, histograms,
quantiles, windowed rates, loss ratio, gauges and the Prometheus text export."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventloom.catalog import SEED, register, table
from eventloom.catalog.q_routing import ROT_INTERVAL, ROT_ORIGIN, SQL_RENDERED, _slots_sql, region_targets
from eventloom.catalog.q_volume import ANOMALIES, EVT_SQL, _ev_t
from eventloom.functions import curves as CV
from eventloom.functions import formats as fm
from eventloom.operators import loss, metrics as MX, routing
from eventloom.operators.quantiles import exact_quantiles
from eventloom.sources.messages import events_as_messages

LOSS_PCT = 5.0


def delivery_log(spark, sf_dir, with_lost: bool = False):
    """One row per sent message: seq, ts, phase, target, transport, result, bytes (LF framed),
    latency (s). Lost messages are removed unless ``with_lost``. One scan of events, no shuffle
    (routing is a broadcast join)."""
    m = events_as_messages(table(spark, sf_dir, "events"))
    msgs = m.select("seq", "ts", "app_name", (F.col("latency") / 1000.0).alias("latency"),
                    fm.rfc5424(F.col("body"), ts=F.col("ts"), facility=1, severity=F.col("severity"),
                               hostname=F.col("hostname"), app_name=F.col("app_name")).alias("message"))
    msgs = msgs.withColumn("lost", loss.is_lost(SEED, "seq", LOSS_PCT))
    if not with_lost:
        msgs = msgs.filter(~F.col("lost"))
    t = region_targets(spark, sf_dir).withColumn(
        "transport", F.when(F.col("target_idx") % 2 == 0, "tcp").otherwise("udp"))
    r = routing.route_weighted(msgs, t, seq="seq", weight="weight", order="target_idx")
    return r.select("seq", "ts", F.col("app_name").alias("phase"), "target", "transport", "lost",
                    F.when(F.col("app_name") == "error", "error").otherwise("ok").alias("result"),
                    F.octet_length(fm.frame_lf(F.col("message"))).cast("bigint").alias("bytes"), "latency", "message")


def delivery_sql(with_lost: bool = False) -> str:
    lost = loss.sql_is_lost(SEED, "r.seq", LOSS_PCT)
    where = "" if with_lost else f"WHERE NOT {lost}"
    return (
        f"SELECT r.seq, r.ts, e.event_type AS phase, s.target, CASE WHEN s.target_idx % 2 = 0 THEN 'tcp' ELSE 'udp' END AS transport, "
        f"{lost} AS lost, CASE WHEN e.event_type = 'error' THEN 'error' ELSE 'ok' END AS result, "
        "CAST(strlen(r.message || chr(10)) AS BIGINT) AS bytes, e.value / 1000.0 AS latency, r.message "
        f"FROM ({SQL_RENDERED}) r JOIN events e ON r.seq = e.event_id + 1 "
        f"JOIN ({_slots_sql(True)}) s ON (r.seq - 1) % s.total >= s.lo AND (r.seq - 1) % s.total < s.lo + s.w {where}")


D_SQL = f"({delivery_sql()}) d"


@register("count_by_labels", f"SELECT transport, phase, target, result, count(*) AS value FROM {D_SQL} GROUP BY ALL")
def count_by_labels(spark, sf_dir):
    return MX.count_by(delivery_log(spark, sf_dir), ["transport", "phase", "target", "result"])


@register("bytes_by_labels", f"SELECT transport, phase, target, CAST(sum(bytes) AS BIGINT) AS value FROM {D_SQL} GROUP BY ALL")
def bytes_by_labels(spark, sf_dir):
    return MX.sum_by(delivery_log(spark, sf_dir), ["transport", "phase", "target"], F.col("bytes"))


@register("generated_vs_sent",
          f"SELECT phase, count(*) AS generated, count(*) FILTER (WHERE NOT lost) AS sent, "
          f"count(*) FILTER (WHERE lost) AS dropped FROM ({delivery_sql(True)}) d GROUP BY phase")
def generated_vs_sent(spark, sf_dir):
    """Generated counts (before loss), sent and dropped, by phase, in one pass."""
    d = delivery_log(spark, sf_dir, with_lost=True)
    return d.groupBy("phase").agg(F.count(F.lit(1)).alias("generated"), F.count_if(~F.col("lost")).alias("sent"),
                                  F.count_if(F.col("lost")).alias("dropped"))


@register("by_format_sink",
          "SELECT 'rfc5424' AS format, transport, count(*) AS value, CAST(sum(bytes) AS BIGINT) AS bytes "
          f"FROM {D_SQL} GROUP BY transport")
def by_format_sink(spark, sf_dir):
    d = delivery_log(spark, sf_dir).withColumn("format", F.lit("rfc5424"))
    return d.groupBy("format", "transport").agg(F.count(F.lit(1)).alias("value"),
                                                F.sum("bytes").cast("bigint").alias("bytes"))


@register("event_counts",
          f"SELECT target, 'error' AS kind, count(*) AS value FROM {D_SQL} WHERE result = 'error' GROUP BY target")
def event_counts(spark, sf_dir):
    """Error-type counters: one count_by with a predicate over the delivery log."""
    d = delivery_log(spark, sf_dir).withColumn("kind", F.lit("error"))
    return MX.count_by(d, ["target", "kind"], where=F.col("result") == "error")


def _anom_sql():
    parts = []
    for a in ANOMALIES:
        if a["type"] == "packet-loss":
            continue
        m = CV.sql_anomaly_multiplier("t", [a])
        parts.append(f"SELECT 'applied' AS kind, '{a['type']}' AS rule, count(*) AS value FROM ({EVT_SQL}) e "
                     f"WHERE abs({m} - 1.0) > 1e-12 HAVING count(*) > 0")
    lost = loss.sql_is_lost(SEED, "seq", [a["loss_percent"] for a in ANOMALIES if a["type"] == "packet-loss"])
    parts.append(f"SELECT 'dropped' AS kind, 'packet-loss' AS rule, count(*) AS value FROM ({EVT_SQL}) e WHERE {lost}")
    return " UNION ALL ".join(parts)


@register("anomaly_counts", _anom_sql())
def anomaly_counts(spark, sf_dir):
    """applied: messages whose rule multiplier is not 1, per rule; dropped: lost messages."""
    e = _ev_t(spark, sf_dir)
    rate_rules = [a for a in ANOMALIES if a["type"] != "packet-loss"]
    ex = e.select("seq", "t", F.explode(CV.anomaly_array(rate_rules)).alias("a"))
    applied = (ex.filter(F.abs(CV.anomaly_factor(F.col("t"), F.col("a")) - 1.0) > 1e-12)
                 .groupBy(F.col("a.type").alias("rule")).agg(F.count(F.lit(1)).alias("value"))
                 .select(F.lit("applied").alias("kind"), "rule", "value"))
    pcts = [a["loss_percent"] for a in ANOMALIES if a["type"] == "packet-loss"]
    dropped = (e.filter(loss.is_lost(SEED, "seq", pcts))
                .agg(F.count(F.lit(1)).alias("value"))
                .select(F.lit("dropped").alias("kind"), F.lit("packet-loss").alias("rule"), "value"))
    return applied.unionByName(dropped)


def _hist_sql(value: str, labels: list[str], bounds) -> str:
    lab = ", ".join(labels)
    sel = []
    for b in sorted(bounds):
        sel.append(f"SELECT {lab}, '{MX._le_text(b)}' AS le, CAST({float(b)!r} AS DOUBLE) AS le_value, "
                   f"CAST(count(*) FILTER (WHERE {value} <= {float(b)!r}) AS BIGINT) AS bucket_count, "
                   f"round(sum({value}), 9) AS sum, count({value}) AS count FROM {D_SQL} GROUP BY {lab}")
    sel.append(f"SELECT {lab}, '+Inf' AS le, CAST('inf' AS DOUBLE) AS le_value, count({value}) AS bucket_count, "
               f"round(sum({value}), 9) AS sum, count({value}) AS count FROM {D_SQL} GROUP BY {lab}")
    return " UNION ALL ".join(sel)


@register("size_histogram", _hist_sql("CAST(bytes AS DOUBLE)", ["target"], MX.SIZE_BUCKETS))
def size_histogram(spark, sf_dir):
    d = delivery_log(spark, sf_dir)
    return MX.histogram(d, ["target"], F.col("bytes").cast("double"), MX.SIZE_BUCKETS).withColumn("sum", F.round("sum", 9))


@register("topic_bytes_histogram", _hist_sql("CAST(strlen(message) AS DOUBLE)", ["target"], MX.TOPIC_BYTES_BUCKETS))
def topic_bytes_histogram(spark, sf_dir):
    """Payload bytes of topic records (messages without framing) by target."""
    size = F.octet_length("message").cast("double")
    return MX.histogram(delivery_log(spark, sf_dir), ["target"], size, MX.TOPIC_BYTES_BUCKETS).withColumn("sum", F.round("sum", 9))


@register("topic_latency_histogram", _hist_sql("latency", ["target"], MX.TOPIC_LATENCY_BUCKETS))
def topic_latency_histogram(spark, sf_dir):
    """Latency of topic records by target."""
    return MX.histogram(delivery_log(spark, sf_dir), ["target"], F.col("latency"), MX.TOPIC_LATENCY_BUCKETS).withColumn("sum", F.round("sum", 9))


@register("drain_histogram", _hist_sql("latency * 100.0", ["transport"], MX.DRAIN_BUCKETS))
def drain_histogram(spark, sf_dir):
    """Drain times by transport; a message's latency in hundredths of a second stands in for one drain."""
    return MX.histogram(delivery_log(spark, sf_dir), ["transport"], F.col("latency") * 100.0, MX.DRAIN_BUCKETS).withColumn("sum", F.round("sum", 9))


@register("latency_histogram", _hist_sql("latency", ["phase"], MX.LATENCY_BUCKETS))
def latency_histogram(spark, sf_dir):
    d = delivery_log(spark, sf_dir)
    # a floating sum depends on summation order: the sum carries 9 decimals
    return MX.histogram(d, ["phase"], F.col("latency"), MX.LATENCY_BUCKETS).withColumn("sum", F.round("sum", 9))


def _p95_sql(q: float = 0.95) -> str:
    h = _hist_sql("latency", ["phase"], MX.LATENCY_BUCKETS)
    return (
        f"WITH h AS ({h}), f AS (SELECT * FROM h WHERE le <> '+Inf'), "
        "t AS (SELECT phase, bucket_count AS total FROM h WHERE le = '+Inf'), "
        f"j AS (SELECT f.*, t.total, CAST({q!r} AS DOUBLE) * t.total AS rnk, "
        "lag(le_value) OVER (PARTITION BY f.phase ORDER BY le_value) AS lo_b, "
        "lag(bucket_count) OVER (PARTITION BY f.phase ORDER BY le_value) AS lo_c, "
        "max(le_value) OVER (PARTITION BY f.phase) AS top FROM f JOIN t USING (phase)), "
        "hit AS (SELECT phase, min(le_value) AS hb FROM j WHERE bucket_count >= rnk GROUP BY phase), "
        "x AS (SELECT j.phase, j.total, j.top, j.rnk, h2.* EXCLUDE (phase) FROM (SELECT DISTINCT phase, total, top, rnk FROM j) j "
        "LEFT JOIN (SELECT j.phase, coalesce(lo_b, 0.0) AS lo, CAST(coalesce(lo_c, 0) AS DOUBLE) AS c_lo, le_value AS hi, "
        "CAST(bucket_count AS DOUBLE) AS c_hi FROM j JOIN hit ON j.phase = hit.phase AND j.le_value = hit.hb) h2 ON j.phase = h2.phase) "
        "SELECT phase, CASE WHEN total <= 0 THEN NULL WHEN hi IS NULL THEN top WHEN c_hi = c_lo THEN hi "
        "ELSE lo + (hi - lo) * (rnk - c_lo) / (c_hi - c_lo) END AS quantile FROM x")


@register("histogram_p95", _p95_sql())
def histogram_p95(spark, sf_dir):
    """PromQL-style p95 from the cumulative latency buckets, per phase."""
    h = latency_histogram(spark, sf_dir)
    return MX.histogram_quantile(h, ["phase"], 0.95)


@register("latency_p95_direct",
          f"SELECT phase, round(quantile_cont(latency, 0.95), 9) AS p95 FROM {D_SQL} GROUP BY phase")
def latency_p95_direct(spark, sf_dir):
    """The direct (exact, interpolated) p95 of latency per phase, to 9 decimals: engines interpolate to different last bits."""
    return exact_quantiles(delivery_log(spark, sf_dir), ["phase"], "latency", [0.95]).select("phase", F.round("q95", 9).alias("p95"))


WIN_FMT = "yyyy-MM-dd HH:mm:ss"


@register("sliding_rate",
          f"SELECT strftime(time_bucket(INTERVAL '15 minutes', ts) - k * INTERVAL '15 minutes', '%Y-%m-%d %H:%M:%S') AS window_start, "
          f"phase, count(*) AS n, count(*) / CAST(3600.0 AS DOUBLE) AS rate FROM {D_SQL}, (SELECT unnest(range(4)) AS k) kk "
          "GROUP BY ALL")
def sliding_rate(spark, sf_dir):
    """Per-second rate in 1-hour windows evaluated every 15 minutes, by phase (count / 3600)."""
    d = delivery_log(spark, sf_dir)
    w = MX.window_rate(d, "ts", ["phase"], "1 hour", "15 minutes")
    return w.select(F.date_format("window_start", WIN_FMT).alias("window_start"), "phase", "n", "rate")


@register("increase_15m",
          f"SELECT strftime(time_bucket(INTERVAL '15 minutes', ts), '%Y-%m-%d %H:%M:%S') AS window_start, target, "
          f"count(*) AS increase FROM {D_SQL} GROUP BY ALL")
def increase_15m(spark, sf_dir):
    d = delivery_log(spark, sf_dir)
    w = MX.window_rate(d, "ts", ["target"], "15 minutes")
    return w.select(F.date_format("window_start", WIN_FMT).alias("window_start"), "target", F.col("n").alias("increase"))


@register("loss_ratio",
          f"SELECT target, count(*) AS messages, count(*) FILTER (WHERE result = 'error') AS errors, "
          f"CAST(count(*) FILTER (WHERE result = 'error') AS DOUBLE) / count(*) AS loss_ratio FROM {D_SQL} GROUP BY target")
def loss_ratio(spark, sf_dir):
    return MX.loss_ratio(delivery_log(spark, sf_dir), ["target"], F.col("result") == "error")


@register("gauges",
          "SELECT 'target_rate' AS gauge, CAST(3.0 AS DOUBLE) AS value UNION ALL "
          "SELECT 'active_workers', CAST(sum(greatest(r_regionkey, 1)) AS DOUBLE) FROM region UNION ALL "
          "SELECT 'achieved_rate', count(*) / (CAST(date_diff('microsecond', min(ts), max(ts)) AS DOUBLE) / 1000000.0) FROM events")
def gauges(spark, sf_dir):
    """Gauges as rows: target rate (peak of the phase shape), active workers
    Σ max(connections, 1) over targets (connections = regionkey), achieved event rate."""
    from eventloom.catalog.q_volume import SCHED_SHAPE
    workers = table(spark, sf_dir, "region").agg(
        F.sum(F.greatest(F.col("r_regionkey"), F.lit(1))).cast("double").alias("value")).select(
        F.lit("active_workers").alias("gauge"), "value")
    achieved = table(spark, sf_dir, "events").agg(
        (F.count(F.lit(1)) / (F.timestamp_diff("MICROSECOND", F.min("ts"), F.max("ts")).cast("double") / 1e6)).alias("value")
    ).select(F.lit("achieved_rate").alias("gauge"), "value")
    target = workers.limit(1).select(F.lit("target_rate").alias("gauge"),
                                     CV.effective_base(SCHED_SHAPE, 0.0).alias("value"))
    return target.unionByName(workers).unionByName(achieved)


def _prom_sql() -> str:
    lab = ("'{transport=\"' || transport || '\",phase=\"' || phase || '\",target=\"' || target || '\",result=\"' || result || '\"}'")
    return (
        "SELECT '# HELP eventloom_messages_total Messages sent, by transport, phase, target and result.' AS line UNION ALL "
        "SELECT '# TYPE eventloom_messages_total counter' UNION ALL "
        f"SELECT 'eventloom_messages_total' || {lab} || ' ' || CAST(count(*) AS VARCHAR) FROM {D_SQL} GROUP BY transport, phase, target, result")


@register("metrics_text", _prom_sql())
def metrics_text(spark, sf_dir):
    """Prometheus exposition lines (HELP, TYPE, one sample per label set) for messages_total."""
    labels = ["transport", "phase", "target", "result"]
    c = MX.count_by(delivery_log(spark, sf_dir), labels)
    return MX.prometheus_lines(c, "eventloom_messages_total", "Messages sent, by transport, phase, target and result.",
                               "counter", labels)


def _hist_text_sql() -> str:
    lab = "'target=\"' || target || '\"'"
    name = "eventloom_message_bytes"
    parts = [f"SELECT '' AS labels, -2 AS pos, '# HELP {name} Bytes of a message.' AS line",
             f"SELECT '', -1, '# TYPE {name} histogram'"]
    for i, b in enumerate([*sorted(MX.SIZE_BUCKETS), None]):
        le, cond = ("+Inf", "TRUE") if b is None else (MX._le_text(b), f"bytes <= {b!r}")
        parts.append(f"SELECT {lab}, {i}, '{name}_bucket{{' || {lab} || ',le=\"{le}\"}} ' || count(*) FILTER (WHERE {cond}) FROM {D_SQL} GROUP BY target")
    n = len(MX.SIZE_BUCKETS) + 1
    for i, (suffix, value) in enumerate((("sum", "CAST(sum(bytes) AS BIGINT)"), ("count", "count(*)"))):
        parts.append(f"SELECT {lab}, {n + i}, '{name}_{suffix}{{' || {lab} || '}} ' || {value} FROM {D_SQL} GROUP BY target")
    return " UNION ALL ".join(parts)


@register("histogram_text", _hist_text_sql())
def histogram_text(spark, sf_dir):
    """The message-size histogram as exposition text: HELP, TYPE, _bucket, _sum and _count lines with their places."""
    hist = MX.histogram(delivery_log(spark, sf_dir), ["target"], F.col("bytes"), MX.SIZE_BUCKETS)
    return MX.histogram_lines(hist, "eventloom_message_bytes", "Bytes of a message.", ["target"])


@register("topic_totals",
          "SELECT 'logs-' || lower(target) AS topic, count(*) AS records, "
          "CAST(coalesce(sum(CASE WHEN lost THEN NULL ELSE strlen(message) END), 0) AS BIGINT) AS value_bytes "
          f"FROM ({delivery_sql(True)}) d GROUP BY ALL")
def topic_totals_q(spark, sf_dir):
    """Topic records per target topic, lost messages sent as tombstones (NULL value):
    every record counts, only non-null value bytes add up."""
    from eventloom.sources import sinks
    d = delivery_log(spark, sf_dir, with_lost=True)
    d = d.withColumn("message", F.when(~F.col("lost"), F.col("message")))   # tombstone when lost
    frame = sinks.topic_frame(d, F.concat(F.lit("logs-"), F.lower("target")))
    return sinks.topic_totals(frame, ["topic"])


def event_log(spark, sf_dir):
    """Delivery events by kind: ``error`` (send failed), ``dropped`` (lost before sending) and
    ``rotation`` (a new daily file per target after its first), with transport/phase/target."""
    from eventloom.operators import rotation
    d = delivery_log(spark, sf_dir, with_lost=True)
    errors = d.filter((F.col("result") == "error") & ~F.col("lost")).select(
        F.lit("error").alias("kind"), "transport", "phase", "target")
    dropped = d.filter("lost").select(F.lit("dropped").alias("kind"), "transport", "phase", "target")
    sent = d.filter(~F.col("lost")).withColumn("segment", rotation.interval_segment(
        CV.seconds_since(F.col("ts"), ROT_ORIGIN), ROT_INTERVAL))
    files = sent.select("transport", "target", "segment").distinct()
    first = files.groupBy("transport", "target").agg(F.min("segment").alias("_s0"))
    rotations = files.join(first, ["transport", "target"]).filter(F.col("segment") > F.col("_s0")).select(
        F.lit("rotation").alias("kind"), "transport", F.lit(None).cast("string").alias("phase"), "target")
    return errors.unionByName(dropped).unionByName(rotations)


_EVLOG_SQL = (
    f"WITH d AS ({delivery_sql(True)}), "
    "f AS (SELECT transport, target, CAST(floor(" + CV.sql_seconds_since("ts", ROT_ORIGIN) + f" / {ROT_INTERVAL!r}) AS BIGINT) AS segment "
    "FROM d WHERE NOT lost GROUP BY ALL), "
    "s0 AS (SELECT transport, target, min(segment) AS s0 FROM f GROUP BY ALL), "
    "ev AS (SELECT 'error' AS kind, transport, phase, target FROM d WHERE result = 'error' AND NOT lost "
    "UNION ALL SELECT 'dropped', transport, phase, target FROM d WHERE lost "
    "UNION ALL SELECT 'rotation', f.transport, CAST(NULL AS VARCHAR), f.target FROM f JOIN s0 USING (transport, target) "
    "WHERE f.segment > s0.s0) "
    "SELECT kind, target, count(*) AS value FROM ev GROUP BY kind, target")


@register("event_log_counts", _EVLOG_SQL)
def event_log_counts(spark, sf_dir):
    """Counters over an event log with a ``kind`` column (errors, drops, rotations) by
    (kind, target): the one count_by operator serves every counter family."""
    return MX.count_by(event_log(spark, sf_dir), ["kind", "target"])
