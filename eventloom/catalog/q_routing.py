"""Routing, delivery and sink-layout queries (events as messages, region as targets)."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventloom.catalog import SEED, register, table
from eventloom.functions import formats as fm
from eventloom.functions import sql_formats as sf
from eventloom.operators import loss, routing
from eventloom.sources.messages import SQL_EVENTS_AS_MESSAGES, events_as_messages


def region_targets(spark, sf_dir):
    """Targets table: one target per region, weight = regionkey + 1, in key order."""
    return table(spark, sf_dir, "region").select(
        F.col("r_name").alias("target"), F.col("r_regionkey").alias("target_idx"),
        (F.col("r_regionkey") + 1).alias("weight"))


def rendered_events(spark, sf_dir):
    m = events_as_messages(table(spark, sf_dir, "events"))
    return m.select("seq", "ts", fm.rfc5424(
        F.col("body"), ts=F.col("ts"), facility=1, severity=F.col("severity"),
        hostname=F.col("hostname"), app_name=F.col("app_name")).alias("message"))


SQL_RENDERED = (
    f"SELECT seq, ts, {sf.rfc5424('body', 'ts', '1', 'severity', 'hostname', 'app_name')} AS message "
    f"FROM ({SQL_EVENTS_AS_MESSAGES}) m"
)

SQL_SLOTS = (
    "SELECT target, target_idx, w, coalesce(sum(w) OVER (ORDER BY target_idx ROWS BETWEEN UNBOUNDED "
    "PRECEDING AND 1 PRECEDING), 0) AS lo, sum(w) OVER () AS total FROM ("
    "SELECT r_name AS target, r_regionkey AS target_idx, {w} AS w FROM region) t"
)


def _slots_sql(weighted: bool) -> str:
    w = "greatest(coalesce(CAST(r_regionkey + 1 AS BIGINT), 1), 1)" if weighted else "CAST(1 AS BIGINT)"
    return SQL_SLOTS.format(w=w)


def flagship(spark, sf_dir):
    """events -> rfc5424 -> 5 % keyed loss -> weighted routing to 5 targets -> count and LF-framed bytes."""
    msgs = rendered_events(spark, sf_dir)
    kept = loss.drop_lost(msgs, SEED, "seq", 5)
    routed = routing.route_weighted(kept, region_targets(spark, sf_dir), seq="seq", weight="weight",
                                    order="target_idx")
    return routed.groupBy("target").agg(
        F.count(F.lit(1)).alias("messages"),
        F.sum(F.octet_length(fm.frame_lf(F.col("message")))).cast("bigint").alias("bytes"))


FLAGSHIP_SQL = (
    f"WITH r AS ({SQL_RENDERED}), k AS (SELECT * FROM r WHERE NOT {loss.sql_is_lost(SEED, 'seq', 5)}), "
    f"s AS ({_slots_sql(True)}) "
    "SELECT s.target, count(*) AS messages, CAST(sum(strlen(k.message || chr(10))) AS BIGINT) AS bytes "
    "FROM k JOIN s ON (k.seq - 1) % s.total >= s.lo AND (k.seq - 1) % s.total < s.lo + s.w "
    "GROUP BY s.target"
)

register("delivery_by_target", FLAGSHIP_SQL)(flagship)


@register("route_weighted",
          f"WITH s AS ({_slots_sql(True)}) SELECT m.seq, s.target FROM ({SQL_EVENTS_AS_MESSAGES}) m "
          "JOIN s ON (m.seq - 1) % s.total >= s.lo AND (m.seq - 1) % s.total < s.lo + s.w")
def q_route_weighted(spark, sf_dir):
    m = events_as_messages(table(spark, sf_dir, "events")).select("seq")
    return routing.route_weighted(m, region_targets(spark, sf_dir)).select("seq", "target")


@register("route_round_robin",
          f"WITH s AS ({_slots_sql(False)}) SELECT m.seq, s.target FROM ({SQL_EVENTS_AS_MESSAGES}) m "
          "JOIN s ON (m.seq - 1) % s.total = s.lo")
def q_route_round_robin(spark, sf_dir):
    m = events_as_messages(table(spark, sf_dir, "events")).select("seq")
    return routing.route_round_robin(m, region_targets(spark, sf_dir)).select("seq", "target")


@register("route_broadcast",
          f"SELECT t.target, count(*) AS messages, CAST(sum(strlen(r.message)) AS BIGINT) AS bytes "
          f"FROM ({SQL_RENDERED}) r, (SELECT r_name AS target FROM region) t GROUP BY t.target")
def q_route_broadcast(spark, sf_dir):
    """Every rendered event to every region target; count and bytes per target."""
    msgs = rendered_events(spark, sf_dir)
    fan = routing.route_broadcast(msgs, region_targets(spark, sf_dir).select("target"))
    return fan.groupBy("target").agg(F.count(F.lit(1)).alias("messages"),
                                     F.sum(F.octet_length("message")).cast("bigint").alias("bytes"))


# ------------------------------------------------------------------ rotation / retention / sinks
from eventloom.functions import curves as CV  # noqa: E402
from eventloom.operators import retire, rotation  # noqa: E402
from eventloom.sources import sinks  # noqa: E402

ROT_ORIGIN = "2024-01-01 00:00:00"
ROT_INTERVAL = 86400.0          # one file per day
ROT_SIZE = 65536                # 64 KiB files
MAX_FILES = 10


def routed_events(spark, sf_dir):
    msgs = rendered_events(spark, sf_dir)
    r = routing.route_weighted(msgs, region_targets(spark, sf_dir), seq="seq", weight="weight", order="target_idx")
    return r.withColumn("nbytes", F.octet_length(fm.frame_lf(F.col("message"))).cast("bigint")) \
            .withColumn("t", CV.seconds_since(F.col("ts"), ROT_ORIGIN))


ROUTED_SQL = (
    f"SELECT k.seq, k.ts, k.message, s.target, CAST(strlen(k.message) + 1 AS BIGINT) AS nbytes, "
    f"{CV.sql_seconds_since('k.ts', ROT_ORIGIN)} AS t FROM ({SQL_RENDERED}) k JOIN ({_slots_sql(True)}) s "
    "ON (k.seq - 1) % s.total >= s.lo AND (k.seq - 1) % s.total < s.lo + s.w")

ROT_INTERVAL_SQL = (f"SELECT target, CAST(floor(t / {ROT_INTERVAL!r}) AS BIGINT) AS segment, count(*) AS messages, "
                    f"CAST(sum(nbytes) AS BIGINT) AS bytes FROM ({ROUTED_SQL}) r GROUP BY ALL")


@register("rotate_interval", ROT_INTERVAL_SQL)
def rotate_interval(spark, sf_dir):
    """Daily files per target: messages and bytes per (target, file)."""
    r = routed_events(spark, sf_dir).withColumn("segment", rotation.interval_segment(F.col("t"), ROT_INTERVAL))
    return rotation.file_summary(r, "target", "segment", "nbytes")


@register("rotate_size_approx",
          f"SELECT target, CAST(floor((cum - nbytes) / {ROT_SIZE}) AS BIGINT) AS segment, count(*) AS messages, "
          f"CAST(sum(nbytes) AS BIGINT) AS bytes FROM (SELECT *, sum(nbytes) OVER (PARTITION BY target ORDER BY seq "
          f"ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum FROM ({ROUTED_SQL}) r) x GROUP BY ALL")
def rotate_size_approx(spark, sf_dir):
    """64 KiB size rotation, parallel form (file = bytes-before div limit) per target."""
    r = routed_events(spark, sf_dir)
    s = rotation.size_segments(r, "target", "seq", "nbytes", ROT_SIZE)
    return rotation.file_summary(s, "target", "segment", "nbytes")


@register("retention",
          f"SELECT target, segment, row_number() OVER (PARTITION BY target ORDER BY segment DESC) AS rank_newest, "
          f"CASE WHEN row_number() OVER (PARTITION BY target ORDER BY segment DESC) <= {MAX_FILES - 1} THEN 'keep' ELSE 'delete' END AS action "
          f"FROM ({ROT_INTERVAL_SQL}) f")
def retention_q(spark, sf_dir):
    """Keep the newest max_files-1 (9) daily files per target, mark the rest for deletion."""
    files = rotate_interval(spark, sf_dir).select("target", "segment")
    return rotation.retention(files, "target", ["segment"], MAX_FILES)


@register("retention_applied",
          f"SELECT target, segment, messages, bytes FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY segment DESC) AS newest "
          f"FROM ({ROT_INTERVAL_SQL}) f) WHERE newest <= {MAX_FILES - 1}")
def retention_applied(spark, sf_dir):
    """Daily files per target written to the shared folder, older ones deleted by the journalled job: what is left, read back."""
    folder, journal = sinks.scratch_path(spark, "retire"), sinks.scratch_path(spark, "retire-journal")
    r = routed_events(spark, sf_dir).withColumn("segment", rotation.interval_segment(F.col("t"), ROT_INTERVAL))
    r.select("target", "segment", "message").repartition("target", "segment").write.partitionBy("target", "segment") \
        .option("lineSep", "\n").text(folder)
    retire.retire(spark, folder, journal, MAX_FILES)
    left = sinks.read_lines(spark, folder).withColumn("nbytes", (F.octet_length("message") + 1).cast("bigint"))
    return rotation.file_summary(left.withColumn("segment", F.col("segment").cast("bigint")), "target", "segment", "nbytes")


@register("topic_frame",
          f"SELECT 'logs-' || lower(target) AS topic, CAST(NULL AS BLOB) AS key, encode(message) AS value FROM ({ROUTED_SQL}) r")
def topic_frame_q(spark, sf_dir):
    """Topic records per routed message: topic by target, null key, message bytes as value."""
    r = routed_events(spark, sf_dir)
    return sinks.topic_frame(r, F.concat(F.lit("logs-"), F.lower("target")))


@register("sink_fanout",
          f"SELECT target, count(*) AS messages, CAST(sum(strlen(message) + 1) AS BIGINT) AS bytes FROM ({ROUTED_SQL}) r GROUP BY target")
def sink_fanout(spark, sf_dir):
    """Write routed messages as LF line files, one folder per target, then read them back
    and count lines and bytes per target folder (round trip through the file sink)."""
    r = routed_events(spark, sf_dir)
    path = sinks.scratch_path(spark, "fanout")
    sinks.write_lines(r, path, "message", partition_by="target")
    back = sinks.read_lines(spark, path)
    return back.groupBy("target").agg(F.count(F.lit(1)).alias("messages"),
                                      F.sum(F.octet_length("message") + 1).cast("bigint").alias("bytes"))


EXACT_CHUNK = 2048   # small chunks so every target spans several chunks even at small scale


def _exact_sql() -> str:
    return (
        f"WITH RECURSIVE x AS (SELECT target, seq, nbytes, row_number() OVER (PARTITION BY target ORDER BY seq) AS rn "
        f"FROM ({ROUTED_SQL}) r), "
        "w AS (SELECT target, rn, nbytes, nbytes AS acc, CAST(0 AS BIGINT) AS segment FROM x WHERE rn = 1 "
        "UNION ALL SELECT x.target, x.rn, x.nbytes, "
        f"CASE WHEN w.acc >= {ROT_SIZE} THEN x.nbytes ELSE w.acc + x.nbytes END, "
        f"CASE WHEN w.acc >= {ROT_SIZE} THEN w.segment + 1 ELSE w.segment END "
        "FROM w JOIN x ON x.target = w.target AND x.rn = w.rn + 1) "
        "SELECT target, segment, count(*) AS messages, CAST(sum(nbytes) AS BIGINT) AS bytes FROM w GROUP BY target, segment")


@register("rotate_size_exact", _exact_sql())
def rotate_size_exact(spark, sf_dir):
    """Exact greedy 64 KiB rotation per target (rotate after the write that reaches the limit;
    counter restarts at 0), computed chunk-parallel with a driver fold over chunk summaries."""
    r = routed_events(spark, sf_dir)
    s = rotation.size_segments_exact(r.select("seq", "target", "nbytes"), "target", "seq", "nbytes", ROT_SIZE,
                                     chunk_span=EXACT_CHUNK)
    return rotation.file_summary(s, "target", "segment", "nbytes")


ROT_INTERVAL_US = 86_400_000_000      # one day
EXACT_TIME_CHUNK_US = 21_600_000_000  # six-hour chunks (several per target even at small scale)


def _interval_exact_sql() -> str:
    t_us = f"CAST(date_diff('microsecond', TIMESTAMP '{ROT_ORIGIN}', k.ts) AS BIGINT)"
    routed = ROUTED_SQL.replace("SELECT k.seq, k.ts,", f"SELECT k.seq, k.ts, {t_us} AS t_us,")
    return (
        f"WITH RECURSIVE x AS (SELECT target, seq, t_us, nbytes, row_number() OVER (PARTITION BY target ORDER BY t_us, seq) AS rn "
        f"FROM ({routed}) r), "
        "w AS (SELECT target, rn, nbytes, t_us AS t0, CAST(0 AS BIGINT) AS segment FROM x WHERE rn = 1 "
        "UNION ALL SELECT x.target, x.rn, x.nbytes, "
        f"CASE WHEN x.t_us - w.t0 >= {ROT_INTERVAL_US} THEN x.t_us ELSE w.t0 END, "
        f"CASE WHEN x.t_us - w.t0 >= {ROT_INTERVAL_US} THEN w.segment + 1 ELSE w.segment END "
        "FROM w JOIN x ON x.target = w.target AND x.rn = w.rn + 1) "
        "SELECT target, segment, count(*) AS messages, CAST(sum(nbytes) AS BIGINT) AS bytes FROM w GROUP BY target, segment")


@register("rotate_interval_exact", _interval_exact_sql())
def rotate_interval_exact(spark, sf_dir):
    """Exact greedy daily rotation per target: a file starts at its first message and a message
    a day or more after that start opens the next file (clock restarts at the rotation)."""
    r = routed_events(spark, sf_dir).withColumn(
        "t_us", F.timestamp_diff("MICROSECOND", F.lit(ROT_ORIGIN).cast("timestamp_ntz"), F.col("ts")))
    s = rotation.interval_segments_exact(r.select("seq", "target", "nbytes", "t_us"), "target", "t_us", "t_us",
                                         ROT_INTERVAL_US, chunk_span=EXACT_TIME_CHUNK_US)
    return rotation.file_summary(s, "target", "segment", "nbytes")
