"""Volume queries: rate curves at event times, anomaly multipliers, arrival schedule,
achieved rate, keyed loss and multi-phase sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventloom.catalog import SEED, register, table
from eventloom.functions import curves as CV
from eventloom.functions import formats as fm
from eventloom.functions import sql_formats as sf
from eventloom.functions import templates as TP
from eventloom.operators import loss, schedule

# ---- fixed profile values used by these queries -----------------------------------------
ORIGIN = "2024-01-01 00:00:00"                      # phase start for event-time curves
LINEAR = {"type": "linear", "start_rate": 250.0, "end_rate": 3700.0}
LINEAR_SECS = 2592000.0                             # 30 days
SINE = {"type": "sine", "min_rate": 150.0, "max_rate": 1350.0, "period_secs": 5400.0}
BURST = {"type": "burst", "base_rate": 40.0, "burst_rate": 2600.0, "every_secs": 900.0, "burst_secs": 75.0}
ANOMALIES = [
    {"type": "burst-injection", "rate_multiplier": 6.0, "interval_secs": 45.0, "duration_secs": 7.0},
    {"type": "slow-drip", "rate_divisor": 3.0, "duration_secs": 150.0},
    {"type": "packet-loss", "loss_percent": 12.5},
]
SCHED_SHAPE = {"type": "sine", "min_rate": 0.5, "max_rate": 3.0, "period_secs": 300.0}
SCHED_ANOMALIES = [
    {"type": "burst-injection", "rate_multiplier": 3.0, "interval_secs": 120.0, "duration_secs": 10.0},
    {"type": "slow-drip", "rate_divisor": 2.0, "duration_secs": 60.0},
]
# -------------------------------------------------------------------------------------------

T_SQL = CV.sql_seconds_since("ts", ORIGIN)
EVT_SQL = f"SELECT event_id + 1 AS seq, {T_SQL} AS t FROM events"


def _ev_t(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select((F.col("event_id") + 1).alias("seq"), CV.seconds_since(F.col("ts"), ORIGIN).alias("t"))


@register("rate_constant", f"SELECT seq, {CV.sql_rate('t', {'type': 'constant', 'rate': 120.5})} AS r_rate, "
                           f"{CV.sql_rate('t', {'type': 'constant'}, base='50')} AS r_base, t FROM ({EVT_SQL}) e")
def rate_constant(spark, sf_dir):
    e = _ev_t(spark, sf_dir)
    return e.select("seq", CV.rate_at(F.col("t"), {"type": "constant", "rate": 120.5}, None, 50).alias("r_rate"),
                    CV.rate_at(F.col("t"), {"type": "constant"}, None, 50).alias("r_base"), "t")


@register("rate_linear", f"SELECT seq, {CV.sql_rate('t', LINEAR, repr(LINEAR_SECS))} AS rate, "
                         f"{CV.sql_rate('t', LINEAR, '0.0')} AS rate_nodur FROM ({EVT_SQL}) e")
def rate_linear(spark, sf_dir):
    e = _ev_t(spark, sf_dir)
    return e.select("seq", CV.rate_at(F.col("t"), LINEAR, LINEAR_SECS, 0).alias("rate"),
                    CV.rate_at(F.col("t"), LINEAR, 0.0, 0).alias("rate_nodur"))


# cos() may differ in the last bit between engines: results carry 9 decimals
@register("rate_sine", f"SELECT seq, round({CV.sql_rate('t', SINE)}, 9) AS rate FROM ({EVT_SQL}) e")
def rate_sine(spark, sf_dir):
    e = _ev_t(spark, sf_dir)
    return e.select("seq", F.round(CV.rate_at(F.col("t"), SINE, 0, 0), 9).alias("rate"))


@register("rate_burst", f"SELECT seq, {CV.sql_rate('t', BURST)} AS rate FROM ({EVT_SQL}) e")
def rate_burst(spark, sf_dir):
    e = _ev_t(spark, sf_dir)
    return e.select("seq", CV.rate_at(F.col("t"), BURST, 0, 0).alias("rate"))


@register("anomaly_multiplier", f"SELECT seq, {CV.sql_anomaly_multiplier('t', ANOMALIES)} AS mult, "
                                f"round({CV.sql_anomaly_multiplier('t', ANOMALIES)} * {CV.sql_rate('t', SINE)}, 9) AS rate FROM ({EVT_SQL}) e")
def anomaly_multiplier(spark, sf_dir):
    """Product of burst (pmod window), slow-drip (first seconds) and loss (×1) at event times."""
    e = _ev_t(spark, sf_dir)
    m = CV.anomaly_multiplier(F.col("t"), ANOMALIES)
    return e.select("seq", m.alias("mult"), F.round(m * CV.rate_at(F.col("t"), SINE, 0, 0), 9).alias("rate"))


def event_phases(spark, sf_dir):
    """Stand-in phases: one per event type, lasting one second per event of that type."""
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.col("event_type").alias("phase")).agg(F.count(F.lit(1)).alias("duration_secs"))


_PH_SQL = "SELECT event_type AS phase, count(*) AS duration_secs FROM events GROUP BY event_type"
_TM = "(CAST(tick AS DOUBLE) * CAST(1.0 AS DOUBLE) + CAST(0.5 AS DOUBLE))"
SCHED_SQL = (
    f"WITH ph AS ({_PH_SQL}), "
    "tk AS (SELECT phase, duration_secs, unnest(range(0, CAST(ceil(duration_secs / 1.0) AS BIGINT))) AS tick FROM ph), "
    f"lm AS (SELECT phase, tick, CAST(round({CV.sql_rate(_TM, SCHED_SHAPE)} * {CV.sql_anomaly_multiplier(_TM, SCHED_ANOMALIES)} * CAST(1000000.0 AS DOUBLE)) AS BIGINT) AS lam FROM tk), "
    "c AS (SELECT *, sum(lam) OVER (PARTITION BY phase ORDER BY tick ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cc FROM lm), "
    "n AS (SELECT phase, tick, CAST(floor((cc - lam) / 1000000) AS BIGINT) AS s0, "
    "CAST(floor(cc / 1000000) AS BIGINT) - CAST(floor((cc - lam) / 1000000) AS BIGINT) AS n FROM c), "
    "a AS (SELECT phase, tick, s0, n, unnest(range(1, n + 1)) AS j FROM n WHERE n > 0) "
    "SELECT phase, s0 + j AS seq, CAST(tick AS DOUBLE) * CAST(1.0 AS DOUBLE) + CAST(1.0 AS DOUBLE) * CAST(j - 1 AS DOUBLE) / CAST(n AS DOUBLE) AS t FROM a"
)


@register("arrival_schedule", SCHED_SQL)
def arrival_schedule(spark, sf_dir):
    """Arrivals per phase under a sine curve with burst and slow-drip anomalies (1 s ticks)."""
    return schedule.arrival_schedule(event_phases(spark, sf_dir), "phase", 1.0, shape=SCHED_SHAPE,
                                     anomalies=SCHED_ANOMALIES)


@register("achieved_rate",
          f"SELECT phase, count(*) AS messages, max(t) - min(t) AS elapsed, "
          f"count(*) / (max(t) - min(t)) AS achieved_rate, CAST(3.0 AS DOUBLE) AS target_rate, "
          f"CAST(100.0 AS DOUBLE) * (count(*) / (max(t) - min(t))) / CAST(3.0 AS DOUBLE) AS pct_of_target FROM ({SCHED_SQL}) s GROUP BY phase")
def achieved_rate(spark, sf_dir):
    """Achieved rate (count / elapsed) per phase of the schedule, next to the peak target rate."""
    a = arrival_schedule(spark, sf_dir)
    target = CV.effective_base(SCHED_SHAPE, 0.0)
    g = a.groupBy("phase").agg(F.count(F.lit(1)).alias("messages"), (F.max("t") - F.min("t")).alias("elapsed"))
    ach = F.col("messages") / F.col("elapsed")
    return g.select("phase", "messages", "elapsed", ach.alias("achieved_rate"), target.alias("target_rate"),
                    (F.lit(100.0) * ach / target).alias("pct_of_target"))


@register("loss_filter", f"SELECT seq FROM ({EVT_SQL}) e WHERE NOT {loss.sql_is_lost(SEED, 'seq', 0.5)}")
def loss_filter(spark, sf_dir):
    """0.5 % loss: the integer roll makes it act as 1 %."""
    return loss.drop_lost(_ev_t(spark, sf_dir), SEED, "seq", 0.5).select("seq")


LOSS_RULES = [5.0, 12.5, float("nan"), -3.0]


@register("loss_multi", f"SELECT seq FROM ({EVT_SQL}) e WHERE NOT {loss.sql_is_lost(SEED, 'seq', LOSS_RULES)}")
def loss_multi(spark, sf_dir):
    """Several loss rules share one roll: the effect is the largest valid percent (12.5 → 13 rolls)."""
    return loss.drop_lost(_ev_t(spark, sf_dir), SEED, "seq", LOSS_RULES).select("seq")


# ---- fixed phase formats for the multi-phase query ----------------------------------------
PHASE_FORMAT = {"F": "rfc5424", "O": "json_lines", "P": "rfc3164"}
PHASE_RATE = 100.0
RUN_START = "2026-01-01 00:00:00"


def _phase_msg(fmt, body, ts, app):
    return fm.render(fmt, body, ts=ts, facility=1, severity=6, hostname="localhost", app_name=app)


@register("multi_phase", None)
def multi_phase(spark, sf_dir):
    """Phases (one per order status, as many messages as orders) run back to back at 100 msg/s;
    seq restarts per phase; each phase renders its own format."""
    o = table(spark, sf_dir, "orders")
    phases = o.groupBy(F.col("o_orderstatus").alias("phase")).agg(F.count(F.lit(1)).alias("total_messages")) \
        .withColumn("messages_per_second", F.lit(PHASE_RATE))
    m = schedule.multi_phase_source(phases, "phase")
    ts = F.timestamp_add("MICROSECOND", F.round(F.col("t") * 1e6).cast("bigint"), F.lit(RUN_START).cast("timestamp_ntz"))
    vals = {"timestamp": F.date_format(ts, fm.RFC5424_TS), "real_app": F.col("phase"), "sequence": F.col("seq")}
    body = TP.render_template(TP.FALLBACK_TEMPLATE, vals)
    out = None
    for ph, f in PHASE_FORMAT.items():
        r = _phase_msg(f, body, ts, F.col("phase"))
        out = F.when(F.col("phase") == ph, r) if out is None else out.when(F.col("phase") == ph, r)
    return m.select("phase", "seq", out.otherwise(body).alias("message"))


def _multi_sql():
    ts = f"(TIMESTAMP '{RUN_START}' + to_microseconds(CAST(round(t * 1000000.0) AS BIGINT)))"
    body = f"({sf.ts5424(ts)} || ' ' || phase || ' seq=' || CAST(seq AS VARCHAR))"
    whens = []
    for ph, f in PHASE_FORMAT.items():
        if f == "rfc5424":
            r = sf.rfc5424(body, ts, "1", "6", "'localhost'", "phase")
        elif f == "rfc3164":
            r = sf.rfc3164(body, ts, "1", "6", "'localhost'", "phase")
        else:
            r = sf.json_lines(body, ts, "6", "1", "'localhost'", "phase")
        whens.append(f"WHEN '{ph}' THEN {r}")
    return (
        "WITH ph AS (SELECT o_orderstatus AS phase, count(*) AS total_messages FROM orders GROUP BY 1), "
        f"p AS (SELECT *, coalesce(sum(total_messages / {PHASE_RATE!r}) OVER (ORDER BY phase ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS st FROM ph), "
        "m AS (SELECT phase, st, unnest(range(1, total_messages + 1)) AS seq FROM p), "
        f"x AS (SELECT phase, seq, st + CAST(seq - 1 AS DOUBLE) / {PHASE_RATE!r} AS t FROM m) "
        f"SELECT phase, seq, CASE phase {' '.join(whens)} ELSE {body} END AS message FROM x")


def _late():
    from eventloom.catalog import ORACLE_SQL
    ORACLE_SQL["multi_phase"] = _multi_sql()


_late()


# ---- fixed stop rule of the stop-predicate query -------------------------------------------
STOP_TOTAL = 5000
STOP_DURATION_SECS = 15 * 86400.0


@register("stop_predicates",
          f"SELECT seq, t FROM ({EVT_SQL}) e WHERE seq <= {STOP_TOTAL} AND t < {STOP_DURATION_SECS!r}")
def stop_predicates(spark, sf_dir):
    """Bounded source: messages until seq reaches the total or the deadline passes."""
    e = _ev_t(spark, sf_dir)
    return e.filter(schedule.stop_condition(F.col("seq"), F.col("t"), STOP_TOTAL, STOP_DURATION_SECS))
