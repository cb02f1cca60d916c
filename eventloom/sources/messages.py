"""Turn an ordinary table into the message columns the operators expect.

A message has a 1-based ``seq`` key, an event time ``ts``, header values and a body.
``events`` is the default stand-in: key = event_id + 1, host from user_id, app from
event_type, body = props, latency = value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

SEVERITY_BY_TYPE = {"error": 3}  # everything else is Informational (6)


def events_as_messages(events: DataFrame) -> DataFrame:
    sev = F.when(F.col("event_type") == "error", F.lit(3)).otherwise(F.lit(6))
    return events.select(
        (F.col("event_id") + 1).alias("seq"),
        F.col("ts"),
        F.concat(F.lit("host-"), F.col("user_id").cast("string")).alias("hostname"),
        F.col("event_type").alias("app_name"),
        sev.alias("severity"),
        F.col("props").alias("body"),
        F.col("value").alias("latency"),
    )


SQL_EVENTS_AS_MESSAGES = (
    "SELECT event_id + 1 AS seq, ts, concat('host-', CAST(user_id AS VARCHAR)) AS hostname, "
    "event_type AS app_name, CASE WHEN event_type = 'error' THEN 3 ELSE 6 END AS severity, "
    "props AS body, value AS latency FROM events"
)
