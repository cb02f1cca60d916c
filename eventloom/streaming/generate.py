"""Live, paced message generation: the ``rate`` source supplies ``seq`` and arrival time,
and the batch operators (fields, templates, formats, keyed loss, routing) apply unchanged —
they are key-derived, so the stream needs no state store."""

from __future__ import annotations

from typing import Any, Mapping

from pyspark.sql import DataFrame, SparkSession, functions as F

from eventloom.functions import fields as FL, formats as fm, templates as TP
from eventloom.operators import loss
from eventloom.streaming.runs import rate_source


def live_messages(spark: SparkSession, rows_per_second: int, schema: Mapping[str, Mapping[str, Any]],
                  template: str, fmt: str = "rfc5424", seed: int = 42, loss_percent: float = 0.0,
                  partitions: int | None = None, **header) -> DataFrame:
    """Streaming DataFrame (seq, ts, message) paced at ``rows_per_second``."""
    s = rate_source(spark, rows_per_second, partitions)
    s = s.withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    if loss_percent:
        s = loss.drop_lost(s, seed, "seq", loss_percent)
    s = FL.with_fields(s, schema, seed, "seq", ts="ts")
    vals = {n: F.col(n) for n in schema}
    vals.update(TP.default_values(seed, "seq", F.col("seq"), F.col("ts"), header.get("app_name", "live")))
    body = TP.render_template(template, vals, seed, "seq")
    return s.select("seq", "ts", fm.render(fmt, body, ts=F.col("ts"), **header).alias("message"))
