"""Sinks: line files (append, per-target folders), topic frames, metrics text.

Writes go under a base folder given by the caller; jobs that need scratch space use the
shared folder named by ``spark.checkpoint.dir`` (never a machine-local temp dir).
"""

from __future__ import annotations

import uuid
from typing import Mapping

from pyspark.sql import DataFrame, SparkSession, functions as F

from eventloom.plans.session import ensure_checkpoint_dir

# ---- fixed values: topic producer options accepted by the reference's topic sink -------
TOPIC_COMPRESSIONS = ("none", "gzip", "lz4", "snappy", "zstd")
TOPIC_ACKS = ("0", "1", "all")
DEFAULT_LINGER_MS = 5
DEFAULT_BATCH = 1024
# -----------------------------------------------------------------------------------------


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the cluster's shared checkpoint folder."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}-{uuid.uuid4().hex}"


def write_lines(df: DataFrame, path: str, message: str = "message", partition_by: str | None = None,
                mode: str = "append") -> None:
    """Append ``message + LF`` per row as text; one folder per ``partition_by`` value."""
    cols = [message] + ([partition_by] if partition_by else [])
    w = df.select(*cols).write.mode(mode).option("lineSep", "\n")
    if partition_by:
        w = w.partitionBy(partition_by)
    w.text(path)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Read back line files with their file path (``target=...`` folders become a column)."""
    return spark.read.option("lineSep", "\n").text(path).select(
        F.col("value").alias("message"), "*", F.col("_metadata.file_path").alias("file_path")).drop("value")


def topic_frame(df: DataFrame, topic: str | F.Column, message: str = "message") -> DataFrame:
    """(topic, key, value) rows for a topic writer: value = message bytes, key = null."""
    t = topic if isinstance(topic, F.Column) else F.lit(topic)
    return df.select(t.cast("string").alias("topic"), F.lit(None).cast("binary").alias("key"),
                     F.encode(F.col(message), "UTF-8").alias("value"))


def topic_options(brokers: str, compression: str = "none", acks: str = "1", linger_ms: int = DEFAULT_LINGER_MS,
                  batch: int = DEFAULT_BATCH) -> Mapping[str, str]:
    """Writer options for the topic sink; brokers are comma separated, blanks dropped."""
    comp = (compression or "none").lower()
    if comp not in TOPIC_COMPRESSIONS:
        raise ValueError(f"compression {compression!r} not in {TOPIC_COMPRESSIONS}")
    a = str(acks).lower()
    if a not in TOPIC_ACKS:
        raise ValueError(f"acks {acks!r} not in {TOPIC_ACKS}")
    servers = ",".join(b.strip() for b in (brokers or "").split(",") if b.strip())
    return {"kafka.bootstrap.servers": servers, "kafka.compression.type": comp, "kafka.acks": a,
            "kafka.linger.ms": str(int(linger_ms)), "kafka.batch.size": str(int(batch))}


def write_topic(df: DataFrame, options: Mapping[str, str]) -> None:
    """Batch write of a topic frame; needs the Kafka connector on the classpath."""
    df.write.format("kafka").options(**options).save()


def read_topic(spark: SparkSession, brokers: str, topic: str, max_offsets_per_trigger: int = 1000,
               starting_offsets: str = "latest") -> DataFrame:
    """Streaming read of a topic (needs the Kafka connector on the classpath)."""
    servers = ",".join(b.strip() for b in (brokers or "").split(",") if b.strip())
    return (spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers)
                 .option("subscribe", topic).option("startingOffsets", starting_offsets)
                 .option("maxOffsetsPerTrigger", int(max_offsets_per_trigger)).load())


def topic_totals(records: DataFrame, group: list[str] | None = None, value: str = "value") -> DataFrame:
    """Records and value bytes received; a NULL value counts as a record but adds no bytes."""
    g = group or []
    return records.groupBy(*g).agg(F.count(F.lit(1)).alias("records"),
                                   F.coalesce(F.sum(F.octet_length(value)), F.lit(0)).cast("bigint").alias("value_bytes"))
