"""Streaming sources, sinks and runners.

* Sources: a file source over parquet (tests and replays) or the ``rate`` source (live
  pacing: ``value`` becomes the 1-based ``seq``).
* Event time: ``event_time_utc`` turns a zone-less timestamp into an instant without
  consulting the session zone, so watermarks and windows agree with batch results.
* Sinks: :func:`write_batches` uses ``foreachBatch`` and writes each micro-batch to
  ``<path>/batch_id=<id>`` with overwrite, so a retried batch replaces its own output
  (idempotent). :func:`read_latest` keeps, per key, the row of the newest batch, which
  turns update-mode output into the final table.
* Message files: :func:`write_committed` stages each try of a micro-batch in a folder of its own and
  names the complete one in a commit table; :func:`read_committed` follows that table only, so a
  half-written try is never read and a repeated batch changes nothing.
"""

from __future__ import annotations

import uuid
from typing import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from eventloom.sources.sinks import scratch_path

EPOCH_NTZ = "1970-01-01 00:00:00"


def event_time_utc(ts: Column) -> Column:
    """timestamp_ntz (UTC wall clock) → timestamp instant, independent of the session zone."""
    micros = F.timestamp_diff("MICROSECOND", F.lit(EPOCH_NTZ).cast("timestamp_ntz"), ts)
    return F.timestamp_micros(micros)


def to_utc_ntz(ts: Column) -> Column:
    """timestamp instant → UTC wall clock as timestamp_ntz (session-zone independent)."""
    return F.timestamp_add("MICROSECOND", F.unix_micros(ts), F.lit(EPOCH_NTZ).cast("timestamp_ntz"))


def file_source(spark: SparkSession, path: str, like: DataFrame, max_files_per_trigger: int | None = None) -> DataFrame:
    """Stream the parquet files at ``path`` with the schema of ``like`` (no inference)."""
    r = spark.readStream.schema(like.schema)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", int(max_files_per_trigger))
    return r.parquet(path)


def rate_source(spark: SparkSession, rows_per_second: int, partitions: int | None = None) -> DataFrame:
    """Live paced source: one row per message, ``seq`` = value + 1, ``ts`` = arrival time."""
    r = spark.readStream.format("rate").option("rowsPerSecond", int(rows_per_second))
    if partitions:
        r = r.option("numPartitions", int(partitions))
    return r.load().select((F.col("value") + 1).alias("seq"), F.col("timestamp").alias("ts"))


def write_batches(stream: DataFrame, path: str, checkpoint: str, output_mode: str = "update",
                  available_now: bool = True, partition_by: Sequence[str] = ()):
    """Start the query with an idempotent per-batch parquet writer; returns the query."""
    def sink(batch: DataFrame, batch_id: int) -> None:
        w = batch.withColumn("batch_id", F.lit(batch_id).cast("bigint")).write.mode("overwrite")
        if partition_by:
            w = w.partitionBy(*partition_by)
        w.parquet(f"{path}/batch_id={batch_id}")

    q = stream.writeStream.outputMode(output_mode).option("checkpointLocation", checkpoint).foreachBatch(sink)
    q = q.trigger(availableNow=True) if available_now else q.trigger(processingTime="5 seconds")
    return q.start()


def read_latest(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """Final table from update-mode batches: per key, the row written by the newest batch."""
    df = spark.read.parquet(path)
    cols = [c for c in df.columns if c not in keys and c != "batch_id"]
    latest = df.groupBy(*keys).agg(F.max_by(F.struct(*cols), F.col("batch_id")).alias("_r"))
    return latest.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in cols])


COMMIT = "batch bigint, try string, rows bigint"


def commits(spark: SparkSession, path: str) -> DataFrame:
    """The commit table below ``path``: batch, the try that holds it, its rows (empty before the first batch)."""
    spark.createDataFrame([], "try string, rows bigint").write.mode("ignore").parquet(f"{path}/commits/batch=-1")
    return spark.read.schema(COMMIT).parquet(f"{path}/commits").select("batch", "try", "rows")


def commit_lines(batch: DataFrame, batch_id: int, path: str, message: str = "message", target: str = "target") -> None:
    """Write one micro-batch: lines in folders of a new try, one for each target, then the commit row that names it.

    A batch that is committed already is left as it is. The commit row is a file that Spark's committer moves in place
    when it is complete; a try without one is never read.
    """
    spark = batch.sparkSession
    if not commits(spark, path).filter(F.col("batch") == batch_id).isEmpty():
        return
    name, seen = uuid.uuid4().hex, Observation()
    lines = batch.select(F.col(message).alias("value"), F.col(target).alias("target")).observe(seen, F.count(F.lit(1)).alias("rows"))
    lines.write.partitionBy("target").mode("overwrite").option("lineSep", "\n").text(f"{path}/data/batch={batch_id}/try={name}")
    spark.createDataFrame([(name, seen.get["rows"])], "try string, rows bigint").coalesce(1) \
        .write.mode("overwrite").parquet(f"{path}/commits/batch={batch_id}")


def write_committed(stream: DataFrame, path: str, checkpoint: str, message: str = "message", target: str = "target",
                    available_now: bool = True):
    """Start a query that writes ``message`` lines to one folder for each target by :func:`commit_lines`."""
    q = stream.select(message, target).writeStream.outputMode("append").option("checkpointLocation", checkpoint) \
        .foreachBatch(lambda batch, batch_id: commit_lines(batch, batch_id, path, message, target))
    return (q.trigger(availableNow=True) if available_now else q.trigger(processingTime="5 seconds")).start()


def read_committed(spark: SparkSession, path: str) -> DataFrame:
    """batch, target, message of all committed lines. The folders are partitions, so other tries are pruned."""
    done = commits(spark, path).select("batch", "try")
    lines = spark.read.schema("value string, batch bigint, try string, target string").option("lineSep", "\n").text(f"{path}/data")
    return lines.join(done, ["batch", "try"], "left_semi").select("batch", "target", F.col("value").alias("message"))


def late_rows(query) -> int:
    """Rows that the watermark kept out of the state of ``query``, from its recent progress reports. An aggregate counts
    them after the partial aggregation of a task; Spark keeps as many reports as
    ``spark.sql.streaming.numRecentProgressUpdates`` says."""
    return sum(int(op["numRowsDroppedByWatermark"]) for report in query.recentProgress for op in report["stateOperators"])


def window_quantile(stream: DataFrame, time: str, keys: Sequence[str], value: Column, bounds: Sequence[float], window: str,
                    q: float) -> DataFrame:
    """Bucket quantile of every closed window: two chained stateful steps, counts by (window, keys, bucket) first, then one
    row of at most ``len(bounds) + 1`` buckets for each window and keys. Needs a watermark on ``time`` and append mode.

    Returns window_start, window_end (instants), keys, messages, quantile; NULL values are left out.
    """
    from eventloom.operators.metrics import quantile_from_buckets
    bounds = sorted(float(b) for b in bounds)
    over = F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b < value))
    n = stream.filter(value.isNotNull()).groupBy(F.window(time, window).alias("w"), *keys, over.alias("_at")).agg(F.count(F.lit(1)).alias("_n"))
    wide = n.groupBy(F.window("w", window).alias("w"), *keys).agg(
        F.sum("_n").alias("messages"), *[F.sum(F.when(F.col("_at") <= i, F.col("_n")).otherwise(0)).alias(f"_b{i}") for i in range(len(bounds))])
    buckets = F.array(*[F.struct(F.lit(b).alias("le_value"), F.col(f"_b{i}").alias("bucket_count")) for i, b in enumerate(bounds)])
    return wide.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, "messages",
                       quantile_from_buckets(buckets, F.col("messages"), q).alias("quantile"))


def run_to_table(spark: SparkSession, stream: DataFrame, keys: Sequence[str], name: str,
                 output_mode: str = "update", timeout_s: int | None = None, partition_by: Sequence[str] = ()) -> DataFrame:
    """Run ``stream`` to completion (availableNow) and return its final result table."""
    base = scratch_path(spark, name)
    q = write_batches(stream, f"{base}/out", f"{base}/checkpoint", output_mode, partition_by=partition_by)
    q.awaitTermination(timeout_s) if timeout_s else q.awaitTermination()
    if q.isActive:
        q.stop()
        raise TimeoutError(f"stream {name} did not finish in {timeout_s}s")
    if q.exception():
        raise q.exception()
    if output_mode == "append":  # every row is final when written; batches never overlap
        return spark.read.parquet(f"{base}/out").drop("batch_id")
    return read_latest(spark, f"{base}/out", keys)
