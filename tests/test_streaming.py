"""Streaming: the rate source feeds the same operators; late rows beyond the watermark are
dropped from append-mode windows; on-time rows give the batch answer."""

import time

import pandas as pd
from pyspark.sql import functions as F

from eventloom.functions import formats as fm
from eventloom.operators import loss
from eventloom.streaming import runs as RS


def test_rate_source_keyed_pipeline(spark, tmp_path):
    s = RS.rate_source(spark, 200, partitions=2)
    m = loss.drop_lost(s, 7, "seq", 10).select("seq", fm.rfc5424(F.lit("x"), ts=F.col("ts")).alias("message"))
    q = (m.writeStream.format("memory").queryName("rate_test").option("checkpointLocation", str(tmp_path / "ck"))
          .trigger(processingTime="1 second").start())
    try:
        deadline = time.time() + 30
        while time.time() < deadline and spark.table("rate_test").count() < 100:
            time.sleep(1)
    finally:
        q.stop()
    got = spark.table("rate_test")
    n = got.count()
    assert n >= 100
    seqs = [r.seq for r in got.select("seq").collect()]
    assert len(set(seqs)) == n and min(seqs) >= 1
    expected_kept = spark.range(1, max(seqs) + 1).withColumnRenamed("id", "seq")
    expected_kept = loss.drop_lost(expected_kept, 7, "seq", 10).count()
    assert n <= expected_kept
    assert got.filter(~F.col("message").startswith("<14>1 ")).count() == 0


def test_late_rows_dropped_by_watermark(spark, tmp_path):
    src = tmp_path / "src"
    src.mkdir()
    base = pd.Timestamp("2024-01-01 00:00:00")
    on_time = pd.DataFrame({"ts": [base + pd.Timedelta(minutes=m) for m in range(0, 600, 10)], "v": 1})
    filler = pd.DataFrame({"ts": [base + pd.Timedelta(minutes=595)], "v": 1})
    late = pd.DataFrame({"ts": [base + pd.Timedelta(minutes=5)], "v": 100})
    # Spark filters late rows with the watermark of the previous batch, so one on-time batch
    # sits between the batch that moves the watermark and the late one.
    for name, pdf in (("a", on_time), ("b", filler), ("c", late)):
        spark.createDataFrame(pdf).coalesce(1).write.parquet(str(src / name))
        time.sleep(1.2)
    like = spark.read.parquet(str(src / "a"))
    stream = (spark.readStream.schema(like.schema).option("maxFilesPerTrigger", 1).parquet(str(src / "*"))
              .withColumn("et", RS.event_time_utc(F.col("ts").cast("timestamp_ntz")))
              .withWatermark("et", "30 minutes")
              .groupBy(F.window("et", "1 hour").alias("w")).agg(F.sum("v").alias("s")))
    out = tmp_path / "out"
    q = RS.write_batches(stream, str(out), str(tmp_path / "ck"), output_mode="append")
    q.awaitTermination(120)
    res = spark.read.parquet(str(out))
    totals = {r.w.start.hour if hasattr(r.w.start, "hour") else r.w.start: r.s for r in res.collect()}
    # the late row (v=100) belongs to the first hour, which had closed before it arrived
    assert all(v < 100 for v in totals.values())
    assert sum(totals.values()) <= 61


def test_live_messages_stream(spark, tmp_path):
    from eventloom.streaming.generate import live_messages
    schema = {"user": {"type": "faker", "faker": "username"}, "code": {"type": "int", "min": 100, "max": 599}}
    s = live_messages(spark, 500, schema, "user={{user}} code={{code}} seq={{sequence}}", "rfc3164",
                      loss_percent=5.0, partitions=2, facility=3, severity=4, hostname="live-host", app_name="gen")
    q = (s.writeStream.format("memory").queryName("live_test").option("checkpointLocation", str(tmp_path / "ck"))
          .trigger(processingTime="1 second").start())
    try:
        deadline = time.time() + 30
        while time.time() < deadline and spark.table("live_test").count() < 200:
            time.sleep(1)
    finally:
        q.stop()
    rows = spark.table("live_test").collect()
    assert len(rows) >= 200
    for r in rows[:50]:
        assert r.message.startswith("<28>") and " live-host gen: user=" in r.message and f"seq={r.seq}" in r.message


def test_repeated_batch_and_half_written_try_change_nothing(spark, tmp_path):
    path = str(tmp_path / "fan")
    first = spark.createDataFrame([("a", "one"), ("b", "two"), (None, "three")], "target string, message string")
    RS.commit_lines(first, 0, path)
    RS.commit_lines(first, 0, path)                                  # the batch again after a restart
    want = {("a", "one"), ("b", "two"), (None, "three")}
    assert sorted(map(str, ((r.target, r.message) for r in RS.read_committed(spark, path).collect()))) == sorted(map(str, want))
    # a try that died before its commit row: its lines are there, nobody reads them
    first.select(F.col("message").alias("value"), "target").write.partitionBy("target").text(f"{path}/data/batch=1/try=dead")
    assert RS.read_committed(spark, path).count() == 3
    RS.commit_lines(spark.createDataFrame([("a", "four")], first.schema), 1, path)
    got = RS.read_committed(spark, path)
    assert {(r.batch, r.target, r.message) for r in got.filter("batch = 1").collect()} == {(1, "a", "four")}
    assert got.count() == 4
    RS.commit_lines(first.limit(0), 2, path)                         # an empty batch
    assert {r["batch"]: r["rows"] for r in RS.commits(spark, path).collect()} == {0: 3, 1: 1, 2: 0}
    assert RS.read_committed(spark, path).count() == 4


def test_late_rows_are_counted(spark, tmp_path):
    src = tmp_path / "src"
    src.mkdir()
    base = pd.Timestamp("2024-01-01 00:00:00")
    steps = [[0, 30, 300], [299], [5], [301, 302]]
    for i, minutes in enumerate(steps):
        pdf = pd.DataFrame({"ts": [base + pd.Timedelta(minutes=m) for m in minutes]})
        spark.createDataFrame(pdf).coalesce(1).write.parquet(str(src / str(i)))
        time.sleep(1.2)
    like = spark.read.parquet(str(src / "0"))
    stream = RS.file_source(spark, str(src / "*"), like, 1).withColumn("et", RS.event_time_utc(F.col("ts").cast("timestamp_ntz"))) \
        .withWatermark("et", "30 minutes").groupBy(F.window("et", "1 hour").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    q = RS.write_batches(stream, str(tmp_path / "out"), str(tmp_path / "ck"), output_mode="append")
    q.awaitTermination(120)
    assert q.exception() is None
    assert RS.late_rows(q) == 1
    closed = [r.n for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert closed == [2]                                             # the first hour, without the late row


def test_window_quantile_equals_batch(spark, tmp_path):
    from eventloom.operators import metrics as MX
    base = pd.Timestamp("2024-01-01 00:00:00")
    rows = [(base + pd.Timedelta(minutes=i), "a" if i % 3 else None, None if i % 50 == 0 else (i * 37 % 100) / 50) for i in range(600)]
    df = spark.createDataFrame(pd.DataFrame(rows, columns=["ts", "phase", "v"])).withColumn("v", F.when(~F.isnan("v"), F.col("v")))
    df = df.withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    df.coalesce(1).write.parquet(str(tmp_path / "src"))
    stream = RS.file_source(spark, str(tmp_path / "src"), df).withColumn("et", RS.event_time_utc(F.col("ts"))).withWatermark("et", "10 minutes")
    bounds = [0.5, 0.1, 1.0]
    out = RS.window_quantile(stream, "et", ["phase"], F.col("v"), bounds, "2 hours", 0.95)
    q = RS.write_batches(out, str(tmp_path / "out"), str(tmp_path / "ck"), output_mode="append")
    q.awaitTermination(120)
    assert q.exception() is None
    got = {(r.window_start, r.phase): (r.messages, r.quantile) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    batch = df.withColumn("et", RS.event_time_utc(F.col("ts"))).withColumn("start", F.window("et", "2 hours")["start"])
    hist = MX.histogram(batch, ["start", "phase"], F.col("v"), bounds)
    want = MX.histogram_quantile(hist, ["start", "phase"], 0.95)
    last = max(r.start for r in want.collect())
    assert {k: v[1] for k, v in got.items()} == {(r.start, r.phase): r.quantile for r in want.collect() if r.start != last}
    assert sum(v[0] for v in got.values()) == 480 - 10               # four closed windows without their NULL values


def test_histogram_text_block(spark, tmp_path):
    from eventloom.operators import metrics as MX
    df = spark.createDataFrame([("a", 10), ("a", 70), ('q"\\', 5), (None, 1)], "target string, bytes long")
    lines = MX.histogram_lines(MX.histogram(df, ["target"], F.col("bytes"), [16.0, 64.0]), "m", "Bytes.", ["target"])
    MX.write_text_block(lines, str(tmp_path / "m"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "m").glob("part-*")))

    def family(label, n16, n64, n, total):
        return (f'm_bucket{{target="{label}",le="16"}} {n16}\nm_bucket{{target="{label}",le="64"}} {n64}\n'
                f'm_bucket{{target="{label}",le="+Inf"}} {n}\nm_sum{{target="{label}"}} {total}\nm_count{{target="{label}"}} {n}\n')
    assert text == ("# HELP m Bytes.\n# TYPE m histogram\n" + family("", 1, 1, 1, 1) + family("a", 1, 1, 2, 80)
                    + family('q\\"\\\\', 1, 1, 1, 5))
    whole = MX.histogram_lines(MX.histogram(df, [], F.col("bytes"), [16.0]), "m", "Bytes.", [])
    assert [r.line for r in whole.orderBy("labels", "pos").collect()][2:] == ['m_bucket{le="16"} 3', 'm_bucket{le="+Inf"} 4', "m_sum 86", "m_count 4"]
