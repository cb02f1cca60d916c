"""Benchmark-analytics rules on small tables: aggregate status, verdict reasons, report
text truncation, variant decision tie-break, baseline thresholds."""

from pyspark.sql import functions as F

from eventloom.operators import benchruns as BR

MATRIX = "workload_id string, run_idx int, tool string, status string, has_measurements boolean"


def _status(spark, rows):
    df = spark.createDataFrame(rows, MATRIX)
    return BR.aggregate_status(df).first().status


def test_aggregate_status_cases(spark):
    assert _status(spark, []) == "schema_only"
    assert _status(spark, [("w", 1, "a", "completed", True), ("w", 1, "b", "completed", True)]) == "complete"
    assert _status(spark, [("w", 1, "a", "completed", True), ("w", 1, "b", "n_a", False)]) == "partial"
    assert _status(spark, [("w", 1, "a", "completed", True), ("w", 1, "b", "failed", True)]) == "partial"
    assert _status(spark, [("w", 1, "a", "skipped", False), ("w", 1, "b", "dry_run", False)]) == "dry_run"


def test_missing_cell_is_skipped(spark):
    wl = spark.createDataFrame([("w1",), ("w2",)], "workload_id string")
    cells = spark.createDataFrame([("w1", 1, "a", "completed")], "workload_id string, run_idx int, tool string, status string")
    m = BR.cell_matrix(wl, "workload_id", F.lit(1), ["a", "b"], cells)
    got = {(r.workload_id, r.tool): (r.status, r.skip_reason is not None) for r in m.collect()}
    assert got == {("w1", "a"): ("completed", False), ("w1", "b"): ("skipped", True),
                   ("w2", "a"): ("skipped", True), ("w2", "b"): ("skipped", True)}
    assert BR.integrity(m, F.col("tool")).first().ok


def test_verdict_reason_order_and_text(spark):
    t = spark.createDataFrame([(10, 5000, 10.0, "reset"), (0, 0, 1.0, None), (100, 50000, 100.0, None),
                               (30, 18000, 10.0, None)],
                              "messages long, bytes long, duration_secs double, error string")
    m = BR.cell_measures(t, F.lit(1.0), F.lit(500.0))
    v = {r.messages: r for r in BR.cell_verdict(m, F.when(F.col("messages") == 10, 2).otherwise(0)).collect()}
    assert v[0].status == "failed" and v[0].fail_reasons == ["zero_messages_received"]
    assert v[10].fail_reasons == ["runner_exit_code=2", "receiver_error=reset"]
    assert v[100].status == "completed" and v[100].fail_reasons == []
    assert v[30].fail_reasons == ["rate_above_5%_tolerance=300.0%", "size_outside_5%_tolerance=20.0%"]
    assert (v[30].achieved_msg_per_sec, v[30].actual_bytes_per_msg, v[30].window_secs) == (3.0, 600.0, 10.0)


def test_fmt_cell_truncation(spark):
    long_reason = "x" * 31
    long_err = "e" * 41
    df = spark.createDataFrame([("skipped", long_reason, None), ("failed", None, long_err), ("skipped", "short", None)],
                               "status string, skip_reason string, error string")
    df = df.withColumn("fr", F.array().cast("array<string>"))
    got = [r.t for r in df.select(BR.fmt_cell(F.col("status"), F.col("skip_reason"), F.col("error"), F.col("fr")).alias("t")).collect()]
    assert got == ["skipped (" + "x" * 27 + "...)", "failed (" + "e" * 37 + "...)", "skipped (short)"]


def test_variant_decision_tie_goes_to_first(spark):
    sizes = spark.createDataFrame([("3", 100), ("s", 60), ("z", 60)], "variant string, size long")
    meds = spark.createDataFrame([("3", "l", 10.0), ("s", "l", 10.2), ("z", "l", 10.1)], "variant string, label string, median_ns double")
    out = {r.variant: r for r in BR.variant_decision(sizes, meds, "variant", "label", "median_ns", "3", ["s", "z"]).collect()}
    assert out["s"].eligible and out["z"].eligible
    assert out["s"].winner and not out["z"].winner
    sizes2 = spark.createDataFrame([("3", 100), ("s", 80), ("z", 50)], "variant string, size long")
    out2 = {r.variant: r for r in BR.variant_decision(sizes2, meds, "variant", "label", "median_ns", "3", ["s", "z"]).collect()}
    assert not out2["s"].eligible and out2["z"].winner


def test_baseline_thresholds_by_category(spark):
    base = spark.createDataFrame([("hot_path/a", 100), ("runtime/b", 100), ("x", 100), ("gone", 5)], "label string, v long")
    curr = spark.createDataFrame([("hot_path/a", 106), ("runtime/b", 106), ("x", 80)], "label string, v long")
    th = spark.createDataFrame([("hot_path", 5.0), ("runtime", 10.0), ("other", 10.0)], "category string, threshold double")
    cat = BR.categorize(F.col("label"), [("contains", "hot_path", "hot_path"), ("prefix", "runtime/", "runtime")])
    got = {r.label: r.verdict for r in BR.compare_to_baseline(base, curr, "label", "v", cat, th).collect()}
    assert got == {"hot_path/a": "REGRESS", "runtime/b": "none", "x": "IMPROVE"}


def test_fmt_cell_na_reason(spark):
    df = spark.createDataFrame([("n_a", "topic tool not installed on this host at all")], "status string, r string")
    got = df.select(BR.fmt_cell(F.col("status"), F.lit(None).cast("string"), F.lit(None).cast("string"),
                                F.array().cast("array<string>"), F.col("r")).alias("t")).first().t
    assert got == "n/a (topic tool not installed on...)"


def test_round_half_even_is_exact(spark):
    import random
    rng = random.Random(18)
    xs = [0.0, 0.125, 0.375, 1.115, 2.675, 0.5, 1.5, 2.5, -0.125, -1.115, 0.0005, 0.0015, 1e-9, 2.0 ** 60, float("inf"), 94.95, 95.05, 104.95]
    xs += [rng.uniform(0, 10 ** rng.randint(-4, 9)) for _ in range(3000)] + [rng.randrange(10 ** 6) / 8 for _ in range(500)]
    xs += [rng.randrange(10 ** 5) / 1000 + 0.0005 for _ in range(500)]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    for r in df.select("x", *[BR.round_half_even(F.col("x"), d).alias(f"d{d}") for d in range(4)]).collect():
        assert [r[f"d{d}"] for d in range(4)] == [round(r["x"], d) for d in range(4)], r


def test_throughput_text_and_pivot(spark):
    rows = [("w", 1, "a", "completed", 12.25, 7, 8), ("w", 2, "a", "completed", 99.0, 7, 8), ("w", 1, "b", "completed", None, 7, 8),
            ("v", 1, "a", "completed", None, None, 8), ("v", 1, "b", "completed", None, None, None), ("u", 1, "a", "failed", 5.0, 7, 8), ("u", 2, "a", "completed", 5.0, 7, 8),
            ("x", 1, "b", "completed", 1234567.96, 1, 1)]
    m = spark.createDataFrame(rows, "w string, run_idx int, tool string, status string, rate double, messages long, received long")
    text = BR.throughput_text(F.col("status"), F.col("rate"), F.col("messages"), F.col("received"))
    got = {r.w: (r.row_order, r.a, r.b) for r in BR.report_pivot(m, "w", ["a", "b"], text, {"w": 0, "v": 1}).collect()}
    assert got == {"w": (0, "12.2 msg/s", "7 msg"), "v": (1, "8 B", "-"), "u": (2, "-", "-"), "x": (2, "-", "1234568.0 msg/s")}
