"""Scans of result files: estimate lines, baseline documents and nested estimates, written from the given tables to the
shared folder and read back by the library's readers."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import functions as F

from eventloom.catalog import register, table
from eventloom.sources import scans
from eventloom.sources.paths import located
from eventloom.sources.sinks import scratch_path


@register("scan_estimates",
          "SELECT l_returnflag || '/' || l_linestatus AS label, l_returnflag AS \"group\", count(*) AS lines, count(l_extendedprice) AS timed, "
          "min(l_extendedprice) AS fastest, max(l_extendedprice) AS slowest FROM lineitem "
          "WHERE l_linenumber <> 7 AND l_linenumber <> 6 AND l_returnflag IS NOT NULL AND l_linestatus IS NOT NULL GROUP BY ALL")
def scan_estimates(spark, sf_dir):
    """Every line item as an estimate line of a run file; those numbered 7 are broken lines, those numbered 6 have an
    empty label, and a blank line follows each line numbered 1: none of these is an estimate."""
    path = scratch_path(spark, "estimates")
    li = table(spark, sf_dir, "lineitem")
    label = F.when(F.col("l_linenumber") == 6, "").otherwise(F.concat("l_returnflag", F.lit("/"), "l_linestatus"))
    text = F.to_json(F.struct(F.lit("prices").alias("bench"), F.col("l_returnflag").alias("group"), label.alias("label"),
                              F.col("l_extendedprice").alias("time_ns_median")))
    text = F.when(F.col("l_linenumber") == 7, F.concat(F.lit("{broken "), text)).when(F.col("l_linenumber") == 1, F.concat(text, F.lit("\n"))).otherwise(text)
    li.select(text.alias("value")).write.text(path)
    return scans.read_estimates(spark, [path, f"{path}-missing"]).groupBy("label", "group").agg(
        F.count("*").alias("lines"), F.count("time_ns_median").alias("timed"), F.min("time_ns_median").alias("fastest"), F.max("time_ns_median").alias("slowest"))


@register("scan_baselines",
          "SELECT 'sha-' || c_nationkey AS sha, CASE WHEN c_nationkey % 2 = 0 THEN 'quick' END AS mode, c_mktsegment AS label, "
          "max(c_acctbal) AS time_ns_median, count(*) AS n_samples FROM customer WHERE c_nationkey IS NOT NULL AND c_mktsegment IS NOT NULL GROUP BY ALL")
def scan_baselines(spark, sf_dir):
    """A baseline document for each nation, with an estimate for each market segment, in either header layout (``sha``
    with a mode, or ``baseline_sha``); all documents read back, a row an estimate."""
    path = scratch_path(spark, "baselines")
    est = table(spark, sf_dir, "customer").filter("c_nationkey IS NOT NULL AND c_mktsegment IS NOT NULL") \
        .groupBy("c_nationkey", "c_mktsegment").agg(F.max("c_acctbal").alias("time_ns_median"), F.count("*").alias("n_samples"))
    docs = est.groupBy("c_nationkey").agg(F.collect_list(F.struct(F.col("c_mktsegment").alias("label"), "time_ns_median", "n_samples")).alias("estimates"))
    even, sha = F.col("c_nationkey") % 2 == 0, F.concat(F.lit("sha-"), F.col("c_nationkey").cast("string"))
    text = F.to_json(F.struct(F.when(even, sha).alias("sha"), F.when(~even, sha).alias("baseline_sha"), F.when(even, "quick").alias("mode"), "estimates"))
    # a file a document, as the reader takes a whole file for one
    docs.select(text.alias("value"), F.col("c_nationkey").alias("nation")).repartition("nation").write.partitionBy("nation").text(path)
    return scans.read_baselines(spark, path).select("sha", "mode", "label", "time_ns_median", "n_samples")


@register("scan_nested_estimates",
          "SELECT CASE WHEN target IS NULL THEN phase ELSE phase || '/' || target END AS label, phase AS \"group\", time_ns_median, time_ns_lower, time_ns_upper "
          "FROM (SELECT event_type AS phase, 'user-' || (user_id % 20) AS target, max(value) AS time_ns_median, min(value) AS time_ns_lower, max(value) + 1.0 AS time_ns_upper "
          "FROM events WHERE event_type IS NOT NULL AND user_id IS NOT NULL GROUP BY ALL UNION ALL SELECT event_type, NULL, max(value), min(value), max(value) + 1.0 "
          "FROM events WHERE event_type IS NOT NULL GROUP BY ALL) WHERE time_ns_median IS NOT NULL")
def scan_nested_estimates(spark, sf_dir):
    """An ``estimates.json`` for each event type and for each event type and share of the users, in nested folders,
    written by the tasks and read back with the labels that the folders give."""
    root = scratch_path(spark, "nested")
    ev = table(spark, sf_dir, "events").filter("event_type IS NOT NULL")
    found = [F.max("value").alias("point"), F.min("value").alias("lower"), (F.max("value") + 1.0).alias("upper")]
    of_type = ev.groupBy(F.col("event_type").alias("folder")).agg(*found)
    of_share = ev.filter("user_id IS NOT NULL").groupBy(F.concat("event_type", F.lit("/user-"), (F.col("user_id") % 20).cast("string")).alias("folder")).agg(*found)

    def put(batches):
        for pdf in batches:
            for folder, point, lower, upper in zip(pdf["folder"], pdf["point"], pdf["lower"], pdf["upper"]):
                files, base = located(root)
                files.create_dir(f"{base}/{folder}/new", recursive=True)
                with files.open_output_stream(f"{base}/{folder}/new/estimates.json") as out:
                    out.write(json.dumps({"mean": {"point_estimate": point, "confidence_interval": {"lower_bound": lower, "upper_bound": upper}}}).encode())
            yield pd.DataFrame({"written": [len(pdf)]})

    of_type.unionByName(of_share).filter("point IS NOT NULL").mapInPandas(put, "written long").agg(F.sum("written")).collect()
    return scans.read_nested_estimates(spark, root)
