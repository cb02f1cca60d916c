"""Counters, byte totals, fixed-bucket histograms, quantiles and rates over event tables.

All are single-pass aggregations: Spark runs a partial (map-side) aggregate per task and
merges the partials after one shuffle on the label columns, so a hot label never puts its
raw rows in one task, only one partial row per task.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, functions as F

# ---- fixed values: histogram bucket bounds used by the reference's metric families ----
SIZE_BUCKETS = [16.0, 64.0, 256.0, 1024.0, 4096.0, 16384.0, 65536.0]
LATENCY_BUCKETS = [0.000005, 0.00001, 0.00005, 0.0001, 0.0005, 0.001, 0.005, 0.01, 0.05, 0.1, 0.5, 1.0]
DRAIN_BUCKETS = [0.1, 0.5, 1.0, 2.0, 5.0, 10.0, 15.0, 30.0, 60.0]
TOPIC_LATENCY_BUCKETS = [0.0005, 0.001, 0.0025, 0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0]
TOPIC_BYTES_BUCKETS = [64.0, 256.0, 1024.0, 4096.0, 16384.0, 65536.0, 262144.0, 1048576.0]
DEFAULT_BUCKETS = [0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0]
# -----------------------------------------------------------------------------------------


def count_by(df: DataFrame, labels: Sequence[str], where: Column | None = None, name: str = "value") -> DataFrame:
    """``count(*)`` by label columns, optionally over the rows matching ``where``."""
    src = df.filter(where) if where is not None else df
    return src.groupBy(*labels).agg(F.count(F.lit(1)).alias(name))


def sum_by(df: DataFrame, labels: Sequence[str], value: Column, name: str = "value") -> DataFrame:
    return df.groupBy(*labels).agg(F.sum(value).cast("bigint").alias(name))


def histogram(df: DataFrame, labels: Sequence[str], value: Column, bounds: Sequence[float]) -> DataFrame:
    """Cumulative ``le`` buckets plus ``+Inf``, ``sum`` and ``count`` in one aggregation pass.

    Output: labels…, ``le`` (string, Prometheus style), ``bucket_count`` (cumulative),
    ``sum``, ``count``.
    """
    bounds = sorted(float(b) for b in bounds)
    aggs = [F.sum(F.when(value <= F.lit(b), 1).otherwise(0)).cast("bigint").alias(f"_b{i}")
            for i, b in enumerate(bounds)]
    aggs += [F.count(value).alias("count"), F.sum(value).alias("sum")]
    agg = df.groupBy(*labels).agg(*aggs)
    entries = [F.struct(F.lit(_le_text(b)).alias("le"), F.lit(float(b)).alias("le_value"),
                        F.col(f"_b{i}").alias("bucket_count")) for i, b in enumerate(bounds)]
    entries.append(F.struct(F.lit("+Inf").alias("le"), F.lit(float("inf")).alias("le_value"),
                            F.col("count").alias("bucket_count")))
    return (agg.select(*labels, "sum", "count", F.explode(F.array(*entries)).alias("_e"))
               .select(*labels, "_e.le", "_e.le_value", "_e.bucket_count", "sum", "count"))


def _le_text(b: float) -> str:
    return repr(float(b)) if not float(b).is_integer() else str(int(b)) if abs(b) < 1e15 else repr(b)


def histogram_quantile(hist: DataFrame, labels: Sequence[str], q: float) -> DataFrame:
    """PromQL ``histogram_quantile`` over cumulative buckets from :func:`histogram`.

    rank = q * total; pick the first bucket whose cumulative count >= rank; interpolate
    linearly inside it (lower bound 0 for the first bucket); if it is ``+Inf`` return the
    highest finite bound. Each label group holds only its bucket rows (a fixed, small number).
    """
    arr = hist.groupBy(*labels).agg(
        F.array_sort(F.collect_list(F.when(F.col("le") != "+Inf", F.struct("le_value", "bucket_count")))).alias("_bs"),
        F.max(F.when(F.col("le") == "+Inf", F.col("bucket_count"))).alias("_total"))
    return arr.select(*labels, quantile_from_buckets(F.col("_bs"), F.col("_total"), q).alias("quantile"))


def quantile_from_buckets(bs: Column, total: Column, q: float) -> Column:
    rank = F.lit(float(q)) * total
    n = F.size(bs)
    # index (1-based) of the first bucket with cumulative count >= rank; 0 when none
    hit = F.size(F.filter(bs, lambda e: e["bucket_count"] < rank)) + 1
    cur = F.element_at(bs, hit)
    prev = F.when(hit > 1, F.element_at(bs, (hit - 1).cast("int")))
    lo = F.coalesce(prev["le_value"], F.lit(0.0))
    c_lo = F.coalesce(prev["bucket_count"], F.lit(0)).cast("double")
    hi = cur["le_value"]
    c_hi = cur["bucket_count"].cast("double")
    interp = lo + (hi - lo) * (rank - c_lo) / (c_hi - c_lo)
    top = F.element_at(bs, n)["le_value"]
    return (F.when(total <= 0, F.lit(None).cast("double"))
             .when(hit > n, top)
             .when(c_hi == c_lo, hi)
             .otherwise(interp))


def window_rate(df: DataFrame, ts: str, labels: Sequence[str], window: str, slide: str | None = None,
                seconds: float | None = None) -> DataFrame:
    """Count per (sliding or tumbling) event-time window, and count / window seconds."""
    w = F.window(F.col(ts), window, slide) if slide else F.window(F.col(ts), window)
    out = df.groupBy(w.alias("w"), *labels).agg(F.count(F.lit(1)).alias("n"))
    secs = seconds or _duration_seconds(window)
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *labels,
                      "n", (F.col("n") / F.lit(float(secs))).alias("rate"))


def _duration_seconds(text: str) -> float:
    num, unit = text.split()[:2]
    unit = unit.rstrip("s").lower()
    mult = {"second": 1, "minute": 60, "hour": 3600, "day": 86400}[unit]
    return float(num) * mult


def loss_ratio(df: DataFrame, labels: Sequence[str], is_error: Column) -> DataFrame:
    return df.groupBy(*labels).agg(
        F.count(F.lit(1)).alias("messages"),
        F.count_if(is_error).alias("errors"),
    ).withColumn("loss_ratio", F.try_divide(F.col("errors").cast("double"), F.col("messages").cast("double")))


def _esc_label(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c.cast("string"), F.lit("\\"), F.lit("\\\\")),
                               F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))


def prometheus_sample(metric: str, labels: Sequence[str], value: str = "value", suffix: Column | None = None) -> Column:
    """One exposition line per row: ``name{l="v",…} value`` (label values escape ``\\``, ``"``, LF)."""
    lab = F.concat_ws(",", *[F.concat(F.lit(f'{l}="'), _esc_label(F.col(l)), F.lit('"')) for l in labels]) \
        if labels else F.lit("")
    name = F.lit(metric) if suffix is None else F.concat(F.lit(metric), suffix)
    return F.concat(name, F.when(lab != "", F.concat(F.lit("{"), lab, F.lit("}"))).otherwise(F.lit("")),
                    F.lit(" "), F.col(value).cast("string"))


def prometheus_lines(samples: DataFrame, metric: str, help_text: str, mtype: str, labels: Sequence[str],
                     value: str = "value") -> DataFrame:
    """``# HELP`` / ``# TYPE`` header lines and one sample line per row, as a ``line`` column."""
    head = samples.sparkSession.createDataFrame([(f"# HELP {metric} {help_text}",), (f"# TYPE {metric} {mtype}",)],
                                                "line string")
    return head.unionByName(samples.select(prometheus_sample(metric, labels, value).alias("line")))


def histogram_lines(hist: DataFrame, metric: str, help_text: str, labels: Sequence[str], sum_text: Column | None = None) -> DataFrame:
    """A histogram family as exposition text: ``labels`` (the rendered label set), ``pos`` and ``line``, a row a line.

    The text is the lines by (labels, pos): HELP and TYPE (empty labels, pos -2 and -1), then for each label set its
    ``_bucket`` lines by ascending bound, ``_sum`` and ``_count``. ``hist`` is a result of :func:`histogram`; a NULL
    label is empty text, ``sum_text`` the sum as text.
    """
    sum_text = F.col("sum").cast("string") if sum_text is None else sum_text
    sets = hist.groupBy(*labels).agg(F.sort_array(F.collect_list(F.struct("le_value", "le", "bucket_count"))).alias("_bs"),
                                     F.first(sum_text).alias("_sum"), F.first("count").cast("string").alias("_count"))
    named = F.concat_ws(",", *[F.concat(F.lit(f'{l}="'), _esc_label(F.coalesce(F.col(l).cast("string"), F.lit(""))), F.lit('"'))
                               for l in labels])
    tail = F.when(F.lit(bool(labels)), F.concat(F.lit("{"), named, F.lit("} "))).otherwise(F.lit(" "))
    start = F.concat(F.lit(f"{metric}_bucket{{"), named, F.lit(',le="' if labels else 'le="'))
    lines = F.concat(F.transform("_bs", lambda b: F.concat(start, b["le"], F.lit('"} '), b["bucket_count"].cast("string"))),
                     F.array(F.concat(F.lit(f"{metric}_sum"), tail, F.col("_sum")), F.concat(F.lit(f"{metric}_count"), tail, F.col("_count"))))
    body = sets.select(named.alias("labels"), F.posexplode(lines).alias("pos", "line"))
    head = hist.sparkSession.createDataFrame([("", -2, f"# HELP {metric} {help_text}"), ("", -1, f"# TYPE {metric} histogram")],
                                             "labels string, pos int, line string")
    return head.unionByName(body)


def write_text_block(lines: DataFrame, path: str) -> None:
    """Write the lines of :func:`histogram_lines` in text order; the part files in name order are the text."""
    lines.orderBy("labels", "pos").select("line").write.mode("overwrite").option("lineSep", "\n").text(path)
