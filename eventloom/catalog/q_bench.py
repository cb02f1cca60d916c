"""Benchmark-analytics queries. Stand-in results come from lineitem: every row is one
estimate (label = category/flag+status/part bucket, run = line number, time = price) or
one received message of a (workload = supplier region, run, tool) cell."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventloom.catalog import register, table
from eventloom.operators import benchruns as BR
from eventloom.operators.quantiles import exact_quantiles

EST_EXPRS = [
    "l_linenumber AS run_idx",
    "CASE l_returnflag WHEN 'A' THEN 'hot_path/' WHEN 'N' THEN 'runtime/' ELSE 'format_matrix/' END || l_returnflag "
    "|| l_linestatus || '/p' || CAST(l_partkey % 10 AS STRING) AS label",
    "'bench_' || l_returnflag AS bench", "l_linestatus AS grp",
    "l_extendedprice AS time_ns_median", "l_extendedprice * (1 - l_discount) AS time_ns_lower",
    "l_extendedprice * (1 + l_tax) AS time_ns_upper", "l_orderkey AS pos", "l_partkey", "l_shipdate",
]


def _duck(exprs):
    return ", ".join(e.replace("AS STRING", "AS VARCHAR") for e in exprs)


EST_SQL = f"(SELECT {_duck(EST_EXPRS)} FROM lineitem) est"
FIRST = "row(run_idx, pos)"


def estimates(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").selectExpr(*EST_EXPRS)


VALUES = ["time_ns_median", "time_ns_lower", "time_ns_upper"]


def _median_sql(src: str, label: str = "label") -> str:
    meds = ", ".join(f"CAST(trunc(median({v})) AS BIGINT) AS {v}" for v in VALUES)
    return (f"SELECT {label}, arg_min(bench, {FIRST}) AS bench, arg_min(grp, {FIRST}) AS grp, {meds}, "
            f"count(*) AS n_samples FROM {src} GROUP BY {label}")


def _medians(df):
    return BR.median_runs(df, "label", VALUES, F.struct("run_idx", "pos"), ["bench", "grp"])


@register("median_runs", _median_sql(EST_SQL))
def median_runs(spark, sf_dir):
    """Exact median across runs of median/lower/upper per label (truncated), n_samples,
    bench/group from the first run."""
    return _medians(estimates(spark, sf_dir))


@register("latency_percentiles",
          "SELECT bench, round(quantile_cont(time_ns_median, 0.5), 9) AS q50, round(quantile_cont(time_ns_median, 0.95), 9) AS q95, "
          f"round(quantile_cont(time_ns_median, 0.99), 9) AS q99 FROM {EST_SQL} GROUP BY bench")
def latency_percentiles(spark, sf_dir):
    """Exact interpolated p50/p95/p99 per bench (distributed rank selection)."""
    q = exact_quantiles(estimates(spark, sf_dir), ["bench"], "time_ns_median", [0.5, 0.95, 0.99])
    return q.select("bench", *[F.round(c, 9).alias(c) for c in ("q50", "q95", "q99")])  # interpolation: 9 decimals


@register("keep_last",
          f"SELECT label, arg_max(time_ns_median, {FIRST}) AS last_ns, max(run_idx) AS last_run FROM {EST_SQL} GROUP BY label")
def keep_last(spark, sf_dir):
    """Last estimate per label (by run, then position) with max_by — a partial aggregate."""
    e = estimates(spark, sf_dir)
    return e.groupBy("label").agg(F.max_by("time_ns_median", F.struct("run_idx", "pos")).alias("last_ns"),
                                  F.max("run_idx").alias("last_run"))


@register("newest_baseline",
          f"SELECT run_idx, strftime(max(l_shipdate), '%Y-%m-%d %H:%M:%S') AS newest FROM {EST_SQL} GROUP BY run_idx "
          "ORDER BY max(l_shipdate) DESC, run_idx DESC LIMIT 1")
def newest_baseline(spark, sf_dir):
    """The newest run (a top-1 report: limit is the feature)."""
    e = estimates(spark, sf_dir).groupBy("run_idx").agg(F.max("l_shipdate").alias("_ts"))
    return e.orderBy(F.col("_ts").desc(), F.col("run_idx").desc()).limit(1).select(
        "run_idx", F.date_format("_ts", "yyyy-MM-dd HH:mm:ss").alias("newest"))


# ---- fixed category rules and thresholds (%), the threshold table is an input -----------------
CATEGORY_RULES = [("contains", "hot_path", "hot_path"), ("prefix", "runtime/", "runtime"), ("prefix", "runtime_", "runtime"),
                  ("contains", "transport_matrix_tcp", "transport"), ("contains", "transport_matrix_udp", "transport"),
                  ("contains", "format_matrix", "format"), ("contains", "dispatch_matrix", "dispatch")]
THRESHOLDS = [("hot_path", 5.0), ("runtime", 10.0), ("transport", 15.0), ("format", 10.0), ("dispatch", 10.0),
              ("other", 10.0)]


def _cat_sql(label: str) -> str:
    whens = " ".join(f"WHEN {('starts_with(' + label + ', ' + repr(t) + ')') if k == 'prefix' else ('contains(' + label + ', ' + repr(t) + ')')} THEN '{c}'"
                     for k, t, c in CATEGORY_RULES)
    return f"CASE {whens} ELSE 'other' END"


_TH_SQL = "(VALUES " + ", ".join(f"('{c}', CAST({t!r} AS DOUBLE))" for c, t in THRESHOLDS) + ") th(category, threshold)"
COMPARE_SQL = (
    f"WITH b AS ({_median_sql(EST_SQL + ' WHERE run_idx <= 3')}), c AS ({_median_sql(EST_SQL + ' WHERE run_idx >= 4')}), "
    f"j AS (SELECT b.label, b.time_ns_median AS base_ns, c.time_ns_median AS curr_ns, {_cat_sql('b.label')} AS category "
    "FROM b JOIN c ON b.label = c.label WHERE b.time_ns_median <> 0) "
    "SELECT j.*, th.threshold, CAST(curr_ns - base_ns AS DOUBLE) / CAST(base_ns AS DOUBLE) * 100.0 AS delta_pct, "
    "CASE WHEN CAST(curr_ns - base_ns AS DOUBLE) / CAST(base_ns AS DOUBLE) * 100.0 > th.threshold THEN 'REGRESS' "
    "WHEN CAST(curr_ns - base_ns AS DOUBLE) / CAST(base_ns AS DOUBLE) * 100.0 < -th.threshold THEN 'IMPROVE' ELSE 'none' END AS verdict "
    f"FROM j LEFT JOIN {_TH_SQL} ON j.category = th.category")


def _compare(spark, sf_dir):
    e = estimates(spark, sf_dir)
    base = _medians(e.filter("run_idx <= 3"))
    curr = _medians(e.filter("run_idx >= 4"))
    th = spark.createDataFrame(THRESHOLDS, "category string, threshold double")
    return BR.compare_to_baseline(base, curr, "label", "time_ns_median", BR.categorize(F.col("label"), CATEGORY_RULES), th)


@register("baseline_compare", COMPARE_SQL)
def baseline_compare(spark, sf_dir):
    """Medians of runs 1-3 (baseline) vs runs 4-7 (current): delta % and REGRESS/IMPROVE flags
    against per-category thresholds (inner join on label)."""
    return _compare(spark, sf_dir).select("label", "base_ns", "curr_ns", "category", "threshold", "delta_pct", "verdict")


@register("regression_gate",
          f"SELECT count(*) FILTER (WHERE verdict = 'REGRESS') AS regressions, count(*) FILTER (WHERE verdict = 'IMPROVE') AS improvements, "
          f"count(*) FILTER (WHERE verdict = 'REGRESS') = 0 AS pass FROM ({COMPARE_SQL}) x")
def regression_gate(spark, sf_dir):
    return BR.gate(_compare(spark, sf_dir))


FINE = "label || '/' || CAST(l_partkey % 1000 AS VARCHAR)"


@register("missing_labels",
          f"SELECT DISTINCT {FINE} AS label FROM {EST_SQL} WHERE run_idx = 1 EXCEPT "
          f"SELECT DISTINCT {FINE} AS label FROM {EST_SQL} WHERE run_idx = 7")
def missing_labels(spark, sf_dir):
    """Fine-grained labels of run 1 that run 7 lacks (anti join)."""
    e = estimates(spark, sf_dir).withColumn("label", F.concat_ws("/", "label", (F.col("l_partkey") % 1000).cast("string")))
    return BR.missing_labels(e.filter("run_idx = 1"), e.filter("run_idx = 7"), "label")


VARIANT = "CASE WHEN run_idx <= 2 THEN '3' WHEN run_idx <= 4 THEN 's' ELSE 'z' END"


def _variant_tables(spark, sf_dir):
    e = estimates(spark, sf_dir).withColumn("variant", F.expr(VARIANT))
    li = table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("run_idx"), "l_quantity") \
        .withColumn("variant", F.expr(VARIANT))
    sizes = li.groupBy("variant").agg(F.sum("l_quantity").cast("bigint").alias("size"))
    meds = exact_quantiles(e, ["variant", "label"], "time_ns_median", [0.5]).withColumnRenamed("q50", "median_ns")
    return sizes, meds


_VSQL = (f"WITH m AS (SELECT {VARIANT} AS variant, label, median(time_ns_median) AS median_ns FROM {EST_SQL} GROUP BY ALL), "
         f"sz AS (SELECT {VARIANT.replace('run_idx', 'l_linenumber')} AS variant, CAST(sum(l_quantity) AS BIGINT) AS size FROM lineitem GROUP BY ALL), ")


@register("variant_decision",
          _VSQL + "r AS (SELECT m.variant, greatest(max((m.median_ns - b.median_ns) / b.median_ns * 100.0), 0.0) AS max_regress_pct "
          "FROM m JOIN m b ON m.label = b.label AND b.variant = '3' WHERE m.variant <> '3' GROUP BY m.variant), "
          "s AS (SELECT sz.variant, sz.size, (base.size - sz.size) / base.size * 100.0 AS reduction_pct, r.max_regress_pct "
          "FROM sz JOIN (SELECT size FROM sz WHERE variant = '3') base ON TRUE LEFT JOIN r ON sz.variant = r.variant WHERE sz.variant <> '3'), "
          "e AS (SELECT *, reduction_pct >= 30.0 AND coalesce(max_regress_pct, 0.0) <= 5.0 AS eligible FROM s), "
          "w AS (SELECT variant FROM e WHERE eligible ORDER BY reduction_pct DESC, CASE variant WHEN 's' THEN 1 ELSE 2 END LIMIT 1) "
          "SELECT e.*, coalesce(e.variant = (SELECT variant FROM w), FALSE) AS winner FROM e")
def variant_decision(spark, sf_dir):
    """Variants '3' (runs 1-2), 's' (3-4), 'z' (5-7): size cut ≥ 30 % and max slowdown ≤ 5 %."""
    sizes, meds = _variant_tables(spark, sf_dir)
    return BR.variant_decision(sizes, meds, "variant", "label", "median_ns", "3", ["s", "z"]).select(
        "variant", "size", "reduction_pct", "max_regress_pct", "eligible", "winner")


@register("variant_pivot",
          _VSQL.rstrip(", ") + " SELECT label, max(median_ns) FILTER (WHERE variant = '3') AS v3, "
          "max(median_ns) FILTER (WHERE variant = 's') AS vs, max(median_ns) FILTER (WHERE variant = 'z') AS vz FROM m GROUP BY label")
def variant_pivot(spark, sf_dir):
    """Per label, the median of each variant side by side (pivot)."""
    _, meds = _variant_tables(spark, sf_dir)
    p = meds.groupBy("label").pivot("variant", ["3", "s", "z"]).agg(F.first("median_ns"))
    return p.select("label", F.col("3").alias("v3"), F.col("s").alias("vs"), F.col("z").alias("vz"))


# ---------------------------------------------------------------- cells: workload × run × tool
TOOLS = ["eventloom", "tool_a", "tool_b"]
WORKLOAD_ORDER = {"africa": 0, "america": 1, "asia": 2, "europe": 3, "middle east": 4}
REC_EXPRS = [
    "lower(r_name) AS workload_id", "l_linenumber AS run_idx",
    "CASE l_returnflag WHEN 'A' THEN 'eventloom' WHEN 'N' THEN 'tool_a' ELSE 'tool_b' END AS tool",
    "CAST(floor(l_extendedprice) AS BIGINT) % 1000 + 1 AS body_bytes",
    "CAST(floor(l_extendedprice) AS BIGINT) % 1000 + 2 AS wire_bytes",
    "CASE WHEN l_quantity = 50 AND l_discount = 0.1 THEN 'connection reset' END AS error",
    "l_orderkey * 10 + l_linenumber AS pos",
]
WL_EXPRS = ["lower(r_name) AS workload_id", "CAST(r_regionkey + 1 AS DOUBLE) * 0.5 AS target_msg_per_sec",
            "CAST(500.0 AS DOUBLE) AS spec_size"]
T_DAYS = "CAST(date_diff('microsecond', TIMESTAMP '1990-01-01 00:00:00', l_shipdate) AS DOUBLE) / 1000000.0 / 86400.0"


def received(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    dims = (table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
            .join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
            .join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
            .select(F.col("s_suppkey").alias("l_suppkey"), "r_name"))
    from eventloom.plans.broadcast import maybe_broadcast
    j = li.join(maybe_broadcast(dims), "l_suppkey", "inner")
    t = F.timestamp_diff("MICROSECOND", F.lit("1990-01-01 00:00:00").cast("timestamp_ntz"), F.col("l_shipdate")).cast("double") / 1e6 / 86400.0
    return j.select(*[F.expr(e) for e in REC_EXPRS], t.alias("t"))


REC_SQL = (f"(SELECT {_duck(REC_EXPRS)}, {T_DAYS} AS t FROM lineitem JOIN supplier ON l_suppkey = s_suppkey "
           f"JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey) rec")
CELL = ["workload_id", "run_idx", "tool"]

TOTALS_SQL = ("SELECT workload_id, run_idx, tool, CAST(sum(body_bytes) AS BIGINT) AS bytes, CAST(sum(wire_bytes) AS BIGINT) AS wire_bytes, "
              "count(*) AS messages, max(t) - min(t) AS duration_secs, arg_min(error, CASE WHEN error IS NOT NULL THEN pos END) AS error "
              f"FROM {REC_SQL} GROUP BY workload_id, run_idx, tool")


def totals(spark, sf_dir):
    return BR.receiver_totals(received(spark, sf_dir), CELL, "body_bytes", "wire_bytes", "error", F.col("pos"), F.col("t"))


@register("receiver_totals", TOTALS_SQL)
def receiver_totals(spark, sf_dir):
    """Per (workload, run, tool): body bytes, wire bytes, messages, span and first error."""
    return totals(spark, sf_dir)


def _rh(x: str, digits: int) -> str:
    # printf renders the exact binary value, ties to even
    return f"CAST(printf('%.{digits}f', CAST({x} AS DOUBLE)) AS DOUBLE)"


MEAS_SQL = (
    f"WITH tt AS ({TOTALS_SQL}), w AS (SELECT {', '.join(WL_EXPRS)} FROM region), "
    "x AS (SELECT tt.*, w.target_msg_per_sec, w.spec_size, greatest(0.001, duration_secs) AS win FROM tt JOIN w USING (workload_id)), "
    f"y AS (SELECT x.*, {_rh('win', 3)} AS window_secs, "
    f"CASE WHEN messages > 0 THEN {_rh('messages / win', 2)} ELSE 0.0 END AS achieved_msg_per_sec, "
    f"CASE WHEN messages > 0 THEN {_rh('100.0 * messages / win / target_msg_per_sec', 1)} ELSE 0.0 END AS rate_pct_of_target, "
    f"CASE WHEN messages > 0 THEN {_rh('bytes / greatest(1, messages)', 2)} ELSE 0.0 END AS actual_bytes_per_msg FROM x) "
    f"SELECT y.* EXCLUDE (win, target_msg_per_sec, spec_size), CASE WHEN messages > 0 THEN {_rh('100.0 * abs(actual_bytes_per_msg - spec_size) / spec_size', 2)} "
    "ELSE 0.0 END AS size_pct_deviation FROM y")


def measures(spark, sf_dir):
    wl = table(spark, sf_dir, "region").selectExpr(*WL_EXPRS)
    t = totals(spark, sf_dir).join(F.broadcast(wl), "workload_id", "inner")
    return BR.cell_measures(t, F.col("target_msg_per_sec"), F.col("spec_size")).drop("target_msg_per_sec", "spec_size")


@register("cell_measure", MEAS_SQL)
def cell_measure(spark, sf_dir):
    """Rate, % of target, bytes per message and size deviation per cell (target by workload)."""
    return measures(spark, sf_dir)


EXIT = "CASE WHEN messages % 97 = 0 THEN 1 ELSE 0 END"
VERDICT_SQL = (
    f"WITH m AS ({MEAS_SQL}), r AS (SELECT m.*, {EXIT} AS exit_code, concat_ws('; ', "
    "CASE WHEN exit_code <> 0 THEN 'runner_exit_code=' || CAST(exit_code AS VARCHAR) END, "
    "CASE WHEN error IS NOT NULL THEN 'receiver_error=' || error END, "
    "CASE WHEN messages = 0 THEN 'zero_messages_received' END, "
    "CASE WHEN messages > 0 AND rate_pct_of_target < 95.0 THEN 'rate_below_5%_tolerance=' || CAST(rate_pct_of_target AS VARCHAR) || '%' END, "
    "CASE WHEN messages > 0 AND rate_pct_of_target > 105.0 THEN 'rate_above_5%_tolerance=' || CAST(rate_pct_of_target AS VARCHAR) || '%' END, "
    "CASE WHEN messages > 0 AND size_pct_deviation > 5.0 THEN 'size_outside_5%_tolerance=' || CAST(size_pct_deviation AS VARCHAR) || '%' END"
    ") AS fail_reasons FROM m) "
    "SELECT workload_id, run_idx, tool, messages, error, exit_code, fail_reasons, "
    "CASE WHEN fail_reasons = '' THEN 'completed' ELSE 'failed' END AS status FROM r")


def verdicts(spark, sf_dir):
    m = measures(spark, sf_dir)
    return BR.cell_verdict(m, F.when(F.col("messages") % 97 == 0, 1).otherwise(0))


@register("cell_verdict", VERDICT_SQL)
def cell_verdict(spark, sf_dir):
    """Status and fail reasons per cell, in the fixed reason order."""
    v = verdicts(spark, sf_dir)
    return v.select(*CELL, "messages", "error", "exit_code", F.array_join("fail_reasons", "; ").alias("fail_reasons"), "status")


#: Cells taken as never run, so that the matrix has gaps to show; only the matrix leaves them out.
RUN_CELLS = "NOT (tool = 'tool_b' AND run_idx > 5)"
MATRIX_SQL = (
    f"WITH v AS (SELECT * FROM ({VERDICT_SQL}) q WHERE {RUN_CELLS}), g AS (SELECT lower(r_name) AS workload_id, CAST(unnest(range(1, (SELECT max(l_linenumber) FROM lineitem) + 1)) AS INTEGER) AS run_idx FROM region), "
    "gt AS (SELECT g.*, t.tool FROM g, (VALUES " + ", ".join(f"('{t}')" for t in TOOLS) + ") t(tool)) "
    "SELECT gt.workload_id, gt.run_idx, gt.tool, coalesce(v.status, 'skipped') AS status, "
    f"CASE WHEN v.status IS NULL THEN '{BR.SKIP_REASON}' END AS skip_reason, v.status IS NOT NULL AS has_measurements, "
    "v.messages, v.error, v.fail_reasons FROM gt LEFT JOIN v USING (workload_id, run_idx, tool)")


def matrix(spark, sf_dir):
    wl = table(spark, sf_dir, "region").select(F.lower("r_name").alias("workload_id"))
    max_run = table(spark, sf_dir, "lineitem").agg(F.max("l_linenumber")).first()[0]  # one scalar
    return BR.cell_matrix(wl, "workload_id", F.lit(int(max_run)), TOOLS, verdicts(spark, sf_dir).filter(RUN_CELLS))


@register("cell_matrix", MATRIX_SQL)
def cell_matrix(spark, sf_dir):
    """workloads × runs × tools; a missing cell becomes ``skipped`` with its reason."""
    m = matrix(spark, sf_dir)
    return m.select("workload_id", "run_idx", "tool", "status", "skip_reason", "has_measurements", "messages", "error",
                    F.array_join("fail_reasons", "; ").alias("fail_reasons"))


@register("aggregate_status",
          f"SELECT count(*) AS cells, count(*) FILTER (WHERE status = 'completed') AS completed, "
          f"count(*) FILTER (WHERE status IN ('skipped', 'dry_run', 'n_a')) AS not_run, "
          "CASE WHEN count(*) = 0 THEN 'schema_only' WHEN count(*) FILTER (WHERE status = 'completed') = count(*) THEN 'complete' "
          "WHEN count(*) FILTER (WHERE status IN ('skipped', 'dry_run', 'n_a')) = count(*) THEN 'dry_run' ELSE 'partial' END AS status "
          f"FROM ({MATRIX_SQL}) m")
def aggregate_status(spark, sf_dir):
    return BR.aggregate_status(matrix(spark, sf_dir))


@register("integrity_check",
          "SELECT count(*) FILTER (WHERE b) AS violations, min(CASE WHEN b THEN k END) AS first_offender, count(*) FILTER (WHERE b) = 0 AS ok "
          "FROM (SELECT workload_id || '/' || tool || '/' || CAST(run_idx AS VARCHAR) AS k, "
          "(status = 'completed' AND NOT has_measurements) OR (status IN ('skipped', 'n_a') AND has_measurements) AS b "
          f"FROM ({MATRIX_SQL}) m) x")
def integrity_check(spark, sf_dir):
    """completed ⇒ measurements; skipped/n_a ⇒ none; count and first offender."""
    k = F.concat_ws("/", "workload_id", "tool", F.col("run_idx").cast("string"))
    return BR.integrity(matrix(spark, sf_dir), k)


def _fmt_sql(prefix: str = "") -> str:
    def cut(x, keep, lim):
        return f"(CASE WHEN length({x}) > {lim} THEN left({x}, {keep}) || '...' ELSE {x} END)"
    err = f"(CASE WHEN coalesce({prefix}error, '') = '' THEN coalesce({prefix}fail_reasons, '') ELSE {prefix}error END)"
    return (f"CASE {prefix}status WHEN 'completed' THEN 'completed' WHEN 'skipped' THEN 'skipped (' || {cut(f'coalesce({prefix}skip_reason, chr(39)||chr(39))'.replace(chr(39)+'||'+chr(39), ''), 27, 30)} || ')' "
            f"WHEN 'dry_run' THEN 'dry_run' WHEN 'failed' THEN 'failed (' || {cut(err, 37, 40)} || ')' WHEN 'n_a' THEN 'n/a ()' ELSE {prefix}status END")


@register("report_pivot",
          f"WITH m AS ({MATRIX_SQL}), l AS (SELECT workload_id, tool, arg_min({_fmt_sql()}, run_idx) AS txt FROM m GROUP BY ALL) "
          "SELECT workload_id, " + "CASE workload_id " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in WORKLOAD_ORDER.items())
          + f" ELSE {len(WORKLOAD_ORDER)} END AS row_order, "
          + ", ".join(f"coalesce(max(txt) FILTER (WHERE tool = '{t}'), '-') AS {t}" for t in TOOLS) + " FROM l GROUP BY workload_id")
def report_pivot(spark, sf_dir):
    """workload × tool report of the last run's cell text (fixed row order, '-' when missing)."""
    m = matrix(spark, sf_dir)
    txt = BR.fmt_cell(F.col("status"), F.col("skip_reason"), F.col("error"), F.col("fail_reasons"))
    return BR.report_pivot(m, "workload_id", TOOLS, txt, WORKLOAD_ORDER)


#: A cell whose only fault is a missed rate counts as completed here: these tables' rates are far from any target.
RAN = "status = 'completed' OR (status = 'failed' AND {reasons} LIKE 'rate!_%' ESCAPE '!' AND {reasons} NOT LIKE '%; %')"


@register("throughput_pivot",
          f"WITH m AS ({MATRIX_SQL}), c AS ({MEAS_SQL}), l AS (SELECT m.workload_id, m.tool, "
          f"arg_min(CASE WHEN {RAN.format(reasons='m.fail_reasons').replace('status', 'm.status')} THEN printf('%.1f msg/s', c.achieved_msg_per_sec) ELSE '-' END, m.run_idx) AS txt "
          "FROM m LEFT JOIN c USING (workload_id, run_idx, tool) GROUP BY ALL) "
          "SELECT workload_id, " + "CASE workload_id " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in WORKLOAD_ORDER.items())
          + f" ELSE {len(WORKLOAD_ORDER)} END AS row_order, "
          + ", ".join(f"coalesce(max(txt) FILTER (WHERE tool = '{t}'), '-') AS {t}" for t in TOOLS) + " FROM l GROUP BY workload_id")
def throughput_pivot(spark, sf_dir):
    """workload × tool table of the first run's throughput, of completed cells only."""
    m = matrix(spark, sf_dir)
    m = m.withColumn("status", F.when(F.expr(RAN.format(reasons="array_join(fail_reasons, '; ')")), BR.STATUS_COMPLETED).otherwise(F.col("status")))
    txt = BR.throughput_text(F.col("status"), F.col("achieved_msg_per_sec"), F.col("messages"), F.col("bytes"))
    return BR.report_pivot(m, "workload_id", TOOLS, txt, WORKLOAD_ORDER)


#: Statuses changed after the runs: every third run called completed, of the others every fifth skipped.
MIXED = "CASE WHEN run_idx % 3 = 0 THEN 'completed' WHEN run_idx % 5 = 0 THEN 'skipped' ELSE status END"


@register("integrity_violations",
          "SELECT count(*) FILTER (WHERE b) AS violations, min(CASE WHEN b THEN k END) AS first_offender, count(*) FILTER (WHERE b) = 0 AS ok "
          "FROM (SELECT workload_id || '/' || tool || '/' || CAST(run_idx AS VARCHAR) AS k, "
          "(mixed = 'completed' AND NOT has_measurements) OR (mixed IN ('skipped', 'n_a') AND has_measurements) AS b "
          f"FROM (SELECT *, {MIXED} AS mixed FROM ({MATRIX_SQL}) m)) x")
def integrity_violations(spark, sf_dir):
    """The integrity check over a matrix whose statuses were changed after the runs."""
    k = F.concat_ws("/", "workload_id", "tool", F.col("run_idx").cast("string"))
    return BR.integrity(matrix(spark, sf_dir).withColumn("status", F.expr(MIXED)), k)


@register("cv_by_cell",
          f"SELECT workload_id, tool, count(*) AS runs, round(stddev_samp(achieved_msg_per_sec) / avg(achieved_msg_per_sec) * 100.0, 9) AS cv_pct "
          f"FROM ({MEAS_SQL}) m WHERE messages > 0 GROUP BY workload_id, tool")
def cv_by_cell(spark, sf_dir):
    """Run-to-run variation (cv % = stddev / mean · 100) of the achieved rate per workload and tool."""
    m = measures(spark, sf_dir).filter("messages > 0")
    return m.groupBy("workload_id", "tool").agg(F.count(F.lit(1)).alias("runs"),
                                                F.round(F.stddev_samp("achieved_msg_per_sec") / F.avg("achieved_msg_per_sec") * 100.0, 9).alias("cv_pct"))


@register("achieved_vs_target",
          f"SELECT m.workload_id, round(avg(achieved_msg_per_sec), 9) AS achieved, w.target_msg_per_sec AS target FROM ({MEAS_SQL}) m "
          f"JOIN (SELECT {', '.join(WL_EXPRS)} FROM region) w USING (workload_id) GROUP BY m.workload_id, w.target_msg_per_sec")
def achieved_vs_target(spark, sf_dir):
    """Mean achieved rate per workload next to its target (dimension lookup, broadcast)."""
    wl = table(spark, sf_dir, "region").selectExpr(*WL_EXPRS)
    m = measures(spark, sf_dir).groupBy("workload_id").agg(F.round(F.avg("achieved_msg_per_sec"), 9).alias("achieved"))
    return m.join(F.broadcast(wl), "workload_id", "inner").select("workload_id", "achieved",
                                                                  F.col("target_msg_per_sec").alias("target"))


TOP_N = 20


@register("top_improvements",
          f"WITH c AS ({COMPARE_SQL}), i AS (SELECT label, delta_pct, row_number() OVER (ORDER BY label) AS rnk "
          "FROM c WHERE verdict = 'IMPROVE') "
          f"SELECT rnk, label, delta_pct, CAST(NULL AS VARCHAR) AS note FROM i WHERE rnk <= {TOP_N} UNION ALL "
          f"SELECT CAST({TOP_N + 1} AS BIGINT), CAST(NULL AS VARCHAR), CAST(NULL AS DOUBLE), "
          f"'... and ' || CAST(count(*) - {TOP_N} AS VARCHAR) || ' more' FROM i HAVING count(*) > {TOP_N}")
def top_improvements(spark, sf_dir):
    """The first 20 improvements in label order (a top-k report) and an '… and N more' line."""
    imp = _compare(spark, sf_dir).filter(F.col("verdict") == "IMPROVE").select("label", "delta_pct")
    top = imp.orderBy("label").limit(TOP_N)
    from pyspark.sql import Window
    top = top.withColumn("rnk", F.row_number().over(Window.orderBy("label")).cast("bigint"))
    more = imp.agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > TOP_N).select(
        F.lit(TOP_N + 1).cast("bigint").alias("rnk"), F.lit(None).cast("string").alias("label"),
        F.lit(None).cast("double").alias("delta_pct"),
        F.concat(F.lit("... and "), (F.col("n") - TOP_N).cast("string"), F.lit(" more")).alias("note"))
    return top.withColumn("note", F.lit(None).cast("string")).select("rnk", "label", "delta_pct", "note").unionByName(more)
