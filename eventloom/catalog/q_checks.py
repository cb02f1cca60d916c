"""Rule checks: the profile model (profiles, targets, phases built from nation, supplier and
part) and ordinary tables (lineitem, orders), all through one check operator."""

from __future__ import annotations

from pyspark.sql import functions as F

import uuid

from eventloom.catalog import register, table
from eventloom.operators.checks import (ENTRY_RULES, PHASE_RULES, PROFILE_RULES, TARGET_RULES, Rule, check, numbered_report,
                                        sql_check)
from eventloom.plans.session import ensure_checkpoint_dir
from eventloom.sources import scans

# Stand-in profile rows: each expression is valid in Spark SQL and DuckDB alike.
TARGET_EXPRS = [
    "s_nationkey AS profile_id", "s_suppkey AS idx",
    "CASE WHEN s_suppkey % 13 = 0 THEN '  ' ELSE s_name END AS address",
    "CASE s_suppkey % 6 WHEN 0 THEN 'tcp' WHEN 1 THEN 'udp' WHEN 2 THEN 'tls' WHEN 3 THEN 'file' WHEN 4 THEN 'kafka' ELSE 'http' END AS transport",
    "CASE s_suppkey % 5 WHEN 0 THEN 'non-transparent' WHEN 1 THEN 'octet-counting' WHEN 2 THEN 'octet' WHEN 3 THEN 'octet_counting' ELSE 'lf' END AS framing",
    "CAST(s_suppkey % 4 AS INT) AS connections", "CAST(s_suppkey % 3 AS INT) AS weight",
    "CASE s_suppkey % 4 WHEN 0 THEN '1.2' WHEN 1 THEN '1.3' WHEN 2 THEN '1.1' ELSE NULL END AS tls_min_protocol_version",
    "s_suppkey % 11 = 0 AS tls_insecure",
    "CAST(s_suppkey % 5 AS BIGINT) AS file_rotation_size_mb",
    "CAST(CASE WHEN s_suppkey % 2 = 0 THEN NULL ELSE s_suppkey % 3 END AS BIGINT) AS file_rotation_interval_secs",
    "CAST(s_suppkey % 7 AS INT) AS file_rotation_max_files",
    "CAST((s_suppkey % 7) * 100 AS BIGINT) AS reconnect_initial_backoff_ms",
    "CAST((s_suppkey % 5) * 100 AS BIGINT) AS reconnect_max_backoff_ms",
    "round(s_acctbal / 1000.0, 3) AS reconnect_multiplier",
    "CASE WHEN s_suppkey % 2 = 0 THEN '' ELSE 'logs' END AS kafka_topic",
    "CASE s_suppkey % 6 WHEN 0 THEN 'gzip' WHEN 1 THEN 'brotli' WHEN 2 THEN ' ZSTD ' WHEN 3 THEN 'No' WHEN 4 THEN '' ELSE NULL END AS kafka_compression",
    "CASE s_suppkey % 5 WHEN 0 THEN '0' WHEN 1 THEN ' all ' WHEN 2 THEN '2' ELSE '1' END AS kafka_acks",
]
PHASE_EXPRS = [
    "p_partkey % 25 AS profile_id", "p_partkey AS idx",
    "CASE WHEN p_size % 10 = 0 THEN ' ' ELSE p_name END AS name",
    "CASE p_partkey % 8 WHEN 0 THEN 'rfc5424' WHEN 1 THEN 'rfc3164' WHEN 2 THEN 'raw' WHEN 3 THEN 'protobuf' "
    "WHEN 4 THEN 'cef' WHEN 5 THEN 'leef' WHEN 6 THEN 'json_lines' ELSE 'xml' END AS format",
    "CAST(p_size % 4 AS INT) AS n_templates",
    "CASE WHEN p_partkey % 3 = 0 THEN 'templates.txt' END AS templates_file",
    "CAST(NULL AS STRING) AS schema_file",
    "CAST(p_size % 5 AS BIGINT) AS duration_secs",
    "CASE WHEN p_partkey % 2 = 0 THEN CAST(p_size * 10 AS BIGINT) END AS total_messages",
    "CASE WHEN p_partkey % 5 = 0 THEN CAST(p_size % 3 AS INT) END AS n_template_weights",
    "CASE WHEN p_partkey % 7 = 0 THEN round(p_retailprice - 1500.0, 2) END AS min_template_weight",
    "CASE WHEN p_partkey % 9 = 0 THEN CAST(p_size % 3 AS INT) END AS pad_to_bytes",
    "CAST(p_size AS INT) AS facility", "CAST(p_partkey % 10 AS INT) AS severity",
    "CASE WHEN p_partkey % 4 = 0 THEN NULL WHEN p_partkey % 4 = 1 THEN '' ELSE p_brand END AS cef_vendor",
    "CAST(p_size % 12 AS INT) AS cef_severity",
    "CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_type END AS leef_vendor",
    "round(p_retailprice - 1000.0, 2) AS shape_rate",
    "CAST(p_size % 6 AS DOUBLE) AS shape_period",
    "CAST(p_size % 4 AS DOUBLE) - 1.0 AS burst_multiplier",
    "CAST(p_size % 3 AS DOUBLE) AS drip_divisor",
    "CAST(p_size * 3 AS DOUBLE) AS loss_percent",
]
PROFILE_EXPRS = [
    "n_nationkey AS profile_id",
    "CASE n_nationkey % 4 WHEN 0 THEN 'round-robin' WHEN 1 THEN 'broadcast' WHEN 2 THEN 'weighted' ELSE 'random' END AS distribution",
    "CASE n_nationkey % 3 WHEN 0 THEN 'drain' WHEN 1 THEN 'immediate' ELSE 'later' END AS shutdown_mode",
]


def _duck(exprs):
    return [e.replace("AS STRING", "AS VARCHAR") for e in exprs]


T_SQL = f"SELECT {', '.join(_duck(TARGET_EXPRS))} FROM supplier"
P_SQL = f"SELECT {', '.join(_duck(PHASE_EXPRS))} FROM part"
PR_SQL = (f"SELECT p.*, coalesce(t.n_targets, 0) AS n_targets, t.max_weight, coalesce(ph.n_phases, 0) AS n_phases "
          f"FROM (SELECT {', '.join(PROFILE_EXPRS)} FROM nation) p "
          f"LEFT JOIN (SELECT profile_id, count(*) AS n_targets, max(weight) AS max_weight FROM ({T_SQL}) x GROUP BY profile_id) t USING (profile_id) "
          f"LEFT JOIN (SELECT profile_id, count(*) AS n_phases FROM ({P_SQL}) y GROUP BY profile_id) ph USING (profile_id)")

IDX = "CAST(profile_id AS VARCHAR) || ':' || CAST(idx AS VARCHAR)"


def profile_tables(spark, sf_dir):
    targets = table(spark, sf_dir, "supplier").selectExpr(*TARGET_EXPRS)
    phases = table(spark, sf_dir, "part").selectExpr(*PHASE_EXPRS)
    tcount = targets.groupBy("profile_id").agg(F.count(F.lit(1)).alias("n_targets"), F.max("weight").alias("max_weight"))
    pcount = phases.groupBy("profile_id").agg(F.count(F.lit(1)).alias("n_phases"))
    profiles = (table(spark, sf_dir, "nation").selectExpr(*PROFILE_EXPRS)
                .join(tcount, "profile_id", "left").join(pcount, "profile_id", "left")
                .fillna({"n_targets": 0, "n_phases": 0}))
    return profiles, targets, phases


def profile_violations(spark, sf_dir):
    profiles, targets, phases = profile_tables(spark, sf_dir)
    idx = F.concat_ws(":", F.col("profile_id").cast("string"), F.col("idx").cast("string"))
    return (check(profiles, "profile", "profile_id", PROFILE_RULES)
            .unionByName(check(targets, "target", idx, TARGET_RULES))
            .unionByName(check(phases, "phase", idx, PHASE_RULES)))


PROFILE_CHECKS_SQL = " UNION ALL ".join([
    sql_check(PR_SQL, "profile", "profile_id", PROFILE_RULES),
    sql_check(T_SQL, "target", IDX, TARGET_RULES),
    sql_check(P_SQL, "phase", IDX, PHASE_RULES)])


@register("profile_checks", PROFILE_CHECKS_SQL)
def profile_checks(spark, sf_dir):
    """Every rule violation at profile, target and phase level (collect-all)."""
    return profile_violations(spark, sf_dir)


@register("profile_report",
          "SELECT profile, string_agg(line, chr(10) ORDER BY n) AS report, count(*) AS errors FROM ("
          "SELECT profile, n, CAST(n AS VARCHAR) || '. ' || subject || '[' || index || ']: ' || rule || "
          "CASE WHEN value IS NOT NULL THEN ' (' || value || ')' ELSE '' END AS line FROM ("
          "SELECT *, split_part(index, ':', 1) AS profile, row_number() OVER (PARTITION BY split_part(index, ':', 1) "
          f"ORDER BY subject, index, rule) AS n FROM ({PROFILE_CHECKS_SQL}) v) x) y GROUP BY profile")
def profile_report(spark, sf_dir):
    """Numbered error list per profile."""
    v = profile_violations(spark, sf_dir).withColumn("profile", F.split_part(F.col("index"), F.lit(":"), F.lit(1)))
    return numbered_report(v, "profile", ["subject", "index", "rule"])


# ---- profiles with nested entries, one JSON line for each part ---------------------------------
_NAN = "CAST('NaN' AS DOUBLE)"
#: Entries of each profile: (path, kind, field, number, text), each expression valid in Spark SQL and DuckDB alike.
ENTRIES = [
    ("targets[1].tls_cipher_suites[0]", "cipher", None, None, "CASE WHEN p_size % 2 = 0 THEN 'TLS_AES_256_GCM_SHA384' ELSE 'TLS_RC4' END"),
    ("targets[1].tls_cipher_suites[1]", "cipher", None, None, "'TLS_AES_128_GCM_SHA256'"),
    ("targets[1].tls_cipher_suites[2]", "cipher", None, None, "CASE WHEN p_size % 3 = 0 THEN 'tls_aes_128_gcm_sha256' ELSE 'TLS_CHACHA20_POLY1305_SHA256' END"),
    ("phases[0].template_weights[0]", "weight", None, "1.0", None),
    ("phases[0].template_weights[1]", "weight", None, "CAST(p_size % 4 AS DOUBLE) - 2.0", None),
    ("phases[0].template_weights[2]", "weight", None, f"CASE WHEN p_size % 7 = 0 THEN {_NAN} ELSE 0.5 END", None),
    *[(f"phases[0].cef.{f}", "cef", f, None, f"CASE WHEN p_size % {k} = 0 THEN ' ' ELSE p_brand END")
      for f, k in (("device_vendor", 3), ("device_product", 4), ("device_version", 5), ("signature_id", 6), ("name", 7))],
    ("phases[0].load_shape.min_rate", "shape_rate", "min_rate", "CAST(p_size AS DOUBLE) - 20.0", None),
    ("phases[0].load_shape.max_rate", "shape_rate", "max_rate", f"CASE WHEN p_size % 5 = 0 THEN {_NAN} ELSE 9.0 END", None),
    ("phases[0].load_shape.period_secs", "shape_period", "period_secs", "CAST(p_size % 3 AS DOUBLE)", None),
    *[(f"phases[0].anomalies[{k}].{f}", "burst-injection", f, e, None) for k in (0, 2) for f, e in (
        ("rate_multiplier", f"CAST((p_size + {k}) % 4 AS DOUBLE) - 1.0"), ("interval_secs", f"CAST((p_size + {k}) % 3 AS DOUBLE)"),
        ("duration_secs", f"CASE WHEN p_size % {k + 2} = 0 THEN CAST('inf' AS DOUBLE) ELSE CAST((p_size + {k}) % 5 AS DOUBLE) - 1.0 END"))],
    ("phases[0].anomalies[1].rate_divisor", "slow-drip", "rate_divisor", "CAST(p_size % 4 AS DOUBLE)", None),
    ("phases[0].anomalies[1].duration_secs", "slow-drip", "duration_secs", "CAST(p_size % 2 AS DOUBLE)", None),
    ("phases[0].anomalies[3].loss_percent", "packet-loss", "loss_percent", "CAST(p_size * 4 AS DOUBLE) - 10.0", None),
    *[(f"phases[1].leef.{f}", "leef", f, None, f"CASE WHEN p_size % {k} = 1 THEN '' ELSE p_type END")
      for f, k in (("vendor", 3), ("product", 4), ("version", 5), ("event_id", 6))],
    *[(f"phases[1].load_shape.{f}", kind, f, f"CAST((p_size + {k}) % 6 AS DOUBLE) - 2.0", None)
      for k, (f, kind) in enumerate((("base_rate", "shape_rate"), ("burst_rate", "shape_rate"), ("burst_secs", "shape_rate"), ("every_secs", "shape_period")))],
]
ENTRY_SQL = " UNION ALL ".join(
    f"SELECT p_partkey AS profile_id, '{path}' AS path, '{kind}' AS kind, {f"'{f}'" if f else 'NULL'} AS field, "
    f"{f'CAST({n} AS DOUBLE)' if n else 'CAST(NULL AS DOUBLE)'} AS number, {t or 'NULL'} AS text FROM part" for path, kind, f, n, t in ENTRIES)


def _profile_json():
    """One profile as a JSON column of part, built from the entries' paths."""
    e = {path: F.expr(n or t) for path, _, _, n, t in ENTRIES}

    def block(prefix, **more):
        fields = [c.alias(path[len(prefix) + 1:]) for path, c in e.items() if path.startswith(prefix + ".")]
        return F.struct(*[F.lit(v).alias(k) for k, v in more.items()], *fields)

    def listed(prefix):
        return F.array(*[e[f"{prefix}[{k}]"] for k in range(3)])
    anomalies = F.array(*[F.to_json(block(f"phases[0].anomalies[{k}]", type=kind))
                          for k, kind in enumerate(("burst-injection", "slow-drip", "burst-injection", "packet-loss"))])
    first = F.struct(F.lit("a").alias("name"), F.lit("cef").alias("format"), F.array(*[F.lit(x) for x in "xyz"]).alias("templates"), F.lit(5).alias("duration_secs"),
                     listed("phases[0].template_weights").alias("template_weights"), block("phases[0].cef").alias("cef"),
                     block("phases[0].load_shape", type="sine").alias("load_shape"))
    second = F.struct(F.lit("b").alias("name"), F.lit("leef").alias("format"), F.array(F.lit("x")).alias("templates"), F.lit(5).alias("duration_secs"),
                      block("phases[1].leef").alias("leef"), block("phases[1].load_shape", type="burst").alias("load_shape"))
    targets = F.array(F.struct(F.lit("h:1").alias("address"), F.lit(None).cast("array<string>").alias("tls_cipher_suites")),
                      F.struct(F.lit("h:2").alias("address"), listed("targets[1].tls_cipher_suites").alias("tls_cipher_suites")))
    # the anomalies have unlike fields, so they are objects of their own
    head = F.to_json(first)
    head = F.concat(F.regexp_replace(head, r"\}$", ""), F.lit(',"anomalies":['), F.array_join(anomalies, ","), F.lit("]}"))
    return F.concat(F.lit('{"profile_id":"'), F.col("p_partkey").cast("string"), F.lit('","targets":'), F.to_json(targets), F.lit(',"phases":['), head, F.lit(","),
                    F.to_json(second), F.lit("]}"))


@register("profile_entries", sql_check(ENTRY_SQL, "entry", "CAST(profile_id AS VARCHAR) || ':' || path", ENTRY_RULES))
def profile_entries(spark, sf_dir):
    """Profiles written as JSON lines, read with their defaults and checked entry by entry: several offenders in
    one phase, NaN among them, are each reported (no rule on whole targets or phases is broken)."""
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/profiles/{uuid.uuid4().hex}"
    table(spark, sf_dir, "part").select(_profile_json().alias("json")).write.text(folder)
    return scans.profile_violations(scans.read_profiles(spark, folder, lines=True))


# ---- fixed table rules ------------------------------------------------------------------------
LINEITEM_RULES = [
    Rule("quantity_out_of_range", "l_quantity <= 0 OR l_quantity > 50", "l_quantity"),
    Rule("discount_out_of_range", "l_discount < 0 OR l_discount > 0.1", "l_discount"),
    Rule("tax_negative", "l_tax < 0", "l_tax"),
    Rule("price_not_positive", "l_extendedprice <= 0", "l_extendedprice"),
    Rule("bad_returnflag", "l_returnflag NOT IN ('A', 'N', 'R')", "l_returnflag"),
    Rule("bad_linestatus", "l_linestatus NOT IN ('O', 'F')", "l_linestatus"),
    Rule("missing_shipdate", "l_shipdate IS NULL", "l_shipdate"),
    Rule("linenumber_out_of_range", "l_linenumber < 1 OR l_linenumber > 7", "l_linenumber"),
]
ORDERS_RULES = [
    Rule("price_not_positive", "o_totalprice <= 0", "o_totalprice"),
    Rule("bad_status", "o_orderstatus NOT IN ('F', 'O', 'P')", "o_orderstatus"),
    Rule("bad_priority", "substr(o_orderpriority, 2, 1) <> '-'", "o_orderpriority"),
    Rule("missing_date", "o_orderdate IS NULL", "o_orderkey"),
    Rule("price_over_500k", "o_totalprice > 500000", "o_totalprice"),
]


@register("table_checks",
          sql_check("SELECT * FROM lineitem", "lineitem", "CAST(l_orderkey AS VARCHAR) || ':' || CAST(l_linenumber AS VARCHAR)",
                    LINEITEM_RULES) + " UNION ALL " + sql_check("SELECT * FROM orders", "orders", "o_orderkey", ORDERS_RULES))
def table_checks(spark, sf_dir):
    """The same collect-all check operator over lineitem and orders."""
    li = table(spark, sf_dir, "lineitem")
    o = table(spark, sf_dir, "orders")
    idx = F.concat_ws(":", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))
    return check(li, "lineitem", idx, LINEITEM_RULES).unionByName(check(o, "orders", "o_orderkey", ORDERS_RULES))


#: Narrower limits, which many rows of the tables break.
STRICT_LINE_RULES = [
    Rule("large_quantity", "l_quantity > 45", "l_quantity"),
    Rule("high_discount", "l_discount > 0.08", "l_discount"),
    Rule("late_return", "l_returnflag = 'R' AND l_shipdate >= '1998-01-01'", "l_shipdate IS NULL"),
]
STRICT_ORDER_RULES = [
    Rule("price_over_300k", "o_totalprice > 300000", "o_orderstatus"),
    Rule("unranked_priority", "substr(o_orderpriority, 3) = 'NOT SPECIFIED'", "o_orderpriority"),
]


@register("table_violations",
          sql_check("SELECT * FROM lineitem", "lineitem", "CAST(l_orderkey AS VARCHAR) || ':' || CAST(l_linenumber AS VARCHAR)", STRICT_LINE_RULES)
          + " UNION ALL " + sql_check("SELECT * FROM orders", "orders", "o_orderkey", STRICT_ORDER_RULES))
def table_violations(spark, sf_dir):
    """Every row of lineitem and orders that breaks narrower limits, one result row for each broken rule."""
    idx = F.concat_ws(":", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))
    return check(table(spark, sf_dir, "lineitem"), "lineitem", idx, STRICT_LINE_RULES) \
        .unionByName(check(table(spark, sf_dir, "orders"), "orders", "o_orderkey", STRICT_ORDER_RULES))


# ---------------------------------------------------------------- workload spec agreement
# ---- fixed values: the four benchmark workload specs and the length tolerance ----------------
WORKLOAD_SPECS = [
    ("udp_100rps_256b", "udp", 100, 256, "datagram"),
    ("tcp_10krps_1kb", "tcp", 10000, 1024, "octet-counting"),
    ("tls_5krps_1kb", "tls", 5000, 1024, "octet-counting"),
    ("kafka_50krps_256b", "kafka", 50000, 256, "kafka-protocol"),
]
TEMPLATE_SIZE_TOLERANCE = 2
HEADER_OVERHEAD = 60
# -----------------------------------------------------------------------------------------------

WORKLOAD_EXPRS = [
    "page_id AS idx",
    "CASE page_id % 4 WHEN 0 THEN 'udp_100rps_256b' WHEN 1 THEN 'tcp_10krps_1kb' WHEN 2 THEN 'tls_5krps_1kb' "
    "ELSE 'kafka_50krps_256b' END AS workload_id",
    "html AS template",
    f"CAST({HEADER_OVERHEAD} AS INT) AS header_overhead_bytes",
    "CAST(page_id % 3 AS INT) * 60 AS duration_secs",
    "page_id % 7 = 0 AS swap_transport", "page_id % 5 = 0 AS double_rate", "page_id % 6 = 0 AS lf_framing",
    "page_id % 10 = 3 AS no_topic",
]
WORKLOAD_RULES = [
    Rule("transport_mismatch", "cfg_transport <> transport", "cfg_transport"),
    Rule("rate_mismatch", "cfg_rate <> rate", "cfg_rate"),
    Rule("framing_mismatch", "cfg_framing <> framing", "cfg_framing"),
    Rule("duration_not_positive", "duration_secs <= 0", "duration_secs"),
    Rule("target_framing_not_octet", "transport IN ('tcp', 'tls') AND cfg_framing <> 'octet-counting'", "cfg_framing"),
    Rule("topic_missing", "transport = 'kafka' AND coalesce(topic, '') = ''", "topic"),
    Rule("template_length", f"abs(length(template) - (size - header_overhead_bytes)) > {TEMPLATE_SIZE_TOLERANCE}",
         "length(template)"),
]
_CFG_EXPRS = [
    "idx", "workload_id", "template", "header_overhead_bytes", "duration_secs", "transport", "rate", "size", "framing",
    "CASE WHEN swap_transport THEN 'udp' ELSE transport END AS cfg_transport",
    "CASE WHEN double_rate THEN rate * 2 ELSE rate END AS cfg_rate",
    "CASE WHEN lf_framing THEN 'lf' ELSE framing END AS cfg_framing",
    "CASE WHEN no_topic THEN '' ELSE 'logs' END AS topic",
]
_SPEC_SQL = "(VALUES " + ", ".join(f"('{w}', '{t}', {r}, {s}, '{f}')" for w, t, r, s, f in WORKLOAD_SPECS) + \
    ") spec(workload_id, transport, rate, size, framing)"
WORKLOAD_SQL = (f"SELECT {', '.join(_CFG_EXPRS)} FROM (SELECT {', '.join(_duck(WORKLOAD_EXPRS))} FROM pages) c "
                f"JOIN {_SPEC_SQL} USING (workload_id)")


@register("workload_checks", sql_check(WORKLOAD_SQL, "workload", "idx", WORKLOAD_RULES))
def workload_checks(spark, sf_dir):
    """Benchmark workload configs (one per page; the page body is the template) checked
    against the fixed workload specs: transport, rate, framing, duration, topic and
    template length within ±2 of size − header."""
    spec = spark.createDataFrame(WORKLOAD_SPECS, "workload_id string, transport string, rate int, size int, framing string")
    cfg = table(spark, sf_dir, "pages").selectExpr(*WORKLOAD_EXPRS).join(F.broadcast(spec), "workload_id", "inner") \
        .selectExpr(*_CFG_EXPRS)
    return check(cfg, "workload", "idx", WORKLOAD_RULES)
