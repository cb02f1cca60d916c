"""Rule-based table checks that report every violation (collect-all, not first-error).

A rule is ``(name, violated_when, value)``: a boolean Column (or SQL text) that is true
when the row breaks the rule, and the offending value to report. :func:`check` evaluates
all rules of a level in one projection — an array of optional structs, compacted and
exploded — so it is one pass over the table with no shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

# ---- fixed values: allowed settings (as in the reference's validator) ------------------
VALID_TRANSPORTS = ["tcp", "udp", "tls", "file", "kafka"]
VALID_FORMATS = ["rfc5424", "rfc3164", "raw", "protobuf", "cef", "leef", "json_lines"]
VALID_DISTRIBUTIONS = ["round-robin", "broadcast", "weighted"]
VALID_FRAMINGS = ["non-transparent", "octet-counting", "octet_counting", "octet"]
VALID_SHUTDOWN_MODES = ["drain", "immediate"]
VALID_TLS_VERSIONS = ["1.2", "1.3"]
VALID_TOPIC_COMPRESSIONS = ["", "no", "none", "gzip", "lz4", "snappy", "zstd"]
VALID_TOPIC_ACKS = ["0", "1", "all"]
VALID_CIPHER_SUITES = ["TLS_AES_256_GCM_SHA384", "TLS_AES_128_GCM_SHA256", "TLS_CHACHA20_POLY1305_SHA256", "TLS_ECDHE_ECDSA_WITH_AES_256_GCM_SHA384",
                       "TLS_ECDHE_ECDSA_WITH_AES_128_GCM_SHA256", "TLS_ECDHE_RSA_WITH_AES_256_GCM_SHA384",
                       "TLS_ECDHE_RSA_WITH_AES_128_GCM_SHA256", "TLS_ECDHE_RSA_WITH_CHACHA20_POLY1305_SHA256"]
MAX_FACILITY = 23
MAX_SEVERITY = 7
MAX_CEF_SEVERITY = 10
# ------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Rule:
    name: str
    violated: str          # SQL boolean expression over the table's columns
    value: str = "NULL"    # SQL expression reported as the offending value (cast to string)

    def cond(self) -> Column:
        return F.coalesce(F.expr(self.violated), F.lit(False))

    def val(self) -> Column:
        return F.expr(self.value).cast("string")


def check(df: DataFrame, subject: str, index: str | Column, rules: Sequence[Rule]) -> DataFrame:
    """All violations of ``rules``: rows (subject, index, rule, value)."""
    idx = F.col(index) if isinstance(index, str) else index
    cands = [F.when(r.cond(), F.struct(F.lit(r.name).alias("rule"), r.val().alias("value"))) for r in rules]
    hits = F.filter(F.array(*cands), lambda x: x.isNotNull())
    return (df.select(idx.cast("string").alias("index"), F.explode(hits).alias("_v"))
              .select(F.lit(subject).alias("subject"), "index", "_v.rule", "_v.value"))


def passes(violations: DataFrame) -> DataFrame:
    """One row: ``ok`` is true when there is no violation, plus the violation count."""
    return violations.agg(F.count(F.lit(1)).alias("violations")).withColumn("ok", F.col("violations") == 0)


def numbered_report(violations: DataFrame, group: str, order: Sequence[str]) -> DataFrame:
    """Numbered error text per ``group``: ``1. rule (value)`` lines joined by LF.

    Numbers come from a window over one group's violations; the text joins those lines
    in number order (bounded by the number of rules × items of a profile).
    """
    w = Window.partitionBy(group).orderBy(*order)
    n = violations.withColumn("_n", F.row_number().over(w))
    line = F.concat(F.col("_n").cast("string"), F.lit(". "), F.col("subject"), F.lit("["), F.col("index"),
                    F.lit("]: "), F.col("rule"), F.when(F.col("value").isNotNull(),
                                                          F.concat(F.lit(" ("), F.col("value"), F.lit(")"))).otherwise(F.lit("")))
    lines = F.array_sort(F.collect_list(F.struct(F.col("_n"), line.alias("line"))))
    return n.groupBy(group).agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("report"),
                                F.count(F.lit(1)).alias("errors"))


def sql_check(table_sql: str, subject: str, index_sql: str, rules: Sequence[Rule]) -> str:
    """DuckDB mirror (oracle): one SELECT per rule, UNION ALL."""
    parts = [f"SELECT '{subject}' AS subject, CAST({index_sql} AS VARCHAR) AS index, '{r.name}' AS rule, "
             f"CAST({r.value} AS VARCHAR) AS value FROM ({table_sql}) t WHERE coalesce({r.violated}, FALSE)"
             for r in rules]
    return " UNION ALL ".join(parts)


def _in(values: Sequence[str]) -> str:
    return "(" + ", ".join("'" + v + "'" for v in values) + ")"


# ---------------------------------------------------------------- rule sets (profile model)

PROFILE_RULES = [
    Rule("invalid_distribution", f"distribution NOT IN {_in(VALID_DISTRIBUTIONS)}", "distribution"),
    Rule("invalid_shutdown_mode", f"shutdown_mode NOT IN {_in(VALID_SHUTDOWN_MODES)}", "shutdown_mode"),
    Rule("weighted_all_zero", "distribution = 'weighted' AND n_targets > 0 AND max_weight = 0", "max_weight"),
    Rule("no_phases", "n_phases = 0", "n_phases"),
]

TARGET_RULES = [
    Rule("empty_address", "trim(address) = ''", "address"),
    Rule("invalid_transport", f"transport NOT IN {_in(VALID_TRANSPORTS)}", "transport"),
    Rule("invalid_framing", f"framing NOT IN {_in(VALID_FRAMINGS)}", "framing"),
    Rule("zero_connections", "connections = 0", "connections"),
    Rule("invalid_tls_min_version", f"tls_min_protocol_version IS NOT NULL AND tls_min_protocol_version NOT IN {_in(VALID_TLS_VERSIONS)}",
         "tls_min_protocol_version"),
    Rule("tls_insecure_enabled", "tls_insecure", "tls_insecure"),
    Rule("zero_rotation_size", "transport = 'file' AND file_rotation_size_mb = 0", "file_rotation_size_mb"),
    Rule("zero_rotation_interval", "transport = 'file' AND file_rotation_interval_secs = 0", "file_rotation_interval_secs"),
    Rule("zero_rotation_max_files", "transport = 'file' AND (file_rotation_size_mb IS NOT NULL OR file_rotation_interval_secs IS NOT NULL) "
         "AND file_rotation_max_files = 0", "file_rotation_max_files"),
    Rule("zero_initial_backoff", "reconnect_initial_backoff_ms = 0", "reconnect_initial_backoff_ms"),
    Rule("invalid_backoff_multiplier", "reconnect_multiplier IS NOT NULL AND (isnan(reconnect_multiplier) OR "
         "reconnect_multiplier < 1.0 OR reconnect_multiplier = CAST('inf' AS DOUBLE))", "reconnect_multiplier"),
    Rule("backoff_max_below_initial", "reconnect_max_backoff_ms < reconnect_initial_backoff_ms", "reconnect_max_backoff_ms"),
    Rule("topic_required", "transport = 'kafka' AND coalesce(kafka_topic, '') = ''", "kafka_topic"),
    Rule("invalid_topic_compression", f"transport = 'kafka' AND kafka_compression IS NOT NULL AND lower(trim(kafka_compression)) NOT IN {_in(VALID_TOPIC_COMPRESSIONS)}",
         "kafka_compression"),
    Rule("invalid_topic_acks", f"transport = 'kafka' AND kafka_acks IS NOT NULL AND trim(kafka_acks) NOT IN {_in(VALID_TOPIC_ACKS)}",
         "kafka_acks"),
]

PHASE_RULES = [
    Rule("empty_phase_name", "trim(name) = ''", "name"),
    Rule("invalid_format", f"format NOT IN {_in(VALID_FORMATS)}", "format"),
    Rule("no_content_source", "n_templates = 0 AND templates_file IS NULL AND schema_file IS NULL", "n_templates"),
    Rule("unbounded_phase", "duration_secs = 0 AND total_messages IS NULL", "duration_secs"),
    Rule("template_weights_mismatch", "n_template_weights IS NOT NULL AND n_template_weights <> n_templates", "n_template_weights"),
    Rule("invalid_template_weight", "min_template_weight IS NOT NULL AND (isnan(min_template_weight) OR min_template_weight < 0)",
         "min_template_weight"),
    Rule("zero_padding", "pad_to_bytes = 0", "pad_to_bytes"),
    Rule("facility_out_of_range", f"format IN ('rfc5424', 'rfc3164') AND facility > {MAX_FACILITY}", "facility"),
    Rule("severity_out_of_range", f"format IN ('rfc5424', 'rfc3164') AND severity > {MAX_SEVERITY}", "severity"),
    Rule("cef_block_missing", "format = 'cef' AND cef_vendor IS NULL", "format"),
    Rule("cef_vendor_blank", "format = 'cef' AND trim(cef_vendor) = ''", "cef_vendor"),
    Rule("cef_severity_out_of_range", f"format = 'cef' AND cef_severity > {MAX_CEF_SEVERITY}", "cef_severity"),
    Rule("leef_block_missing", "format = 'leef' AND leef_vendor IS NULL", "format"),
    Rule("leef_vendor_blank", "format = 'leef' AND trim(leef_vendor) = ''", "leef_vendor"),
    Rule("invalid_shape_rate", "shape_rate IS NOT NULL AND (isnan(shape_rate) OR shape_rate < 0)", "shape_rate"),
    Rule("invalid_shape_period", "shape_period IS NOT NULL AND (isnan(shape_period) OR shape_period <= 0)", "shape_period"),
    Rule("invalid_burst_multiplier", "burst_multiplier IS NOT NULL AND (isnan(burst_multiplier) OR burst_multiplier <= 0)",
         "burst_multiplier"),
    Rule("invalid_drip_divisor", "drip_divisor IS NOT NULL AND (isnan(drip_divisor) OR drip_divisor <= 1)", "drip_divisor"),
    Rule("invalid_loss_percent", "loss_percent IS NOT NULL AND (isnan(loss_percent) OR loss_percent < 0 OR loss_percent > 100)",
         "loss_percent"),
]


def _not_finite_or(bound: str) -> str:
    return f"(isnan(number) OR number IN (CAST('inf' AS DOUBLE), CAST('-inf' AS DOUBLE)) OR {bound})"


def _blank(column: str) -> str:
    """Nothing but white space, or NULL (both dialects trim spaces only)."""
    return f"translate(coalesce({column}, ''), ' \t\n\r\f\x0b', '') = ''"


_NUMBER = ("CASE WHEN isnan(number) THEN 'NaN' WHEN number = CAST('inf' AS DOUBLE) THEN 'inf' WHEN number = CAST('-inf' AS DOUBLE) THEN '-inf' "
           "ELSE CAST(number AS STRING) END")
#: Rules on single entries of a profile's nested arrays and blocks (one row an entry: kind, field, number, text).
ENTRY_RULES = [
    Rule("invalid_cipher_suite", f"kind = 'cipher' AND text NOT IN {_in(VALID_CIPHER_SUITES)}", "text"),
    Rule("invalid_template_weight", "kind = 'weight' AND (isnan(number) OR number < 0)", _NUMBER),
    Rule("cef_field_blank", f"kind = 'cef' AND {_blank('text')}", "field"),
    Rule("leef_field_blank", f"kind = 'leef' AND {_blank('text')}", "field"),
    Rule("invalid_shape_rate", "kind = 'shape_rate' AND (isnan(number) OR number < 0)", _NUMBER),
    Rule("invalid_shape_period", "kind = 'shape_period' AND (isnan(number) OR number <= 0)", _NUMBER),
    Rule("invalid_burst_multiplier", f"kind = 'burst-injection' AND field = 'rate_multiplier' AND {_not_finite_or('number <= 0')}", _NUMBER),
    Rule("invalid_burst_interval", f"kind = 'burst-injection' AND field = 'interval_secs' AND {_not_finite_or('number <= 0')}", _NUMBER),
    Rule("invalid_burst_duration", f"kind = 'burst-injection' AND field = 'duration_secs' AND {_not_finite_or('number < 0')}", _NUMBER),
    Rule("invalid_drip_divisor", f"kind = 'slow-drip' AND field = 'rate_divisor' AND {_not_finite_or('number <= 1')}", _NUMBER),
    Rule("invalid_drip_duration", f"kind = 'slow-drip' AND field = 'duration_secs' AND {_not_finite_or('number <= 0')}", _NUMBER),
    Rule("invalid_loss_percent", f"kind = 'packet-loss' AND field = 'loss_percent' AND {_not_finite_or('number < 0 OR number > 100')}", _NUMBER),
]
#: Phase rules that ENTRY_RULES replace where a profile's nested entries are at hand.
_BY_ENTRY = {r.name for r in ENTRY_RULES} | {"cef_vendor_blank", "leef_vendor_blank"}
WHOLE_PHASE_RULES = [r for r in PHASE_RULES if r.name not in _BY_ENTRY]
