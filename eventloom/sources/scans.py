"""Scans of configuration and result files: profiles (JSON with defaults), benchmark
estimate lines (JSONL), baseline documents and nested per-benchmark estimate files.

All readers use explicit schemas (no inference), so a malformed line is dropped rather
than widening the schema, and the file a row came from is kept from ``_metadata``.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from eventloom.operators.checks import ENTRY_RULES, PROFILE_RULES, TARGET_RULES, WHOLE_PHASE_RULES, check

# ---- fixed values: profile defaults -----------------------------------------------------------
DEFAULT_DISTRIBUTION = "round-robin"
DEFAULT_SHUTDOWN_MODE = "drain"
DEFAULT_DRAIN_TIMEOUT_SECS = 15
DEFAULT_CONNECTIONS = 1
DEFAULT_WEIGHT = 1
DEFAULT_FRAMING = "non-transparent"
DEFAULT_FACILITY = 1
DEFAULT_SEVERITY = 6
DEFAULT_HOSTNAME = "{{hostname}}"
DEFAULT_APP_NAME = "eventloom"      # our default; no result depends on it
NIL = "-"
# ------------------------------------------------------------------------------------------------

PROFILE_DDL = """
profile_id string, distribution string, broadcast_policy string, on_target_failure string,
shutdown struct<mode:string, drain_timeout_secs:bigint>,
targets array<struct<address:string, transport:string, connections:int, weight:int, framing:string,
  tls_min_protocol_version:string, tls_cipher_suites:array<string>, tls_insecure:boolean, kafka_topic:string, kafka_compression:string,
  kafka_acks:string, file_rotation_size_mb:bigint, file_rotation_interval_secs:bigint,
  file_rotation_max_files:int, reconnect_initial_backoff_ms:bigint, reconnect_max_backoff_ms:bigint,
  reconnect_multiplier:double>>,
phases array<struct<name:string, duration_secs:bigint, messages_per_second:bigint,
  total_messages:bigint, templates:array<string>, template_weights:array<double>, templates_file:string,
  schema_file:string, format:string, seed:bigint, pad_to_bytes:int,
  syslog:struct<facility:int, severity:int, hostname:string, app_name:string, procid:string,
                msgid:string, structured_data:string, bom:boolean>,
  load_shape:struct<type:string, rate:double, start_rate:double, end_rate:double, min_rate:double,
                    max_rate:double, period_secs:double, base_rate:double, burst_rate:double,
                    every_secs:double, burst_secs:double>,
  anomalies:array<struct<type:string, rate_multiplier:double, interval_secs:double,
                         duration_secs:double, rate_divisor:double, loss_percent:double>>,
  cef:struct<device_vendor:string, device_product:string, device_version:string,
             signature_id:string, name:string, severity:int, extensions:map<string,string>>,
  leef:struct<vendor:string, product:string, version:string, event_id:string,
              attributes:map<string,string>>,
  json_lines_fields:map<string,string>>>
"""
_PROFILE_SCHEMA = None


def profile_schema() -> T.StructType:
    """The profile struct type (parsed from the DDL above once a session exists)."""
    global _PROFILE_SCHEMA
    if _PROFILE_SCHEMA is None:
        _PROFILE_SCHEMA = T._parse_datatype_string(" ".join(PROFILE_DDL.split()))
    return _PROFILE_SCHEMA


def read_profiles(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """One row per profile file (JSON documents; ``lines``: one profile a line), unknown fields ignored, defaults filled.

    ``profile_id`` defaults to the file path.
    """
    PROFILE_SCHEMA = profile_schema()
    raw = spark.read.schema(PROFILE_SCHEMA).option("multiLine", str(not lines).lower()).json(path) \
        .withColumn("_file", F.col("_metadata.file_path"))

    def target(t):
        return (t.withField("connections", F.coalesce(t["connections"], F.lit(DEFAULT_CONNECTIONS)))
                 .withField("weight", F.coalesce(t["weight"], F.lit(DEFAULT_WEIGHT)))
                 .withField("framing", F.coalesce(t["framing"], F.lit(DEFAULT_FRAMING)))
                 .withField("transport", F.coalesce(t["transport"], F.lit("udp")))
                 .withField("tls_insecure", F.coalesce(t["tls_insecure"], F.lit(False))))

    def syslog(s):
        return F.struct(
            F.coalesce(s["facility"], F.lit(DEFAULT_FACILITY)).alias("facility"),
            F.coalesce(s["severity"], F.lit(DEFAULT_SEVERITY)).alias("severity"),
            F.coalesce(s["hostname"], F.lit(DEFAULT_HOSTNAME)).alias("hostname"),
            F.coalesce(s["app_name"], F.lit(DEFAULT_APP_NAME)).alias("app_name"),
            F.coalesce(s["procid"], F.lit(NIL)).alias("procid"),
            F.coalesce(s["msgid"], F.lit(NIL)).alias("msgid"),
            F.coalesce(s["structured_data"], F.lit(NIL)).alias("structured_data"),
            F.coalesce(s["bom"], F.lit(False)).alias("bom"))

    def phase(p):
        return (p.withField("duration_secs", F.coalesce(p["duration_secs"], F.lit(0).cast("bigint")))
                 .withField("messages_per_second", F.coalesce(p["messages_per_second"], F.lit(0).cast("bigint")))
                 .withField("templates", F.coalesce(p["templates"], F.array().cast("array<string>")))
                 .withField("anomalies", F.coalesce(p["anomalies"], F.array().cast(
                     PROFILE_SCHEMA["phases"].dataType.elementType["anomalies"].dataType)))
                 .withField("syslog", syslog(p["syslog"])))

    return raw.select(
        F.coalesce("profile_id", "_file").alias("profile_id"),
        F.coalesce("distribution", F.lit(DEFAULT_DISTRIBUTION)).alias("distribution"),
        F.struct(F.coalesce(F.col("shutdown.mode"), F.lit(DEFAULT_SHUTDOWN_MODE)).alias("mode"),
                 F.coalesce(F.col("shutdown.drain_timeout_secs"), F.lit(DEFAULT_DRAIN_TIMEOUT_SECS).cast("bigint"))
                 .alias("drain_timeout_secs")).alias("shutdown"),
        F.transform(F.coalesce("targets", F.array().cast(PROFILE_SCHEMA["targets"].dataType)), target).alias("targets"),
        F.transform(F.coalesce("phases", F.array().cast(PROFILE_SCHEMA["phases"].dataType)), phase).alias("phases"))


def profile_level(profiles: DataFrame) -> DataFrame:
    """Columns the profile-level rules read."""
    return profiles.select("profile_id", "distribution", F.col("shutdown.mode").alias("shutdown_mode"),
                           F.size("targets").alias("n_targets"),
                           F.array_max(F.transform("targets", lambda t: t["weight"])).alias("max_weight"),
                           F.size("phases").alias("n_phases"))


def profile_violations(profiles: DataFrame) -> DataFrame:
    """Every violation of profiles read by :func:`read_profiles`: subject, index (profile and place), rule, value."""
    def idx(*parts):
        return F.concat_ws(":", "profile_id", *[F.col(c).cast("string") for c in parts])
    return (check(profile_level(profiles), "profile", "profile_id", PROFILE_RULES)
            .unionByName(check(profile_targets(profiles).drop("tls_cipher_suites"), "target", idx("idx"), TARGET_RULES))
            .unionByName(check(profile_phases(profiles), "phase", idx("idx"), WHOLE_PHASE_RULES))
            .unionByName(check(profile_entries(profiles), "entry", idx("path"), ENTRY_RULES)))


def profile_targets(profiles: DataFrame) -> DataFrame:
    """One row per target: profile_id, idx (0-based position) and the target's fields."""
    return profiles.select("profile_id", F.posexplode("targets").alias("idx", "t")).select("profile_id", "idx", "t.*")


def profile_phases(profiles: DataFrame) -> DataFrame:
    """One row per phase with the columns the phase rules read."""
    p = profiles.select("profile_id", F.posexplode("phases").alias("idx", "p"))
    shape = F.col("p.load_shape")
    rates = F.array_min(F.array_compact(F.array(*[shape[f] for f in
                                                  ("rate", "start_rate", "end_rate", "min_rate", "max_rate", "base_rate", "burst_rate")])))
    periods = F.array_min(F.array_compact(F.array(shape["period_secs"], shape["every_secs"])))
    an = F.col("p.anomalies")

    def pick(kind: str, field: str, agg) -> Column:
        vals = F.transform(F.filter(an, lambda a: a["type"] == kind), lambda a: a[field])
        return agg(vals)
    return p.select(
        "profile_id", "idx", F.col("p.name").alias("name"), F.coalesce(F.col("p.format"), F.lit("rfc5424")).alias("format"),
        F.size("p.templates").alias("n_templates"), F.col("p.templates_file").alias("templates_file"),
        F.col("p.schema_file").alias("schema_file"), F.col("p.duration_secs").alias("duration_secs"),
        F.col("p.total_messages").alias("total_messages"),
        F.when(F.col("p.template_weights").isNotNull(), F.size("p.template_weights")).alias("n_template_weights"),
        F.array_min("p.template_weights").alias("min_template_weight"), F.col("p.pad_to_bytes").alias("pad_to_bytes"),
        F.col("p.syslog.facility").alias("facility"), F.col("p.syslog.severity").alias("severity"),
        F.when(F.col("p.cef").isNotNull(), F.coalesce("p.cef.device_vendor", F.lit(""))).alias("cef_vendor"), F.col("p.cef.severity").alias("cef_severity"),
        F.when(F.col("p.leef").isNotNull(), F.coalesce("p.leef.vendor", F.lit(""))).alias("leef_vendor"), rates.alias("shape_rate"), periods.alias("shape_period"),
        pick("burst-injection", "rate_multiplier", F.array_min).alias("burst_multiplier"),
        pick("slow-drip", "rate_divisor", F.array_min).alias("drip_divisor"),
        pick("packet-loss", "loss_percent", F.array_max).alias("loss_percent"))


#: Numbers a load shape and an anomaly of each type reads. Fixed values.
SHAPE_RATES = {"constant": ["rate"], "linear": ["start_rate", "end_rate"], "sine": ["min_rate", "max_rate"], "burst": ["base_rate", "burst_rate", "burst_secs"]}
SHAPE_PERIODS = {"sine": ["period_secs"], "burst": ["every_secs"]}
ANOMALY_FIELDS = {"burst-injection": ["rate_multiplier", "interval_secs", "duration_secs"], "slow-drip": ["rate_divisor", "duration_secs"],
                  "packet-loss": ["loss_percent"]}
BLOCK_FIELDS = {"cef": ["device_vendor", "device_product", "device_version", "signature_id", "name"], "leef": ["vendor", "product", "version", "event_id"]}


def profile_entries(profiles: DataFrame) -> DataFrame:
    """One row per nested entry that a rule reads: profile_id, path (its place in the profile), kind, field, number, text.

    Arrays are exploded, never folded, so each entry is judged on its own: a second offender or a NaN can't hide
    behind a minimum.
    """
    def entry(path, kind, field=None, number=None, text=None):
        return F.struct(path.alias("path"), (F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), F.lit(field).cast("string").alias("field"),
                        (F.lit(None) if number is None else number).cast("double").alias("number"),
                        (F.lit(None) if text is None else text).cast("string").alias("text"))

    def at(*parts) -> Column:
        return F.concat(*[(F.lit(x) if isinstance(x, str) else x.cast("string")) for x in parts])

    t, p, i = F.col("t"), F.col("p"), F.col("i")
    shape, place = p["load_shape"], at("phases[", i, "]")
    suites = F.transform(t["tls_cipher_suites"], lambda x, k: entry(at("targets[", i, "].tls_cipher_suites[", k, "]"), "cipher", text=x))
    weights = F.transform(p["template_weights"], lambda x, k: entry(at(place, ".template_weights[", k, "]"), "weight", number=x))

    def of_anomaly(a, k):
        fields = [F.when(a["type"] == kind, entry(at(place, ".anomalies[", k, f"].{f}"), kind, f, number=a[f])) for kind, fs in ANOMALY_FIELDS.items() for f in fs]
        return F.array(*fields)
    anomalies = F.flatten(F.transform(p["anomalies"], of_anomaly))
    single = [F.when(shape["type"] == kind, entry(at(place, f".load_shape.{f}"), name, f, number=shape[f]))
              for name, table in (("shape_rate", SHAPE_RATES), ("shape_period", SHAPE_PERIODS)) for kind, fs in table.items() for f in fs]
    single += [F.when((p["format"] == kind) & p[kind].isNotNull(), entry(at(place, f".{kind}.{f}"), kind, f, text=p[kind][f]))
               for kind, fs in BLOCK_FIELDS.items() for f in fs]
    none = F.array().cast("array<struct<path:string,kind:string,field:string,number:double,text:string>>")
    of_targets = profiles.select("profile_id", F.posexplode("targets").alias("i", "t")).select("profile_id", F.explode(F.coalesce(suites, none)).alias("e"))
    of_phases = (profiles.select("profile_id", F.posexplode("phases").alias("i", "p"))
                 .select("profile_id", F.explode(F.concat(F.coalesce(weights, none), F.coalesce(anomalies, none), F.array(*single))).alias("e")))
    return of_targets.unionByName(of_phases).filter("e IS NOT NULL").select("profile_id", "e.*")


ESTIMATE_SCHEMA = T.StructType([
    T.StructField("bench", T.StringType()), T.StructField("group", T.StringType()), T.StructField("label", T.StringType()),
    T.StructField("time_ns_median", T.DoubleType()), T.StructField("time_ns_lower", T.DoubleType()),
    T.StructField("time_ns_upper", T.DoubleType()), T.StructField("_corrupt_record", T.StringType())])


def existing_paths(spark: SparkSession, paths: Sequence[str]) -> list[str]:
    """Keep the paths that exist (a missing run file is a warning, not an error)."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    out = []
    for p in paths:
        hp = jvm.org.apache.hadoop.fs.Path(p)
        if hp.getFileSystem(conf).globStatus(hp):
            out.append(p)
        else:
            print(f"WARNING: run file not found: {p}")
    return out


def read_estimates(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Estimate lines from run files: blank, malformed and label-less lines are skipped;
    ``run`` is the file the line came from."""
    ps = existing_paths(spark, paths)
    if not ps:
        return spark.createDataFrame([], "bench string, group string, label string, time_ns_median double, "
                                         "time_ns_lower double, time_ns_upper double, run string")
    df = spark.read.schema(ESTIMATE_SCHEMA).option("mode", "PERMISSIVE").json(ps)
    df = df.withColumn("run", F.col("_metadata.file_path"))
    return (df.filter(F.col("_corrupt_record").isNull() & F.col("label").isNotNull() & (F.col("label") != ""))
              .drop("_corrupt_record"))


BASELINE_SCHEMA = T.StructType([
    T.StructField("sha", T.StringType()), T.StructField("baseline_sha", T.StringType()),
    T.StructField("mode", T.StringType()), T.StructField("timestamp", T.StringType()),
    T.StructField("status", T.StringType()), T.StructField("n_runs", T.LongType()),
    T.StructField("estimates", T.ArrayType(T.StructType(ESTIMATE_SCHEMA.fields[:6] + [
        T.StructField("n_samples", T.LongType())])))])


def read_baselines(spark: SparkSession, path: str) -> DataFrame:
    """Baseline documents (either header layout) flattened to one row per estimate, with the
    document's sha, timestamp and file modification time (for "newest baseline")."""
    df = spark.read.schema(BASELINE_SCHEMA).option("multiLine", "true").json(path)
    return df.select(F.coalesce("sha", "baseline_sha").alias("sha"), "mode", "timestamp",
                     F.col("_metadata.file_modification_time").alias("file_mtime"),
                     F.explode("estimates").alias("e")).select("sha", "mode", "timestamp", "file_mtime", "e.*")


NESTED_SCHEMA = T.StructType([T.StructField(stat, T.StructType([
    T.StructField("point_estimate", T.DoubleType()),
    T.StructField("confidence_interval", T.StructType([T.StructField("lower_bound", T.DoubleType()),
                                                       T.StructField("upper_bound", T.DoubleType())]))]))
    for stat in ("mean", "median")])


def read_nested_estimates(spark: SparkSession, root: str, stat: str = "mean") -> DataFrame:
    """Per-benchmark estimate files at ``<root>/<group>/new/estimates.json`` (label = group)
    or ``<root>/<group>/<sub>/new/estimates.json`` (label = group/sub)."""
    r = root.rstrip("/")
    df = (spark.read.schema(NESTED_SCHEMA).option("multiLine", "true").option("recursiveFileLookup", "true")
               .option("pathGlobFilter", "estimates.json").json(r))
    import re as _re
    bare = _re.sub(r"^[a-zA-Z][a-zA-Z0-9+.-]*:/*", "/", r) if ":" in r.split("/")[0] else r
    rel = F.regexp_extract(F.col("_metadata.file_path"), _re.escape(bare) + r"/([^/]+(?:/[^/]+)?)/new/estimates\.json$", 1)
    s = F.col(stat)
    out = df.select(rel.alias("label"), F.split(rel, "/").getItem(0).alias("group"),
                    s["point_estimate"].alias("time_ns_median"),
                    s["confidence_interval"]["lower_bound"].alias("time_ns_lower"),
                    s["confidence_interval"]["upper_bound"].alias("time_ns_upper"))
    return out.filter(F.col("time_ns_median").isNotNull())
