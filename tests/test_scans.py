"""File scans: profiles with defaults feeding the rule checks, estimate lines, baselines,
nested estimate files."""

import json
import os

from pyspark.sql import functions as F

from eventloom.operators.checks import PHASE_RULES, PROFILE_RULES, TARGET_RULES, check
from eventloom.sources import scans

FIX = os.path.join(os.path.dirname(__file__), "fixtures")


def test_profile_defaults(spark):
    p = scans.read_profiles(spark, os.path.join(FIX, "profile_two_targets.json"))
    t = {r.idx: r for r in scans.profile_targets(p).collect()}
    assert t[0].connections == 1 and t[0].framing == "non-transparent" and t[1].connections == 2
    ph = scans.read_profiles(spark, os.path.join(FIX, "profile_two_targets.json")).select(F.explode("phases").alias("p")) \
        .select("p.name", "p.syslog.facility", "p.syslog.app_name", "p.duration_secs").collect()
    assert [(r.name, r.facility, r.app_name) for r in ph] == [("warmup", 1, "eventloom"), ("steady", 1, "eventloom")]
    assert ph[1].duration_secs == 0


def _violations(spark, name):
    p = scans.read_profiles(spark, os.path.join(FIX, name))
    v = (check(scans.profile_level(p), "profile", "profile_id", PROFILE_RULES)
         .unionByName(check(scans.profile_targets(p), "target", "idx", TARGET_RULES))
         .unionByName(check(scans.profile_phases(p), "phase", "idx", PHASE_RULES)))
    return {r.rule for r in v.collect()}


def test_good_profile_has_no_violations(spark):
    assert _violations(spark, "profile_two_targets.json") == set()


def test_broken_profile_reports_every_violation(spark):
    got = _violations(spark, "profile_broken.json")
    assert {"invalid_distribution", "invalid_shutdown_mode", "empty_address", "invalid_transport", "invalid_framing",
            "zero_connections", "invalid_tls_min_version", "invalid_backoff_multiplier", "backoff_max_below_initial",
            "empty_phase_name", "invalid_format", "no_content_source", "unbounded_phase", "zero_padding",
            "invalid_shape_rate", "invalid_shape_period", "invalid_drip_divisor", "invalid_loss_percent"} <= got


def test_estimate_lines(spark, tmp_path):
    r1 = tmp_path / "run1.jsonl"
    r1.write_text('{"bench":"b","group":"g","label":"x","time_ns_median":10}\n\n{bad json\n'
                  '{"bench":"b","group":"g","label":"","time_ns_median":5}\n{"label":"y","time_ns_median":7}\n')
    r2 = tmp_path / "run2.jsonl"
    r2.write_text('{"bench":"b","group":"g","label":"x","time_ns_median":30}\n')
    df = scans.read_estimates(spark, [str(r1), str(r2), str(tmp_path / "missing.jsonl")])
    got = sorted((r.label, r.time_ns_median) for r in df.collect())
    assert got == [("x", 10.0), ("x", 30.0), ("y", 7.0)]
    assert df.select("run").distinct().count() == 2


def test_baselines_two_layouts(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"sha": "aaa", "mode": "quick", "estimates": [{"label": "l1", "time_ns_median": 1}]}))
    (tmp_path / "b.json").write_text(json.dumps({"baseline_sha": "bbb", "n_runs": 3,
                                                 "estimates": [{"label": "l1", "time_ns_median": 2}, {"label": "l2", "time_ns_median": 3}]}))
    df = scans.read_baselines(spark, str(tmp_path))
    assert sorted((r.sha, r.label) for r in df.collect()) == [("aaa", "l1"), ("bbb", "l1"), ("bbb", "l2")]


def test_nested_estimates(spark, tmp_path):
    def put(rel, mean):
        d = tmp_path / rel / "new"
        d.mkdir(parents=True)
        (d / "estimates.json").write_text(json.dumps({"mean": {"point_estimate": mean, "confidence_interval":
                                                               {"lower_bound": mean - 1, "upper_bound": mean + 1}}}))
    put("faker_ipv4", 88.0)
    put("hot_path/rfc5424_with_faker", 1700.0)
    df = scans.read_nested_estimates(spark, str(tmp_path))
    got = sorted((r.label, r.group, r.time_ns_median, r.time_ns_lower) for r in df.collect())
    assert got == [("faker_ipv4", "faker_ipv4", 88.0, 87.0), ("hot_path/rfc5424_with_faker", "hot_path", 1700.0, 1699.0)]


def test_every_offender_of_a_nested_profile_is_reported(spark, tmp_path):
    nan, inf = float("nan"), float("inf")
    profile = {"profile_id": "p", "targets": [{"address": "a:1", "tls_cipher_suites": ["TLS_RC4", "TLS_AES_128_GCM_SHA256", "x"]}, {"address": "b:1"}],
               "phases": [{"name": "one", "format": "cef", "templates": ["t"] * 3, "template_weights": [nan, -1, 2], "duration_secs": 5,
                           "cef": {"device_vendor": "v", "device_product": " ", "device_version": "", "signature_id": "1"},
                           "load_shape": {"type": "sine", "min_rate": nan, "max_rate": 3, "period_secs": 0, "every_secs": -1},
                           "anomalies": [{"type": "burst-injection", "rate_multiplier": 0, "interval_secs": inf, "duration_secs": 0},
                                         {"type": "slow-drip", "rate_divisor": 1, "duration_secs": 0, "interval_secs": -5},
                                         {"type": "burst-injection", "rate_multiplier": nan, "interval_secs": 1, "duration_secs": -1},
                                         {"type": "packet-loss", "loss_percent": 101}, {"type": "packet-loss", "loss_percent": 100}]},
                          {"name": "two", "format": "leef", "templates": ["t"], "duration_secs": 5, "leef": {"vendor": "v", "product": "p", "version": "\t", "event_id": "e"},
                           "load_shape": {"type": "burst", "base_rate": -1, "burst_rate": 1, "every_secs": nan, "burst_secs": -2}},
                          {"name": "three", "format": "raw", "templates": ["t"], "duration_secs": 5, "cef": {"device_vendor": ""}}]}
    (tmp_path / "p.json").write_text(json.dumps(profile))
    got = {(r["index"], r.rule, r.value) for r in scans.profile_violations(scans.read_profiles(spark, str(tmp_path))).collect()}
    one, two = "p:phases[0]", "p:phases[1]"
    assert got == {
        ("p:targets[0].tls_cipher_suites[0]", "invalid_cipher_suite", "TLS_RC4"), ("p:targets[0].tls_cipher_suites[2]", "invalid_cipher_suite", "x"),
        (f"{one}.template_weights[0]", "invalid_template_weight", "NaN"), (f"{one}.template_weights[1]", "invalid_template_weight", "-1.0"),
        (f"{one}.cef.device_product", "cef_field_blank", "device_product"), (f"{one}.cef.device_version", "cef_field_blank", "device_version"),
        (f"{one}.cef.name", "cef_field_blank", "name"), (f"{one}.load_shape.min_rate", "invalid_shape_rate", "NaN"),
        (f"{one}.load_shape.period_secs", "invalid_shape_period", "0.0"), (f"{one}.anomalies[0].rate_multiplier", "invalid_burst_multiplier", "0.0"),
        (f"{one}.anomalies[0].interval_secs", "invalid_burst_interval", "inf"), (f"{one}.anomalies[1].rate_divisor", "invalid_drip_divisor", "1.0"),
        (f"{one}.anomalies[1].duration_secs", "invalid_drip_duration", "0.0"), (f"{one}.anomalies[2].rate_multiplier", "invalid_burst_multiplier", "NaN"),
        (f"{one}.anomalies[2].duration_secs", "invalid_burst_duration", "-1.0"), (f"{one}.anomalies[3].loss_percent", "invalid_loss_percent", "101.0"),
        (f"{two}.leef.version", "leef_field_blank", "version"), (f"{two}.load_shape.base_rate", "invalid_shape_rate", "-1.0"),
        (f"{two}.load_shape.every_secs", "invalid_shape_period", "NaN"), (f"{two}.load_shape.burst_secs", "invalid_shape_rate", "-2.0")}


def test_profile_violations_of_the_fixtures(spark):
    def rules(name):
        return {r.rule for r in scans.profile_violations(scans.read_profiles(spark, os.path.join(FIX, name))).collect()}
    assert rules("profile_two_targets.json") == set()
    assert {"invalid_distribution", "empty_address", "invalid_shape_rate", "invalid_shape_period", "invalid_drip_divisor", "invalid_loss_percent"} <= rules("profile_broken.json")
