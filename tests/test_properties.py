"""Invariants of the keyed operators: determinism, partition independence, ranges, pads."""

import pytest
from pyspark.sql import functions as F

from eventloom.functions import draws as D
from eventloom.functions import fields as FL
from eventloom.functions import templates as TP
from eventloom.operators import loss, routing


def test_draw_independent_of_partitioning(spark):
    a = spark.range(1, 5001, numPartitions=1).select("id", D.draw(7, "id", "x").alias("u"))
    b = spark.range(1, 5001, numPartitions=13).repartition(7).select("id", D.draw(7, "id", "x").alias("u"))
    assert sorted(a.collect()) == sorted(b.collect())


def test_draw_range_and_fast_draw(spark):
    r = spark.range(1, 20001).select(D.draw(1, "id", "a").alias("u"), D.fast_draw(1, "id", "a").alias("v")) \
        .agg(F.min("u"), F.max("u"), F.min("v"), F.max("v"), F.avg("u")).first()
    assert 0 <= r[0] and r[1] < 1 and 0 <= r[2] and r[3] < 1
    assert abs(r[4] - 0.5) < 0.02


def test_int_field_bounds(spark):
    r = spark.range(1, 20001).select(FL.int_field(3, "id", "n", -5, 5).alias("n")) \
        .agg(F.min("n"), F.max("n"), F.countDistinct("n")).first()
    assert (r[0], r[1], r[2]) == (-5, 5, 11)


def test_weighted_shares(spark):
    df = spark.range(1, 40001).select(FL.enum_field(42, "id", "m", ["a", "b"], "weighted", [1, 3]).alias("v"))
    share = df.filter("v = 'b'").count() / 40000
    assert abs(share - 0.75) < 0.02


def test_pad_exact_bytes(spark):
    df = spark.createDataFrame([(1, "héllo"), (2, "x" * 300), (3, "")], "k long, b string")
    out = df.select("k", F.octet_length(TP.pad_to_bytes(F.col("b"), 256, 1, "k")).alias("n")).collect()
    assert {r.k: r.n for r in out} == {1: 256, 2: 300, 3: 256}


def test_loss_edges(spark):
    df = spark.range(1, 1001)
    assert loss.drop_lost(df, 1, "id", 0).count() == 1000
    assert loss.drop_lost(df, 1, "id", 100).count() == 0
    assert loss.drop_lost(df, 1, "id", float("nan")).count() == 1000
    kept = loss.drop_lost(df, 1, "id", 20).count()
    assert 740 < kept < 860


def test_weighted_route_counts(spark):
    msgs = spark.range(1, 101).withColumnRenamed("id", "seq")
    t = spark.createDataFrame([("a", 0, 1), ("b", 1, 3)], "target string, target_idx int, weight int")
    c = {r.target: r["count"] for r in routing.route_weighted(msgs, t).groupBy("target").count().collect()}
    assert c == {"a": 25, "b": 75}


def test_round_robin_and_zero_weight(spark):
    msgs = spark.range(1, 10).withColumnRenamed("id", "seq")
    t = spark.createDataFrame([("a", 0, 0), ("b", 1, 0), ("c", 2, 0)], "target string, target_idx int, weight int")
    got = [r.target for r in routing.route_weighted(msgs, t).orderBy("seq").collect()]
    assert got == ["a", "b", "c"] * 3


def test_template_rules(spark):
    vals = {"a": F.lit("A"), "n": F.lit(None)}
    df = spark.range(1)
    got = df.select(TP.render_template("x{{a}}{{n}}{{zz}}{{}} {{open", vals).alias("m")).first().m
    assert got == "x{{zz}}{{}} {{open".replace("x", "xA", 1)


def test_exact_quantiles_agree_with_percentile(spark):
    from eventloom.operators.quantiles import exact_quantiles
    df = spark.range(0, 30000).select((F.col("id") % 3).alias("g"), ((F.col("id") * 7919) % 10007 / 3.0).alias("v"))
    ref = {r.g: (r.a, r.b) for r in df.groupBy("g").agg(F.percentile("v", 0.5).alias("a"), F.percentile("v", 0.95).alias("b")).collect()}
    for fm in (50_000, 500):   # without and with narrowing rounds (groups of 10 000 > 500)
        got = {r.g: (r.q50, r.q95) for r in exact_quantiles(df, ["g"], "v", [0.5, 0.95], final_max=fm, bins=16).collect()}
        for g in ref:
            assert abs(got[g][0] - ref[g][0]) < 1e-9 and abs(got[g][1] - ref[g][1]) < 1e-9


def test_exact_quantiles_null_groups_odd_names_and_extreme_values(spark):
    from eventloom.operators.quantiles import exact_quantiles
    inf = float("inf")
    groups = {None: [4.0, 1.0, 9.0, 2.0, 7.0, 7.0], "a": [-inf, -1.7e308, 0.0, 1e-300, 1.7e308, inf, inf],
              "b": [inf, inf, inf, inf, 1.0], "c": [10.0 ** e for e in range(-20, 20, 3)], "d": [3.0]}
    rows = [(k, k, v) for k, vs in groups.items() for v in [*vs, None, float("nan")]]
    df = spark.createDataFrame(rows, "k string, lo string, v double")
    for fm in (3, 50_000):
        got = {(r["k"], r["lo"]): r["q50"] for r in exact_quantiles(df, ["k", "lo"], "v", [0.5], final_max=fm).collect()}
        assert len(got) == len(groups)
        for k, vs in groups.items():
            vs = sorted(vs)
            lo, hi = vs[(len(vs) - 1) // 2], vs[len(vs) // 2]
            assert got[(k, k)] == (lo if lo == hi else lo + (hi - lo) * 0.5)
    one = exact_quantiles(df.filter("k = 'd' or k is null"), [], "v", [0.0, 1.0], final_max=2).collect()
    assert [tuple(r) for r in one] == [(1.0, 9.0)]


def test_pick_intervals_tile_the_whole_range(spark):
    from eventloom.operators import picks
    dom = picks.zipf_weights(spark.range(1, 30_001).withColumnRenamed("id", "rank"), "rank", 1.1)
    t = picks.pick_table(dom, "rank", "_w", buckets=512)
    rows = t.select("rank", "_lo", "_hi", "_total").distinct().orderBy("rank").collect()
    assert len(rows) == 30_000 and rows[0]["_lo"] == 0.0 and rows[-1]["_hi"] == rows[-1]["_total"]
    assert all(a["_hi"] == b["_lo"] for a, b in zip(rows, rows[1:]))


def test_placeholder_names(spark):
    df = spark.createDataFrame([("a {{x}} {{y}} {{x}} {{", ), ("none",)], "t string")
    got = [r.n for r in df.select(TP.placeholder_names(F.col("t")).alias("n")).collect()]
    assert got == [["x", "y"], []]
    assert TP.placeholders("{{b}}{{a}}{{b}}") == ["b", "a"]


def test_fast_mode_keyed_and_in_range(spark):
    from eventloom.functions import fakers as FK
    from eventloom.functions.draws import draw_mode
    with draw_mode("fast"):
        cols = [FK.faker("ipv4", 5, "id").alias("ip"), FK.faker("uuid", 5, "id").alias("u"),
                FL.string_field(5, "id", "s", 10).alias("s"), D.draw(5, "id", "x").alias("d")]
        a = spark.range(1, 3001, numPartitions=1).select("id", *cols)
        b = spark.range(1, 3001, numPartitions=7).repartition(5).select("id", *cols)
    assert sorted(a.collect()) == sorted(b.collect())
    rows = a.collect()
    for r in rows:
        o = [int(x) for x in r.ip.split(".")]
        assert 1 <= o[0] <= 223 and 0 <= o[1] <= 255 and 0 <= o[2] <= 255 and 1 <= o[3] <= 254
        assert len(r.u) == 36 and r.u[14] == "4" and r.u[19] in "89ab"
        assert len(r.s) == 10 and 0 <= r.d < 1
    exact = spark.range(1, 3001).select("id", FK.faker("ipv4", 5, "id").alias("ip"))
    assert sorted(exact.collect()) != sorted(a.select("id", "ip").collect())


def test_capture_file_scans(spark, tmp_path):
    from eventloom.sources import framed
    (tmp_path / "lf").mkdir()
    (tmp_path / "lf" / "c1.log").write_bytes("a\nbé\n\ntail".encode())
    (tmp_path / "lf" / "c2.log").write_bytes(b"x\n")
    got = sorted((r.conn.rsplit("/", 1)[-1], r.pos, r.body, r.wire_bytes) for r in framed.read_lf_files(spark, str(tmp_path / "lf")).collect())
    assert got == [("c1.log", 0, "a", 2), ("c1.log", 1, "bé", 4), ("c1.log", 2, "", 1), ("c2.log", 0, "x", 2)]
    (tmp_path / "oc").mkdir()
    (tmp_path / "oc" / "s.bin").write_bytes(b"3 abc5 hello0 zz")
    rows = sorted((r.pos, r.body, r.wire_bytes, r.error) for r in framed.read_octet_files(spark, str(tmp_path / "oc")).collect())
    assert rows == [(0, "abc", 5, None), (5, "hello", 7, None), (12, None, None, "octet-counting: implausible length 0")]


def test_domain_pick_equals_literal_pick(spark):
    from eventloom.operators import picks
    weights = [5.0, 0.0, 2.5, 1.0, 0.0, 7.0, 3.0]
    dom = spark.createDataFrame([(i, w) for i, w in enumerate(weights)], "idx long, w double")
    t = picks.pick_table(dom, "idx", "w", buckets=64)
    msgs = spark.range(1, 5001).withColumnRenamed("id", "seq")
    got = {r.seq: r.idx for r in picks.pick_by_weight(msgs, 9, "seq", "m", t, buckets=64, keep=["seq", "idx"]).collect()}
    ref = {r.seq: r.i for r in msgs.select("seq", FL.enum_index(9, "seq", "m", len(weights), "weighted", weights).alias("i")).collect()}
    assert got == ref
    assert 1 not in set(got.values()) and 4 not in set(got.values())


def test_prometheus_lines_escape_labels(spark):
    from eventloom.operators import metrics as MX
    df = spark.createDataFrame([('a"b\\c', 3)], "t string, value long")
    lines = [r.line for r in MX.prometheus_lines(df, "m_total", "help", "counter", ["t"]).collect()]
    assert lines == ["# HELP m_total help", "# TYPE m_total counter", 'm_total{t="a\\"b\\\\c"} 3']


def test_keyed_text_column_length_equals_literal(spark):
    df = spark.range(1, 301).select("id", F.lit(13).alias("n"))
    a = df.select("id", FL.keyed_text(3, "id", "s", 13, FL.ALNUM).alias("t"))
    b = df.select("id", FL.keyed_text(3, "id", "s", F.col("n"), FL.ALNUM).alias("t"))
    assert sorted(a.collect()) == sorted(b.collect())
    assert all(len(r.t) == 13 for r in a.collect())


def test_with_fields_mode_argument(spark):
    from eventloom.functions.draws import draw_mode
    schema = {"ip": {"type": "faker", "faker": "ipv4"}, "n": {"type": "int", "min": 1, "max": 9}}
    base = spark.range(1, 201)
    a = FL.with_fields(base, schema, 1, "id", mode="fast").collect()
    with draw_mode("fast"):
        b = FL.with_fields(base, schema, 1, "id").collect()
    c = FL.with_fields(base, schema, 1, "id").collect()
    assert sorted(a) == sorted(b) and sorted(a) != sorted(c)


def test_empty_placeholder_stays_and_the_next_one_renders(spark):
    from eventloom.functions import templates as T
    df = spark.createDataFrame([("x", "{{}} {{a}} {{b}}")], "a string, t string")
    row = df.select(T.render_template("{{}} {{a}}", {"a": F.col("a")}).alias("r"), T.placeholder_names(F.col("t")).alias("n")).first()
    assert row["r"] == "{{}} x" and row["n"] == ["a", "b"]


@pytest.mark.parametrize("small", [True, False])
def test_weighted_route_of_any_weights(spark, monkeypatch, small):
    """Slots of a target follow each other, for weights from 0 to thousands of millions and more targets than are broadcast."""
    monkeypatch.setattr(routing, "MAX_TARGETS", 10_000 if small else 3)
    weights = [3, 5_000_000_000, None, 1, 0, 1, 250, -4, 1, 1] + [1] * 40 + [700]
    targets = spark.createDataFrame([(f"t{i:03d}", f"k{i:03d}", w) for i, w in enumerate(weights)], "target string, rank string, weight long")
    owners, at = [], 0
    for i, w in enumerate(weights):
        at += max(w or 1, 1)
        owners.append((at, f"t{i:03d}"))
    seqs = [*range(-5, 10), *(at + d for d in range(-800, 5)), 5_000_000_002, 5_000_000_003, 5_000_000_004, 5_000_000_005, 7 * at + 4]
    msgs = spark.createDataFrame([(s,) for s in seqs], "seq long")
    got = {r.seq: r.target for r in routing.route_weighted(msgs, targets, order="rank").collect()}
    assert got == {s: next(t for end, t in owners if (s - 1) % at < end) for s in seqs}


@pytest.mark.parametrize("block, most", [(1000, 10_000), (7, 10_000), (7, 3)])
def test_fan_out_reaches_every_target(spark, monkeypatch, block, most):
    monkeypatch.setattr(routing, "FAN_BLOCK", block)
    monkeypatch.setattr(routing, "MAX_TARGETS", most)
    targets = spark.createDataFrame([(f"t{i % 30}", i % 3) for i in range(60)], "target string, zone int")   # each twice
    msgs = spark.range(50).select(F.col("id").alias("seq"))
    got = routing.route_broadcast(msgs, targets)
    assert got.columns == ["seq", "target", "zone"]
    counts = {(r.seq, r.target): r["count"] for r in got.groupBy("seq", "target").count().collect()}
    assert len(counts) == 50 * 30 and set(counts.values()) == {2}
    assert routing.route_broadcast(msgs, targets.filter("zone > 5")).collect() == []
