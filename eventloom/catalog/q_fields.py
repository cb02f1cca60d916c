"""Value-generator queries: keyed draws, fakers, typed fields, enums, correlations,
schema projection, templates and padding. Key = events.event_id + 1 unless noted."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventloom.catalog import SEED, register, table
from eventloom.functions import draws as D
from eventloom.functions import fakers as FK
from eventloom.functions import fields as FL
from eventloom.functions import templates as TP
from eventloom.operators.lookup import lookup_with_default

EV_SQL = "SELECT event_id + 1 AS seq, ts, event_type, user_id FROM events"

# ---- a parcel depot's scans: each kind of field once, with a chain of dependent fields ---------
# Which lane a parcel takes follows from its depot, what is done next from how the scan went.
PARCEL_SCHEMA = {
    "label": {"type": "string", "len": 14},
    "depot": {"type": "enum", "values": ["Aalen", "Brno", "Cork", "Dijon", "Espoo", "Faro", "Gdansk", "Hobart", "Izmir"]},
    "lane": {"type": "enum", "values": ["air", "rail"], "depends_on": "depot",
             "mapping": {"Cork": "sea", "Hobart": "sea", "Espoo": "sea", "Faro": "air"}},
    "grams": {"type": "int", "min": 15, "max": 31500},
    "handler": {"type": "faker", "faker": "username"},
    "reading": {"type": "enum", "values": ["clean", "smudged", "torn"], "distribution": "weighted", "weights": [188, 9, 3]},
    "next_step": {"type": "enum", "values": ["belt"], "depends_on": "reading", "mapping": {"smudged": "rescan"}, "mapping_default": "forward"},
    "carrier": {"type": "enum", "values": ["swift", "union", "north", "delta", "post", "quick"], "distribution": "zipf", "zipf_exponent": 0.8},
    "scanned_at": {"type": "datetime", "jitter_secs": 45},
    "scanner": {"type": "faker", "faker": "mac"},
}
PARCEL_TEMPLATE = ('{{scanned_at}} depot {{depot}} scanner [{{scanner}}] parcel {{label}} ({{grams}} g, {{carrier}}, {{lane}}) read {{reading}}, {{next_step}} '
                   'by {{handler}}; trace {{faker.uuid}} {{missing}} {{ open')
# -----------------------------------------------------------------------------------------


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events").select((F.col("event_id") + 1).alias("seq"), "ts", "event_type", "user_id")


@register("draw_uniform", f"SELECT seq, {D.sql_draw(SEED, 'seq', 'u')} AS u FROM ({EV_SQL}) e")
def draw_uniform(spark, sf_dir):
    return _events(spark, sf_dir).select("seq", D.draw(SEED, "seq", "u").alias("u"))


@register("draw_fast")
def draw_fast(spark, sf_dir):
    """xxhash64-based draw (Spark only): rows check plus range/determinism tests."""
    return _events(spark, sf_dir).select("seq", D.fast_draw(SEED, "seq", "u").alias("u"))


def _faker_query(kind):
    def q(spark, sf_dir):
        return _events(spark, sf_dir).select("seq", FK.faker(kind, SEED, "seq").alias("value"))
    q.__doc__ = f"faker.{kind} keyed on the event sequence."
    return q


for _k in FK.FAKERS:
    register(f"faker_{_k}", f"SELECT seq, {FK.sql_faker(_k, SEED, 'seq')} AS value FROM ({EV_SQL}) e")(_faker_query(_k))


@register("field_int", f"SELECT seq, {FL.sql_int_field(SEED, 'seq', 'bytes', 64, 1048576)} AS bytes, "
                       f"{FL.sql_int_field(SEED, 'seq', 'req_time', 1, 2500)} AS req_time, "
                       f"{FL.sql_int_field(SEED, 'seq', 'flipped', 10, 5)} AS flipped, "
                       f"{FL.sql_int_field(SEED, 'seq', 'neg', -1000, 1000)} AS neg FROM ({EV_SQL}) e")
def field_int(spark, sf_dir):
    return _events(spark, sf_dir).select(
        "seq", FL.int_field(SEED, "seq", "bytes", 64, 1048576).alias("bytes"),
        FL.int_field(SEED, "seq", "req_time", 1, 2500).alias("req_time"),
        FL.int_field(SEED, "seq", "flipped", 10, 5).alias("flipped"),
        FL.int_field(SEED, "seq", "neg", -1000, 1000).alias("neg"))


@register("field_string", f"SELECT seq, {FL.sql_keyed_text(SEED, 'seq', 's8', '8', FL.ALNUM)} AS s8, "
                          f"{FL.sql_keyed_text(SEED, 'seq', 's20', '20', FL.ALNUM)} AS s20, "
                          f"{FL.sql_keyed_text(SEED, 'seq', 's0', '0', FL.ALNUM)} AS s0 FROM ({EV_SQL}) e")
def field_string(spark, sf_dir):
    return _events(spark, sf_dir).select(
        "seq", FL.string_field(SEED, "seq", "s8", 8).alias("s8"), FL.string_field(SEED, "seq", "s20", 20).alias("s20"),
        FL.string_field(SEED, "seq", "s0", 0).alias("s0"))


@register("field_datetime", f"SELECT seq, {FL.sql_datetime_field(SEED, 'seq', 'd0', 'ts', 0)} AS d0, "
                            f"{FL.sql_datetime_field(SEED, 'seq', 'd5', 'ts', 5)} AS d5, "
                            f"{FL.sql_datetime_field(SEED, 'seq', 'd3600', 'ts', 3600)} AS d3600 FROM ({EV_SQL}) e")
def field_datetime(spark, sf_dir):
    e = _events(spark, sf_dir)
    return e.select("seq", FL.datetime_field(SEED, "seq", "d0", F.col("ts"), 0).alias("d0"),
                    FL.datetime_field(SEED, "seq", "d5", F.col("ts"), 5).alias("d5"),
                    FL.datetime_field(SEED, "seq", "d3600", F.col("ts"), 3600).alias("d3600"))


METHODS = ["GET", "POST", "PUT", "DELETE"]


@register("enum_uniform", f"SELECT seq, {FL.sql_enum_field(SEED, 'seq', 'm', METHODS)} AS method, "
                          f"{FL.sql_enum_field(SEED, 'seq', 'e', [])} AS empty, "
                          f"{FL.sql_enum_field(SEED, 'seq', 'o', ['a', 'b'], 'other')} AS other FROM ({EV_SQL}) e")
def enum_uniform(spark, sf_dir):
    return _events(spark, sf_dir).select(
        "seq", FL.enum_field(SEED, "seq", "m", METHODS).alias("method"),
        FL.enum_field(SEED, "seq", "e", []).alias("empty"),
        FL.enum_field(SEED, "seq", "o", ["a", "b"], "other").alias("other"))


_W = dict(a=("m", METHODS, [70, 20, 7, 3]), b=("z", ["p", "q", "r", "s"], [0, 1, 0, 2]),
          c=("x", ["u", "v", "w"], [1, 2]), d=("n", ["k", "l"], [0, 0]))


@register("enum_weighted", "SELECT seq, " + ", ".join(
    f"{FL.sql_enum_field(SEED, 'seq', s, v, 'weighted', w)} AS {c}" for c, (s, v, w) in _W.items())
    + f" FROM ({EV_SQL}) e")
def enum_weighted(spark, sf_dir):
    """Weighted picks: plain, zero weights skipped, length mismatch → uniform, all-zero → first."""
    return _events(spark, sf_dir).select(
        "seq", *[FL.enum_field(SEED, "seq", s, v, "weighted", w).alias(c) for c, (s, v, w) in _W.items()])


CARRIERS = PARCEL_SCHEMA["carrier"]["values"]


@register("enum_zipf", f"SELECT seq, {FL.sql_enum_field(SEED, 'seq', 'p', CARRIERS, 'zipf', None, 1.1)} AS path, "
                       f"{FL.sql_enum_field(SEED, 'seq', 'q', CARRIERS, 'zipf')} AS path_s1 FROM ({EV_SQL}) e")
def enum_zipf(spark, sf_dir):
    return _events(spark, sf_dir).select(
        "seq", FL.enum_field(SEED, "seq", "p", CARRIERS, "zipf", None, 1.1).alias("path"),
        FL.enum_field(SEED, "seq", "q", CARRIERS, "zipf").alias("path_s1"))


# ---- fixed mapping used by the correlated-field query ---------------------------------
TIER = {"AUTOMOBILE": "gold", "BUILDING": "silver", "FURNITURE": "silver"}
REGION_CODE = {"HOUSEHOLD": "H", "MACHINERY": "M"}
CUST_SQL = "SELECT c_custkey + 1 AS k, c_mktsegment FROM customer"


@register("field_correlated", f"SELECT k, c_mktsegment, "
          f"{FL.sql_correlated('c_mktsegment', TIER, 'bronze', FL.sql_enum_field(SEED, 'k', 'tier', ['x']))} AS tier, "
          f"{FL.sql_correlated('c_mktsegment', REGION_CODE, None, FL.sql_enum_field(SEED, 'k', 'code', ['X', 'Y', 'Z']))} AS code "
          f"FROM ({CUST_SQL}) c")
def field_correlated(spark, sf_dir):
    """Child value from mapping[parent], else the default, else the child's own base draw."""
    c = table(spark, sf_dir, "customer").select((F.col("c_custkey") + 1).alias("k"), "c_mktsegment")
    schema = {
        "tier": {"type": "enum", "values": ["x"], "depends_on": "c_mktsegment", "mapping": TIER,
                 "mapping_default": "bronze"},
        "code": {"type": "enum", "values": ["X", "Y", "Z"], "depends_on": "c_mktsegment", "mapping": REGION_CODE},
    }
    return FL.with_fields(c, schema, SEED, "k")


def _sql_schema(schema, key_sql, ts_sql):
    out = {}
    for level in FL.field_order(schema):
        for n in level:
            spec = schema[n]
            base = FL.sql_base(spec, SEED, key_sql, n, ts_sql)
            if spec.get("depends_on"):
                base = FL.sql_correlated(out.get(spec["depends_on"], spec["depends_on"]), spec.get("mapping"),
                                         spec.get("mapping_default"), base)
            out[n] = base
    return out


_PARCEL_SQL = _sql_schema(PARCEL_SCHEMA, "seq", "ts")


@register("schema_project", "SELECT seq, " + ", ".join(f"{v} AS {k}" for k, v in _PARCEL_SQL.items())
          + f" FROM ({EV_SQL}) e")
def schema_project(spark, sf_dir):
    """The parcel schema (all field kinds, two dependent fields) keyed on events."""
    e = _events(spark, sf_dir).select("seq", "ts")
    return FL.with_fields(e, PARCEL_SCHEMA, SEED, "seq", ts="ts").drop("ts")


@register("template_render",
          f"SELECT seq, {TP.sql_render_template(PARCEL_TEMPLATE, _PARCEL_SQL, SEED, 'seq')} AS message FROM ({EV_SQL}) e")
def template_render(spark, sf_dir):
    e = FL.with_fields(_events(spark, sf_dir).select("seq", "ts"), PARCEL_SCHEMA, SEED, "seq", ts="ts")
    values = {n: F.col(n) for n in PARCEL_SCHEMA}
    return e.select("seq", TP.render_template(PARCEL_TEMPLATE, values, SEED, "seq").alias("message"))


# ---- fixed templates for the pick query -----------------------------------------------
ORDER_TEMPLATES = ["order {{o_orderkey}} status={{o_orderstatus}} total={{o_totalprice}}",
                   "{{timestamp}} {{real_app}} seq={{sequence}} pid={{pid}}",
                   "prio {{o_orderpriority}} on {{real_hostname}} cmd={{real_command}} {{faker.username}}"]
ORDER_WEIGHTS = [5, 3, 2]


@register("template_pick", None)
def template_pick(spark, sf_dir):
    """One of three weighted templates per order, with the default message values."""
    o = table(spark, sf_dir, "orders").withColumn("seq", F.col("o_orderkey") + 1)
    vals = {c: F.col(c) for c in ["o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]}
    vals.update(TP.default_values(SEED, "seq", F.col("seq"), F.col("o_orderdate"), "orders"))
    return o.select("seq", TP.pick_template(ORDER_TEMPLATES, ORDER_WEIGHTS, SEED, "seq", vals).alias("message"))


def _template_pick_sql():
    vals = {c: c for c in ["o_orderkey", "o_orderstatus", "o_orderpriority"]}
    vals["o_totalprice"] = "o_totalprice"
    vals.update({
        "sequence": "CAST(seq AS VARCHAR)",
        "timestamp": "(strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.%g') || 'Z')",
        "pid": f"CAST({D.sql_int_from_unit(D.sql_draw(SEED, 'seq', 'pid'), 1, 65535)} AS VARCHAR)",
        "hostname": "'localhost'", "real_hostname": "'localhost'", "real_command": "'echo ok'",
        "real_app": "'orders'", "app_name": "'orders'",
    })
    cum = FL.cumulative_weights(3, "weighted", ORDER_WEIGHTS)
    idx = (f"least(len(list_filter({[float(c) for c in cum]}, lambda c: c <= "
           f"{D.sql_draw(SEED, 'seq', 'template')} * {float(cum[-1])!r})), 2)")
    cases = " ".join(f"WHEN {idx} = {i} THEN {TP.sql_render_template(t, vals, SEED, 'seq')}"
                     for i, t in enumerate(ORDER_TEMPLATES))
    return f"SELECT seq, CASE {cases} END AS message FROM (SELECT *, o_orderkey + 1 AS seq FROM orders) o"


PAD_TARGET = 2048


@register("pad_bytes", f"SELECT doc_id, {TP.sql_pad_to_bytes('text', PAD_TARGET, SEED, 'doc_id')} AS body, "
                       f"CAST(strlen({TP.sql_pad_to_bytes('text', PAD_TARGET, SEED, 'doc_id')}) AS BIGINT) AS n_bytes "
                       "FROM documents")
def pad_bytes(spark, sf_dir):
    """Pad every document body to 2048 bytes (UTF-8 bytes, not characters); longer ones unchanged."""
    d = table(spark, sf_dir, "documents")
    body = TP.pad_to_bytes(F.col("text"), PAD_TARGET, SEED, "doc_id")
    return d.select("doc_id", body.alias("body")).withColumn("n_bytes", F.octet_length("body").cast("bigint"))


@register("mapping_lookup",
          "SELECT d.doc_id, coalesce(l.quality, -1) AS quality, coalesce(l.toxic, -1) AS toxic "
          "FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def mapping_lookup(spark, sf_dir):
    """Parent value -> child value through a lookup table, with a default when missing."""
    d = table(spark, sf_dir, "documents").select("doc_id")
    lab = table(spark, sf_dir, "labels")
    return lookup_with_default(d, lab, "doc_id", {"quality": -1, "toxic": -1})


def _late():
    from eventloom.catalog import ORACLE_SQL
    ORACLE_SQL["template_pick"] = _template_pick_sql()


_late()


# ---------------------------------------------------------------- regex text
from eventloom.functions.regex_text import regex_text  # noqa: E402

# ---- fixed patterns: a request id, a log level word, a host, free text -----------------------
REGEX_FIELDS = {
    "req": r"[A-Z]{2}-\d{3,5}(-[a-f0-9]{4})?",
    "level": r"(INFO|WARN|ERROR|DEBUG)",
    "host": r"(web|db|cache)-[0-9]{2}\.example\.(com|net)",
    "note": r"\w+ x*[^a-z\s]{1,3}\.?",
    "word": r"(unclosed",
}


def _spread_seqs(spark, sf_dir):
    """The events' seq dealt evenly over the cores: the table is small for its rows (few row groups), the work of a row is large."""
    return _events(spark, sf_dir).select("seq").repartition(4 * spark.sparkContext.defaultParallelism)


@register("regex_text")
def regex_text_q(spark, sf_dir):
    """Text generated from five patterns per event (the last one does not parse → '')."""
    e = _spread_seqs(spark, sf_dir)
    return e.select("seq", *[regex_text(p, SEED, "seq", n).alias(n) for n, p in REGEX_FIELDS.items()])


# field: pattern, and the same set as a pattern of Spark's own matcher
REGEX_SETS = {
    # letters that every Unicode version in use knows: the engines differ in later ones
    "upper": (r"[\p{Lu}&&\x{0}-\u{24F}]{2,4}-\PL+", r"[\p{Lu}&&[\x00-\u024F]]{2,4}-\P{L}+"),
    "posix": (r"[[:alpha:]_][[:^alpha:]&&[:ascii:]]{0,6}", r"[A-Za-z_][\x00-\x40\x5B-\x60\x7B-\x7F]{0,6}"),
    "consonants": (r"[a-z&&[^aeiou]]{3,9}", r"[a-z&&[^aeiou]]{3,9}"),
    "without": (r"[\p{Greek}&&\x{370}-\x{3FF}--\p{Lu}]{2}[0-9~~5-7]", r"[\p{IsGreek}&&[Ͱ-Ͽ]&&[^\p{Lu}]]{2}[0-489]"),
    "points": (r"(?<mark>\x{1F600}|\u{e9}|[]^-])\z", "(\U0001F600|\u00e9|[\\]^-])"),
}


@register("regex_sets", " UNION ALL ".join(f"SELECT '{n}' AS field, count(*) AS messages, count(*) AS matched FROM events" for n in REGEX_SETS))
def regex_sets(spark, sf_dir):
    """Texts of patterns with properties, POSIX classes and set operators: every text matches (Spark's matcher counts)."""
    e = _spread_seqs(spark, sf_dir)
    fields = F.explode(F.array(*[F.struct(F.lit(n).alias("field"), regex_text(p, SEED, "seq", n).rlike(f"^(?:{same})\\z").alias("hit"))
                                 for n, (p, same) in REGEX_SETS.items()]))
    return e.select(fields.alias("f")).groupBy("f.field").agg(F.count(F.lit(1)).alias("messages"), F.count_if("f.hit").alias("matched"))


# ---------------------------------------------------------------- per-row template column
# a value may look like a placeholder ("see {{seq}}"): it stays as it is
TPL_COLUMN_SQL = ("concat('user={{user_id}} ', CASE WHEN value > 50 THEN 'big {{}} ' ELSE '' END, "
                  "'type={{event_type}} props={{props}} note={{note}} seq={{seq}} unknown={{nope}} {{', CASE WHEN value < 20 THEN 'seq}}' ELSE ' open' END)")
NOTE_SQL = "CASE WHEN value > 80 THEN 'see {{seq}}' WHEN value < 10 THEN NULL ELSE '{{' || event_type END"
TPL_VALUES = ["user_id", "event_type", "props", "seq", "note"]


@register("template_column_render",
          f"SELECT seq, {TP.sql_render_template_column('tpl', {n: n for n in TPL_VALUES})} AS message "
          f"FROM (SELECT event_id + 1 AS seq, {TPL_COLUMN_SQL} AS tpl, {NOTE_SQL} AS note, user_id, event_type, props FROM events) e")
def template_column_render(spark, sf_dir):
    """Templates that differ per row (a template column) rendered with the row's values."""
    e = table(spark, sf_dir, "events").select((F.col("event_id") + 1).alias("seq"), F.expr(TPL_COLUMN_SQL).alias("tpl"),
                                               F.expr(NOTE_SQL).alias("note"), "user_id", "event_type", "props")
    vals = {n: F.col(n) for n in TPL_VALUES}
    return e.select("seq", TP.render_template_column(F.col("tpl"), vals).alias("message"))


@register("template_placeholders",
          f"SELECT name, count(*) AS templates FROM (SELECT unnest(list_distinct(list_filter(regexp_extract_all(tpl, '(?s)\\{{\\{{(.*?)\\}}\\}}', 1), "
          f"lambda x: x <> ''))) AS name FROM (SELECT {TPL_COLUMN_SQL} AS tpl FROM events) e) n GROUP BY name")
def template_placeholders(spark, sf_dir):
    """The distinct placeholder names of a template column, and how many templates have each."""
    e = table(spark, sf_dir, "events").select(F.expr(TPL_COLUMN_SQL).alias("tpl"))
    return e.select(F.explode(TP.placeholder_names(F.col("tpl"))).alias("name")).groupBy("name").agg(F.count("*").alias("templates"))


# ---------------------------------------------------------------- large-domain Zipf pick
from eventloom.operators import picks  # noqa: E402

ZIPF_PARTS_S = 1.1


@register("enum_zipf_domain",
          f"WITH w AS (SELECT p_partkey, 1.0 / pow(CAST(p_partkey + 1 AS DOUBLE), {ZIPF_PARTS_S!r}) AS wt FROM part), "
          "c AS (SELECT p_partkey, sum(wt) OVER (ORDER BY p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS hi, wt FROM w), "
          "t AS (SELECT sum(wt) AS total FROM w), "
          f"e AS (SELECT event_id + 1 AS seq, {D.sql_draw(SEED, 'event_id + 1', 'part')} * (SELECT total FROM t) AS x FROM events) "
          "SELECT e.seq, c.p_partkey FROM e JOIN c ON e.x >= c.hi - c.wt AND e.x < c.hi")
def enum_zipf_domain(spark, sf_dir):
    """A Zipf(1.1) pick of one part per event over the whole part table (rank = partkey + 1)."""
    parts = picks.zipf_weights(table(spark, sf_dir, "part").select("p_partkey").withColumn("rank", F.col("p_partkey") + 1),
                               "rank", ZIPF_PARTS_S)
    t = picks.pick_table(parts, "p_partkey", "_w")
    e = _events(spark, sf_dir).select("seq")
    return picks.pick_by_weight(e, SEED, "seq", "part", t, keep=["seq", "p_partkey"])
