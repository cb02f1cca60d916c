"""Rendering queries: header helpers, the seven wire formats, frames and unframing."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from eventloom.catalog import SEED, register, table
from eventloom.functions import fakers as FK
from eventloom.functions import formats as fm
from eventloom.functions import sql_formats as sf
from eventloom.plans.session import ensure_checkpoint_dir
from eventloom.sources import framed
from eventloom.sources.messages import SQL_EVENTS_AS_MESSAGES, events_as_messages

M_SQL = f"({SQL_EVENTS_AS_MESSAGES}) m"


def _msgs(spark, sf_dir):
    return events_as_messages(table(spark, sf_dir, "events"))


@register("prival", "SELECT event_id, " + sf.prival("CAST(user_id % 30 AS INTEGER)", "CAST(event_id % 10 AS INTEGER)")
          + " AS pri FROM events")
def prival(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("event_id", fm.prival((F.col("user_id") % 30).cast("int"), (F.col("event_id") % 10).cast("int")).alias("pri"))


@register("sanitize_header",
          f"SELECT doc_id, {sf.sanitize('text', 48)} AS app48, {sf.sanitize('source', 255)} AS host, "
          f"{sf.sanitize('lang', 32)} AS msgid FROM documents")
def sanitize_header(spark, sf_dir):
    """Header sanitizing on free text: non-printable/non-ASCII → '_', cut to the field limit."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", fm.sanitize_header(F.col("text"), 48).alias("app48"),
                    fm.sanitize_header(F.col("source"), 255).alias("host"),
                    fm.sanitize_header(F.col("lang"), 32).alias("msgid"))


@register("sd_escape", f"SELECT conv_id, turn, '[meta role=\"' || {sf.sd_escape('role')} || '\" text=\"' || "
                       f"{sf.sd_escape('text')} || '\"]' AS sd FROM conversations")
def sd_escape(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", F.concat(F.lit('[meta role="'), fm.sd_escape(F.col("role")), F.lit('" text="'),
                                                fm.sd_escape(F.col("text")), F.lit('"]')).alias("sd"))


@register("severity_name", f"SELECT event_id, {sf.severity_name('CAST(event_id % 10 AS INTEGER)')} AS level FROM events")
def severity_name(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("event_id", fm.severity_name((F.col("event_id") % 10).cast("int")).alias("level"))


_SD_SQL = f"'[ev@32473 user=\"' || CAST(user_id AS VARCHAR) || '\" props=\"' || {sf.sd_escape('props')} || '\"]'"


@register("fmt_rfc5424",
          f"SELECT seq, {sf.rfc5424('body', 'ts', '16', 'severity', 'hostname', 'app_name', 'CAST(user_id AS VARCHAR)', 'upper(app_name)', 'sd')} AS message, "
          f"{sf.rfc5424('body', 'ts', '16', 'severity', 'hostname', 'app_name', bom=True)} AS message_bom "
          f"FROM (SELECT m.*, e.user_id, {_SD_SQL} AS sd FROM {M_SQL} JOIN events e ON m.seq = e.event_id + 1) x")
def fmt_rfc5424(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    sd = F.concat(F.lit('[ev@32473 user="'), F.col("user_id").cast("string"), F.lit('" props="'),
                  fm.sd_escape(F.col("props")), F.lit('"]'))
    m = e.select((F.col("event_id") + 1).alias("seq"), "ts", "user_id", "props", "event_type",
                 F.concat(F.lit("host-"), F.col("user_id").cast("string")).alias("hostname"),
                 F.when(F.col("event_type") == "error", 3).otherwise(6).alias("severity"), sd.alias("sd"))
    return m.select("seq", fm.rfc5424(F.col("props"), ts=F.col("ts"), facility=16, severity=F.col("severity"),
                                      hostname=F.col("hostname"), app_name=F.col("event_type"),
                                      procid=F.col("user_id").cast("string"), msgid=F.upper("event_type"),
                                      structured_data=F.col("sd")).alias("message"),
                    fm.rfc5424(F.col("props"), ts=F.col("ts"), facility=16, severity=F.col("severity"),
                               hostname=F.col("hostname"), app_name=F.col("event_type"), bom=True).alias("message_bom"))


@register("fmt_rfc3164", f"SELECT seq, {sf.rfc3164('body', 'ts', '4', 'severity', 'hostname', 'app_name', 'CAST(seq % 100 AS VARCHAR)')} AS message, "
                         f"{sf.rfc3164('body', 'ts', '4', 'severity')} AS message_nil FROM {M_SQL}")
def fmt_rfc3164(spark, sf_dir):
    m = _msgs(spark, sf_dir)
    return m.select("seq", fm.rfc3164(F.col("body"), ts=F.col("ts"), facility=4, severity=F.col("severity"),
                                      hostname=F.col("hostname"), app_name=F.col("app_name"),
                                      procid=(F.col("seq") % 100).cast("string")).alias("message"),
                    fm.rfc3164(F.col("body"), ts=F.col("ts"), facility=4, severity=F.col("severity")).alias("message_nil"))


@register("fmt_raw", "SELECT doc_id, coalesce(text, '') AS message, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n_bytes FROM documents")
def fmt_raw(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", fm.raw(F.col("text")).alias("message")).withColumn(
        "n_bytes", F.octet_length("message").cast("bigint"))


# ---- fixed CEF / LEEF headers for the format queries ----------------------------------
CEF_HDR = dict(vendor="Acme|Corp", product="Event\\Mill", version="1.0", signature_id="100", name="web_event")
LEEF_HDR = dict(vendor="Acme", product="Event|Mill", version="2.1", event_id="evt001")


def _cef_ext_spark():
    return {"src": FK.faker("ipv4", SEED, "seq"), "suser": FK.faker("username", SEED, "seq"),
            "act": F.col("app_name"), "cs1": F.col("hostname")}


def _cef_ext_sql():
    return {"src": FK.sql_faker("ipv4", SEED, "seq"), "suser": FK.sql_faker("username", SEED, "seq"),
            "act": "app_name", "cs1": "hostname"}


@register("fmt_cef", f"SELECT seq, {sf.cef('body', *[sf.q(v) for v in CEF_HDR.values()], 'severity', _cef_ext_sql())} AS message FROM {M_SQL}")
def fmt_cef(spark, sf_dir):
    m = _msgs(spark, sf_dir)
    return m.select("seq", fm.cef(F.col("body"), severity=F.col("severity"), extensions=_cef_ext_spark(),
                                  **CEF_HDR).alias("message"))


@register("fmt_cef_text", f"SELECT doc_id, {sf.cef('text', *[sf.q(v) for v in CEF_HDR.values()], '5', {'lang': 'lang', 'src': 'source'})} AS message FROM documents")
def fmt_cef_text(spark, sf_dir):
    """CEF over free text: escapes for backslash, pipe and '=' in long, multi-line bodies."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", fm.cef(F.col("text"), severity=5, extensions={"lang": F.col("lang"), "src": F.col("source")},
                                     **CEF_HDR).alias("message"))


@register("fmt_leef", f"SELECT doc_id, {sf.leef('text', *[sf.q(v) for v in LEEF_HDR.values()], {'lang': 'lang', 'src': 'source', 'chars': 'n_chars'})} AS message FROM documents")
def fmt_leef(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", fm.leef(F.col("text"), attributes={"lang": F.col("lang"), "src": F.col("source"),
                                                                   "chars": F.col("n_chars")}, **LEEF_HDR).alias("message"))


_JSON_EXTRAS_SQL = {"conv": "CAST(conv_id AS VARCHAR)", "host": "'override-host'", "role": "role", "lang": "'x'"}


@register("fmt_json_lines",
          f"SELECT conv_id, turn, {sf.json_lines('text', "TIMESTAMP '2026-01-01 00:00:00'", '6', '16', 'role', "'chat'", 'CAST(turn AS VARCHAR)', "'-'", _JSON_EXTRAS_SQL)} AS message FROM conversations")
def fmt_json_lines(spark, sf_dir):
    """JSON lines over multi-line chat text; 4 extras, one overriding ``host``; msgid '-' left out."""
    c = table(spark, sf_dir, "conversations")
    ts = F.lit("2026-01-01 00:00:00").cast("timestamp_ntz")
    return c.select("conv_id", "turn", fm.json_lines(
        F.col("text"), ts=ts, severity=6, facility=16, hostname=F.col("role"), app_name="chat",
        procid=F.col("turn").cast("string"), msgid="-",
        extras={"conv": F.col("conv_id").cast("string"), "host": F.lit("override-host"), "role": F.col("role"),
                "lang": F.lit("x")}).alias("message"))


# ---- fixed format-per-app mapping for the mixed query ---------------------------------
MIXED = {"click": "rfc5424", "purchase": "cef", "error": "json_lines", "signup": "leef", "view": "rfc3164"}


def _mixed_sql():
    whens = []
    for app, f in MIXED.items():
        if f == "rfc5424":
            r = sf.rfc5424("body", "ts", "1", "severity", "hostname", "app_name")
        elif f == "rfc3164":
            r = sf.rfc3164("body", "ts", "1", "severity", "hostname", "app_name")
        elif f == "cef":
            r = sf.cef("body", *[sf.q(v) for v in CEF_HDR.values()], "severity", _cef_ext_sql())
        elif f == "leef":
            r = sf.leef("body", *[sf.q(v) for v in LEEF_HDR.values()], {"host": "hostname"})
        else:
            r = sf.json_lines("body", "ts", "severity", "1", "hostname", "app_name")
        whens.append(f"WHEN '{app}' THEN {r}")
    return f"SELECT seq, CASE app_name {' '.join(whens)} ELSE coalesce(body, '') END AS message FROM {M_SQL}"


@register("fmt_mixed", _mixed_sql())
def fmt_mixed(spark, sf_dir):
    """Format chosen per row (by app): one CASE in one projection."""
    m = _msgs(spark, sf_dir)
    hdr = dict(ts=F.col("ts"), facility=1, severity=F.col("severity"), hostname=F.col("hostname"),
               app_name=F.col("app_name"))
    out = None
    for app, f in MIXED.items():
        if f == "cef":
            r = fm.cef(F.col("body"), severity=F.col("severity"), extensions=_cef_ext_spark(), **CEF_HDR)
        elif f == "leef":
            r = fm.leef(F.col("body"), attributes={"host": F.col("hostname")}, **LEEF_HDR)
        else:
            r = fm.render(f, F.col("body"), **hdr)
        cond = F.col("app_name") == app
        out = F.when(cond, r) if out is None else out.when(cond, r)
    return m.select("seq", out.otherwise(fm.raw(F.col("body"))).alias("message"))


@register("frame_octet", f"SELECT doc_id, {sf.frame_octet('text')} AS framed, CAST(strlen({sf.frame_octet('text')}) AS BIGINT) AS wire_bytes FROM documents")
def frame_octet(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", fm.frame_octet(F.col("text")).alias("framed"),
                    fm.wire_bytes(F.col("text"), "octet-counting").alias("wire_bytes"))


@register("frame_lf", f"SELECT conv_id, turn, {sf.frame_lf('text')} AS framed, CAST(strlen(text) + 1 AS BIGINT) AS wire_bytes FROM conversations")
def frame_lf(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", fm.frame_lf(F.col("text")).alias("framed"),
                    fm.wire_bytes(F.col("text"), "lf").alias("wire_bytes"))


@register("unframe_lf",
          "SELECT doc_id, pos, body, CAST(strlen(body) AS BIGINT) AS body_bytes, CAST(strlen(body) + 1 AS BIGINT) AS wire_bytes "
          "FROM (SELECT doc_id, unnest(parts) AS body, unnest(range(len(parts))) AS pos, len(parts) AS n "
          "FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents)) WHERE pos < n - 1")
def unframe_lf(spark, sf_dir):
    """Each document text is one LF-framed byte stream: every complete line is a frame,
    an unterminated tail is not."""
    d = table(spark, sf_dir, "documents")
    return framed.split_lf(d, "doc_id", "text")


_OCT_SQL = (
    "WITH l AS (SELECT doc_id, unnest(parts) AS body, unnest(range(len(parts))) AS idx FROM "
    "(SELECT doc_id, string_split(CASE WHEN doc_id % 5 = 0 THEN text || chr(10) || chr(10) || 'tail' ELSE text END, chr(10)) AS parts FROM documents)), "
    "p AS (SELECT *, CAST(coalesce(sum(strlen(CAST(strlen(body) AS VARCHAR)) + 1 + strlen(body)) OVER "
    "(PARTITION BY doc_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS pos, "
    "min(CASE WHEN strlen(body) = 0 OR strlen(body) > 65535 THEN idx END) OVER (PARTITION BY doc_id) AS bad FROM l) "
    "SELECT doc_id, pos, CASE WHEN bad IS NOT NULL AND idx = bad THEN NULL ELSE body END AS body, "
    "CASE WHEN bad IS NOT NULL AND idx = bad THEN NULL ELSE CAST(strlen(CAST(strlen(body) AS VARCHAR)) + 1 + strlen(body) AS BIGINT) END AS wire_bytes, "
    "CASE WHEN bad IS NOT NULL AND idx = bad THEN 'octet-counting: implausible length ' || CAST(strlen(body) AS VARCHAR) END AS error "
    "FROM p WHERE bad IS NULL OR idx <= bad"
)


@register("unframe_octet", _OCT_SQL)
def unframe_octet(spark, sf_dir):
    """Round trip: each document's lines are octet-count framed into one stream (F11), then the
    stream is decoded frame by frame (stops at an implausible length, as a receiver does: every
    fifth stream has an empty frame before its last one)."""
    d = table(spark, sf_dir, "documents")
    text = F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("\n\ntail"))).otherwise(F.col("text"))
    blobs = d.select("doc_id", F.array_join(F.transform(F.split(text, "\n", -1), lambda l: fm.frame_octet(l)), "")
                     .alias("stream"))
    return framed.decode_octet(blobs, "doc_id", "stream")


@register("scan_lf_files",
          "SELECT body, CAST(strlen(body) AS BIGINT) AS body_bytes, CAST(strlen(body) + 1 AS BIGINT) AS wire_bytes, count(*) AS frames "
          "FROM (SELECT unnest(string_split(text, chr(10))) AS body FROM documents WHERE text IS NOT NULL) GROUP BY ALL")
def scan_lf_files(spark, sf_dir):
    """Texts written as LF-framed capture files in the shared folder and scanned back in byte ranges: how often each frame came."""
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/captures/{uuid.uuid4().hex}"
    table(spark, sf_dir, "documents").filter("text IS NOT NULL").select("text").write.option("lineSep", "\n").text(folder)
    frames = framed.read_lf_files(spark, folder)
    return frames.groupBy("body", "body_bytes", "wire_bytes").agg(F.count("*").alias("frames"))


PIECE = 16_000          # characters of a frame at most (64 000 bytes)
OCTET_SCAN_RANGE = 1 << 17


@register("scan_octet_files",
          f"SELECT body, CAST(strlen(body) AS BIGINT) AS body_bytes, CAST(strlen(CAST(strlen(body) AS VARCHAR)) + 1 + strlen(body) AS BIGINT) AS wire_bytes, "
          f"count(*) AS frames FROM (SELECT substr(text, CAST(1 + {PIECE} * i AS BIGINT), {PIECE}) || chr(10) AS body FROM "
          f"(SELECT text, unnest(range(greatest(1, CAST(ceil(length(text) / {PIECE}.0) AS BIGINT)))) AS i FROM documents WHERE text IS NOT NULL)) GROUP BY ALL")
def scan_octet_files(spark, sf_dir):
    """Texts in frames of at most ``PIECE`` characters (each with a line end), written as octet-counted capture files
    in the shared folder and scanned back in byte ranges: how often each frame came."""
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/captures/{uuid.uuid4().hex}"
    text = table(spark, sf_dir, "documents").filter("text IS NOT NULL").select("text")
    last = F.greatest(F.ceil(F.length("text") / F.lit(float(PIECE))), F.lit(1)).cast("int") - 1
    piece = text.select("text", F.explode(F.sequence(F.lit(0), last)).alias("i")).select(F.substring("text", F.lit(1) + F.col("i") * PIECE, F.lit(PIECE)).alias("piece"))
    framed_lines = piece.select(F.concat((F.octet_length("piece") + 1).cast("string"), F.lit(" "), F.col("piece")).alias("value"))
    framed_lines.write.option("lineSep", "\n").text(folder)      # the line end is the last byte of each body
    frames = framed.read_octet_files(spark, f"{folder}/part-*", OCTET_SCAN_RANGE)
    return frames.groupBy("body").agg(F.count("*").alias("frames"), F.first("wire_bytes").alias("wire_bytes")) \
        .select("body", F.octet_length("body").cast("bigint").alias("body_bytes"), "wire_bytes", "frames")


# ---------------------------------------------------------------- protobuf
from eventloom.functions import protobuf as PB  # noqa: E402

# ---- fixed spec: one field of each wire kind, an unsigned one above 2^63 ---------------------
PB_SPEC = {"id": "1:uint:{{vec_id}}", "label": "2:sint:{{label_delta}}", "norm": "3:double:{{norm}}",
           "first": "4:float:{{first}}", "tag": "5:str:vec-{{vec_id}}/{{label}}", "ok": "6:bool:{{ok}}",
           "n": "7:int:{{dims}}", "raw": "plain {{label}}", "far": "17:uint:{{far}}", "below": "18:int:-{{label}}"}
TOP_UINT = 18446744073709551615


def _embedding_messages(spark, sf_dir, encode):
    e = table(spark, sf_dir, "embeddings")
    norm = F.sqrt(F.aggregate(F.col("embedding"), F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))
    vals = {"vec_id": F.col("vec_id"), "label": F.col("label"), "label_delta": F.col("label") - 5,
            "norm": norm, "first": F.element_at("embedding", 1), "ok": (F.col("label") % 2 == 0).cast("string"),
            "dims": F.size("embedding"), "far": F.lit(str(TOP_UINT)).cast("decimal(20,0)") - F.col("vec_id")}
    return e.select("vec_id", encode(PB_SPEC, vals).alias("message"))


def _protobuf_sql():
    norm = "sqrt(list_reduce(list_prepend(0.0::DOUBLE, list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)), lambda a, b: a + b))"
    parts = {"id": "vec_id", "label": "label - 5", "norm": norm, "first": "embedding[1]", "tag": "('vec-' || vec_id || '/' || label)", "ok": "label % 2 = 0",
             "n": "len(embedding)", "raw": "('plain ' || label)", "far": f"({TOP_UINT}::HUGEINT - vec_id)", "below": "-label"}
    fields = " || ".join(PB.sql_field_hex(num, typ, parts[name]) for num, typ, _, name in PB.parse_spec(PB_SPEC))
    return f"SELECT vec_id, {fields} AS message FROM embeddings"


@register("protobuf_encode", _protobuf_sql())
def protobuf_encode(spark, sf_dir):
    """Protobuf messages from embeddings, as hex: uint ids (one above 2^63), zigzag label delta, double L2 norm,
    float first component, string tag, bool, int dimension count, negative int, auto-numbered string."""
    return _embedding_messages(spark, sf_dir, PB.encode_protobuf).select("vec_id", F.hex("message").alias("message"))


@register("protobuf_decode",
          f"SELECT vec_id, CAST(vec_id AS DECIMAL(20,0)) AS id, CAST({TOP_UINT}::HUGEINT - vec_id AS DECIMAL(20,0)) AS far, "
          "'vec-' || vec_id || '/' || label AS tag, 10 AS fields FROM embeddings")
def protobuf_decode(spark, sf_dir):
    """The messages of protobuf_encode, encoded column by column and read back: unsigned values exact up to 2^64-1."""
    m = _embedding_messages(spark, sf_dir, PB.encode_protobuf_columns).withColumn("f", PB.decode_protobuf(F.col("message")))

    def one(number):
        return F.filter("f", lambda x: x["number"] == number)[0]
    return m.select("vec_id", one(1)["value"].alias("id"), one(17)["value"].alias("far"), F.decode(one(5)["bytes"], "UTF-8").alias("tag"),
                    F.size("f").alias("fields"))


# ---- fixed spec of a protobuf phase: header fields only ---------------------------------------
PB_HEADER_SPEC = {"host": "1:str:{{hostname}}", "app": "2:str:{{app_name}}", "pid": "3:uint:{{procid}}"}


@register("fmt_protobuf", "SELECT seq, " + " || ".join(PB.sql_field_hex(n, t, v) for n, t, v in (
    (1, "str", "hostname"), (2, "str", "app_name"), (3, "uint", "seq"))) + f" AS message FROM {M_SQL}")
def fmt_protobuf(spark, sf_dir):
    """A protobuf phase through the format dispatch, as hex: fields from the message's header."""
    m = _msgs(spark, sf_dir)
    out = fm.render("protobuf", F.col("body"), fields=PB_HEADER_SPEC, hostname=F.col("hostname"), app_name=F.col("app_name"), procid=F.col("seq"))
    return m.select("seq", F.hex(out).alias("message"))


# ---------------------------------------------------------------- header fields from templates
from eventloom.catalog.q_fields import PARCEL_SCHEMA, _PARCEL_SQL  # noqa: E402
from eventloom.functions import fields as FL  # noqa: E402
from eventloom.functions import templates as TP  # noqa: E402

# ---- fixed header templates ------------------------------------------------------------------
HEADER_TEMPLATES = {"hostname": "{{faker.hostname}}", "app_name": "{{real_app}}-svc", "procid": "{{pid}}",
                    "msgid": "{{next_step}}_{{reading}}", "structured_data": '[depot name="{{depot}}" lane="{{lane}}"]'}
BODY_TEMPLATE = "{{depot}} {{lane}} {{reading}} {{grams}}"


@register("fmt_header_templates", None)
def fmt_header_templates(spark, sf_dir):
    """RFC 5424 whose header fields are themselves templates over the event's values."""
    e = table(spark, sf_dir, "events").select((F.col("event_id") + 1).alias("seq"), "ts", "event_type")
    e = FL.with_fields(e, PARCEL_SCHEMA, SEED, "seq", ts="ts")
    vals = {n: F.col(n) for n in PARCEL_SCHEMA}
    vals.update(TP.default_values(SEED, "seq", F.col("seq"), F.col("ts"), F.col("event_type")))
    hdr = {k: TP.render_template(t, vals, SEED, "seq") for k, t in HEADER_TEMPLATES.items()}
    body = TP.render_template(BODY_TEMPLATE, vals, SEED, "seq")
    return e.select("seq", fm.rfc5424(body, ts=F.col("ts"), facility=16, severity=6, **hdr).alias("message"))


def _hdr_sql():
    from eventloom.functions import draws as D
    vals = dict(_PARCEL_SQL)
    vals.update({"sequence": "CAST(seq AS VARCHAR)", "timestamp": "(strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || 'Z')",
                 "pid": f"CAST({D.sql_int_from_unit(D.sql_draw(SEED, 'seq', 'pid'), 1, 65535)} AS VARCHAR)",
                 "hostname": "'localhost'", "real_hostname": "'localhost'", "real_command": "'echo ok'",
                 "real_app": "event_type", "app_name": "event_type"})
    h = {k: TP.sql_render_template(t, vals, SEED, "seq") for k, t in HEADER_TEMPLATES.items()}
    body = TP.sql_render_template(BODY_TEMPLATE, vals, SEED, "seq")
    msg = sf.rfc5424(body, "ts", "16", "6", h["hostname"], h["app_name"], h["procid"], h["msgid"], h["structured_data"])
    return f"SELECT seq, {msg} AS message FROM (SELECT event_id + 1 AS seq, ts, event_type FROM events) e"


def _late_hdr():
    from eventloom.catalog import ORACLE_SQL
    ORACLE_SQL["fmt_header_templates"] = _hdr_sql()


_late_hdr()
