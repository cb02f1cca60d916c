"""Wire formats as Column expressions: RFC 5424, RFC 3164, raw, CEF, LEEF, JSON lines,
plus frames (octet counting / LF) and header helpers.

Every renderer is a tree of built-in string functions, so a rendered event is one
codegen'd projection; constant header parts fold to literals.
"""

from __future__ import annotations

from typing import Mapping

from pyspark.sql import Column, functions as F

# ---- fixed values (RFC 5424 / reference limits and names) ---------------------------
NILVALUE = "-"
BOM = "﻿"  # encodes to EF BB BF
HOSTNAME_MAX = 255
APP_NAME_MAX = 48
PROCID_MAX = 128
MSGID_MAX = 32
RFC3164_TAG_MAX = 32
SEVERITY_NAMES = ["Emergency", "Alert", "Critical", "Error", "Warning", "Notice",
                  "Informational", "Debug"]
FORMATS = ("rfc5424", "rfc3164", "raw", "protobuf", "cef", "leef", "json_lines")
# --------------------------------------------------------------------------------------

RFC5424_TS = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"


def _c(x) -> Column:
    if isinstance(x, Column):
        return x
    return F.lit(x)


def prival(facility, severity) -> Column:
    """PRI = min(facility, 23) * 8 + min(severity, 7)."""
    return (F.least(_c(facility), F.lit(23)) * 8 + F.least(_c(severity), F.lit(7))).cast("int")


def sanitize_header(value, max_len: int) -> Column:
    """Empty or ``-`` gives ``-``; bytes outside ``!``..``~`` become ``_``; cut to ``max_len``."""
    v = _c(value).cast("string")
    cleaned = F.left(F.regexp_replace(v, "[^!-~]", "_"), F.lit(max_len))
    return F.when(v.isNull() | (v == "") | (v == NILVALUE), F.lit(NILVALUE)).otherwise(cleaned)


def sd_escape(value) -> Column:
    """Structured-data PARAM-VALUE escape: backslash before ``"``, ``\\`` and ``]``."""
    v = _c(value)
    return F.replace(F.replace(F.replace(v, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')),
                     F.lit("]"), F.lit("\\]"))


def severity_name(severity) -> Column:
    return F.element_at(F.array(*[F.lit(s) for s in SEVERITY_NAMES]),
                        (F.least(_c(severity), F.lit(7)) + 1).cast("int"))


def ts_rfc5424(ts) -> Column:
    """``YYYY-MM-DDTHH:MM:SS.mmmZ``; pass a UTC (or zone-less) timestamp."""
    return F.date_format(_c(ts), RFC5424_TS)


def ts_rfc3164(ts) -> Column:
    """``Mmm dd hh:mm:ss`` with the day padded by a space."""
    t = _c(ts)
    return F.concat(F.date_format(t, "MMM"), F.lit(" "), F.lpad(F.dayofmonth(t).cast("string"), 2, " "),
                    F.lit(" "), F.date_format(t, "HH:mm:ss"))


def rfc5424(msg, *, ts, facility=1, severity=6, hostname="-", app_name="-", procid="-",
            msgid="-", structured_data="-", bom: bool = False) -> Column:
    """``<PRI>1 TS HOST APP PROCID MSGID SD [BOM]MSG``."""
    sd = _c(structured_data)
    sd = F.when(sd.isNull() | (sd == ""), F.lit(NILVALUE)).otherwise(sd)
    parts = [
        F.lit("<"), prival(facility, severity).cast("string"), F.lit(">1 "), ts_rfc5424(ts), F.lit(" "),
        sanitize_header(hostname, HOSTNAME_MAX), F.lit(" "),
        sanitize_header(app_name, APP_NAME_MAX), F.lit(" "),
        sanitize_header(procid, PROCID_MAX), F.lit(" "),
        sanitize_header(msgid, MSGID_MAX), F.lit(" "), sd, F.lit(" "),
    ]
    if bom:
        parts.append(F.lit(BOM))
    parts.append(F.coalesce(_c(msg).cast("string"), F.lit("")))
    return F.concat(*parts)


def rfc3164(msg, *, ts, facility=1, severity=6, hostname="-", app_name="-", procid="-") -> Column:
    """``<PRI>Mmm dd hh:mm:ss HOST TAG[PID]: MSG`` (host ``-`` → localhost, app ``-`` → app)."""
    host = sanitize_header(hostname, HOSTNAME_MAX)
    host = F.when(host == NILVALUE, F.lit("localhost")).otherwise(host)
    app = sanitize_header(app_name, RFC3164_TAG_MAX)
    app = F.when(app == NILVALUE, F.lit("app")).otherwise(app)
    pid = sanitize_header(procid, PROCID_MAX)
    tag_end = F.when(pid == NILVALUE, F.lit(":")).otherwise(F.concat(F.lit("["), pid, F.lit("]:")))
    return F.concat(F.lit("<"), prival(facility, severity).cast("string"), F.lit(">"), ts_rfc3164(ts),
                    F.lit(" "), host, F.lit(" "), app, tag_end, F.lit(" "),
                    F.coalesce(_c(msg).cast("string"), F.lit("")))


def raw(msg) -> Column:
    return F.coalesce(_c(msg).cast("string"), F.lit(""))


def _esc_pipe(v: Column) -> Column:
    return F.replace(F.replace(v, F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|"))


def cef_value_escape(v) -> Column:
    return F.replace(_esc_pipe(_c(v).cast("string")), F.lit("="), F.lit("\\="))


def leef_value_escape(v) -> Column:
    x = F.replace(F.replace(_c(v).cast("string"), F.lit("\\"), F.lit("\\\\")), F.lit("="), F.lit("\\="))
    return F.replace(F.replace(x, F.lit("\t"), F.lit("\\t")), F.lit("\n"), F.lit("\\n"))


def cef(msg, *, vendor, product, version, signature_id, name, severity=0,
        extensions: Mapping[str, object] | None = None) -> Column:
    """``CEF:0|vendor|product|version|sig|name|sev|k=v … msg=body``; keys sorted."""
    parts = [F.lit("CEF:0|")]
    for i, h in enumerate([vendor, product, version, signature_id, name]):
        parts += [_esc_pipe(_c(h).cast("string")), F.lit("|")]
    parts += [_c(severity).cast("string"), F.lit("|")]
    for k in sorted(extensions or {}):
        parts += [F.lit(f"{k}="), cef_value_escape(F.coalesce(_c(extensions[k]).cast("string"), F.lit(""))),
                  F.lit(" ")]
    parts += [F.lit("msg="), cef_value_escape(F.coalesce(_c(msg).cast("string"), F.lit("")))]
    return F.concat(*parts)


def leef(msg, *, vendor, product, version, event_id,
         attributes: Mapping[str, object] | None = None) -> Column:
    """``LEEF:2.0|vendor|product|version|event<TAB>k=v<TAB>…msg=body<LF>``."""
    parts = [F.lit("LEEF:2.0|")]
    for i, h in enumerate([vendor, product, version, event_id]):
        parts.append(_esc_pipe(_c(h).cast("string")))
        parts.append(F.lit("|" if i < 3 else "\t"))
    for k in sorted(attributes or {}):
        parts += [F.lit(f"{k}="), leef_value_escape(F.coalesce(_c(attributes[k]).cast("string"), F.lit(""))),
                  F.lit("\t")]
    parts += [F.lit("msg="), leef_value_escape(F.coalesce(_c(msg).cast("string"), F.lit(""))), F.lit("\n")]
    return F.concat(*parts)


_UPPER_CTRL = ["000B", "000E", "000F", "001A", "001B", "001C", "001D", "001E", "001F"]


def _json_lower_hex(js: Column) -> Column:
    """Spark writes ``\\u001B``; the format (and DuckDB) write ``\\u001b``. Fix real escapes only."""
    fixed = js
    for code in _UPPER_CTRL:
        fixed = F.regexp_replace(fixed, r"(?<!\\)((?:\\\\)*)\\u" + code, "$1\\\\u" + code.lower())
    return F.when(F.instr(js, "\\u00") > 0, fixed).otherwise(js)


def json_lines(msg, *, ts, severity=6, facility=1, hostname="-", app_name="-", procid="-",
               msgid="-", extras: Mapping[str, object] | None = None, newline: bool = True) -> Column:
    """One JSON object per event: ts, level, facility, host, app, procid?, msgid?, msg, extras.

    All values are strings; keys are sorted; procid/msgid are left out when empty or ``-``;
    extras override built-in keys.
    """
    def opt(v):
        c = _c(v).cast("string")
        return F.when((c == "") | (c == NILVALUE), F.lit(None).cast("string")).otherwise(c)

    fields = {
        "ts": ts_rfc5424(ts),
        "level": severity_name(severity),
        "facility": F.least(_c(facility), F.lit(23)).cast("string"),
        "host": _c(hostname).cast("string"),
        "app": _c(app_name).cast("string"),
        "procid": opt(procid),
        "msgid": opt(msgid),
        "msg": F.coalesce(_c(msg).cast("string"), F.lit("")),
    }
    for k, v in (extras or {}).items():
        fields[k] = _c(v).cast("string")
    js = F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]))
    js = _json_lower_hex(js)
    return F.concat(js, F.lit("\n")) if newline else js


def frame_octet(msg) -> Column:
    """Octet counting: ``LEN SP msg`` with LEN in bytes."""
    m = _c(msg)
    return F.concat(F.octet_length(m).cast("string"), F.lit(" "), m)


def frame_lf(msg) -> Column:
    return F.concat(_c(msg), F.lit("\n"))


def frame(msg, framing: str | None) -> Column:
    f = (framing or "").lower()
    if f in ("octet-counting", "octet_counting", "octet"):
        return frame_octet(msg)
    return frame_lf(msg)


def wire_bytes(msg, framing: str | None) -> Column:
    """Bytes on the wire for a message under ``framing``."""
    return F.octet_length(frame(msg, framing)).cast("bigint")


def render(fmt: str, msg, **kw) -> Column:
    """Dispatch by format name; unknown names render raw. ``protobuf`` takes its field spec as ``fields``, gives binary,
    and its templates see hostname, app_name, procid and msgid; the message itself is no field."""
    f = (fmt or "raw").lower()
    if f == "protobuf":
        from eventloom.functions.protobuf import encode_protobuf
        header = {}
        for k in ("hostname", "app_name", "procid", "msgid"):
            v = kw.get(k)
            header[k] = v if isinstance(v, Column) else F.lit("" if v is None else str(v))
        return encode_protobuf(kw.get("fields") or {}, header)
    if f == "rfc5424":
        return rfc5424(msg, **{k: v for k, v in kw.items() if k in (
            "ts", "facility", "severity", "hostname", "app_name", "procid", "msgid", "structured_data", "bom")})
    if f == "rfc3164":
        return rfc3164(msg, **{k: v for k, v in kw.items() if k in (
            "ts", "facility", "severity", "hostname", "app_name", "procid")})
    if f == "cef":
        return cef(msg, **kw.get("cef", {}))
    if f == "leef":
        return leef(msg, **kw.get("leef", {}))
    if f in ("json_lines", "json-lines", "jsonl"):
        return json_lines(msg, **{k: v for k, v in kw.items() if k in (
            "ts", "severity", "facility", "hostname", "app_name", "procid", "msgid", "extras")})
    return raw(msg)
