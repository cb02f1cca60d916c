"""DuckDB SQL mirrors of :mod:`eventloom.functions.formats` (oracle side only)."""

from __future__ import annotations

from eventloom.functions.formats import (APP_NAME_MAX, HOSTNAME_MAX, MSGID_MAX, PROCID_MAX,
                                         RFC3164_TAG_MAX, SEVERITY_NAMES)


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def prival(f: str, s: str) -> str:
    return f"CAST(least({f}, 23) * 8 + least({s}, 7) AS INTEGER)"


def sanitize(v: str, max_len: int) -> str:
    return (f"(CASE WHEN {v} IS NULL OR {v} = '' OR {v} = '-' THEN '-' "
            f"ELSE left(regexp_replace({v}, '[^!-~]', '_', 'g'), {max_len}) END)")


def sd_escape(v: str) -> str:
    return f"replace(replace(replace({v}, '\\', '\\\\'), '\"', '\\\"'), ']', '\\]')"


def severity_name(s: str) -> str:
    arr = "[" + ", ".join(q(n) for n in SEVERITY_NAMES) + "]"
    return f"{arr}[least({s}, 7) + 1]"


def ts5424(ts: str) -> str:
    return f"(strftime({ts}, '%Y-%m-%dT%H:%M:%S.%g') || 'Z')"


def ts3164(ts: str) -> str:
    return f"(strftime({ts}, '%b') || ' ' || lpad(CAST(day({ts}) AS VARCHAR), 2, ' ') || ' ' || strftime({ts}, '%H:%M:%S'))"


def rfc5424(msg: str, ts: str, f: str = "1", s: str = "6", host: str = "'-'", app: str = "'-'",
            procid: str = "'-'", msgid: str = "'-'", sd: str = "'-'", bom: bool = False) -> str:
    sdx = f"(CASE WHEN {sd} IS NULL OR {sd} = '' THEN '-' ELSE {sd} END)"
    b = "chr(65279) || " if bom else ""
    return (f"('<' || CAST({prival(f, s)} AS VARCHAR) || '>1 ' || {ts5424(ts)} || ' ' || "
            f"{sanitize(host, HOSTNAME_MAX)} || ' ' || {sanitize(app, APP_NAME_MAX)} || ' ' || "
            f"{sanitize(procid, PROCID_MAX)} || ' ' || {sanitize(msgid, MSGID_MAX)} || ' ' || {sdx} || ' ' || "
            f"{b}coalesce(CAST({msg} AS VARCHAR), ''))")


def rfc3164(msg: str, ts: str, f: str = "1", s: str = "6", host: str = "'-'", app: str = "'-'",
            procid: str = "'-'") -> str:
    h = sanitize(host, HOSTNAME_MAX)
    a = sanitize(app, RFC3164_TAG_MAX)
    p = sanitize(procid, PROCID_MAX)
    return (f"('<' || CAST({prival(f, s)} AS VARCHAR) || '>' || {ts3164(ts)} || ' ' || "
            f"(CASE WHEN {h} = '-' THEN 'localhost' ELSE {h} END) || ' ' || "
            f"(CASE WHEN {a} = '-' THEN 'app' ELSE {a} END) || "
            f"(CASE WHEN {p} = '-' THEN ':' ELSE '[' || {p} || ']:' END) || ' ' || "
            f"coalesce(CAST({msg} AS VARCHAR), ''))")


def esc_pipe(v: str) -> str:
    return f"replace(replace({v}, '\\', '\\\\'), '|', '\\|')"


def cef_value(v: str) -> str:
    return f"replace({esc_pipe(v)}, '=', '\\=')"


def leef_value(v: str) -> str:
    return (f"replace(replace(replace(replace({v}, '\\', '\\\\'), '=', '\\='), chr(9), '\\t'), "
            f"chr(10), '\\n')")


def cef(msg: str, vendor: str, product: str, version: str, sig: str, name: str, sev: str = "0",
        extensions: dict[str, str] | None = None) -> str:
    parts = ["'CEF:0|'"]
    for h in (vendor, product, version, sig, name):
        parts += [esc_pipe(h), "'|'"]
    parts += [f"CAST({sev} AS VARCHAR)", "'|'"]
    for k in sorted(extensions or {}):
        parts += [q(k + "="), cef_value(f"coalesce(CAST({extensions[k]} AS VARCHAR), '')"), "' '"]
    parts += ["'msg='", cef_value(f"coalesce(CAST({msg} AS VARCHAR), '')")]
    return "(" + " || ".join(parts) + ")"


def leef(msg: str, vendor: str, product: str, version: str, event_id: str,
         attributes: dict[str, str] | None = None) -> str:
    parts = ["'LEEF:2.0|'"]
    for i, h in enumerate((vendor, product, version, event_id)):
        parts += [esc_pipe(h), "'|'" if i < 3 else "chr(9)"]
    for k in sorted(attributes or {}):
        parts += [q(k + "="), leef_value(f"coalesce(CAST({attributes[k]} AS VARCHAR), '')"), "chr(9)"]
    parts += ["'msg='", leef_value(f"coalesce(CAST({msg} AS VARCHAR), '')"), "chr(10)"]
    return "(" + " || ".join(parts) + ")"


def json_lines(msg: str, ts: str, s: str = "6", f: str = "1", host: str = "'-'", app: str = "'-'",
               procid: str = "'-'", msgid: str = "'-'", extras: dict[str, str] | None = None,
               newline: bool = True) -> str:
    fields = {
        "ts": (ts5424(ts), False),
        "level": (severity_name(s), False),
        "facility": (f"CAST(least({f}, 23) AS VARCHAR)", False),
        "host": (f"CAST({host} AS VARCHAR)", False),
        "app": (f"CAST({app} AS VARCHAR)", False),
        "procid": (f"CAST({procid} AS VARCHAR)", True),
        "msgid": (f"CAST({msgid} AS VARCHAR)", True),
        "msg": (f"coalesce(CAST({msg} AS VARCHAR), '')", False),
    }
    for k, v in (extras or {}).items():
        fields[k] = (f"CAST({v} AS VARCHAR)", False)
    pieces = []
    for k in sorted(fields):
        expr, optional = fields[k]
        kv = f"'\"{k}\":' || to_json({expr})"
        if optional:
            pieces.append(f"(CASE WHEN {expr} = '' OR {expr} = '-' OR {expr} IS NULL THEN NULL ELSE {kv} END)")
        else:
            pieces.append(f"(CASE WHEN {expr} IS NULL THEN NULL ELSE {kv} END)")
    body = "'{' || concat_ws(',', " + ", ".join(pieces) + ") || '}'"
    return f"({body}{' || chr(10)' if newline else ''})"


def frame_octet(m: str) -> str:
    return f"(CAST(strlen({m}) AS VARCHAR) || ' ' || {m})"


def frame_lf(m: str) -> str:
    return f"({m} || chr(10))"
