"""Schema-driven value generators: int, string, datetime, enum (uniform/weighted/zipf),
faker, regex, and correlated (depends_on + mapping) fields.

A *schema* is a dict ``name -> spec`` (the reference's field spec: ``type``, ``faker``,
``values``, ``min``/``max``, ``len``, ``jitter_secs``, ``distribution``, ``weights``,
``zipf_exponent``, ``regex``, ``depends_on``, ``mapping``, ``mapping_default``).
:func:`with_fields` compiles it once on the driver into Column expressions and adds
them in two ``withColumns`` calls (roots, then dependents in topological order);
Catalyst collapses both into one projection.

Every field is salted with its own name, so adding a field never shifts the values
of the others (the reference shares one stream per message; we keep the property
"same seed + key -> same values", not its bit stream).
"""

from __future__ import annotations

import math
from typing import Any, Mapping

from pyspark.sql import Column, DataFrame, functions as F

from eventloom.functions import draws as D
from eventloom.functions import fakers as FK

# ---- fixed values -------------------------------------------------------------------
ALNUM = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"  # string(len)
LOWER_ALNUM = "abcdefghijklmnopqrstuvwxyz0123456789"                       # pad filler
DEFAULT_STRING_LEN = 8
I64_MAX = 9223372036854775807
DATETIME_TEXT = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"
# --------------------------------------------------------------------------------------

_SLICE_BITS = 17           # bits per character draw
_SLICES = 3                # characters per 13-hex-digit (52-bit) chunk: one conv() serves three
_CHUNKS = 2                # 13-digit chunks used from each 32-digit hash
_CHARS_PER_HASH = _SLICES * _CHUNKS
_HEX_BLOCK = 32


def _u(seed, key, salt):
    return D.draw(seed, key, salt)


# ---------------------------------------------------------------- scalar generators

def int_field(seed: int, key, name: str, lo: int | None = None, hi: int | None = None) -> Column:
    lo = 0 if lo is None else int(lo)
    hi = I64_MAX if hi is None else int(hi)
    return D.int_from_unit(_u(seed, key, name), lo, hi)


def _block_hex(seed: int, keys: list[Column], salt: str, b) -> Column:
    b = b if isinstance(b, Column) else F.lit(str(int(b)))
    if D.current_mode() == "fast":
        return F.concat(*[F.lpad(F.lower(F.hex(F.xxhash64(F.lit(int(seed)), *keys, F.lit(f"{salt}#{i}"), b.cast("string")))),
                                 16, "0") for i in range(2)])
    return F.md5(F.concat_ws(":", F.lit(str(int(seed))), *[c.cast("string") for c in keys], F.lit(salt),
                             b.cast("string")))


def _chunk_value(h: Column, start) -> Column:
    return F.conv(F.substring(h, start, 13), 16, 10).cast("bigint")


def _char_from(cs: Column, k: float, v: Column, sl) -> Column:
    if isinstance(sl, Column):   # per-row slice index: v < 2^52, so dividing by 2^(17 s) is exact
        bits = F.pmod(F.floor(v / F.pow(F.lit(2.0), (sl * _SLICE_BITS).cast("double"))).cast("bigint"),
                      F.lit(1 << _SLICE_BITS))
    else:
        bits = F.shiftright(v, sl * _SLICE_BITS).bitwiseAND(F.lit((1 << _SLICE_BITS) - 1))
    return F.substring(cs, (F.lit(1) + F.floor(bits * F.lit(k) / F.lit(float(1 << _SLICE_BITS)))).cast("int"), 1)


def keyed_text(seed: int, key, salt: str, length, charset: str) -> Column:
    """Random text of ``length`` characters (Column or int) from ``charset``.

    One MD5 per 6 characters: character i uses block ``i div 6``; within the block two
    13-hex-digit chunks each give three 17-bit draws (one ``conv`` per three characters).
    A literal length is unrolled into plain expressions (codegen; a chunk shared by three
    characters is computed once by common-subexpression elimination); a per-row length
    uses higher-order functions over the blocks.
    """
    cs = F.lit(charset)
    k = float(len(charset))
    keys = D._keys(key)
    if not isinstance(length, Column):
        n = int(length)
        if n <= 0:
            return F.lit("")
        hs = [_block_hex(seed, keys, salt, b) for b in range((n + _CHARS_PER_HASH - 1) // _CHARS_PER_HASH)]
        out = []
        for i in range(n):
            b, r = divmod(i, _CHARS_PER_HASH)
            ch, sl = divmod(r, _SLICES)
            out.append(_char_from(cs, k, _chunk_value(hs[b], 1 + 13 * ch), sl))
        return F.concat(*out)
    n = length.cast("int")
    nblocks = F.greatest(F.ceil(n / F.lit(float(_CHARS_PER_HASH))).cast("int"), F.lit(1))
    blocks = F.transform(F.sequence(F.lit(0), nblocks - 1), lambda b: _block_hex(seed, keys, salt, b))
    hexall = F.array_join(blocks, "")

    def chars(h):
        def one(i):
            b = F.floor(i / _CHARS_PER_HASH).cast("int")
            r = i - b * _CHARS_PER_HASH
            ch = F.floor(r / _SLICES).cast("int")
            sl = r - ch * _SLICES
            return _char_from(cs, k, _chunk_value(h, b * _HEX_BLOCK + ch * 13 + 1), sl)
        return F.array_join(F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), one), "")

    text = F.element_at(F.transform(F.array(hexall), chars), 1)
    return F.when(n > 0, text).otherwise(F.lit(""))


def string_field(seed: int, key, name: str, length: int | None = None) -> Column:
    return keyed_text(seed, key, name, DEFAULT_STRING_LEN if length is None else length, ALNUM)


def datetime_field(seed: int, key, name: str, ts: Column, jitter_secs: int | None = 0) -> Column:
    """Event time ± uniform whole seconds in [-j, j], as ``YYYY-MM-DDTHH:MM:SS.mmmZ``."""
    j = int(jitter_secs or 0)
    t = ts
    if j > 0:
        off = D.int_from_unit(_u(seed, key, name), -j, j)
        t = F.timestamp_add("SECOND", off, ts)
    return F.date_format(t, DATETIME_TEXT)


def enum_index(seed: int, key, name: str, n: int, distribution: str | None = "uniform",
               weights=None, zipf_exponent: float | None = None) -> Column:
    """0-based index into ``n`` values, by the reference's selection rules."""
    cum = cumulative_weights(n, distribution, weights, zipf_exponent)
    u = _u(seed, key, name)
    if cum is None:
        return D.int_from_unit(u, 0, n - 1) if n > 0 else F.lit(0).cast("bigint")
    if not cum or cum[-1] <= 0:
        return F.lit(0).cast("bigint")
    x = u * F.lit(float(cum[-1]))
    if len(cum) <= CASE_TREE_MAX:
        idx = _search_tree(x, cum, 0, len(cum))
    else:
        idx = F.size(F.filter(F.array(*[F.lit(float(c)) for c in cum]), lambda c: c <= x))
    return F.least(idx, F.lit(n - 1)).cast("bigint")


CASE_TREE_MAX = 4096


def _search_tree(x: Column, cum: list, lo: int, hi: int) -> Column:
    """Number of ``cum`` entries <= x, as a balanced tree of comparisons (codegen, log n)."""
    if lo >= hi:
        return F.lit(lo)
    mid = (lo + hi) // 2
    return F.when(x < F.lit(float(cum[mid])), _search_tree(x, cum, lo, mid)).otherwise(_search_tree(x, cum, mid + 1, hi))


def cumulative_weights(n: int, distribution: str | None, weights=None, zipf_exponent=None):
    """Driver-side cumulative weights, or ``None`` for uniform selection.

    weighted: only weights > 0 count (others add 0); a length mismatch means uniform.
    zipf: weight of rank k is 1 / k^s (s defaults to 1.0).
    """
    dist = (distribution or "uniform").lower()
    if dist == "weighted":
        if weights is None or len(weights) != n:
            return None
        ws = [float(w) if (w is not None and not math.isnan(float(w)) and float(w) > 0) else 0.0 for w in weights]
    elif dist == "zipf":
        s = 1.0 if zipf_exponent is None else float(zipf_exponent)
        ws = [1.0 / (k ** s) for k in range(1, n + 1)]
    else:
        return None
    out, acc = [], 0.0
    for w in ws:
        acc += w
        out.append(acc)
    return out


def enum_field(seed: int, key, name: str, values, distribution=None, weights=None, zipf_exponent=None) -> Column:
    vals = list(values or [])
    if not vals:
        return F.lit("")
    idx = enum_index(seed, key, name, len(vals), distribution, weights, zipf_exponent)
    return D.pick([str(v) for v in vals], idx)


def correlated(parent: Column, mapping: Mapping[str, str] | None, default: str | None, base: Column) -> Column:
    """``mapping[parent]`` → else ``default`` → else the field's own base value."""
    parts = []
    if mapping:
        m = F.create_map(*[x for k, v in sorted(mapping.items()) for x in (F.lit(str(k)), F.lit(str(v)))])
        parts.append(F.try_element_at(m, parent.cast("string")))
    if default is not None:
        parts.append(F.lit(str(default)))
    parts.append(base)
    return F.coalesce(*parts) if len(parts) > 1 else parts[0]


# ---------------------------------------------------------------- schema compiler

def base_column(spec: Mapping[str, Any], seed: int, key, name: str, ts: Column | None) -> Column:
    t = (spec.get("type") or "").lower()
    if t == "int":
        return int_field(seed, key, name, spec.get("min"), spec.get("max")).cast("string")
    if t == "string":
        return string_field(seed, key, name, spec.get("len"))
    if t == "datetime":
        return datetime_field(seed, key, name, ts if ts is not None else F.current_timestamp(),
                              spec.get("jitter_secs"))
    if t == "enum":
        return enum_field(seed, key, name, spec.get("values"), spec.get("distribution"),
                          spec.get("weights"), spec.get("zipf_exponent"))
    if t == "faker":
        return FK.faker(spec.get("faker") or "", seed, key, salt=name)
    if t == "regex":
        from eventloom.functions.regex_text import regex_text
        return regex_text(spec.get("regex") or "", seed, key, name)
    return F.lit("")


def field_order(schema: Mapping[str, Mapping[str, Any]]) -> list[list[str]]:
    """Levels of field names: roots (sorted), then dependents level by level.

    A ``depends_on`` naming an unknown field is treated as a root lookup against an
    existing column; a cycle raises ``ValueError``.
    """
    names = sorted(schema)
    done: set[str] = set()
    levels = []
    remaining = list(names)
    while remaining:
        level = [n for n in remaining
                 if not schema[n].get("depends_on") or schema[n]["depends_on"] not in schema
                 or schema[n]["depends_on"] in done]
        if not level:
            raise ValueError(f"cycle in depends_on among {remaining}")
        levels.append(level)
        done.update(level)
        remaining = [n for n in remaining if n not in done]
    return levels


def with_fields(df: DataFrame, schema: Mapping[str, Mapping[str, Any]], seed: int, key,
                ts: str | Column | None = None, mode: str | None = None) -> DataFrame:
    """Add one string column per schema field (see module doc).

    ``mode`` ("exact" or "fast") overrides the current draw mode for these fields.
    """
    if mode is not None:
        with D.draw_mode(mode):
            return with_fields(df, schema, seed, key, ts)
    tsc = F.col(ts) if isinstance(ts, str) else ts
    out = df
    for level in field_order(schema):
        cols = {}
        for n in level:
            spec = schema[n]
            base = base_column(spec, seed, key, n, tsc)
            parent = spec.get("depends_on")
            if parent:
                base = correlated(F.col(parent), spec.get("mapping"), spec.get("mapping_default"), base)
            cols[n] = base
        out = out.withColumns(cols)
    return out


BASE36 = "0123456789abcdefghijklmnopqrstuvwxyz"   # the pad filler set [a-z0-9], in base-36 digit order
_B36_PER_DRAW = 8                                  # base-36 digits taken from one 52-bit draw


def keyed_base36(seed: int, key, salt: str, length) -> Column:
    """Random [0-9a-z] text of ``length`` characters, 8 per hash.

    Block ``b`` hashes ``seed:key:salt:b``; its first 13 hex digits (52 bits) are written in
    base 36 and the low 8 digits are kept (the cut-off high digits carry the only bias,
    below 0.1 %). One higher-order step per 8 characters instead of one per character.
    """
    n = (length if isinstance(length, Column) else F.lit(int(length))).cast("int")
    keys = D._keys(key)
    nb = F.greatest(F.ceil(n / F.lit(float(_B36_PER_DRAW))).cast("int"), F.lit(1))
    # a 52-bit value has at most 11 base-36 digits; pad to 11 (lpad also truncates), keep the low 8
    chunk = lambda b: F.right(F.lpad(F.lower(F.conv(F.substring(_block_hex(seed, keys, salt, b), 1, 13), 16, 36)),
                                     11, "0"), F.lit(_B36_PER_DRAW))
    text = F.left(F.array_join(F.transform(F.sequence(F.lit(0), nb - 1), chunk), ""), n)
    return F.when(n > 0, text).otherwise(F.lit(""))


# ---------------------------------------------------------------- SQL mirrors (oracle)

def _sql_list(vals) -> str:
    return "[" + ", ".join("'" + str(v).replace("'", "''") + "'" for v in vals) + "]"


def sql_int_field(seed, key_sql, name, lo=None, hi=None) -> str:
    lo = 0 if lo is None else int(lo)
    hi = I64_MAX if hi is None else int(hi)
    return D.sql_int_from_unit(D.sql_draw(seed, key_sql, name), lo, hi)


def sql_keyed_text(seed, key_sql, salt, length_sql, charset) -> str:
    k = float(len(charset))
    blocks = (f"array_to_string(list_transform(range(0, greatest(CAST(ceil(({length_sql}) / {float(_CHARS_PER_HASH)!r}) AS BIGINT), 1)), "
              f"lambda b: md5(concat_ws(':', '{int(seed)}', CAST({key_sql} AS VARCHAR), '{salt}', CAST(b AS VARCHAR)))), '')")
    start = f"CAST((i // {_CHARS_PER_HASH}) * {_HEX_BLOCK} + ((i % {_CHARS_PER_HASH}) // {_SLICES}) * 13 + 1 AS BIGINT)"
    v = f"CAST(concat('0x', substr({blocks}, {start}, 13)) AS BIGINT)"
    bits = f"(({v} >> CAST(((i % {_CHARS_PER_HASH}) % {_SLICES}) * {_SLICE_BITS} AS INTEGER)) & {(1 << _SLICE_BITS) - 1})"
    chars = (f"array_to_string(list_transform(range(0, {length_sql}), lambda i: substr('{charset}', "
             f"CAST(1 + floor({bits} * {k!r} / {float(1 << _SLICE_BITS)!r}) AS BIGINT), 1)), '')")
    return f"(CASE WHEN ({length_sql}) > 0 THEN {chars} ELSE '' END)"


def sql_keyed_base36(seed, key_sql, salt, length_sql) -> str:
    digits = " || ".join(
        f"substr('{BASE36}', CAST(((x // {36 ** k}) % 36) + 1 AS BIGINT), 1)" for k in range(_B36_PER_DRAW - 1, -1, -1))
    chunk = (f"list_transform([CAST(concat('0x', substr(md5(concat_ws(':', '{int(seed)}', CAST({key_sql} AS VARCHAR), "
             f"'{salt}', CAST(b AS VARCHAR))), 1, 13)) AS BIGINT)], lambda x: {digits})[1]")
    nb = f"greatest(CAST(ceil(({length_sql}) / {float(_B36_PER_DRAW)!r}) AS BIGINT), 1)"
    text = f"left(array_to_string(list_transform(range(0, {nb}), lambda b: {chunk}), ''), CAST({length_sql} AS BIGINT))"
    return f"(CASE WHEN ({length_sql}) > 0 THEN {text} ELSE '' END)"


def sql_datetime_field(seed, key_sql, name, ts_sql, jitter_secs) -> str:
    j = int(jitter_secs or 0)
    t = ts_sql
    if j > 0:
        off = D.sql_int_from_unit(D.sql_draw(seed, key_sql, name), -j, j)
        t = f"({ts_sql} + to_seconds({off}))"
    return f"(strftime({t}, '%Y-%m-%dT%H:%M:%S.%g') || 'Z')"


def sql_enum_field(seed, key_sql, name, values, distribution=None, weights=None, zipf_exponent=None) -> str:
    vals = [str(v) for v in (values or [])]
    if not vals:
        return "''"
    n = len(vals)
    cum = cumulative_weights(n, distribution, weights, zipf_exponent)
    u = D.sql_draw(seed, key_sql, name)
    if cum is None:
        idx = D.sql_int_from_unit(u, 0, n - 1)
    elif not cum or cum[-1] <= 0:
        idx = "0"
    else:
        arr = "[" + ", ".join(repr(float(c)) for c in cum) + "]"
        idx = f"least(len(list_filter({arr}, lambda c: c <= {u} * {float(cum[-1])!r})), {n - 1})"
    return f"{_sql_list(vals)}[{idx} + 1]"


def sql_base(spec, seed, key_sql, name, ts_sql) -> str:
    t = (spec.get("type") or "").lower()
    if t == "int":
        return f"CAST({sql_int_field(seed, key_sql, name, spec.get('min'), spec.get('max'))} AS VARCHAR)"
    if t == "string":
        ln = spec.get("len")
        return sql_keyed_text(seed, key_sql, name, str(DEFAULT_STRING_LEN if ln is None else int(ln)), ALNUM)
    if t == "datetime":
        return sql_datetime_field(seed, key_sql, name, ts_sql, spec.get("jitter_secs"))
    if t == "enum":
        return sql_enum_field(seed, key_sql, name, spec.get("values"), spec.get("distribution"),
                              spec.get("weights"), spec.get("zipf_exponent"))
    if t == "faker":
        return FK.sql_faker(spec.get("faker") or "", seed, key_sql, salt=name)
    return "''"


def sql_correlated(parent_sql, mapping, default, base_sql) -> str:
    parts = []
    if mapping:
        whens = " ".join(f"WHEN '{str(k)}' THEN '{str(v)}'" for k, v in sorted(mapping.items()))
        parts.append(f"(CASE CAST({parent_sql} AS VARCHAR) {whens} END)")
    if default is not None:
        parts.append(f"'{default}'")
    parts.append(base_sql)
    return f"coalesce({', '.join(parts)})" if len(parts) > 1 else parts[0]
