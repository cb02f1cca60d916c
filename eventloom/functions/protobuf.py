"""Protobuf wire encoding of template-valued fields, and its decoding.

A spec maps field names to ``"num:type:template"``, ``"num:template"`` or ``"template"``
(auto-numbered by sorted name; string type). Types: str/string, bytes, int/int32/int64,
uint/uint32/uint64, sint/sint32/sint64 (zigzag), bool/boolean, double/f64, float/f32;
anything else is a string. Fields are written in ascending field number.

Texts are parsed by Spark expressions. :func:`encode_protobuf` builds the message from built-ins (varints from
unsigned shifts, the raw bits of floats through ``java_method``, one hex string turned into binary), so a
plan stays in the JVM. :func:`encode_protobuf_columns` gives the same bytes from one Arrow function per message that
encodes whole columns (varints from a matrix of seven-bit groups, floats as their bytes) and has a deterministic
plan. Unsigned values go through ``decimal``, so all of 0 .. 2^64-1 is encoded. Unparsable numbers and
numbers out of range encode 0; booleans are true for ``1``/``true``/``yes``. :func:`decode_protobuf` reads messages back.
"""

from __future__ import annotations

from typing import Mapping

from pyspark.sql import Column, functions as F

from eventloom.functions.templates import render_template

# ---- fixed values: accepted type names and their wire types ------------------------------
TYPE_ALIASES = {
    "int": "int", "int64": "int", "int32": "int",
    "uint": "uint", "uint64": "uint", "uint32": "uint",
    "sint": "sint", "sint64": "sint", "sint32": "sint",
    "bool": "bool", "boolean": "bool",
    "double": "double", "f64": "double",
    "float": "float", "f32": "float",
    "bytes": "bytes", "str": "str", "string": "str",
}
WIRE_TYPE = {"str": 2, "bytes": 2, "int": 0, "uint": 0, "sint": 0, "bool": 0, "double": 1, "float": 5}
TRUE_WORDS = ["1", "true", "yes"]
# ---------------------------------------------------------------------------------------------


def parse_spec(fields: Mapping[str, str]) -> list[tuple[int, str, str, str]]:
    """(number, type, template, name) per field, ordered by field number (name breaks ties)."""
    out = []
    for i, name in enumerate(sorted(fields), start=1):
        raw = fields[name]
        num, typ, tmpl = i, "str", raw
        head, sep, rest = raw.partition(":")
        if sep and head.strip().isdigit():
            num, tmpl = int(head.strip()), rest
            t, sep2, tail = rest.partition(":")
            if sep2 and t.strip().lower() in TYPE_ALIASES:
                typ, tmpl = TYPE_ALIASES[t.strip().lower()], tail
        out.append((num, typ, tmpl, name))
    return sorted(out, key=lambda x: x[0])


def varint_bytes(v: int) -> bytes:
    """Driver-side varint (used for the constant tags)."""
    v &= (1 << 64) - 1
    out = bytearray()
    while True:
        b = v & 0x7F
        v >>= 7
        out.append(b | (0x80 if v else 0))
        if not v:
            return bytes(out)


def varint_column(bits):
    """Arrow binary array of the unsigned LEB128 varints of a uint64 array."""
    import numpy as np
    import pyarrow as pa
    groups = (bits[:, None] >> (np.arange(10, dtype=np.uint64) * np.uint64(7))).astype(np.uint64)
    present = groups != 0
    present[:, 0] = True
    size = present.sum(1)  # groups above the highest one bit are all 0, so the present ones come first
    octets = (groups & np.uint64(127)).astype(np.uint8)
    octets[np.arange(10) < (size - 1)[:, None]] |= 128
    ends = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(bits), [None, pa.py_buffer(ends), pa.py_buffer(octets[present])])


def _fixed_column(values, width: int):
    """Arrow binary array of the values' own bytes, width each."""
    import numpy as np
    import pyarrow as pa
    ends = (np.arange(len(values) + 1) * width).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(values), [None, pa.py_buffer(ends), pa.py_buffer(values.tobytes())])


def encode_columns(fields, columns):
    """Arrow binary array of the messages; columns: text for str and bytes, 64-bit patterns for varints, floats."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc
    parts = []
    for (num, typ), column in zip(fields, columns):
        n = len(column)
        parts.append(pa.array([varint_bytes((num << 3) | WIRE_TYPE[typ])] * n, pa.binary()))
        if typ in ("str", "bytes"):
            parts.append(varint_column(pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.uint64)))
            parts.append(column.cast(pa.binary()))
        elif typ in ("double", "float"):
            kind = "<f8" if typ == "double" else "<f4"
            parts.append(_fixed_column(column.to_numpy(zero_copy_only=False).astype(kind), int(kind[2])))
        else:
            parts.append(varint_column(column.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)))
    return pc.binary_join_element_wise(*parts, pa.scalar(b"", pa.binary()))


def _parsed(value: Column, typ: str) -> Column:
    """The column a field is encoded from: text, float, or the 64 bits of a varint as a bigint."""
    s = F.coalesce(value.cast("string"), F.lit(""))
    if typ in ("str", "bytes"):
        return s
    if typ in ("double", "float"):
        return F.coalesce(F.trim(s).try_cast(typ), F.lit(0).cast(typ))
    if typ == "bool":
        return F.lower(F.trim(s)).isin(*TRUE_WORDS).cast("bigint")
    if typ == "uint":
        whole = F.when(F.trim(s).rlike(r"^\+?[0-9]+$"), F.trim(s).try_cast("decimal(38,0)"))
        top, high = F.lit("18446744073709551616").cast("decimal(38,0)"), F.lit("9223372036854775808").cast("decimal(38,0)")
        return F.coalesce(F.when(whole < high, whole).when(whole < top, whole - top).cast("bigint"), F.lit(0).cast("bigint"))
    v = F.coalesce(F.trim(s).try_cast("bigint"), F.lit(0).cast("bigint"))
    return F.shiftleft(v, 1).bitwiseXOR(F.shiftright(v, 63)) if typ == "sint" else v


def _hex_byte(x: Column) -> Column:
    return F.lpad(F.hex(x), 2, "0")


def varint_hex(v: Column) -> Column:
    """Hex of the unsigned LEB128 varint of the 64 bits of a bigint."""
    v = v.cast("bigint")
    parts = []
    for k in range(10):
        # shifts are taken mod 64 by the JVM, so the 10th byte never has a continuation
        cont = (F.shiftrightunsigned(v, 7 * (k + 1)) != 0) if k < 9 else F.lit(False)
        byte = F.shiftrightunsigned(v, 7 * k).bitwiseAND(F.lit(127)) + F.when(cont, F.lit(128)).otherwise(F.lit(0))
        present = F.lit(True) if k == 0 else (F.shiftrightunsigned(v, 7 * k) != 0)
        parts.append(F.when(present, _hex_byte(byte)))
    return F.concat_ws("", *parts)


def field_hex(num: int, typ: str, value: Column) -> Column:
    tag = varint_bytes((num << 3) | WIRE_TYPE[typ]).hex().upper()
    v = _parsed(value, typ)
    if typ in ("str", "bytes"):
        payload = F.concat(varint_hex(F.octet_length(v)), F.hex(F.encode(v, "UTF-8")))
    elif typ in ("double", "float"):
        kind, call, width = ("java.lang.Double", "doubleToRawLongBits", 8) if typ == "double" else ("java.lang.Float", "floatToRawIntBits", 4)
        bits = F.call_function("java_method", F.lit(kind), F.lit(call), v).cast("bigint")
        payload = F.concat(*[_hex_byte(F.shiftrightunsigned(bits, 8 * k).bitwiseAND(F.lit(255))) for k in range(width)])
    else:
        payload = varint_hex(v)
    return F.concat(F.lit(tag), payload)


def encode_protobuf(spec: Mapping[str, str], values: Mapping[str, Column], seed: int | None = None, key=None) -> Column:
    """Binary protobuf message for each row; an empty spec gives empty bytes."""
    fields = parse_spec(spec)
    if not fields:
        return F.lit(b"").cast("binary")
    return F.unhex(F.concat(*[field_hex(num, typ, render_template(tmpl, values, seed, key)) for num, typ, tmpl, _ in fields]))


def encode_protobuf_columns(spec: Mapping[str, str], values: Mapping[str, Column], seed: int | None = None, key=None) -> Column:
    """The bytes of :func:`encode_protobuf`, encoded column by column in an Arrow function."""
    fields = parse_spec(spec)
    if not fields:
        return F.lit(b"").cast("binary")
    heads = [(num, typ) for num, typ, _, _ in fields]

    @F.arrow_udf("binary")
    def message(*columns):
        return encode_columns(heads, columns)
    return message(*[_parsed(render_template(tmpl, values, seed, key), typ) for _, typ, tmpl, _ in fields])


WIRE_FIELDS = "array<struct<number:int,wire:int,value:decimal(20,0),bytes:binary>>"


def wire_fields(message: bytes) -> list[tuple]:
    """(number, wire type, value of a varint, bytes of any other) of each field, in order."""
    out, at = [], 0

    def varint():
        nonlocal at
        value = shift = 0
        while True:
            value |= (message[at] & 127) << shift
            shift, at = shift + 7, at + 1
            if message[at - 1] < 128:
                return value
    while at < len(message):
        tag = varint()
        wire = tag & 7
        if wire == 0:
            out.append((tag >> 3, wire, varint(), None))
            continue
        size = {1: 8, 5: 4}[wire] if wire != 2 else varint()
        if at + size > len(message):
            raise ValueError("cut short")
        out.append((tag >> 3, wire, None, message[at:at + size]))
        at += size
    return out


def decode_protobuf(message: Column) -> Column:
    """The fields of a message in wire order; NULL for a message that is NULL or broken."""
    @F.arrow_udf(WIRE_FIELDS)
    def fields(messages):
        import decimal
        import pyarrow as pa
        kind = pa.list_(pa.struct([("number", pa.int32()), ("wire", pa.int32()), ("value", pa.decimal128(20, 0)), ("bytes", pa.binary())]))
        rows = []
        for m in messages.to_pylist():
            try:
                found = None if m is None else wire_fields(m)
            except (IndexError, KeyError, ValueError):
                found = None
            rows.append(found and [{"number": n, "wire": w, "value": None if v is None else decimal.Decimal(v), "bytes": b} for n, w, v, b in found])
        return pa.array(rows, kind)
    return fields(message)


# ---------------------------------------------------------------- SQL mirrors (oracle): upper-case hex

def sql_varint_hex(bits: str) -> str:
    """Hex varint of an SQL number of 0 .. 2^64-1."""
    b = f"CAST({bits} AS HUGEINT)"
    return (f"array_to_string(list_transform(list_filter(range(10), lambda k: k = 0 OR {b} // (CAST(1 AS HUGEINT) << CAST(7 * k AS INTEGER)) > 0), "
            f"lambda k: printf('%02X', CAST({b} // (CAST(1 AS HUGEINT) << CAST(7 * k AS INTEGER)) % 128 AS INTEGER) + "
            f"CASE WHEN {b} // (CAST(1 AS HUGEINT) << CAST(7 * k + 7 AS INTEGER)) > 0 THEN 128 ELSE 0 END)), '')")


def sql_field_hex(num: int, typ: str, value: str) -> str:
    """Hex of a field; value: SQL text for str and bytes, a number (any sign for int and sint), a boolean or a float."""
    tag = "'" + varint_bytes((num << 3) | WIRE_TYPE[typ]).hex().upper() + "'"
    if typ in ("str", "bytes"):
        return f"({tag} || {sql_varint_hex(f'strlen({value})')} || hex(encode({value})))"
    if typ in ("double", "float"):
        sql_type, width = ("DOUBLE", 8) if typ == "double" else ("FLOAT", 4)
        bits = f"(CAST(CAST(CAST({value} AS {sql_type}) AS BIT) AS VARCHAR))"
        octets = (f"list_transform(list_reverse(range({width})), lambda k: printf('%02X', "
                  f"list_reduce(list_transform(string_split({bits}[8 * k + 1:8 * k + 8], ''), lambda c: CAST(c AS INTEGER)), lambda x, y: 2 * x + y)))")
        return f"({tag} || array_to_string({octets}, ''))"
    if typ == "bool":
        return f"({tag} || CASE WHEN {value} THEN '01' ELSE '00' END)"
    v = f"CAST({value} AS HUGEINT)"
    if typ == "sint":
        v = f"(CASE WHEN {v} < 0 THEN -2 * {v} - 1 ELSE 2 * {v} END)"
    return f"({tag} || {sql_varint_hex(f'(CASE WHEN {v} < 0 THEN {v} + 18446744073709551616 ELSE {v} END)')})"
