"""Protobuf round trip: encode in Spark, decode the wire format here and compare."""

import math
import struct

from pyspark.sql import functions as F

from eventloom.functions.protobuf import encode_protobuf, encode_protobuf_columns, parse_spec


def _varint(b, i):
    shift = v = 0
    while True:
        x = b[i]
        i += 1
        v |= (x & 0x7F) << shift
        shift += 7
        if not x & 0x80:
            return v, i


def decode(b):
    out, i = [], 0
    while i < len(b):
        tag, i = _varint(b, i)
        num, wt = tag >> 3, tag & 7
        if wt == 0:
            v, i = _varint(b, i)
        elif wt == 1:
            v = struct.unpack("<d", b[i:i + 8])[0]
            i += 8
        elif wt == 5:
            v = struct.unpack("<f", b[i:i + 4])[0]
            i += 4
        else:
            n, i = _varint(b, i)
            v = b[i:i + n].decode()
            i += n
        out.append((num, v))
    return out


def test_spec_parsing():
    got = parse_spec({"b": "3:int:{{x}}", "a": "2:{{y}}", "c": "plain", "d": "9:weird:z"})
    assert got == [(2, "str", "{{y}}", "a"), (3, "int", "{{x}}", "b"), (3, "str", "plain", "c"), (9, "str", "weird:z", "d")]


def test_round_trip(spark):
    df = spark.createDataFrame([(1, "héllo", "-3", "2.5", "0.25", "yes", "18446744073709551615x", "300"),
                                (2, None, "9223372036854775807", "-0.0", "nan", "TRUE ", "9223372036854775808", "18446744073709551615"),
                                (3, "", "-9223372036854775808", "1e308", "x", "on", "-9223372036854775808", "18446744073709551616"),
                                (4, "x" * 300, " 7 ", "inf", "-1", "0", "", "-1"), (5, "a", "1.5", "", None, None, None, "+12")],
                               "k long, s string, si string, d string, f string, b string, bad string, u string").repartition(2)
    spec = {"s": "1:str:{{s}}", "si": "2:sint:{{si}}", "d": "3:double:{{d}}", "f": "4:float:{{f}}",
            "b": "5:bool:{{b}}", "bad": "6:int:{{bad}}", "u": "7:uint:{{u}}", "neg": "8:int:-1"}
    vals = {c: F.col(c) for c in df.columns}
    rows = df.select("k", encode_protobuf(spec, vals).alias("m"), encode_protobuf_columns(spec, vals).alias("c")).collect()
    assert all(bytes(r.m) == bytes(r.c) for r in rows)
    got = {r.k: dict(decode(bytes(r.m))) for r in rows}
    assert got[1] == {1: "héllo", 2: 5, 3: 2.5, 4: 0.25, 5: 1, 6: 0, 7: 300, 8: (1 << 64) - 1}
    assert got[2][1] == "" and got[2][2] == (1 << 64) - 2 and math.copysign(1, got[2][3]) == -1 and math.isnan(got[2][4]) and got[2][5] == 1
    assert got[2][6] == 0 and got[2][7] == (1 << 64) - 1
    assert got[3][2] == (1 << 64) - 1 and got[3][3] == 1e308 and got[3][4] == 0 and got[3][5] == 0 and got[3][6] == 1 << 63 and got[3][7] == 0
    assert got[4][1] == "x" * 300 and got[4][2] == 14 and got[4][3] == math.inf and got[4][7] == 0
    assert got[5][2] == 0 and got[5][3] == 0 and got[5][5] == 0 and got[5][7] == 12


def test_varints_of_every_length():
    import numpy as np
    from eventloom.functions.protobuf import varint_bytes, varint_column, wire_fields
    values = sorted({0, 1, *(x for k in range(1, 65) for x in ((1 << k) - 1, (1 << k) - 2, min(1 << k, (1 << 64) - 1)))})
    got = varint_column(np.array(values, np.uint64)).to_pylist()
    assert got == [varint_bytes(v) for v in values]
    assert [wire_fields(b"\x08" + m)[0][2] for m in got] == values


def test_decoding_broken_messages(spark):
    from eventloom.functions.protobuf import decode_protobuf
    rows = [(1, b"\x08\x96\x01"), (2, b"\x08\x96"), (3, b"\x0a\x05ab"), (4, b""), (5, None), (6, b"\x0b\x01"), (7, b"\x0a\x02ab\x10\x00")]
    df = spark.createDataFrame(rows, "k long, m binary")
    got = {r.k: r.f and [(x.number, x.wire, x.value and int(x.value), x.bytes and bytes(x.bytes)) for x in r.f]
           for r in df.select("k", decode_protobuf(F.col("m")).alias("f")).collect()}
    assert got[1] == [(1, 0, 150, None)] and got[2] is None and got[3] is None and got[4] == [] and got[5] is None and got[6] is None
    assert got[7][0] == (1, 2, None, b"ab") and got[7][1][:2] == (2, 0)


def test_dispatch_gives_protobuf(spark):
    from eventloom.functions import formats as fm
    out = spark.range(1).select(fm.render("protobuf", F.lit("body"), fields={"h": "1:str:{{hostname}}", "m": "2:{{msgid}}"}, hostname="h1").alias("m"),
                                fm.render("PROTOBUF", F.lit("body")).alias("e")).first()
    assert decode(bytes(out.m)) == [(1, "h1"), (2, "")] and bytes(out.e) == b""


def test_registered_query_decodes(spark, sf_small):
    import __spark_entry__ as E
    rows = E.queries()["protobuf_encode"](spark, sf_small).limit(20).collect()
    for r in rows:
        fields = dict(decode(bytes.fromhex(r.message)))
        assert fields[1] == r.vec_id
        assert fields[5].startswith(f"vec-{r.vec_id}/")
