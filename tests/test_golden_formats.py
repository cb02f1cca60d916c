"""Golden strings for the text formats (same header for all: facility 16, severity 6,
host test-host, app test-app, pid 12345, msgid TST, ts 2026-01-01T00:00:00.000Z)."""

from pyspark.sql import functions as F

from eventloom.functions import formats as fm

TS = "2026-01-01 00:00:00"
HDR = dict(facility=16, severity=6, hostname="test-host", app_name="test-app", procid="12345", msgid="TST")


def _one(spark, col):
    df = spark.range(1).select(F.lit(TS).cast("timestamp_ntz").alias("ts"))
    return df.select(col.alias("m")).first()["m"]


def test_rfc5424(spark):
    got = _one(spark, fm.rfc5424(F.lit("hello world"), ts=F.col("ts"), **HDR))
    assert got == "<134>1 2026-01-01T00:00:00.000Z test-host test-app 12345 TST - hello world"


def test_rfc5424_empty_body(spark):
    got = _one(spark, fm.rfc5424(F.lit(""), ts=F.col("ts"), **HDR))
    assert got == "<134>1 2026-01-01T00:00:00.000Z test-host test-app 12345 TST - "


def test_rfc5424_bom(spark):
    got = _one(spark, fm.rfc5424(F.lit("x"), ts=F.col("ts"), bom=True, **HDR))
    assert got.encode("utf-8").endswith(b"- \xef\xbb\xbfx")


def test_rfc3164(spark):
    got = _one(spark, fm.rfc3164(F.lit("test msg"), ts=F.col("ts"), facility=16, severity=6,
                                 hostname="test-host", app_name="test-app", procid="12345"))
    assert got == "<134>Jan  1 00:00:00 test-host test-app[12345]: test msg"


def test_rfc3164_nil_header(spark):
    got = _one(spark, fm.rfc3164(F.lit("m"), ts=F.col("ts")))
    assert got == "<14>Jan  1 00:00:00 localhost app: m"


def test_cef(spark):
    got = _one(spark, fm.cef(F.lit("test payload"), vendor="TestVendor", product="TestProduct", version="1.0",
                             signature_id="100", name="test_event", severity=5))
    assert got == "CEF:0|TestVendor|TestProduct|1.0|100|test_event|5|msg=test payload"


def test_cef_escapes_and_sorted_extensions(spark):
    got = _one(spark, fm.cef(F.lit("a=b|c\\d"), vendor="V|x", product="P\\y", version="1", signature_id="s",
                             name="n", extensions={"zz": "1", "aa": "x=y"}))
    assert got == "CEF:0|V\\|x|P\\\\y|1|s|n|0|aa=x\\=y zz=1 msg=a\\=b\\|c\\\\d"


def test_leef(spark):
    got = _one(spark, fm.leef(F.lit("test event"), vendor="TestVendor", product="TestProduct", version="1.0",
                              event_id="evt001"))
    assert got == "LEEF:2.0|TestVendor|TestProduct|1.0|evt001\tmsg=test event\n"


def test_leef_value_escapes(spark):
    got = _one(spark, fm.leef(F.lit("a\tb\nc=d"), vendor="V", product="P", version="1", event_id="e",
                              attributes={"k": "x\\y"}))
    assert got == "LEEF:2.0|V|P|1|e\tk=x\\\\y\tmsg=a\\tb\\nc\\=d\n"


def test_json_lines(spark):
    got = _one(spark, fm.json_lines(F.lit("json msg"), ts=F.col("ts"), newline=False, **HDR))
    assert got == ('{"app":"test-app","facility":"16","host":"test-host","level":"Informational",'
                   '"msg":"json msg","msgid":"TST","procid":"12345","ts":"2026-01-01T00:00:00.000Z"}')


def test_json_lines_drops_nil_ids_and_lowercases_control_escapes(spark):
    got = _one(spark, fm.json_lines(F.lit("a\u001bb\\u001B"), ts=F.col("ts"), procid="-", msgid="",
                                    extras={"host": "override"}))
    assert got == ('{"app":"-","facility":"1","host":"override","level":"Informational",'
                   '"msg":"a\\u001bb\\\\u001B","ts":"2026-01-01T00:00:00.000Z"}\n')


def test_frames(spark):
    assert _one(spark, fm.frame_octet(F.lit("héllo"))) == "6 héllo"
    assert _one(spark, fm.frame_lf(F.lit("x"))) == "x\n"


def test_prival_and_sanitize(spark):
    assert _one(spark, fm.prival(F.lit(99), F.lit(99))) == 191
    assert _one(spark, fm.sanitize_header(F.lit("a béc"), 4)) == "a_b_"
    assert _one(spark, fm.sanitize_header(F.lit(""), 4)) == "-"
    assert _one(spark, fm.sd_escape(F.lit('a"b]c\\'))) == 'a\\"b\\]c\\\\'
