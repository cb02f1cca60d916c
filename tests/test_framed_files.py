"""Capture files read in byte ranges against the same files read whole."""

import random

import pytest

from eventloom.sources import framed

FILES = {"plain": b"one\ntwo\n\nthree and more words\n", "open": b"a\nb\nunterminated tail", "cr": b"x\r\ny\r\n", "mark": "\ufeffwith mark\nnext\n".encode(),
         "mark_open": "\ufeffwith mark\nnext".encode(), "empty": b"", "lf": b"\n", "lfs": b"\n" * 40, "one": b"no end", "long": b"z" * 3000 + b"\nend\n",
         "words": "\n".join(f"line {i} \u00e9\u4e2d {'w' * (i % 50)}" for i in range(400)).encode() + b"\n"}


@pytest.mark.parametrize("limit", ["64", "1000", "134217728"])
def test_ranges_give_the_frames_of_the_whole_file(spark, tmp_path, limit):
    for name, data in FILES.items():
        (tmp_path / name).write_bytes(data)
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", limit)
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        df = framed.read_lf_files(spark, str(tmp_path))
        rows = df.collect()
        if limit == "64":
            assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 50
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    got = {}
    for r in sorted(rows, key=lambda r: r.pos):
        assert r.body_bytes == len(r.body.encode()) and r.wire_bytes == r.body_bytes + 1
        got.setdefault(r.conn.rsplit("/", 1)[1], []).append((r.pos, r.body))
    for name, data in FILES.items():
        want = list(enumerate(data.decode().split("\n")[:-1]))
        assert got.get(name, []) == want, name


def test_octet_frames_leave_in_bounded_parts(spark, monkeypatch):
    monkeypatch.setattr(framed, "OUT_ROWS", 3)
    stream = "".join(f"{len(w)} {w}" for w in ["ab"] * 10) + "0 x5 after"
    got = framed.decode_octet(spark.createDataFrame([(1, stream), (2, None), (3, "")], "k long, s string"), "k", "s").collect()
    assert len(got) == 11 and [r.error for r in got if r.error] == ["octet-counting: implausible length 0"]


def _octet_files():
    rnd = random.Random(5)

    def stream(n, most):
        words = ["7 up", "200 OK", "12 9 3 ", "0 1 ", "65535 ", "x" * 40, "\u00e9\u4e2d", "99999999 "]
        return [" ".join(rnd.choice(words) for _ in range(rnd.randint(1, most))).encode() for _ in range(n)]

    def joined(bodies, pad=0):
        return b"".join(b"%0*d %s" % (pad, len(b), b) for b in bodies)

    good = joined(stream(9000, 12))
    return {"good": good, "tail": good + b"50 not all there", "bad": good + b"0 " + good, "large": good + b"70000 x" + good, "text": good + b"no header" + good,
            "long": joined([b"1 " * 32767] * 30), "zeros": joined(stream(3000, 9), 70), "digits": good + b"9" * 300_000 + b" " + good,
            "many zeros": good + b"0" * 5000 + b"3 abc" + good, "fits": good + b"0" * 4000 + b"3 abc" + good, "empty": b"", "one": b"3 abc", "no": b"abc",
            "edge": joined([b"y" * 65530] * 8)[:1 << 18], "space": b"5 a\xff\xfe b" * 60_000, "exact": b"14 " + b"1 " * 7 + joined([b"z" * 1020] * 400)}


@pytest.mark.parametrize("size, fan", [(1 << 17, 2), (1 << 17, 64), (1 << 18, 3), (framed.OCTET_RANGE, 64)])
def test_octet_ranges_give_the_frames_of_the_whole_file(spark, tmp_path, monkeypatch, size, fan):
    monkeypatch.setattr(framed, "RANGE_FAN", fan)
    files = _octet_files()
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    got = {}
    for r in framed.read_octet_files(spark, str(tmp_path), size).collect():
        got.setdefault(r.conn.rsplit("/", 1)[1].replace("%20", " "), []).append((r.pos, r.body, r.wire_bytes, r.error))
    for name, data in files.items():
        want = [(p, None if b is None else b.decode("utf-8", "replace"), n, e) for p, b, n, e in framed.decode_octet_bytes(data)]
        assert sorted(got.get(name, []), key=lambda r: r[0]) == want, name
    assert sum(r[3] is not None for rows in got.values() for r in rows) == 2      # bad, large


def test_octet_ranges_of_no_bytes(spark, tmp_path):
    (tmp_path / "empty").write_bytes(b"")
    assert framed.read_octet_files(spark, str(tmp_path)).collect() == []
    with pytest.raises(ValueError):
        framed.read_octet_files(spark, str(tmp_path), 1000)
