"""Framed byte-stream scans: LF (non-transparent) and octet-counting.

A stream is one row, or one capture file. LF splitting of a row is a built-in ``split`` +
``posexplode``; LF capture files are read in byte ranges by Spark's own line reader, so a file of any size
is read by many tasks. Octet-counting decodes a row's stream in one batched pandas map; a capture file is cut into
byte ranges too: each range maps the places where it may be entered to the place where it is left, and these
maps, joined in a merge tree, say where every range's first frame starts.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F, types as T

from eventloom.plans.lineage import cut
from eventloom.sources.paths import located

MAX_FRAME = 65535
#: Digits of a length at most; a longer run of digits is no header.
MAX_DIGITS = 4096
#: Bytes of a capture file that one range holds; the least that a range may hold (no frame is longer).
OCTET_RANGE, LEAST_RANGE = 4 << 20, 1 << 17
#: Range maps that one merge joins; bytes of ranges that one task reads, and tasks at most.
RANGE_FAN, TASK_BYTES, MOST_TASKS = 64, 16 << 20, 20_000
#: Frames handed on together: at most so many, and about so many bytes.
OUT_ROWS, OUT_BYTES = 20_000, 8 << 20
_HEADER = re.compile(rb"(\d{1,%d}) " % MAX_DIGITS)


def split_lf(df: DataFrame, key: str, stream: str) -> DataFrame:
    """One row per complete LF-terminated frame: key, pos (frame index), body, body/wire bytes."""
    parts = df.select(key, F.split(F.col(stream), "\n", -1).alias("_p"))
    ex = parts.select(key, F.size("_p").alias("_n"), F.posexplode("_p").alias("pos", "body"))
    return (ex.filter(F.col("pos") < F.col("_n") - 1)
              .select(key, F.col("pos").cast("bigint").alias("pos"), "body",
                      F.octet_length("body").cast("bigint").alias("body_bytes"),
                      (F.octet_length("body") + 1).cast("bigint").alias("wire_bytes")))


def decode_octet_bytes(buf: bytes, stop: int | None = None):
    """Yield (pos, body_bytes | None, wire_bytes | None, error | None) for one stream, of the frames that start before ``stop``.

    ``LEN SP body`` repeated; LEN (at most ``MAX_DIGITS`` digits) must be 1..65535, otherwise an error row ends
    the stream; an incomplete tail (or a non-header) stays undecoded.
    """
    pos = 0
    n = len(buf)
    while pos < (n if stop is None else min(n, stop)):
        m = _HEADER.match(buf, pos)
        if not m:
            return
        length = int(m.group(1))
        if length <= 0 or length > MAX_FRAME:
            yield pos, None, None, f"octet-counting: implausible length {length}"
            return
        end = m.end() + length
        if end > n:
            return
        yield pos, buf[m.end():end], end - pos, None
        pos = end


OCTET_SCHEMA = T.StructType([
    T.StructField("pos", T.LongType()), T.StructField("body", T.StringType()),
    T.StructField("wire_bytes", T.LongType()), T.StructField("error", T.StringType())])


def _frame_parts(streams, columns):
    """Decoded streams (key, position of the stream's first byte, bytes, stop) as frames in bounded parts."""
    rows, held = [], 0
    for key, at, buf, stop in streams:
        for pos, body, wire, err in decode_octet_bytes(buf, stop):
            rows.append((key, at + pos, None if body is None else body.decode("utf-8", "replace"), wire, err))
            held += wire or 0
            if held > OUT_BYTES or len(rows) >= OUT_ROWS:
                yield pd.DataFrame(rows, columns=columns)
                rows, held = [], 0
    if rows:
        yield pd.DataFrame(rows, columns=columns)


def decode_octet(df: DataFrame, key: str, stream: str) -> DataFrame:
    """Decode octet-counted streams: key, pos (byte offset), body, wire_bytes, error."""
    key_type = df.schema[key].dataType
    out_schema = T.StructType([T.StructField(key, key_type)] + OCTET_SCHEMA.fields)
    columns = out_schema.names

    def run(batches):
        for pdf in batches:
            yield from _frame_parts(((k, 0, bytes(s) if isinstance(s, (bytes, bytearray)) else s.encode("utf-8"), None)
                                     for k, s in zip(pdf[key], pdf[stream]) if s is not None), columns)

    return df.select(key, stream).mapInPandas(run, out_schema)


def read_lf_files(spark, path: str) -> DataFrame:
    """LF-framed capture files, one file = one connection: conn (file), pos, body, body_bytes, wire_bytes.

    Spark's line reader cuts each file into byte ranges (``spark.sql.files.maxPartitionBytes``) and gives
    a range the lines that start in it. A line's place in its file is the number of lines in the ranges before plus
    its place in its range, from a table of one row per range. The lines' bytes against the file's
    size tell whether the last line is unterminated, so no frame, and whether the reader took a byte order mark off.
    """
    lines = (spark.read.option("lineSep", "\n").text(path)
             .select(F.col("_metadata.file_path").alias("conn"), F.col("_metadata.file_block_start").alias("start"),
                     F.col("_metadata.file_size").alias("size"), F.col("value").alias("body"), F.monotonically_increasing_id().alias("id")))
    ranges = lines.groupBy("conn", "start").agg(F.min("id").alias("first"), F.count("*").alias("n"), F.max("size").alias("size"),
                                                F.sum(F.octet_length("body") + 1).alias("wire"))
    before = Window.partitionBy("conn").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("conn")
    extra = F.sum("wire").over(whole) - F.col("size")  # 1 more for a last line without LF, 3 less for a byte order mark
    ranges = ranges.select(F.col("conn").alias("r_conn"), F.col("start").alias("r_start"), (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"),
                           (F.sum("n").over(whole) - extra.isin(1, -2).cast("int")).alias("frames"), (extra < 0).alias("mark"))
    body = F.when(F.col("mark") & (F.col("pos") == 0), F.concat(F.lit("\ufeff"), F.col("body"))).otherwise(F.col("body"))
    return (lines.join(ranges, (F.col("conn") == F.col("r_conn")) & (F.col("start") == F.col("r_start")))
            .withColumn("pos", F.col("id") + F.col("shift")).filter(F.col("pos") < F.col("frames"))
            .select("conn", "pos", body.alias("body"))
            .withColumn("body_bytes", F.octet_length("body").cast("bigint")).withColumn("wire_bytes", F.col("body_bytes") + 1))


def _read_range(path: str, start: int, end: int) -> bytes:
    """Bytes [start, end) of a file named as Spark names it."""
    files, name = located(path)
    with files.open_input_file(name) as file:
        return file.read_at(end - start, start)


def _range_map(buf: bytes, own: int, left: int, heads: int):
    """Where a range may be entered and where it is left: (entries, exits), places from the range's start.

    ``own`` bytes of ``buf`` are the range, ``left`` bytes of the file follow its start. Entries are the headers
    that start before ``heads``; an exit is the first frame start at or after ``own``, -1 where the stream ends before.
    """
    w = np.frombuffer(buf, dtype=np.uint8)
    digit = (w >= 48) & (w <= 57)
    other = np.append(np.flatnonzero(~digit), len(w)).astype(np.int32)
    at = np.flatnonzero(digit[:own]).astype(np.int32)
    space = other[np.searchsorted(other, at)]                       # the first byte after the run of digits
    header = (space < len(w)) & (space - at <= MAX_DIGITS)
    header[header] = w[space[header]] == 32
    at, space = at[header], space[header]
    length = np.zeros(len(at), dtype=np.int32)
    for place in range(5):
        inside = space - 1 - place >= at
        length[inside] += (w[space[inside] - 1 - place].astype(np.int32) - 48) * 10 ** place
    nonzero = np.append(0, np.cumsum(digit & (w > 48), dtype=np.int32))
    small = nonzero[np.maximum(space - 5, at)] == nonzero[at]       # nothing but zeros before the last five digits
    after = space.astype(np.int64) + 1 + length
    whole = small & (length > 0) & (length <= MAX_FRAME) & (after <= left)
    if not len(at):
        return at.astype(np.int64), at.astype(np.int64)
    following = np.minimum(np.searchsorted(at, after), len(at) - 1).astype(np.int32)
    goes_on = whole & (at[following] == after)                      # another header of this range stands there
    jump = np.where(goes_on, following, np.arange(len(at), dtype=np.int32))
    while True:                                                     # pointer doubling
        twice = jump[jump]
        if np.array_equal(twice, jump):
            break
        jump = twice
    exits = np.where(whole & (after >= own), after, -1)[jump]
    head = at < heads
    return at[head].astype(np.int64), exits[head]


def _leave(entries, exits, x: np.ndarray) -> np.ndarray:
    """Exits for the entries x (-1 where x is no entry)."""
    entries, exits = np.asarray(entries, dtype=np.int64), np.asarray(exits, dtype=np.int64)
    if not len(entries):
        return np.full(len(x), -1, dtype=np.int64)
    at = np.minimum(np.searchsorted(entries, x), len(entries) - 1)
    return np.where(entries[at] == x, exits[at], -1)


_RANGE_MAP = "conn string, node bigint, entries array<bigint>, exits array<bigint>"
_RANGE_ENTRY = "conn string, node bigint, entry bigint"


def _range_entries(maps: DataFrame, width: int) -> DataFrame:
    """Start of the first frame in every range but those that no frame starts in: maps are joined ``RANGE_FAN`` at a
    time up to one of each file, then each node's entry goes down to its children."""
    def merge(pdf):
        rows = list(pdf.sort_values("node")[["entries", "exits"]].itertuples(index=False, name=None))
        x = np.asarray(rows[0][1], dtype=np.int64)
        for entries, exits in rows[1:]:
            x = _leave(entries, exits, x)
        return pd.DataFrame({"conn": [pdf["conn"].iloc[0]], "node": [pdf["parent"].iloc[0]], "entries": [rows[0][0]], "exits": [x]})

    def spread(pdf):
        x, out = np.array([pdf["entry"].iloc[0]], dtype=np.int64), []
        for node, entries, exits in pdf.sort_values("node")[["node", "entries", "exits"]].itertuples(index=False, name=None):
            if x[0] < 0:
                break
            out.append((pdf["conn"].iloc[0], node, int(x[0])))
            x = _leave(entries, exits, x)
        return pd.DataFrame(out, columns=["conn", "node", "entry"])

    levels, level = [], maps
    while width > 1:
        level = level.withColumn("parent", F.floor(F.col("node") / F.lit(RANGE_FAN)).cast("bigint"))
        levels.append(level)
        width = -(-width // RANGE_FAN)
        if width > 1:
            level = cut(level.groupBy("conn", "parent").applyInPandas(merge, _RANGE_MAP))
    entry = levels[-1].select("conn", F.lit(0).cast("bigint").alias("parent"), F.lit(0).cast("bigint").alias("entry")).distinct()
    for level in reversed(levels):
        down = level.join(entry, ["conn", "parent"])
        entry = cut(down.groupBy("conn", "parent").applyInPandas(spread, _RANGE_ENTRY)).withColumnRenamed("node", "parent")
    return entry.withColumnRenamed("parent", "node")


def read_octet_files(spark, path: str, range_bytes: int = OCTET_RANGE) -> DataFrame:
    """Octet-counted capture files (one file = one connection): conn (file), pos (byte offset), body, wire_bytes, error.

    A file is read in ranges of ``range_bytes`` by many tasks, twice where it has more than one: first for the
    places where each range may be entered and is left, then, with every range's entry known, for its frames. A frame
    belongs to the range that it starts in. The driver learns the number of ranges only. The workers read
    through Arrow's file systems (local or shared folders, HDFS, S3). Empty files give no row.
    """
    step = int(range_bytes)
    if step < LEAST_RANGE:
        raise ValueError(f"a range holds at least {LEAST_RANGE} bytes")
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("conn"), F.col("length").alias("size")).filter("size > 0")
    ranges = files.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("size") - 1) / F.lit(step)).cast("bigint"))).alias("node"))
    count, last = ranges.agg(F.count("*"), F.max("node")).first()
    tasks = max(min(count, max(spark.sparkContext.defaultParallelism, min(count * step // TASK_BYTES, MOST_TASKS))), 1)

    def summarize(batches):
        for pdf in batches:
            for conn, size, node in zip(pdf["conn"], pdf["size"], pdf["node"]):
                start = int(node) * step
                own = min(step, size - start)
                buf = _read_range(conn, start, min(size, start + own + MAX_DIGITS + 1))
                entries, exits = _range_map(buf, own, size - start, 1 if node == 0 else MAX_FRAME + MAX_DIGITS + 1)
                yield pd.DataFrame({"conn": [conn], "node": [node], "entries": [entries + start],
                                    "exits": [np.where(exits < 0, -1, exits + start)]})

    def decode(batches):
        for pdf in batches:
            def streams():
                for conn, size, node, entry in zip(pdf["conn"], pdf["size"], pdf["node"], pdf["entry"]):
                    end = min(size, (int(node) + 1) * step)
                    yield conn, entry, _read_range(conn, entry, min(size, end + MAX_FRAME + MAX_DIGITS + 1)), end - entry
            yield from _frame_parts(streams(), columns)

    schema = T.StructType([T.StructField("conn", T.StringType())] + OCTET_SCHEMA.fields)
    columns = schema.names
    one = ranges.filter(F.col("size") <= step).withColumn("entry", F.lit(0).cast("bigint"))
    if (last or 0) > 0:
        many = ranges.filter(F.col("size") > step)
        maps = cut(many.repartition(tasks, "conn", "node").mapInPandas(summarize, _RANGE_MAP))
        entries = _range_entries(maps, int(last) + 1)
        one = one.unionByName(many.join(entries, ["conn", "node"]).filter(F.col("entry") < F.col("size")))
    return one.repartition(tasks, "conn", "node").mapInPandas(decode, schema)
