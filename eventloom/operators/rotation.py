"""File rotation and retention as table operations.

* interval rotation: a file per tumbling time bucket (``floor(t / interval)``);
* size rotation (parallel form): file = ``floor(bytes written before / limit)`` from a
  scalable two-level running sum per target;
* retention: keep the newest ``max_files - 1`` rotated files per target.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from eventloom.operators.schedule import prefix_sum
from eventloom.plans.lineage import cut

MIB = 1 << 20
DEFAULT_MAX_FILES = 10


def interval_segment(t_seconds: Column, interval_secs: float) -> Column:
    """File index for interval rotation: the tumbling bucket of ``t`` (seconds)."""
    return F.floor(t_seconds / F.lit(float(interval_secs))).cast("bigint")


def size_segments(df: DataFrame, target: str, order: str, nbytes: str, limit_bytes: int,
                  out: str = "segment") -> DataFrame:
    """Parallel size rotation: a message goes to file ``floor(bytes_before / limit)``.

    ``bytes_before`` is the target's running byte count before the message (framing
    included). Each file therefore starts at a multiple of ``limit`` in the byte stream;
    this is the scalable form (no serial fold), equal to the greedy writer when message
    boundaries align with the limit.
    """
    c = prefix_sum(df, [target], order, nbytes, "_cum")
    return c.withColumn(out, F.floor((F.col("_cum") - F.col(nbytes)) / F.lit(int(limit_bytes))).cast("bigint")).drop("_cum")


def file_summary(df: DataFrame, target: str, segment: str, nbytes: str, ts: str | None = None) -> DataFrame:
    aggs = [F.count(F.lit(1)).alias("messages"), F.sum(nbytes).cast("bigint").alias("bytes")]
    if ts:
        aggs += [F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts")]
    return df.groupBy(target, segment).agg(*aggs)


def retention(files: DataFrame, target: str, order_desc: Sequence[str], max_files: int = DEFAULT_MAX_FILES) -> DataFrame:
    """Mark each rotated file keep/drop: the newest ``max_files - 1`` per target are kept.

    The window runs over file rows (one per rotated file), not messages.
    """
    keep_n = max(int(max_files) - 1, 0)
    w = Window.partitionBy(target).orderBy(*[F.col(c).desc() for c in order_desc])
    r = files.withColumn("rank_newest", F.row_number().over(w).cast("bigint"))
    return r.withColumn("action", F.when(F.col("rank_newest") <= keep_n, "keep").otherwise("delete"))


# ------------------------------------------------------------------ exact greedy rotation
import numpy as np  # noqa: E402
import pyarrow as pa  # noqa: E402
import pandas as pd  # noqa: E402
from pyspark.sql import types as T  # noqa: E402

EXACT_CHUNK_SPAN = 1 << 20
#: Values of a chunk that a task holds at once while it summarizes.
PART_ROWS = 1 << 17
#: Chunk summaries that one merge joins.
FAN = 64
_FAR = np.iinfo(np.int64).max


def _ends(jump: np.ndarray):
    """Where each chain i -> jump[i] ends (jump[i] == i) and its number of steps, by pointer doubling."""
    hops = (jump != np.arange(len(jump))).astype(np.int64)
    while True:
        twice = jump[jump]
        if np.array_equal(twice, jump):
            return jump, hops
        hops, jump = hops + hops[jump], twice


def _visited(jump: np.ndarray, start: int) -> np.ndarray:
    """The places of the chain from ``start``; every round doubles the known part."""
    at = np.array([start], dtype=np.int64)
    while True:
        more = np.unique(np.concatenate((at, jump[at])))
        if len(more) == len(at):
            return at
        at, jump = more, jump[jump]


def _size_jumps(sizes: np.ndarray, limit: int):
    """Bytes before each message (and at the end), and where the file after the one starting at i starts."""
    before = np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))
    full = np.searchsorted(before[1:], before[:-1] + limit, side="left")   # message that fills a file starting at i
    m = len(sizes)
    return before, np.append(np.where(full < m, full + 1, np.arange(m)), m)


def _chunk_summary(sizes: np.ndarray, limit: int):
    """Transfer table of one chunk for the greedy writer.

    For an entry carry c (bytes already in the open file, 0 <= c < limit) the chunk's first
    rotation happens after message j(c) = first j with c + P[j] >= limit; from there on the
    run is fixed. Returns steps [(c_lo, exit_carry, rotations)] sorted by c_lo, where the
    step applies to c_lo <= c < next c_lo; exit_carry -1 means "c + chunk bytes" (no rotation).
    """
    before, jump = _size_jumps(sizes, limit)
    total = int(before[-1])
    end, hops = _ends(jump)
    # the first rotation is after a message whose prefix is below the limit, or after the first one at it
    j = np.arange(min(int(np.searchsorted(before[1:], limit, side="left")), len(sizes) - 1), -1, -1)
    lo = np.maximum(limit - before[j + 1], 0)
    j, lo = j[lo < limit], lo[lo < limit]
    exits, turns = total - before[end[j + 1]], hops[j + 1] + 1
    last = _last_of_equal(lo)                                     # empty messages: the earliest reaches the limit
    lo, exits, turns = lo[last], exits[last], turns[last]
    steps = [(0, -1, 0)] if total < limit else []
    return steps + [tuple(s) for s in zip(*(a.tolist() for a in _merged(lo, exits, turns)))]


def _run_chunk(sizes: np.ndarray, limit: int, carry: int):
    """File index (0-based, local) of each message when the chunk is entered with ``carry``, the
    number of rotations and the carry at its end."""
    before, jump = _size_jumps(sizes, limit)
    m = len(sizes)
    j = int(np.searchsorted(before[1:], limit - carry, side="left"))
    if j >= m:
        return np.zeros(m, dtype=np.int64), 0, carry + int(before[-1])
    starts = _visited(jump, j + 1)
    mark = np.zeros(m + 1, dtype=np.int64)
    mark[starts] = 1
    return np.cumsum(mark[:m]), len(starts), int(before[-1] - before[starts[-1]])


def _interval_jumps(ts: np.ndarray, interval: int):
    after = np.searchsorted(ts, ts + interval, side="left")
    return np.where(after < len(ts), after, np.arange(len(ts)))


def _interval_summary(ts: np.ndarray, interval: int):
    """Transfer table for interval rotation over one chunk (``ts`` sorted).

    State = start time t0 of the open file. Before writing message j, if ts_j - t0 >= interval
    the writer rotates and the new file starts at ts_j. For an entry t0 the first rotation is
    at j(t0) = first j with ts_j >= t0 + interval; afterwards the run is fixed. Returns steps
    [(t0_hi, exit_t0, rotations)] for entries t0 <= t0_hi (ascending t0_hi), plus the rule
    "no rotation, exit = t0" for larger t0.
    """
    end, hops = _ends(_interval_jumps(ts, interval))
    # an entry t0 is never after ts[0] (it is a time already seen), so j(t0) lies in the head
    j = np.arange(min(int(np.searchsorted(ts, ts[0] + interval, side="left")) + 1, len(ts)))
    j = j[::-1]                                                   # of equal times the earliest is where the writer rotates
    j = j[_last_of_equal(ts[j])]
    lo, exits, turns = _merged(interval - ts[j], ts[end[j]], hops[j] + 1)
    return [(-x, e, r) for x, e, r in zip(*(a[::-1].tolist() for a in (lo, exits, turns)))]


def _last_of_equal(values: np.ndarray) -> np.ndarray:
    return np.append(values[1:] != values[:-1], True)[:len(values)]


def _merged(lo: np.ndarray, exits: np.ndarray, turns: np.ndarray):
    """Steps without those that repeat the outcome before them."""
    new = np.append(True, (exits[1:] != exits[:-1]) | (turns[1:] != turns[:-1]))[:len(lo)]
    return lo[new], exits[new], turns[new]


def _run_interval(ts: np.ndarray, interval: int, t0: int):
    m = len(ts)
    k = int(np.searchsorted(ts, t0 + interval, side="left"))
    if k >= m:
        return np.zeros(m, dtype=np.int64), 0, t0
    starts = _visited(_interval_jumps(ts, interval), k)
    mark = np.zeros(m, dtype=np.int64)
    mark[starts] = 1
    return np.cumsum(mark), len(starts), int(ts[starts[-1]])


def _run_interval_chunk(ts: np.ndarray, interval: int, t0: int) -> np.ndarray:
    """File index (0-based, local) of each message when the chunk is entered with file start t0."""
    return _run_interval(ts, interval, t0)[0]


# A run of messages as a step function of its entry state x: (lo, exits, turns, shift, floor). From lo[i] up to
# lo[i + 1] the state after the run is exits[i], after turns[i] rotations; below lo[0] nothing rotates and the
# state after it is x + shift. No entry is below floor. Sizes: x = carried bytes. Intervals: x = -(file start).
def _size_step(sizes: np.ndarray, limit: int):
    steps = np.array([s for s in _chunk_summary(sizes, limit) if s[1] >= 0], dtype=np.int64).reshape(-1, 3)
    return steps[:, 0], steps[:, 1], steps[:, 2], int(sizes.sum()), 0


def _interval_step(ts: np.ndarray, interval: int):
    steps = np.array(_interval_summary(ts, interval), dtype=np.int64).reshape(-1, 3)[::-1]
    return -steps[:, 0], -steps[:, 1], steps[:, 2], 0, -int(ts[0])


def _apply(step, x: np.ndarray):
    lo, exits, turns, shift, _ = step
    at = np.searchsorted(lo, x, side="right")
    return np.append(0, exits)[at] * (at > 0) + (x + shift) * (at == 0), np.append(0, turns)[at]


def _compose(f, g):
    """The run f followed by the run g."""
    lo, exits, turns, shift, floor = f
    after, more = _apply(g, exits)
    head = g[0] - shift < (lo[0] if len(lo) else _FAR)              # entries that f lets through unrotated
    if len(lo) and lo[0] <= floor:
        head = np.zeros(len(g[0]), dtype=bool)
    h_lo = np.maximum(g[0][head] - shift, floor)
    last = _last_of_equal(h_lo)                                     # of those below the floor the last holds
    return (*_merged(np.concatenate((h_lo[last], lo)), np.concatenate((g[1][head][last], after)),
                     np.concatenate((g[2][head][last], turns + more))), shift + g[3], floor)


def _runs(batch: pa.RecordBatch):
    """(key, chunk, first row, row after the last) of the runs of equal (key, chunk) in a sorted batch."""
    key = batch.column("_key").to_numpy(zero_copy_only=False)
    chunk = batch.column("_chunk").to_numpy(zero_copy_only=False)
    cuts = np.flatnonzero((key[1:] != key[:-1]) | (chunk[1:] != chunk[:-1])) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(key)]):
        yield key[a], int(chunk[a]), a, b


_NODE = "_key string, _node bigint, lo array<bigint>, exits array<bigint>, turns array<bigint>, shift bigint, floor bigint"
_ENTRY = "_key string, _node bigint, _entry bigint, _files bigint"


def _step_rows(rows) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["_key", "_node", "lo", "exits", "turns", "shift", "floor"])


def _steps(pdf: pd.DataFrame):
    """The nodes of one parent in order, with their step functions."""
    cols = pdf.sort_values("_node")[["_node", "lo", "exits", "turns", "shift", "floor"]]
    for node, lo, exits, turns, shift, floor in cols.itertuples(index=False, name=None):
        yield node, (np.asarray(lo, dtype=np.int64), np.asarray(exits, dtype=np.int64),
                     np.asarray(turns, dtype=np.int64), int(shift), int(floor))


def _entries(nodes: DataFrame) -> DataFrame:
    """Entry state and files before of every chunk: summaries are merged FAN at a time up to one node a key,
    then each node's entry goes down to its children. No task sees more than FAN summaries of a key at once."""
    span = nodes.agg(F.min("_node"), F.max("_node")).first()
    width = span[1] - span[0] + 1 if span[0] is not None else 1
    level = nodes.withColumn("_node", F.col("_node") - F.lit(span[0] or 0))

    def merge(pdf):
        whole = None
        for _, step in _steps(pdf):
            whole = step if whole is None else _compose(whole, step)
        return _step_rows([(pdf["_key"].iloc[0], pdf["_parent"].iloc[0], *whole)])

    def spread(pdf):
        x, files, out = int(pdf["_entry"].iloc[0]), int(pdf["_files"].iloc[0]), []
        for node, step in _steps(pdf):
            out.append((node, x, files))
            after, more = _apply(step, np.array([x], dtype=np.int64))
            x, files = int(after[0]), files + int(more[0])
        return pd.DataFrame({"_key": pdf["_key"].iloc[0], "_node": [o[0] for o in out],
                             "_entry": [o[1] for o in out], "_files": [o[2] for o in out]})

    levels = []
    while width > 1:
        level = level.withColumn("_parent", F.floor(F.col("_node") / F.lit(FAN)).cast("bigint"))
        levels.append(level)
        level = cut(level.groupBy("_key", "_parent").applyInPandas(merge, _NODE))
        width = -(-width // FAN)
    entry = level.select("_key", "_node", F.col("floor").alias("_entry"), F.lit(0).cast("bigint").alias("_files"))
    for level in reversed(levels):
        down = level.join(entry.withColumnRenamed("_node", "_parent"), ["_key", "_parent"])
        entry = cut(down.groupBy("_key", "_parent").applyInPandas(spread, _ENTRY))
    return entry.select("_key", (F.col("_node") + F.lit(span[0] or 0)).alias("_chunk"), "_entry", "_files")


def _exact_segments(df: DataFrame, target: str, order: str, value: Column, out: str, chunk_span: int, step_of, run,
                    to_state) -> DataFrame:
    """Greedy segments in three passes: summarize chunks, find every chunk's entry, label messages.

    The entries travel as one marker row in front of their chunk, through the shuffle that the label pass needs
    anyway, so there is no join with the messages. A task works on one Arrow batch of a chunk at a time.
    """
    text = F.col(f"`{target}`").cast("string")
    keyed = df.select("*", F.when(text.isNull(), "").otherwise(F.concat(F.lit("="), text)).alias("_key"),
                      F.floor(F.col(f"`{order}`") / F.lit(int(chunk_span))).cast("bigint").alias("_chunk"), value.alias("_value"),
                      F.lit(None).cast("bigint").alias("_entry"), F.lit(None).cast("bigint").alias("_files"))

    def summarize(batches):
        at, whole, held, n = None, None, [], 0

        def folded():
            step = step_of(np.concatenate(held))
            return step if whole is None else _compose(whole, step)

        for batch in batches:
            value_of = batch.column("_value").to_numpy(zero_copy_only=False)
            for key, chunk, a, b in _runs(batch) if len(batch) else ():
                if at != (key, chunk):
                    if held:
                        whole = folded()
                    if whole is not None:
                        yield pa.RecordBatch.from_pandas(_step_rows([(*at, *whole)]), schema=node_type, preserve_index=False)
                    at, whole, held, n = (key, chunk), None, [], 0
                held.append(value_of[a:b].copy())
                n += b - a
                if n >= PART_ROWS:
                    whole, held, n = folded(), [], 0
        if held:
            whole = folded()
        if whole is not None:
            yield pa.RecordBatch.from_pandas(_step_rows([(*at, *whole)]), schema=node_type, preserve_index=False)

    longs = pa.list_(pa.int64())
    node_type = pa.schema([("_key", pa.string()), ("_node", pa.int64()), ("lo", longs), ("exits", longs),
                           ("turns", longs), ("shift", pa.int64()), ("floor", pa.int64())])
    by = ["_key", "_chunk"]
    slim = keyed.select(*by, F.col(f"`{order}`").alias("_order"), "_value").repartition(*by).sortWithinPartitions(*by, "_order", "_value")
    entries = _entries(cut(slim.select(*by, "_value").mapInArrow(summarize, _NODE)))

    marked = keyed.unionByName(entries, allowMissingColumns=True).repartition(*by) \
        .sortWithinPartitions(*by, F.col("_entry").asc_nulls_last(), F.col(f"`{order}`"), "_value")
    kept = df.schema.fields
    result = T.StructType(kept + [T.StructField(out, T.LongType())])

    def label(batches):
        state = files = None
        for batch in batches:
            if not len(batch):
                continue
            entry = batch.column("_entry")
            marker = entry.is_valid().to_numpy(zero_copy_only=False)
            value_of = batch.column("_value").fill_null(0).to_numpy(zero_copy_only=False)
            segment = np.zeros(len(batch), dtype=np.int64)
            for _, _, a, b in _runs(batch):
                if marker[a]:
                    state, files, a = to_state(entry[a].as_py()), batch.column("_files")[a].as_py(), a + 1
                if a < b:
                    local, turned, state = run(value_of[a:b], state)
                    segment[a:b] = files + local
                    files += turned
            whole = pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(kept))), pa.array(segment)],
                                               names=[*(f.name for f in kept), out])
            yield whole.filter(pa.array(~marker))

    return marked.mapInArrow(label, result)


def size_segments_exact(df: DataFrame, target: str, order: str, nbytes: str, limit_bytes: int,
                        out: str = "segment", chunk_span: int = EXACT_CHUNK_SPAN) -> DataFrame:
    """Exact greedy size rotation (rotate after the write that reaches the limit; the counter
    restarts at 0, overshoot is not carried), computed in parallel.

    Messages are cut per target into chunks of ``chunk_span`` consecutive ``order`` values (not NULL). Each chunk
    becomes a step function "entry carry → exit carry and rotations", found by pointer doubling; step functions
    are composed in a merge tree and every chunk's entry is sent down it again; then the chunks are labelled.
    Rows of equal ``order`` are written from small to large. A NULL size counts as 0; NULL targets are one target.
    """
    limit = int(limit_bytes)
    if limit < 1:
        raise ValueError("the size limit must be at least one byte")
    size = F.coalesce(F.col(f"`{nbytes}`").cast("bigint"), F.lit(0).cast("bigint"))
    return _exact_segments(df, target, order, size, out, chunk_span, lambda v: _size_step(v, limit),
                           lambda v, carry: _run_chunk(v, limit, carry), lambda x: x)


def interval_segments_exact(df: DataFrame, target: str, order: str, t_micros: str, interval_micros: int,
                            out: str = "segment", chunk_span: int = EXACT_CHUNK_SPAN) -> DataFrame:
    """Exact greedy interval rotation per target: a message whose time is at least
    ``interval_micros`` after the open file's start goes to a new file that starts at that
    message's time (the first file starts at the target's first message). Times are integer
    microseconds (exact comparisons, not NULL). ``order`` must sort messages by time within a target.
    Same merge tree as :func:`size_segments_exact`.
    """
    interval = int(interval_micros)
    if interval < 1:
        raise ValueError("the interval must be at least one microsecond")
    return _exact_segments(df, target, order, F.col(f"`{t_micros}`").cast("bigint"), out, chunk_span,
                           lambda v: _interval_step(v, interval), lambda v, t0: _run_interval(v, interval, t0), lambda x: -x)
