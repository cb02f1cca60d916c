"""Token-id output: best-fit-decreasing packing into fixed-length rows of ids.

Documents are encoded, each ended by the end id; one longer than a row is split losslessly into full
rows and a rest. The pieces of a block of documents are placed longest first, each in the open row with
the least room that still holds it. A segment tree over the room sizes finds that row in log2(row length)
steps. Every output row is one packed matrix row: ids (little-endian uint32, padded), cumulative segment
lengths, and the position at which each segment starts (0 for a document's start, the token offset for a
continued one), so position ids reset at every segment.

Tasks pack the documents they read, in blocks of bounded size; nothing is shuffled. Defined cases: a null text is the empty
text (its one id is the end id); rows that repeat an id are documents of their own; an empty table
gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.llm.common import bound_batches
from eventloom.llm.tokens import token_batches

ROW_TOKENS = 2048
END_ID = 2
PAD_ID = 0
BLOCK_TOKENS = 4 << 20


class RoomTree:
    """Segment tree over room sizes 0..size: how many open rows have a room in each range."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.rows: dict[int, list[int]] = {}

    def _add(self, room: int, by: int) -> None:
        i = self.leaves + room
        while i:
            self.count[i] += by
            i >>= 1

    def put(self, room: int, row: int) -> None:
        self.rows.setdefault(room, []).append(row)
        self._add(room, 1)

    def take(self, least: int):
        """The row with the smallest room of at least that much, or None."""
        i, count = self.leaves + least, self.count
        if not count[i]:
            while i > 1 and (i & 1 or not count[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.leaves:
                i = 2 * i if count[2 * i] else 2 * i + 1
        room = i - self.leaves
        self._add(room, -1)
        return room, self.rows[room].pop()


def best_fit(lengths, size: int):
    """Rows of pieces (doc, start, length) for documents of these lengths, best fit decreasing."""
    rows, rest = [], []
    for doc, n in enumerate(lengths):
        n = int(n)
        for start in range(0, n - n % size, size):
            rows.append([(doc, start, size)])
        if n % size:
            rest.append((doc, n - n % size, n % size))
    rest.sort(key=lambda p: (-p[2], p[0]))
    tree = RoomTree(size)
    for piece in rest:
        found = tree.take(piece[2])
        room, row = found if found else (size, len(rows))
        if not found:
            rows.append([])
        rows[row].append(piece)
        if room > piece[2]:
            tree.put(room - piece[2], row)
    return rows


def _rows(path: str, size: int, end_id: int, pad_id: int, block_tokens: int, id_type):
    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext
        next_row = TaskContext.get().partitionId() << 40
        held, total = [], 0

        def flush():
            nonlocal held, total, next_row
            names = [x for c, _, _ in held for x in c.to_pylist()]
            docs = [(ids, int(b[i]), int(b[i + 1])) for _, ids, b in held for i in range(len(b) - 1)]
            packed = best_fit([e - s for _, s, e in docs], size)
            for at in range(0, len(packed), 500):
                part = packed[at:at + 500]
                matrix = np.full((len(part), size), pad_id, "<u4")
                for k, pieces in enumerate(part):
                    offset = 0
                    for d, s, n in pieces:
                        ids, first, _ = docs[d]
                        matrix[k, offset:offset + n] = ids[first + s:first + s + n]
                        offset += n
                sums = [np.concatenate([[0], np.cumsum([n for _, _, n in pieces])]).tolist() for pieces in part]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(range(next_row + at, next_row + at + len(part)), pa.int64()),
                     pa.array([r.tobytes() for r in matrix], pa.binary()),
                     pa.array(sums, pa.list_(pa.int32())),
                     pa.array([[s for _, s, _ in pieces] for pieces in part], pa.list_(pa.int64())),
                     pa.array([[names[d] for d, _, _ in pieces] for pieces in part], pa.list_(id_type or held[0][0].type)),
                     pa.array([s[-1] for s in sums], pa.int32())],
                    ["row_id", "input_ids", "cu_seqlens", "position_starts", "doc_ids", "n_tokens"])
            next_row += len(packed)
            held, total = [], 0

        for batch, ids, bounds in token_batches(batches, path, end_id, 1):
            # a copy of the ids: the column would hold on to the texts of its batch
            held.append((batch.column(0).take(pa.array(np.arange(batch.num_rows))), ids, bounds))
            total += len(ids)
            if total >= block_tokens:
                yield from flush()
        if held:
            yield from flush()
    return run


def pack_rows(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", row_tokens: int = ROW_TOKENS,
              end_id: int = END_ID, pad_id: int = PAD_ID, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """One row per packed matrix row: row_id, input_ids, cu_seqlens, position_starts, doc_ids, n_tokens."""
    bound_batches(docs.sparkSession)
    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_rows(path, row_tokens, end_id, pad_id, block_tokens, None),
                           f"row_id long, input_ids binary, cu_seqlens array<int>, position_starts array<long>, doc_ids array<{kind}>, n_tokens int")


def write_packed(packed: DataFrame, path: str) -> None:
    """Write the packed rows as Parquet: one file for each task, a retried task replaces its file."""
    packed.write.mode("overwrite").parquet(path)
