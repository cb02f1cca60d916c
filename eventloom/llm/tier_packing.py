"""Hierarchical packing: documents are routed to context-size tiers and packed tier by tier.

Windows are powers of two up to the longest (512, 1024, 2048, 4096 tokens). A document goes to the
smallest window that holds it; one longer than all is cut in full longest windows, and its rest is routed.
Tiers are packed from long to short: a window takes its tier's documents best fit first, longest first,
and what is left of it is filled from the shorter tiers, largest piece that fits first. The last gap of a
window is filled by cutting a piece, whose rest goes back to its tier, so that only the last sequence of
a block of documents is padded (to a power of two). Steps are balanced: a task's sequences, block after
block, fill one step group after the other; none holds more than STEP_TOKENS, and all but a task's last
one are full up to less than the next sequence's window.

A task packs its own documents in blocks of bounded token count, so nothing is shuffled and no task
holds more than a block. Every id lies in exactly one piece.

Defined cases: a null text is the empty text, and every document ends with the end id, so it has at least
one piece; rows that repeat an id are documents of their own; an empty table gives an empty result;
special tokens' strings in a text are what the tokenizer file makes of them.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.llm.common import bound_batches
from eventloom.llm.tokens import token_batches

TIERS = (512, 1024, 2048, 4096)
END_ID = 2
#: Tokens packed together; the one partly filled sequence of a block is about 0.1 % of them.
BLOCK_TOKENS = 4 << 20
#: Tokens of a training step; sequences of any window fill it evenly.
STEP_TOKENS = 64 * 4096


class TierPool:
    """Pieces (document, start) of every length up to the longest window, by length."""

    def __init__(self, longest: int):
        self.longest = longest
        self.by_length: list[list[tuple[int, int]]] = [[] for _ in range(longest + 1)]
        self.mask = 0  # bit n: a piece of length n waits
        self.tokens = 0

    def add(self, doc: int, start: int, length: int) -> None:
        self.by_length[length].append((doc, start))
        self.mask |= 1 << length
        self.tokens += length

    def take(self, at_most: int):
        """The longest piece of at most that length, or None."""
        below = self.mask & ((1 << (at_most + 1)) - 1)
        if not below:
            return None
        return self._pop(below.bit_length() - 1)

    def least(self):
        return self._pop((self.mask & -self.mask).bit_length() - 1) if self.mask else None

    def _pop(self, length: int):
        doc, start = self.by_length[length].pop()
        if not self.by_length[length]:
            self.mask ^= 1 << length
        self.tokens -= length
        return doc, start, length


def pack_block(lengths, tiers=TIERS):
    """Pieces (doc, start, length, sequence, offset) and windows of the sequences, for documents of these lengths."""
    longest = tiers[-1]
    pool = TierPool(longest)
    pieces, windows = [], []
    for doc, n in enumerate(lengths):
        n = int(n)
        for start in range(0, n - n % longest, longest):
            pieces.append((doc, start, longest, len(windows), 0))
            windows.append(longest)
        if n % longest:
            pool.add(doc, n - n % longest, n % longest)
    for k in range(len(tiers) - 1, -1, -1):
        window = tiers[k]
        floor = tiers[k - 1] if k else 0
        # sequences of this window as long as its own tier has documents left
        while pool.mask >> (floor + 1) if k else pool.mask:
            room, sequence, got = window, len(windows), []
            while room:
                piece = pool.take(room)
                if piece is None:
                    piece = pool.least()
                    if piece is None:
                        break
                    doc, start, length = piece
                    pool.add(doc, start + room, length - room)
                    piece = (doc, start, room)
                got.append(piece)
                room -= piece[2]
            offset = 0
            for doc, start, length in got:
                pieces.append((doc, start, length, sequence, offset))
                offset += length
            windows.append(window if not room else 1 << (offset - 1).bit_length())
    return pieces, windows


def step_groups(windows, group: int, used: int, step_tokens: int = STEP_TOKENS):
    """Step group of each sequence, going on in `group` of which `used` tokens are taken; then the last group and its tokens."""
    out = []
    for window in windows:
        if used and used + window > step_tokens:
            group, used = group + 1, 0
        out.append(group)
        used += window
    return out, group, used


def _pack_rows(path: str, end_id: int, tiers, block_tokens: int, step_tokens: int):
    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext
        base = TaskContext.get().partitionId() << 40
        held, total, blocks = [], 0, 0
        group, used = TaskContext.get().partitionId() << 20, 0

        def flush():
            nonlocal held, total, blocks, base, group, used
            id_column = pa.concat_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c, _, _ in held])
            docs = [(ids, int(b[i]), int(b[i + 1])) for _, ids, b in held for i in range(len(b) - 1)]
            lengths = [e - s for _, s, e in docs]
            pieces, windows = pack_block(lengths, tiers)
            steps, group, used = step_groups(windows, group, used, step_tokens)
            pieces.sort(key=lambda p: (p[3], p[4]))
            doc, start, length, sequence, offset = (np.array(c, np.int64) for c in zip(*pieces))
            crcs = [zlib.crc32(np.ascontiguousarray(docs[d][0][docs[d][1] + s:docs[d][1] + s + n], "<u4").tobytes())
                    for d, s, n in zip(doc.tolist(), start.tolist(), length.tolist())]
            windows = np.array(windows, np.int64)
            total_of = np.array(lengths, np.int64)[doc]
            out = pa.RecordBatch.from_arrays(
                [id_column.take(pa.array(doc)), pa.array(start), pa.array(length), pa.array(crcs, pa.int64()), pa.array(total_of),
                 pa.array(base + sequence), pa.array(offset), pa.array(windows[sequence]), pa.array(np.array(steps, np.int64)[sequence])],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "window", "step_group"])
            base += len(windows)
            held, total, blocks = [], 0, blocks + 1
            for i in range(0, out.num_rows, 100_000):
                yield out.slice(i, 100_000)

        for batch, ids, bounds in token_batches(batches, path, end_id, 1):
            # a copy of the ids: the column would hold on to the texts of its batch
            held.append((batch.column(0).take(pa.array(np.arange(batch.num_rows))), ids, bounds))
            total += len(ids)
            if total >= block_tokens:
                yield from flush()
        if held:
            yield from flush()
    return run


def pack_tiers(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID,
               tiers=TIERS, block_tokens: int = BLOCK_TOKENS, step_tokens: int = STEP_TOKENS) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset, window (the
    length the sequence is padded to), step_group. path: tokenizer file, at the same place on all executors."""
    bound_batches(docs.sparkSession)
    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = rows.mapInArrow(_pack_rows(path, end_id, tuple(tiers), block_tokens, step_tokens),
                          f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, "
                          "offset long, window long, step_group long")
    return out.withColumnRenamed("doc_id", id_col)
