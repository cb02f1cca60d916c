"""Line deduplication by a segment-partition edit join.

Lines (separated by newline, trimmed of spaces and tabs) of a corpus are alike when they are equal, or
when both have at least MIN_CHARS code points and their edit distance is at most TAU. Each distinct line
of length l is split in TAU + 1 segments; TAU edits leave one of them untouched, so a line of length L
holds, for some l in L - TAU .. L, a segment of every line of length l that is alike, at a start that the
lengths bound. The index has a row for every segment, the probe a row for every such substring; both are
named by a hash of (l, segment number, content), and equal names make candidates. Every row carries the
parities of its line's letter and letter-pair counts in 64 bits: an edit flips at most two letter bits and
four pair bits, so candidates that differ in more are out before their texts are read. The others are
verified on the whole lines with a bit-parallel edit distance inside a band of TAU diagonals.

Classes are connected components of the alike relation. Of a class, the line that comes first (by
document id, then line number) stays. Pairs inside a class already found need no check: neighbours in
every list are verified first, and then pairs that still lie in different classes.

Defined cases: a null text is empty; empty lines are not lines (never dropped, never counted); rows that
repeat an id keep separate line numbers but share the id (lines of both are matched); a null id comes
first; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import functools

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.llm.common import Tables, split_by_keys
from eventloom.llm.components import connected
from eventloom.llm.shingles import Hasher, mix

TAU = 2
MIN_CHARS = 20
#: Code points whose prefix hashes a task holds together.
PIECE_CHARS = 2_000_000
#: Line hashes a task remembers so as not to emit a line twice.
REMEMBER = 500_000
BLANKS = " \t\r"


def segments(length, tau: int = TAU):
    """(start, size) arrays of the tau + 1 segments of lines of these lengths: even sizes, the longer ones last."""
    k = tau + 1
    base, longer = length // k, length % k
    out, start = [], np.zeros_like(length)
    for i in range(k):
        size = base + (i >= k - longer)
        out.append((start, size))
        start = start + size
    return out


def probe_starts(i: int, delta: int, tau: int = TAU):
    """Shifts of segment i (from 0) of a line shorter by delta at which its copy may start: an edit script
    of tau edits leaves some segment with at most i edits before it and at most tau - i behind it."""
    low = max(-i, delta - (tau - i))
    return range(low, min(i, delta + (tau - i)) + 1)


class Signer:
    """Hashes of segments and of the substrings that may match one."""

    def __init__(self, tau: int = TAU):
        self.tau, self.hasher = tau, Hasher(1)

    def parities(self, lines):
        """Per non-empty line: bit c % 32 of the lower half counts letters c, the upper half letter pairs, each modulo 2."""
        codes = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        length = np.array([len(x) for x in lines], np.int64)
        first = np.cumsum(length) - length
        one = np.uint64(1)
        bits = one << (codes & np.uint64(31))
        pair = mix(codes[:-1] * np.uint64(0x9E3779B97F4A7C15) + codes[1:]) >> np.uint64(59)
        inside = np.ones(len(pair), bool)
        inside[first[1:] - 1] = False  # pairs of two lines
        bits[:-1] ^= np.where(inside, one << (pair + np.uint64(32)), np.uint64(0))
        return np.bitwise_xor.reduceat(bits, first)

    def signatures(self, lines):
        """(index hashes [n, tau + 1], probe hashes [n, probes] with 0 for none) for lines of over tau letters."""
        n = len(lines)
        codes = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32)
        length = np.array([len(x) for x in lines], np.int64)
        first = np.cumsum(length) - length
        sums = self.hasher.sums(mix(codes.astype(np.uint64) + np.uint64(0x51ED27)))

        def named(start, size, l, i):
            h = self.hasher.slices(sums, first + start, first + start + size)
            return mix(h ^ (l.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(i + 1)))

        index = np.stack([named(s, z, length, i) for i, (s, z) in enumerate(segments(length, self.tau))], 1)
        probes = []
        for delta in range(self.tau + 1):
            l = np.maximum(length - delta, 0)
            for i, (s, z) in enumerate(segments(l, self.tau)):
                for shift in probe_starts(i, delta, self.tau):
                    if delta == 0 and shift == 0:
                        continue  # this is the line's own index row
                    start = s + shift
                    ok = (start >= 0) & (start + z <= length) & (l > self.tau)
                    h = named(np.where(ok, start, 0), np.where(ok, z, 0), l, i)
                    probes.append(np.where(ok, h, np.uint64(0)))
        return index, np.stack(probes, 1) if probes else np.zeros((n, 0), np.uint64)


def repeats(sig):
    """Marks of the values that occur further left in their row. In a run of one letter a segment and its shifted
    copies coincide; the index row stands first and stays, so all rows of a line under one name are equal."""
    order = np.argsort(sig, axis=1, kind="stable")
    ranked = np.take_along_axis(sig, order, 1)
    out = np.zeros(sig.shape, bool)
    np.put_along_axis(out, order[:, 1:], ranked[:, 1:] == ranked[:, :-1], 1)
    return out


def _signature_rows(tau: int):
    """Rows (line hash, line) -> postings (sig, line, len, parity, indexed), one for each sig of a line."""
    def run(batches):
        import pyarrow as pa
        signer, seen = Signer(tau), set()
        for batch in batches:
            ids, lines, chars = [], [], 0

            def out():
                index, probes = signer.signatures(lines)
                who = np.array(ids, np.int64)
                size = np.array([len(x) for x in lines], np.int32)
                parity = signer.parities(lines).view(np.int64)
                sig = np.concatenate([index, probes], 1)
                indexed = np.zeros(sig.shape, bool)
                indexed[:, :index.shape[1]] = True
                real = (sig != 0) & ~repeats(sig)
                who, size, parity = (np.broadcast_to(x[:, None], sig.shape)[real] for x in (who, size, parity))
                return pa.RecordBatch.from_arrays(
                    [pa.array(sig[real].view(np.int64)), pa.array(who), pa.array(size), pa.array(parity), pa.array(indexed[real])],
                    ["sig", "line_id", "len", "parity", "indexed"])

            for h, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if h in seen:
                    continue
                if len(seen) > REMEMBER:
                    seen.clear()
                seen.add(h)
                ids.append(h), lines.append(line)
                chars += len(line)
                if chars > PIECE_CHARS:
                    yield out()
                    ids, lines, chars = [], [], 0
            if ids:
                yield out()
    return run


def within(a: str, b: str, tau: int) -> bool:
    """Is the edit distance of a and b at most tau? Bit-parallel: the columns of the distance matrix are bit vectors of
    vertical differences, cut to the band of 2 tau + 1 diagonals."""
    if abs(len(a) - len(b)) > tau:
        return False
    # equal ends don't matter
    lo, hi = 0, min(len(a), len(b))
    while lo < hi and a[lo] == b[lo]:
        lo += 1
    a, b = a[lo:], b[lo:]
    end = 0
    while end < min(len(a), len(b)) and a[-1 - end] == b[-1 - end]:
        end += 1
    if end:
        a, b = a[:-end], b[:-end]
    m, n = len(a), len(b)
    if not m or not n:
        return max(m, n) <= tau
    # band[d]: the furthest row on diagonal d reached with e edits, as a set of reachable cells per column:
    # bit i of rows[e] is set when a[:i] and the current b[:j] are within e edits, for |i - j| <= tau
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | (1 << (i + 1))
    rows = [(1 << (e + 1)) - 1 for e in range(tau + 1)]
    full = (1 << (m + 1)) - 1
    for j, c in enumerate(b, 1):
        band = full & ~((1 << max(0, j - tau)) - 1) & ((1 << (j + tau + 1)) - 1)
        match = places.get(c, 0)
        new = [((rows[0] << 1) & match) & band]
        for e in range(1, tau + 1):
            new.append(((rows[e] << 1) & match | rows[e - 1] | (rows[e - 1] << 1) | (new[e - 1] << 1)) & band)
        rows = new
        if not rows[tau]:
            return False
    return bool(rows[tau] >> m & 1)


def _verify_rows(tau: int):
    def run(batches):
        import pyarrow as pa
        for batch in batches:
            a, b = [], []
            for x, y, left, right in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if within(left, right, tau):
                    a.append(x), b.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
    return run


def may_be_alike(parity: str, other: str, tau: int) -> str:
    """SQL condition that lines within tau edits always meet."""
    flips = f"({parity} ^ {other})"
    return f"bit_count({flips} & 4294967295L) <= {2 * tau} and bit_count(shiftrightunsigned({flips}, 32)) <= {4 * tau}"


def trimmed(line: Column) -> Column:
    """line without the BLANKS at its ends. trim with a set walks the whole line; most lines have no blank at an end."""
    blank = functools.reduce(Column.__or__, [end(b) for b in BLANKS for end in (line.startswith, line.endswith)])
    return F.when(blank, F.trim(line, F.lit(BLANKS))).otherwise(line)


def lines_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, line_no from 0, line) of the non-empty trimmed lines."""
    split = F.posexplode(F.split(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "\n"))
    rows = docs.select(F.col(id_col).alias("id"), split.alias("line_no", "line"))
    return rows.withColumn("line", trimmed(F.col("line"))).filter("line <> ''")


def line_key(line: Column) -> Column:
    return F.xxhash64(line)


def line_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tau: int = TAU, min_chars: int = MIN_CHARS) -> DataFrame:
    """One row per non-empty line: id, line_no, class_id, keep_id, keep_line, class_size, dropped."""
    tables = Tables(docs.sparkSession, "line_edit")
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    lines = lines_of(source, "id", "text")
    seen = tables.put("lines", lines.select("id", "line_no", line_key(F.col("line")).alias("line_id"), F.xxhash64(F.lit(1), "line").alias("check"),
                                            F.length("line").alias("len")))
    long_lines = lines.filter(F.length("line") >= min_chars).select(line_key(F.col("line")).alias("line_id"), "line")
    post = long_lines.mapInArrow(_signature_rows(tau), "sig long, line_id long, len int, parity long, indexed boolean")
    order = "over (partition by sig order by len, line_id)"
    lists = (post.withColumn("prev", F.expr(f"lag(line_id) {order}")).withColumn("next", F.expr(f"lead(line_id) {order}"))
             .withColumn("prev_len", F.expr(f"lag(len) {order}")).withColumn("prev_parity", F.expr(f"lag(parity) {order}"))
             .filter("(prev is not null and prev <> line_id) or (next is not null and next <> line_id)"))
    lists = tables.put("lists", lists.drop("next"))

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        pairs = tables.put(f"{name}-pairs", pairs)
        wanted = tables.put(f"{name}-wanted", pairs.select(F.col("a").alias("key")).unionByName(pairs.select(F.col("b").alias("key"))).distinct())
        near, _ = split_by_keys(long_lines, F.col("line_id"), wanted, "key")
        texts = tables.put(f"{name}-texts", near.groupBy("line_id", "line").agg(F.count("*")).select("line_id", "line")
                           .join(wanted, F.col("line_id") == F.col("key"), "left_semi"))
        both = (pairs.join(texts.select(F.col("line_id").alias("a"), F.col("line").alias("left")), "a")
                .join(texts.select(F.col("line_id").alias("b"), F.col("line").alias("right")), "b").select("a", "b", "left", "right"))
        links = tables.put(f"{name}-links", both.mapInArrow(_verify_rows(tau), "a long, b long"))
        tables.drop(f"{name}-texts", f"{name}-wanted")
        return links

    met = (lists.filter(f"prev <> line_id and len - prev_len <= {tau} and {may_be_alike('parity', 'prev_parity', tau)}").groupBy("line_id", "prev").agg(F.count("*").alias("times"))
           .groupBy("line_id").agg(F.max_by("prev", F.struct("times", "prev")).alias("prev")))
    first = verified(met.select(F.col("prev").alias("a"), F.col("line_id").alias("b")), "first")
    roots = tables.put("roots", connected(tables, first, "first-cc"))
    marked = tables.put("marked", lists.select("sig", "line_id", "len", "parity", "indexed").distinct()
                        .join(roots.withColumnRenamed("id", "line_id"), "line_id", "left").withColumn("root", F.coalesce("root", "line_id")))
    tables.drop("lists")
    still = marked.groupBy("sig").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("sig")
    open_rows = tables.put("open", marked.join(still, "sig", "left_semi"))
    tables.drop("marked")
    right = open_rows.filter("indexed").select("sig", F.col("line_id").alias("line2"), F.col("len").alias("len2"), F.col("parity").alias("parity2"), F.col("root").alias("root2"))
    cross = (open_rows.join(right, "sig").filter(f"root <> root2 and len >= len2 and len - len2 <= {tau} and (len <> len2 or line_id <> line2)")
             .filter(may_be_alike("parity", "parity2", tau))
             .select(F.least("line2", "line_id").alias("a"), F.greatest("line2", "line_id").alias("b")).distinct())
    second = verified(cross, "second")
    classes = connected(tables, first.unionByName(second), "all-cc")

    # a line hash that two different lines share would merge them: such lines keep their second hash as class
    by_line = (seen.groupBy("line_id", "check").agg(F.min(F.struct("id", "line_no")).alias("first"), F.count("*").alias("n")))
    kinds = by_line.groupBy("line_id").agg(F.count("*").alias("kinds"))
    by_line = (by_line.join(kinds, "line_id").join(classes.withColumnRenamed("id", "line_id"), "line_id", "left")
               .withColumn("class_id", F.when(F.col("kinds") > 1, F.col("check")).otherwise(F.coalesce("root", "line_id"))))
    keep = by_line.groupBy("class_id").agg(F.min("first").alias("keep"), F.sum("n").alias("class_size"))
    # only classes of more than one line go back to the rows
    many = tables.put("many", by_line.join(keep.filter("class_size > 1"), "class_id").select("line_id", "check", "class_id", "keep", "class_size"))
    out = seen.join(many, ["line_id", "check"], "left")
    first_row = F.struct("id", "line_no")
    return out.select(F.col("id").alias(id_col), "line_no", F.coalesce("class_id", "line_id").alias("class_id"),
                      F.when(F.col("keep").isNull(), F.col("id")).otherwise(F.col("keep.id")).alias("keep_id"),
                      F.when(F.col("keep").isNull(), F.col("line_no")).otherwise(F.col("keep.line_no")).alias("keep_line"),
                      F.coalesce("class_size", F.lit(1).cast("long")).alias("class_size"),
                      F.coalesce(~first_row.eqNullSafe(F.col("keep")) & F.col("keep").isNotNull(), F.lit(False)).alias("dropped"))


def line_summary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **limits) -> DataFrame:
    """One row per id: n_lines, n_kept, dropped (sorted line numbers), changed."""
    found = line_classes(docs, id_col, text_col, **limits)
    by = found.groupBy(id_col).agg(F.count("*").alias("n_lines"), F.sum((~F.col("dropped")).cast("long")).alias("n_kept"),
                                   F.array_sort(F.collect_list(F.when(F.col("dropped"), F.col("line_no")))).alias("dropped"))
    ids = docs.select(F.col(id_col).alias("all_id")).distinct()
    return (ids.join(by, F.col("all_id").eqNullSafe(F.col(id_col)), "left")
            .select(F.col("all_id").alias(id_col), F.coalesce("n_lines", F.lit(0).cast("long")).alias("n_lines"),
                    F.coalesce("n_kept", F.lit(0).cast("long")).alias("n_kept"),
                    F.coalesce("dropped", F.array().cast("array<int>")).alias("dropped"), (F.coalesce(F.size("dropped"), F.lit(0)) > 0).alias("changed")))


def drop_lines(docs: DataFrame, summary: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the dropped lines taken out of their texts; ids must not repeat."""
    gone = summary.filter("changed").select(F.col(id_col).alias("gone_id"), F.col("dropped").alias("gone_lines"))
    rows = docs.join(gone, F.col(id_col).eqNullSafe(F.col("gone_id")), "left")
    kept = F.expr(f"array_join(filter(split(`{text_col}`, '\\n'), (x, i) -> not array_contains(gone_lines, i)), '\\n')")
    return rows.withColumn(text_col, F.when(F.col("gone_lines").isNull(), F.col(text_col)).otherwise(kept)).drop("gone_id", "gone_lines")
