"""N-gram Jaccard join: size-aware heavy-light set join on word shingles.

Documents link when the Jaccard similarity of their shingle sets is at least 3/4. Equal sets are one
set (named by a 64-bit set id, `sid`). Every set orders its shingles by (frequency level, hash); two sets
that link share at least ceil(3/4 size) shingles, so they share a shingle among the first floor(size/4)+1
of each, and two shingles among the first floor(size/4)+2.

* light sets (up to a boundary size) enumerate all subsets of two of their first floor(size/4)+2
  shingles: a posting for every subset;
* heavy sets scan the inverted lists of their first floor(size/4)+1 shingles; light sets near enough in
  size to link with a heavy one are in those lists, too.

The boundary is the size at which the summed cost, C(prefix, 2) postings for light sets against the
length of the lists for heavy ones, is least, from counts over all documents. The more frequent shingles
come last in the order, by levels of a fixed-size count sketch over all shingles; a wrong guess there costs
time, never a link. Candidates are verified on whole sets.

Links are used for connected components, so pairs inside a component already found need no check:
first the neighbours in every posting list are verified, then, for lists that still span several
components, pairs from different components that two exact bounds allow: what the set whose first shingles end
earlier can share at most, and the parities of both sets' shingles.

Defined cases: null and empty texts (and white space alone) have an empty set and link with nothing;
equal sets always link; rows that repeat an id each get a row; other columns are ignored; an empty table
gives an empty result. Two distinct sets share a sid with probability 2^-64 a pair.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.llm.common import Tables, keep_rows, row_key, split_by_keys
from eventloom.llm.components import connected
from eventloom.llm.shingles import Shingler, mix

WIDTH = 5
#: Similarity 3/4 as a fraction.
NUM, DEN = 3, 4
SKETCH_BITS = 22
SKETCH_SLICES = 64
#: Largest boundary considered: C(66, 2) postings for one set of 257 shingles never pay.
MAX_LIGHT = 64
#: Lists of so many sets have a leader, with which their members are compared first.
LONG_LIST = 8
#: Words of 64 bits with the parities of a set's shingles.
PARITY = [f"parity{i}" for i in range(4)]


def allowed_misses(n):
    """Shingles of a set of n that a linked set may lack."""
    return n - (NUM * n + DEN - 1) // DEN


def _set_id(s):
    if not len(s):
        return 0
    h = np.bitwise_xor.reduce(mix(s)) ^ mix(np.array([len(s)], np.uint64))[0]
    with np.errstate(over="ignore"):
        h = h * np.uint64(0x9FB21C651E98DF25) + np.add.reduce(mix(s ^ np.uint64(0xA0761D6478BD642F)))
    return int(np.array(h, np.uint64).astype(np.int64)) or 1


def _sketch_rows(batches):
    """Count shingles into 2^SKETCH_BITS counters; rows (slice, counters). Each distinct set counts once a task."""
    import pyarrow as pa
    shingler, seen, counts, wait, waiting = Shingler(WIDTH), set(), None, [], 0
    size = 1 << SKETCH_BITS

    def flush():
        nonlocal counts, wait, waiting
        at = np.sort((np.concatenate(wait) >> np.uint64(64 - SKETCH_BITS)).astype(np.uint32))
        starts = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        counts = np.zeros(size, np.uint32) if counts is None else counts
        counts[at[starts]] += np.diff(np.append(starts, len(at))).astype(np.uint32)
        wait, waiting = [], 0

    for batch in batches:
        for _, s in shingler.sets(batch.column(0)):
            sid = _set_id(s)
            if len(s) and sid not in seen:
                seen.add(sid)
                wait.append(s)
                waiting += len(s)
                if waiting > 1_000_000:
                    flush()
    if wait:
        flush()
    if counts is not None:
        import zlib
        parts = counts.reshape(SKETCH_SLICES, -1)
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(SKETCH_SLICES), pa.int32()), pa.array([zlib.compress(p.tobytes(), 1) for p in parts], pa.binary()),
             pa.array([int(p.sum()) for p in parts], pa.int64())], ["slice", "counters", "total"])


def _sketch_sums(batches):
    """Add up the counters of every slice, as they stream by."""
    import zlib
    import pyarrow as pa
    sums = {}
    for batch in batches:
        for k, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            c = np.frombuffer(zlib.decompress(c), np.uint32).astype(np.uint64)
            sums[k] = sums[k] + c if k in sums else c
    if sums:
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary()),
                                          pa.array([int(x.sum()) for x in sums.values()], pa.int64())], ["slice", "counters", "total"])


def _frequency_levels(limit):
    """Counters to four bits each: 0 up to the limit, then one more for every doubling, 15 at most."""
    def run(batches):
        import pyarrow as pa
        for batch in batches:
            rows = []
            for c in batch.column(1).to_pylist():
                over = np.frombuffer(c, np.uint64) / limit
                level = np.where(over > 1, np.minimum(15, 1 + np.floor(np.log2(np.maximum(over, 1)))), 0).astype(np.uint8)
                rows.append((level[::2] << 4 | level[1::2]).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary())], ["slice", "levels"])
    return run


def frequency_levels(tables: Tables, docs: DataFrame, text_col: str):
    """Four bits for every counter of the sketch over all shingles: 0 unless well above the mean.
    The sketch has 2^22 counters at any input size; the driver gets their levels, 2 MB."""
    rows = docs.select(F.col(text_col).cast("string")).mapInArrow(_sketch_rows, "slice int, counters binary, total long")
    sums = tables.put("sketch", rows.repartition("slice").mapInArrow(_sketch_sums, "slice int, counters binary, total long"))
    load = (sums.agg(F.sum("total")).first()[0] or 0) / (1 << SKETCH_BITS)
    levels = np.zeros((SKETCH_SLICES, (1 << SKETCH_BITS) // SKETCH_SLICES // 2), np.uint8)
    for r in sums.mapInArrow(_frequency_levels(int(4 * load + 32)), "slice int, levels binary").collect():
        levels[r["slice"]] = np.frombuffer(r["levels"], np.uint8)
    tables.drop("sketch")
    return levels.ravel()


def _parity(s):
    """One bit for each of 256 classes of hashes: is the number of shingles in it odd?"""
    odd = np.bincount(((s >> np.uint64(20)) & np.uint64(64 * len(PARITY) - 1)).astype(np.int64), minlength=64 * len(PARITY)) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64).tolist()


def _signature_rows(levels):
    """Rows (id, row key, sid, n, first shingles, pairs of first shingles, frequent shingles among the first, end, parities).
    end is where the first shingles end in the common order (level, hash), cut to 63 bits."""
    def run(batches):
        import pyarrow as pa
        shingler, seen = Shingler(WIDTH), set()
        level_of = np.stack([levels >> 4, levels & 15], 1).ravel()
        for batch in batches:
            sids, sizes, lists, pairs, scan, ends, parities = [], [], [], [], [], [], []
            for _, s in shingler.sets(batch.column(2)):
                sid, n = _set_id(s), len(s)
                one = two = ()
                heavy, end, parity = 0, 0, (0,) * len(PARITY)
                if n > 2 and sid not in seen:  # sets of one or two shingles link with equal sets alone
                    seen.add(sid)
                    m = int(allowed_misses(n))
                    parity = _parity(s)
                    level = level_of[(s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
                    first = np.argsort(level, kind="stable")[:m + 2]
                    end = int(level[first[m]]) << 59 | int(s[first[m]]) >> 5
                    s = s[first]
                    heavy = max(0, m + 1 - int((level == 0).sum()))
                    one = s[:m + 1].view(np.int64)
                    if n <= MAX_LIGHT:
                        i, j = np.triu_indices(len(s), 1)
                        low, high = np.minimum(s[i], s[j]), np.maximum(s[i], s[j])
                        two = mix(low * np.uint64(0xC2B2AE3D27D4EB4F) + high).view(np.int64)
                sids.append(sid), sizes.append(n), lists.append(one), pairs.append(two), scan.append(heavy), ends.append(end), parities.append(parity)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sids, pa.int64()), pa.array(sizes, pa.int64()),
                 pa.array(lists, pa.list_(pa.int64())), pa.array(pairs, pa.list_(pa.int64())), pa.array(scan, pa.int64()), pa.array(ends, pa.int64()),
                 *[pa.array([p[i] for p in parities], pa.int64()) for i in range(len(PARITY))]],
                ["id", "row_key", "sid", "n", "ones", "twos", "often", "end", *PARITY])
    return run


def light_boundary(sets: DataFrame) -> int:
    """Size up to which enumerating subsets costs less than scanning lists. Per size, a light set costs
    C(prefix, 2) postings, a heavy one its list entries plus the mean list length for each frequent one."""
    rows = (sets.filter((F.col("n") > 2) & (F.col("n") <= MAX_LIGHT) & (F.size("ones") > 0)).groupBy("n")
            .agg(F.sum(F.size("twos")).alias("two"), F.sum(F.size("ones")).alias("one"), F.sum("often").alias("often"), F.count("*").alias("sets"))
            .collect())  # at most MAX_LIGHT rows
    total = sum(r["sets"] for r in rows)
    by = {r["n"]: (r["two"], r["one"] + r["often"] * total ** 0.5) for r in rows}
    best, at = None, 2
    for x in range(2, MAX_LIGHT + 1):
        cost = sum(two if n <= x else one for n, (two, one) in by.items())
        if best is None or cost < best:
            best, at = cost, x
    return at


def may_link(shared: str, n: str, n2: str, boundary: int) -> str:
    """SQL condition: can sets of n and n2 shingles that share so many of their first ones link? All shingles up
    to the end of one of the two prefixes are known, so beyond it that set adds at most its rest."""
    rest = lambda x: f"(({NUM} * {x} + {DEN - 1}) div {DEN} - 1)"
    need = f"(({NUM} * ({n} + {n2}) + {NUM + DEN - 1}) div {NUM + DEN})"
    return f"(greatest({n}, {n2}) <= {boundary} or {shared} + greatest({rest(n)}, {rest(n2)}) >= {need})"


def can_reach(ours: str, theirs: str, boundary: int) -> str:
    """SQL condition: can the two sets of a posting list link? The set whose first shingles end earlier shares with
    the other at most `ours` or `theirs`, the bound for that set; on equal ends either bound may hold."""
    bound = f"(case when end < end2 then {ours} when end > end2 then {theirs} else greatest({ours}, {theirs}) end)"
    return f"(greatest(n, n2) <= {boundary} or {NUM + DEN} * {bound} >= {NUM} * (n + n2))"


def parities_allow() -> str:
    """SQL condition: two sets differ in at least as many shingles as their parities differ in bits, so they share
    at most half of the rest."""
    differ = " + ".join(f"bit_count({c} ^ {c}2)" for c in PARITY)
    return f"{NUM + DEN} * (n + n2 - ({differ})) >= {2 * NUM} * (n + n2)"


def _short(s):
    """Distinct 16-bit remainders of a set's shingles, sorted."""
    return np.unique((s & np.uint64(0xFFFF)).astype(np.uint16))


def _set_rows(batches):
    import pyarrow as pa
    shingler, seen = Shingler(WIDTH), set()
    for batch in batches:
        sids, sizes, short, items = [], [], [], []
        for _, s in shingler.sets(batch.column(0)):
            sid = _set_id(s)
            if sid not in seen:
                seen.add(sid)
                sids.append(sid), sizes.append(len(s)), short.append(_short(s).tobytes()), items.append(s.tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(sids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(short, pa.binary()), pa.array(items, pa.binary())],
                                         ["sid", "size", "short", "items"])


def _common(left, right) -> int:
    both = np.concatenate([left, right])
    both.sort(kind="stable")
    return int((both[1:] == both[:-1]).sum())


def _may_rows(batches):
    """Rows (a, b, short sets and sizes) that can still link: remainders that coincide inside a set hide at most
    size - distinct of its shingles, so the bound is exact."""
    import pyarrow as pa
    for batch in batches:
        a, b = [], []
        for x, y, left, n, right, n2 in zip(*(batch.column(i).to_pylist() for i in range(6))):
            left, right = np.frombuffer(left, np.uint16), np.frombuffer(right, np.uint16)
            most = min(n, n2, _common(left, right) + min(n - len(left), n2 - len(right)))
            if (NUM + DEN) * most >= NUM * (n + n2):
                a.append(x), b.append(y)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _verify_rows(batches):
    """Rows (a, b, whole sets) that reach the similarity."""
    import pyarrow as pa
    for batch in batches:
        a, b = [], []
        for x, y, left, right in zip(*(batch.column(i).to_pylist() for i in range(4))):
            left, right = np.frombuffer(left, np.uint64), np.frombuffer(right, np.uint64)
            if (NUM + DEN) * _common(left, right) >= NUM * (len(left) + len(right)):
                a.append(x), b.append(y)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _read_sets(tables: Tables, name: str, pairs: DataFrame, docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(sid, size, short, items) of the sets in pairs (a, b). Only their texts are read again and shuffled."""
    wanted = pairs.select(F.col("a").alias("sid")).unionByName(pairs.select(F.col("b").alias("sid"))).distinct()
    # one row of documents for every wanted set
    rows = tables.put(f"{name}-rows", ids.join(wanted, "sid", "left_semi").groupBy("sid").agg(F.min("row_key").alias("row_key")))
    key = row_key(F.col("id"), F.col("text"))
    near, _ = split_by_keys(docs.select("id", "text"), key, rows, "row_key")
    chosen = near.withColumn("row_key", key).join(rows.select("row_key"), "row_key", "left_semi")
    sets = chosen.select("text").mapInArrow(_set_rows, "sid long, size long, short binary, items binary").dropDuplicates(["sid"])
    return tables.put(f"{name}-sets", sets)


def _verified(tables: Tables, name: str, pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of sids that link: first by the short sets, the rest by the whole ones."""
    def sides(pairs, col, *more):
        for side, end in (("a", "1"), ("b", "2")):
            pairs = pairs.join(sets.select(F.col("sid").alias(side), *[F.col(c).alias(c + end) for c in (col, *more)]), side)
        return pairs
    may = sides(pairs.select("a", "b"), "short", "size").select("a", "b", "short1", "size1", "short2", "size2")
    may = tables.put(f"{name}-may", may.mapInArrow(_may_rows, "a long, b long"))
    whole = sides(may, "items").select("a", "b", "items1", "items2")
    return tables.put(f"{name}-links", whole.mapInArrow(_verify_rows, "a long, b long"))


def similar_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, n_shingles, component_id (smallest id reachable by links), row_key."""
    spark = docs.sparkSession
    tables = Tables(spark, "ngram_join")
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    levels = frequency_levels(tables, docs, "text")
    keyed = docs.select("id", row_key(F.col("id"), F.col("text")).alias("row_key"), "text")
    id_type = dict(docs.dtypes)["id"]
    sets = tables.put("sets", keyed.mapInArrow(_signature_rows(levels),
                      f"id {id_type}, row_key long, sid long, n long, ones array<long>, twos array<long>, often long, end long, " + ", ".join(f"{c} long" for c in PARITY)))
    boundary = light_boundary(sets)
    near = -(-NUM * (boundary + 1) // DEN)  # light sets from this size on may link with a heavy one
    light = F.when(F.col("n") <= boundary, F.col("twos")).otherwise(F.array().cast("array<long>"))
    heavy = F.when(F.col("n") >= near, F.col("ones")).otherwise(F.array().cast("array<long>"))
    # a posting for every key; neighbours in a list are ordered by size
    post = (sets.filter(F.size("ones") > 0).select("sid", "n", F.explode(F.concat(light, heavy)).alias("key")))
    other = lambda f: F.expr(f"{f}(sid) over (partition by key order by n, sid)")
    lists = (post.withColumn("prev", other("lag")).withColumn("next", other("lead"))
             .filter("(prev is not null and prev <> sid) or (next is not null and next <> sid)")
             .withColumn("prev_n", F.expr("lag(n) over (partition by key order by n, sid)"))
             .withColumn("members", F.expr("count(*) over (partition by key)")))
    lists = tables.put("lists", lists.select("key", "sid", "n", "prev", "prev_n", "members"))
    ids = sets.select("sid", "row_key")

    # neighbours first: for each set, the one it meets most often
    near_by = (lists.filter(f"prev <> sid and {DEN} * prev_n >= {NUM} * n").groupBy("sid", "n", "prev", "prev_n").agg(F.count("*").alias("times"))
           .filter(may_link("2 * times", "n", "prev_n", boundary)).groupBy("sid").agg(F.max_by("prev", F.struct("times", "prev")).alias("prev")))
    near_by = near_by.select(F.col("prev").alias("a"), F.col("sid").alias("b"))
    # and, in long lists, the leader: the member whose first shingles are in the longest lists. Of many edits of one
    # text, the text itself leads, even if the edits don't link with one another.
    long = lists.filter(F.col("members") >= LONG_LIST)
    weight = long.groupBy("sid", "n").agg((F.sum("members") / F.col("n")).alias("weight")).select(F.col("sid").alias("w_sid"), "weight")
    members = long.select("key", "sid", "n").distinct()
    leads = (members.join(weight, F.col("sid") == F.col("w_sid"))  # the smaller sid on equal weights
             .groupBy("key").agg(F.max_by(F.struct("sid", "n"), F.struct("weight", F.bitwise_not("sid"))).alias("lead")))
    led = (members.join(leads, "key").filter("lead.sid <> sid").groupBy("sid", "n", "lead").agg(F.count("*").alias("times"))
           .filter(f"{DEN} * least(n, lead.n) >= {NUM} * greatest(n, lead.n) and " + may_link("2 * times", "n", "lead.n", boundary))
           .groupBy("sid").agg(F.max_by("lead.sid", F.struct("times", "lead.sid")).alias("lead"))
           .select(F.least("sid", "lead").alias("a"), F.greatest("sid", "lead").alias("b")))
    met = tables.put("met", near_by.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).union(led).distinct())
    links = _verified(tables, "first", met, _read_sets(tables, "first", met, docs, ids))
    roots = tables.put("roots", connected(tables, links, "first-cc"))
    tables.drop("first-sets")

    # then the pairs of different components in the lists that still span several
    root = F.coalesce("root", "sid").alias("root")
    marked = tables.put("marked", lists.select("key", "sid", "n").distinct().join(roots.withColumnRenamed("id", "sid"), "sid", "left")
                        .select("key", "sid", "n", root))
    tables.drop("lists")
    open_keys = marked.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("key")
    left = marked.join(open_keys, "key", "left_semi")
    # a set shares with another component no more than its open first shingles and the rest of its shingles
    reach = (left.groupBy("sid").agg(F.count("*").alias("keys"))
             .join(sets.filter(F.size("ones") > 0).select("sid", "end", F.size("ones").alias("firsts"), *PARITY).distinct(), "sid")
             .select("sid", "end", "firsts", *PARITY, F.least("keys", "firsts").alias("open_firsts")))
    left = tables.put("open", left.join(reach, "sid").select("key", "sid", "n", "root", "end", *PARITY, (F.col("n") - F.col("firsts")).alias("rest"),
                                                             (F.col("n") - F.col("firsts") + F.col("open_firsts")).alias("reach")))
    right = left.select("key", *[F.col(c).alias(c + "2") for c in ("sid", "n", "root", "end", "rest", "reach", *PARITY)])
    cross = (left.join(right, "key").filter(f"root <> root2 and (n < n2 or (n = n2 and sid < sid2)) and {DEN} * n >= {NUM} * n2")
             .filter(can_reach("reach", "reach2", boundary)).filter(parities_allow())
             .groupBy(F.col("sid").alias("a"), F.col("sid2").alias("b"), "n", "n2", "root", "root2", "end", "end2", "rest", "rest2")
             .agg(F.count("*").alias("shared")).filter(can_reach("(shared + rest)", "(shared + rest2)", boundary))
             .select("a", "b", "n", "n2", "root", "root2", "shared"))
    cross = tables.put("cross", cross)
    tables.drop("open")
    sets_in = _read_sets(tables, "cross", cross, docs, ids)
    # one pair of every two components first: if it links, the others need no check
    order = F.struct(F.col("shared") / (F.col("n") + F.col("n2")), "a", "b")
    best = (cross.groupBy(F.least("root", "root2").alias("r1"), F.greatest("root", "root2").alias("r2"))
            .agg(F.max_by(F.struct("a", "b"), order).alias("pair")).select("pair.a", "pair.b"))
    best = tables.put("best", best)
    links = tables.put("links-2", links.unionByName(_verified(tables, "best", best, sets_in)))
    roots = tables.put("roots-2", connected(tables, links, "best-cc"))
    of = lambda side: roots.select(F.col("id").alias(side), F.col("root").alias(f"root_{side}"))
    rest = (cross.select("a", "b").join(best, ["a", "b"], "left_anti").join(of("a"), "a", "left").join(of("b"), "b", "left")
            .filter(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b"))
    rest = tables.put("rest", rest)
    linked = connected(tables, links.unionByName(_verified(tables, "rest", rest, sets_in)), "all-cc")

    # smallest document id of every component; sums per set first, as copies of one set may be many
    named = sets.filter("n > 0").groupBy("sid").agg(F.min("id").alias("least"))
    classes = (named.join(linked.withColumnRenamed("id", "sid"), "sid", "left")
               .withColumn("root", F.coalesce("root", "sid")))
    least = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    by_set = tables.put("classes", classes.join(least, "root").select("sid", "component_id"))
    out = sets.select("id", "row_key", "sid", "n").join(by_set, "sid", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"),
                      F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"), "row_key")


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with only the smallest id of each component; same columns."""
    found = similar_components(docs, id_col, text_col)
    # a row goes when another row of its component stays; rows of an id that repeats in it count once
    stay = F.coalesce(F.col(id_col).eqNullSafe(F.col("component_id")), F.lit(True))
    decisions = (found.filter("n_shingles > 0").groupBy("row_key")
                 .agg(F.max(stay.cast("long")).alias("copies_kept"), F.count("*").alias("n")).filter("n > copies_kept").drop("n"))
    return keep_rows(docs, Tables(docs.sparkSession, "ngram_drop").put("decisions", decisions), id_col, text_col)
