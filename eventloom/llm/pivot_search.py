"""Exact top-k by inner product over a pivot-distance index.

A vector x gets one more component, sqrt(M^2 - |x|^2) with M the largest norm; a query gets 0 there. Then
|q - x|^2 = |q|^2 + M^2 - 2 <q, x>, so a large inner product is a small distance. Each vector is keyed by
its nearest pivot and its distance to it; sorted by that key, the vectors are cut into annuli (blocks of
one pivot, with an inner and an outer radius). For a query at distance d from a pivot, all vectors of
an annulus are at least max(lo - d, d - hi) away (triangle inequality).

Queries come in blocks, too. A block first searches the two annuli nearest to it, which gives every query
its k-th best score so far. Then it is joined to the annuli that this score leaves open: an
equality join on the pivot with a range of radii. The annuli are expanded in the order of their bounds, and the
search stops when no query of the block can gain from the next one.

Defined cases: vectors that are null, empty of finite numbers or without an id take no part; a shorter
vector counts as padded with zeros; of all rows only the query's own is no candidate of it, so rows that
repeat an id or a vector are candidates and queries of their own; ties go to the smaller id; an empty table gives an empty result. Scores beyond
2^53 are outside the defined range.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.llm.common import Tables

K = 20
#: Pivots and the bounded sample of vectors they are fitted on.
PIVOTS = 32
SAMPLE = 4096
ANNULUS = 1024
QUERY_BLOCK = 256
#: Annuli that one task expands for one query block.
CHUNK = 32


def quantised(vectors: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """(id, v array<long>, key) of the vectors that take part: v = floor(scale * x), key a number of the row."""
    x = F.col("v")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    fine = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != float("inf")))
    return (rows.filter(F.col("id").isNotNull() & x.isNotNull() & F.coalesce(fine, F.lit(False)))
            .select("id", F.transform(x, lambda e: F.floor(e * F.lit(float(scale)))).alias("v"), F.monotonically_increasing_id().alias("key")))


def _matrix(column, dim: int):
    """Arrow list column -> int64 matrix, zero-padded to dim."""
    import pyarrow.compute as pc
    n = len(column)
    sizes = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((n, dim), np.int64)
    rows = np.repeat(np.arange(n), sizes)
    out[rows, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _pivots(sample, dim: int, number: int):
    """Pivots by a few rounds of k-means on the sample (augmented vectors)."""
    if not len(sample):
        return np.zeros((1, dim + 1))
    rng = np.random.default_rng(7)
    centres = sample[rng.choice(len(sample), min(number, len(sample)), replace=False)]
    for _ in range(6):
        near = _distances(sample, centres).argmin(1)
        for j in range(len(centres)):
            own = sample[near == j]
            if len(own):
                centres[j] = own.mean(0)
    return np.unique(centres, axis=0)


def _distances(x, pivots):
    d = (x * x).sum(1)[:, None] - 2 * x @ pivots.T + (pivots * pivots).sum(1)[None]
    return np.sqrt(np.maximum(d, 0))


def _keyed(dim, pivots, m2, query: bool):
    def run(batches):
        import pyarrow as pa
        for batch in batches:
            if not batch.num_rows:
                continue
            v = _matrix(batch.column(1), dim).astype(float)
            extra = np.zeros(len(v)) if query else np.sqrt(np.maximum(m2 - (v * v).sum(1), 0))
            d = _distances(np.hstack([v, extra[:, None]]), pivots)
            near = d.argmin(1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(near.astype(np.int32)), pa.array(d[np.arange(len(d)), near])],
                                             ["id", "v", "key", "pivot", "dist"])
    return run


def _blocks(dim, most, kind):
    """Consecutive rows of one pivot, at most `most` together."""
    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext
        number = TaskContext.get().partitionId() << 32
        ids, keys, vecs, dists, pivot = [], [], [], [], None

        def out():
            nonlocal number, ids, keys, vecs, dists
            row = pa.RecordBatch.from_arrays(
                [pa.array([number], pa.int64()), pa.array([pivot], pa.int32()), pa.array([min(dists)], pa.float64()), pa.array([max(dists)], pa.float64()),
                 pa.array([len(ids)], pa.int32()), pa.array([np.array(ids, np.int64).tobytes()], pa.binary()), pa.array([np.array(keys, np.int64).tobytes()], pa.binary()),
                 pa.array([np.array(vecs, kind).tobytes()], pa.binary())],
                ["block", "pivot", "lo", "hi", "n", "ids", "keys", "vecs"])
            number += 1
            ids, keys, vecs, dists = [], [], [], []
            return row

        for batch in batches:
            if not batch.num_rows:
                continue
            v = _matrix(batch.column(1), dim)
            for i, key, p, d, x in zip(*(batch.column(c).to_pylist() for c in (0, 2, 3, 4)), v):
                if ids and (p != pivot or len(ids) >= most):
                    yield out()
                pivot = p
                ids.append(i), keys.append(key), vecs.append(x), dists.append(d)
        if ids:
            yield out()
    return run


def _block_table(tables: Tables, name: str, keyed: DataFrame, dim: int, most: int, kind) -> DataFrame:
    parts = int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = keyed.repartitionByRange(parts, "pivot", "dist", "id", "key").sortWithinPartitions("pivot", "dist", "id", "key")
    return tables.put(name, ordered.mapInArrow(_blocks(dim, most, kind), "block long, pivot int, lo double, hi double, n int, ids binary, keys binary, vecs binary"))


def _array(blob, dtype, dim=None):
    a = np.frombuffer(blob, dtype)
    return a.reshape(-1, dim) if dim else a


class Best:
    """The k best (score, id) of every query of a block so far."""

    def __init__(self, queries, keys, k):
        self.q, self.keys, self.k = queries.astype(float), keys, k
        n = len(keys)
        self.scores = np.full((n, 0), -np.inf)
        self.found = np.zeros((n, 0), np.int64)

    def add(self, ids, keys, vecs):
        s = self.q @ vecs.T.astype(float)
        s[self.keys[:, None] == keys[None]] = -np.inf
        scores = np.hstack([self.scores, s])
        found = np.hstack([self.found, np.broadcast_to(ids, s.shape)])
        order = np.lexsort((found, -scores), axis=1)[:, :self.k]
        self.scores, self.found = np.take_along_axis(scores, order, 1), np.take_along_axis(found, order, 1)

    def kth(self):
        if self.scores.shape[1] < self.k:
            return np.full(len(self.keys), -np.inf)
        return self.scores[:, -1]


def _radius(q, m2, kth):
    """Distance within which a vector must lie to reach score kth."""
    d2 = (q * q).sum(1) + m2 - 2 * np.where(np.isfinite(kth), kth, 0)
    return np.where(np.isfinite(kth), np.sqrt(np.maximum(d2, 0)) * (1 + 1e-9) + 1e-6, np.inf)


def _expand(dim, pivots, m2, k, kind):
    """cogroup function: one query block and its annuli, in the order of their bounds."""
    def run(key, queries, annuli):
        import pandas as pd
        schema = {"query_id": "int64", "query_key": "int64", "vec_id": "int64", "score": "int64", "qblock": "int64", "pos": "int64"}
        if not len(queries) or not len(annuli):
            return pd.DataFrame({c: pd.Series(dtype=t) for c, t in schema.items()})
        row = queries.iloc[0]
        ids, keys, q = _array(row["ids_q"], np.int64), _array(row["keys_q"], np.int64), _array(row["vecs_q"], kind, dim)
        best = Best(q, keys, k)
        start = _array(row["kth"], float) if row["kth"] is not None else np.full(len(ids), -np.inf)
        d = _distances(np.hstack([q.astype(float), np.zeros((len(q), 1))]), pivots)
        qf = q.astype(float)
        for a in annuli.sort_values(["bound", "block"]).itertuples():
            reach = _radius(qf, m2, np.maximum(start, best.kth()))
            if a.bound > reach.max():
                break
            far = np.maximum(a.lo - d[:, a.pivot], d[:, a.pivot] - a.hi)
            if (far <= reach).any():
                best.add(_array(a.ids, np.int64), _array(a.keys, np.int64), _array(a.vecs, kind, dim))
        pos, at = np.nonzero(np.isfinite(best.scores))
        return pd.DataFrame({"query_id": ids[pos], "query_key": keys[pos], "vec_id": best.found[pos, at], "score": best.scores[pos, at].astype(np.int64),
                             "qblock": np.full(len(pos), row["q_of"], np.int64), "pos": pos.astype(np.int64)})
    return run


def _reaches(dim, pivots, m2, kind):
    """For each query block and pivot, the range of radii that its k-th scores leave open."""
    def run(batches):
        import pyarrow as pa
        for batch in batches:
            for number, ids, vecs, kth in zip(*(batch.column(i).to_pylist() for i in range(4))):
                q = _array(vecs, kind, dim).astype(float)
                d = _distances(np.hstack([q, np.zeros((len(q), 1))]), pivots)
                r = _radius(q, m2, _array(kth, float) if kth is not None else np.full(len(q), -np.inf))[:, None]
                p = len(pivots)
                yield pa.RecordBatch.from_arrays([pa.array([number] * p, pa.int64()), pa.array(range(p), pa.int32()), pa.array((d - r).min(0)), pa.array((d + r).max(0)),
                                                  pa.array(d.min(0)), pa.array(d.max(0))], ["qblock", "pivot", "near", "far", "dmin", "dmax"])
    return run


def _kth_blocks(n_of):
    def run(key, rows):
        import pandas as pd
        kth = np.full(int(rows["n"].iloc[0]), -np.inf)
        kth[rows["pos"].to_numpy()] = rows["kth"].to_numpy()
        return pd.DataFrame({"qblock": [key[0]], "kth": [kth.tobytes()]})
    return run


def top_k(vectors: DataFrame, is_query=None, id_col: str = "vec_id", vec_col: str = "embedding", k: int = K, scale: int = 64) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest inner products of every query among all rows but its own.
    is_query: a condition on `id` (default: divisible by 20)."""
    spark = vectors.sparkSession
    tables = Tables(spark, "pivot_search")
    is_query = is_query if is_query is not None else F.col("id") % 20 == 0
    rows = tables.put("vectors", quantised(vectors, id_col, vec_col, scale))
    norm = F.aggregate("v", F.lit(0.0), lambda s, e: s + e.cast("double") * e.cast("double"))
    dim, m2 = rows.agg(F.max(F.size("v")), F.max(norm)).first()
    dim, m2 = max(1, dim or 0), float(m2 or 0.0)
    # no component is larger than the largest norm
    kind = next((t for t in (np.int16, np.int32) if m2 < float(np.iinfo(t).max) ** 2), np.int64)
    sample = [r[0] for r in rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").collect()]
    s = np.zeros((len(sample), dim))
    for i, v in enumerate(sample):
        s[i, :len(v)] = v
    pivots = _pivots(np.hstack([s, np.sqrt(np.maximum(m2 - (s * s).sum(1), 0))[:, None]]), dim, PIVOTS)
    keyed = "id long, v array<long>, key long, pivot int, dist double"
    index = _block_table(tables, "index", rows.mapInArrow(_keyed(dim, pivots, m2, False), keyed), dim, ANNULUS, kind)
    queries = _block_table(tables, "queries", rows.filter(is_query).mapInArrow(_keyed(dim, pivots, m2, True), keyed), dim, QUERY_BLOCK, kind)
    queries = queries.select(F.col("block").alias("qblock"), "pivot", "lo", "hi", "n", F.col("ids").alias("ids_q"), F.col("keys").alias("keys_q"), F.col("vecs").alias("vecs_q"))
    annuli = index.select("block", "pivot", "lo", "hi")

    def search(pairs: DataFrame, blocks: DataFrame, name: str) -> DataFrame:
        """pairs: qblock, chunk, block, bound."""
        wanted = pairs.select(F.col("qblock").alias("q_of"), F.col("chunk").alias("chunk_of")).distinct()
        left = wanted.join(blocks, F.col("q_of") == F.col("qblock")).select("q_of", "chunk_of", "ids_q", "keys_q", "vecs_q", "kth")
        right = pairs.join(index, "block").select("qblock", "chunk", "block", "bound", "pivot", "lo", "hi", "ids", "keys", "vecs")
        found = left.groupBy("q_of", "chunk_of").cogroup(right.groupBy("qblock", "chunk")).applyInPandas(
            _expand(dim, pivots, m2, k, kind), "query_id long, query_key long, vec_id long, score long, qblock long, pos long")
        ranked = found.withColumn("rank", F.expr("row_number() over (partition by qblock, pos order by score desc, vec_id)"))
        return tables.put(name, ranked.filter(F.col("rank") <= k))

    # seeds: the two annuli of the block's own pivot that are nearest to it
    gap = F.greatest(F.col("lo") - F.col("q_hi"), F.col("q_lo") - F.col("hi"), F.lit(0.0))
    seeds = (queries.select("qblock", "pivot", F.col("lo").alias("q_lo"), F.col("hi").alias("q_hi")).join(annuli, "pivot")
             .withColumn("bound", gap).withColumn("nr", F.expr("row_number() over (partition by qblock order by bound, block)")).filter("nr <= 2")
             .select("qblock", F.lit(0).alias("chunk"), "block", "bound"))
    first = search(seeds, queries.withColumn("kth", F.lit(None).cast("binary")), "seeds")
    kth = (first.filter(F.col("rank") == k).select("qblock", "pos", F.col("score").cast("double").alias("kth"))
           .join(queries.select("qblock", "n"), "qblock").groupBy("qblock").applyInPandas(_kth_blocks(None), "qblock long, kth binary"))
    blocks = tables.put("blocks", queries.join(kth, "qblock", "left"))
    reach = blocks.select("qblock", "ids_q", "vecs_q", "kth").mapInArrow(_reaches(dim, pivots, m2, kind), "qblock long, pivot int, near double, far double, dmin double, dmax double")
    open_pairs = (reach.join(annuli, "pivot").filter("hi >= near and lo <= far")
                  .withColumn("bound", F.greatest(F.col("lo") - F.col("dmax"), F.col("dmin") - F.col("hi"), F.lit(0.0))))
    pairs = tables.put("pairs", open_pairs.withColumn("nr", F.expr("row_number() over (partition by qblock order by bound, block)"))
                       .select("qblock", F.expr(f"cast((nr - 1) div {CHUNK} as int)").alias("chunk"), "block", "bound"))
    found = search(pairs, blocks, "found")
    best = found.withColumn("rank", F.expr("row_number() over (partition by query_key order by score desc, vec_id)").cast("int"))
    return best.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


TOP_K_SQL = """
with v as (select row_number() over () as key, vec_id as id, list_transform(embedding, lambda x: cast(floor(64 * cast(x as double)) as bigint)) as q from embeddings
           where embedding is not null and vec_id is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.key, a.id as query_id, b.id as vec_id, cast(list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2])) as bigint) as score
      from v a join v b on a.key <> b.key where a.id % 20 = 0)
select query_id, cast(rank as integer) as rank, vec_id, score from (
  select *, row_number() over (partition by key order by score desc, vec_id) as rank from s) where rank <= 20
"""
