"""Exact deduplication over an extendible-hash index on shared files, with DataFrame functions only.

Every text has a 64-bit hash key. The entries (key, SHA-256, length, id; no texts) are written as a table
in the shared folder. The directory has 2^depth slots, one for each prefix of the key; while a bucket
holds more distinct keys than its capacity, the directory doubles and the overfull buckets split (the
others keep their smaller local depth, so several slots point to one bucket). The directory routes every
entry to its bucket, and owner tasks take whole buckets: within a bucket, the different texts of a key are
chained. The texts of a key with more than one row are compared byte by byte (they come to the owner
grouped on the text itself, with map-side combine), so a chain has one link for each text, with the row that stays
and the size of the group. Rows find their link by bucket, key and digest; two links of one key that share
digest and length stop the job.

Defined cases: a null text is the empty text; a null id sorts below all ids; of rows that repeat
the largest id one is kept (the largest row key, so texts may differ in A-Z case); a row repeated very
often is written out by many tasks; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.llm.common import Tables, fresh, keep_rows, row_key, split_by_keys
from eventloom.operators.schedule import expand_counts

#: Distinct keys a bucket holds before it splits.
BUCKET_KEYS = 20_000
#: A directory of at most this many slots (16 MB) is broadcast; a larger one is joined by shuffle.
BROADCAST_SLOTS = 1 << 20
#: A key with at least this share of all rows is hot; there are at most 1 / HOT_SHARE of them.
HOT_SHARE = 1 / 256
MAX_DEPTH = 40
#: Copies of one row that one array may hold.
COPIES = 10_000


def normalised(text: Column) -> Column:
    """A-Z in lower case, all else as it is; null is empty."""
    return F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def _slot(depth: int) -> Column:
    return F.expr(f"shiftrightunsigned(key, {64 - depth})") if depth else F.lit(0).cast("long")


def directory(keys: DataFrame, capacity: int = BUCKET_KEYS) -> tuple[DataFrame, int]:
    """(slot, bucket, local_depth) for every slot in use, and the directory's depth. keys: distinct
    `key`. A bucket is named by its prefix, followed by a 1 and zeros up to the directory's depth."""
    total = keys.count()
    start = max(0, math.floor(math.log2(max(1, total / capacity))))
    depth = start
    while depth < MAX_DEPTH:
        fullest = keys.groupBy(_slot(depth).alias("slot")).count().agg(F.max("count")).first()[0] or 0
        if fullest <= capacity:
            break
        depth += 1
    slots = keys.groupBy(_slot(depth).alias("slot")).agg(F.count("*").alias("n"))
    # local depth: the smallest at which the slots of a prefix fit in one bucket together
    local, prefix = F.lit(depth), F.col("slot")
    for d in range(depth - 1, start - 1, -1):
        sums = (slots.groupBy(F.expr(f"shiftright(slot, {depth - d})").alias(f"p{d}")).agg(F.sum("n").alias(f"s{d}")))
        slots = slots.withColumn(f"p{d}", F.expr(f"shiftright(slot, {depth - d})")).join(sums, f"p{d}")
        fits = F.col(f"s{d}") <= capacity
        local, prefix = F.when(fits, F.lit(d)).otherwise(local), F.when(fits, F.col(f"p{d}")).otherwise(prefix)
    slots = slots.select("slot", local.alias("local_depth"), prefix.alias("prefix"))
    name = F.expr(f"shiftleft(2 * prefix + 1, {depth} - local_depth)")
    return slots.select("slot", name.alias("bucket"), "local_depth"), depth


def dedup_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = BUCKET_KEYS) -> DataFrame:
    """One row per row of docs: id, keep_id, group_size, kept, text_sha256, row_key.
    Of equal texts (A-Z lower-cased) one row with the largest id stays."""
    spark = docs.sparkSession
    tables = Tables(spark, "exact_index")
    norm = normalised(F.col(text_col))
    entries = docs.select(F.col(id_col).alias("id"), F.xxhash64(norm).alias("key"), F.sha2(norm, 256).alias("sha"),
                          F.octet_length(norm).alias("n_bytes"), row_key(F.col(id_col), F.col(text_col)).alias("row_key"))
    index = tables.put("index", entries)
    keys = tables.put("keys", index.groupBy("key").agg(F.count("*").alias("n")))
    slots, depth = directory(keys, capacity)
    slots = tables.put("directory", slots.select("slot", "bucket"))
    if slots.count() <= BROADCAST_SLOTS:
        slots = F.broadcast(slots)

    def routed(df: DataFrame) -> DataFrame:
        return df.withColumn("slot", _slot(depth)).join(slots, "slot").drop("slot")

    # Links: one for each text of a key that more than one row has, grouped on the text itself.
    shared = keys.filter("n > 1")
    may_share, _ = split_by_keys(docs.select(F.xxhash64(norm).alias("key"), norm.alias("norm"), F.col(id_col).alias("id"),
                                             row_key(F.col(id_col), F.col(text_col)).alias("row_key")), F.col("key"), shared, "key")
    links = (may_share.groupBy("key", "norm").agg(F.max(F.struct("id", "row_key")).alias("keep"), F.count("*").alias("group_size"))
             .select("key", F.sha2("norm", 256).alias("sha"), F.octet_length("norm").alias("n_bytes"), "keep", "group_size"))
    # Owner tasks: whole buckets; the links of a key form its chain.
    place = "over (partition by bucket, key order by sha, n_bytes)"
    chains = (routed(links).repartition("bucket").withColumn("chain_pos", F.expr(f"row_number() {place}"))
              .withColumn("twin", F.expr(f"lag(struct(sha, n_bytes)) {place} = struct(sha, n_bytes)"))
              .withColumn("chain_pos", F.when(F.col("twin"), F.raise_error(F.lit("different texts share length, 64-bit hash and SHA-256")).cast("int"))
                          .otherwise(F.col("chain_pos"))))
    groups = tables.put("chains", chains.filter("chain_pos > 0 and group_size > 1").select(
        "bucket", "key", "chain_pos", "sha", "n_bytes", F.col("keep.id").alias("keep_id"), F.col("keep.row_key").alias("keep_row"), "group_size"))

    # Every row looks its link up in its bucket; a hot link is repeated once for every salt of its rows.
    texts = tables.put("texts", index.groupBy("key", "sha", "n_bytes", "id", "row_key").agg(F.count("*").alias("copies")))
    rows = index.count()
    share = max(1000, rows * HOT_SHARE)
    on = ["bucket", "key", "sha", "n_bytes"]
    hot = F.broadcast(groups.filter(F.col("group_size") >= share).select(*on, F.ceil(F.col("group_size") / share).cast("int").alias("salts")))
    salted = (routed(texts).join(hot, on, "left")
              .withColumn("salt", F.when(F.col("salts").isNull(), 0).otherwise(F.pmod(F.xxhash64("id"), F.col("salts")).cast("int"))).drop("salts"))
    spread = (groups.join(hot, on, "left")
              .withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("salts"), F.lit(1)) - 1))).drop("salts"))
    joined = salted.join(spread, [*on, "salt"], "left").select("id", "row_key", "sha", "keep_id", "keep_row", "group_size", "copies")
    few = joined.filter(F.col("copies") <= COPIES).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    many = expand_counts(joined.filter(F.col("copies") > COPIES), "copies", "copy", COPIES)
    joined = few.unionByName(many.select(*few.columns))
    keep = F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("keep_id"))
    size = F.coalesce(F.col("group_size"), F.lit(1).cast("long"))
    return joined.select(F.col("id").alias(id_col), keep.alias("keep_id"), size.alias("group_size"),
                         (F.coalesce(F.col("row_key") == F.col("keep_row"), F.lit(True)) & F.col("id").eqNullSafe(keep) & (F.col("copy") == 1)).alias("kept"),
                         F.col("sha").alias("text_sha256"), F.col("row_key"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the copies that dedup_exact does not keep; same columns."""
    found = dedup_exact(docs, id_col, text_col)
    count = F.sum(F.col("kept").cast("long"))
    decisions = (found.filter("group_size > 1").groupBy("row_key")
                 .agg(count.alias("copies_kept"), F.count("*").alias("n")).filter("n > copies_kept").drop("n"))
    return keep_rows(docs, Tables(docs.sparkSession, "exact_drop").put("decisions", decisions), id_col, text_col)


__all__ = ["dedup_exact", "directory", "drop_copies", "fresh", "normalised"]
