"""Shared helpers: tables in the shared folder, bounded Arrow batches, bitmap joins."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ARROW_ROWS = 500
#: Bits of a key bitmap; as a table it has at most BITMAP_BITS / 64 rows of 16 bytes, at any input size.
BITMAP_BITS = 1 << 22


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir; a local one only where none is named
    and the master is local."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    root = tempfile.mkdtemp(prefix="eventloom-llm-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


class Tables:
    """Written tables of one operator call, below the shared folder. They cut the lineage: a lost
    executor costs the tasks it ran, not the steps before."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{shared_folder(spark)}/llm/{name}-{uuid.uuid4().hex}"
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))

    def put(self, name: str, df: DataFrame) -> DataFrame:
        path = f"{self.base}/{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Remove tables that no result reads any more."""
        sc = self.spark.sparkContext
        for name in names:
            path = sc._jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}")
            path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def bound_batches(spark: SparkSession) -> None:
    """Few rows to an Arrow batch, so that very long texts fit in a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def fresh(df: DataFrame, name: str) -> str:
    """`name`, or a longer form of it where a column of df has that name already."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def row_key(*cols: Column) -> Column:
    """64-bit key of a row's columns; nulls count as values of their own."""
    parts = []
    for c in cols:
        parts += [c.isNull(), c]
    return F.xxhash64(*parts)


def _bit(key: Column) -> tuple[Column, Column]:
    slot = F.pmod(key, F.lit(BITMAP_BITS))
    return F.floor(slot / 64).cast("long"), (slot % 64).cast("int")


def key_bitmap(keys: DataFrame, key: str) -> DataFrame:
    """Bitmap of the keys as a table (bm_word, bm_bits) of at most BITMAP_BITS / 64 rows."""
    word, bit = _bit(F.col(key))
    return (keys.select(word.alias("bm_word"), bit.alias("bm_bit"))
            .groupBy("bm_word").agg(F.expr("bit_or(shiftleft(1L, bm_bit))").alias("bm_bits")))


def split_by_keys(df: DataFrame, key: Column, keys: DataFrame, key_name: str) -> tuple[DataFrame, DataFrame]:
    """(rows whose key may be among keys, rows whose key surely is not). The first holds all rows of
    keys and a few others; no row is shuffled for it. The bitmap's size is fixed, so it can always be
    broadcast; on a very large key set it fills up and the first part is then simply everything."""
    marks = key_bitmap(keys, key_name)
    w, b, h = fresh(df, "bm_word"), fresh(df, "bm_bit"), fresh(df, "bm_hit")
    bits = fresh(df, "bm_bits")
    marks = marks.select(F.col("bm_word").alias(w), F.col("bm_bits").alias(bits))
    word, bit = _bit(key)
    marked = (df.withColumns({w: word, b: bit}).join(F.broadcast(marks), w, "left")
              .withColumn(h, F.coalesce(F.expr(f"(`{bits}` & shiftleft(1L, `{b}`)) != 0"), F.lit(False))))
    return (marked.filter(F.col(h)).select(*[F.col(f"`{c}`") for c in df.columns]),
            marked.filter(~F.col(h)).select(*[F.col(f"`{c}`") for c in df.columns]))


def keep_rows(docs: DataFrame, decisions: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows of docs that the decisions keep. decisions: (row_key, copies_kept), for every row key of
    docs of which not all rows stay; row_key is row_key(id, text). Only rows of those keys (and the few
    that share their bitmap bit) are shuffled; of rows that repeat id and text, copies_kept stay."""
    k, n = fresh(docs, "row_key"), fresh(docs, "row_nr")
    d, c = fresh(docs, "decision_key"), fresh(docs, "decision_kept")
    key = row_key(F.col(id_col), F.col(text_col))
    hit, miss = split_by_keys(docs, key, decisions, "row_key")
    decisions = decisions.select(F.col("row_key").alias(d), F.col("copies_kept").alias(c))
    judged = hit.withColumn(k, key).join(decisions, F.col(k) == F.col(d), "left")
    stay = judged.filter(F.col(c).isNull() | (F.col(c) > 0))
    # rows of a kept key that repeat: one stays for each copy kept
    single = stay.filter(F.col(c).isNull())
    repeated = stay.filter(F.col(c).isNotNull()).dropDuplicates([k])
    cols = [F.col(f"`{x}`") for x in docs.columns]
    return miss.select(*cols).unionByName(single.select(*cols)).unionByName(repeated.select(*cols))
