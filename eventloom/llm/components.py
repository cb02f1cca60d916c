"""Connected components of a link table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.llm.common import Tables


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star round. Large: a node's larger neighbours move to its smallest neighbour; small: its
    smaller ones and the node itself do. Every step is an aggregation on one end and a join on it, so
    a node with very many neighbours is split by Spark's skew handling, never gathered."""
    if large:
        sides = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        sides = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = sides.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    moved = sides.join(least, "a")
    if large:
        out = moved.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = (moved.select(F.col("b").alias("a"), F.col("m").alias("b"))
               .unionByName(least.select("a", F.col("m").alias("b"))))
    return out.filter("a <> b").distinct()


def connected(tables: Tables, links: DataFrame, name: str) -> DataFrame:
    """(id, root) for every id of the links (a, b): root is the smallest id reachable, so ids that
    link to nothing don't occur. Ids are non-null longs."""
    edges = tables.put(f"{name}-0", links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                       .filter("a <> b").distinct())
    turn = 0
    before = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    while True:
        turn += 1
        new = tables.put(f"{name}-{turn}", _star(_star(edges, True), False))
        tables.drop(f"{name}-{turn - 1}")
        now = new.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        edges = new
        if now == before:
            break
        before = now
    roots = edges.select(F.col("b").alias("id")).distinct().select("id", F.col("id").alias("root"))
    return edges.select(F.col("a").alias("id"), F.col("b").alias("root")).unionByName(roots)
