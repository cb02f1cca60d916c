"""Merkle manifest of a table: nested-struct rollup over the digits of a row's rank.

Every row is a leaf: SHA-256 over its fields. The leaves of a tree (one for each value of the tree
column) stand in order of their id; runs of 8 consecutive nodes become their parent until one is left,
the subroot. The subroots, in order of the tree's value, become the root in the same way.

A rank is written in digits of base 8. Blocks of 8^3 leaves are one row each: the lowest digit is grouped
away first, then the next, each time nesting the children's structs in an array of their parent, all in
the one shuffle that brings a block together. Blocks are the leaves of the next rollup, and so on, so a
row never holds more than a block, at any number of rows. A block's path to the root comes into its group
as one more row, and the nested structs are unfolded by transform and explode: each explode adds the
siblings left and right of a node, so the proofs need no join of leaves with nodes.

The rank: rows are range-partitioned and sorted by (tree, id, leaf, seat); what lies before a task's rows
of a tree is a sum over tasks, not over rows.

Defined cases: a null field is "-", any other its length in bytes, ":" and its value, so no two rows share
a field string; a null id comes first and is never tampered with; rows that repeat an id stand in order of
their leaf; a null tree value is a tree of its own and comes first; a tree of one leaf has that leaf as
its subroot, a table of one tree its subroot as root; no siblings give the SHA-256 of the empty string;
an empty table gives an empty result; other columns are ignored and may have any name.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.llm.common import Tables

RUN_BITS = 3
#: Digits that one block rolls up: 8^3 = 512 leaves, about 75 kB as a nested row.
BLOCK_DIGITS = 3
BLOCK = 1 << (RUN_BITS * BLOCK_DIGITS)
#: A table of (task, tree) offsets of at most this many rows is broadcast; a larger one is joined by shuffle.
BROADCAST_ROWS = 1 << 18
STEPS = "array<struct<l:string,r:string>>"


def field_text(c: Column) -> Column:
    """Self-delimiting text of a field: "-" for null, else bytes, ":" and the value."""
    s = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf_hash(cols: list[Column]) -> Column:
    return F.sha2(F.concat(*[field_text(c) for c in cols]), 256)


def _ranked(tables: Tables, name: str, rows: DataFrame, order: list[str]) -> DataFrame:
    """rows with `rank` (from 0, within `tree`) and `n`, the number of rows of the tree."""
    keys = ["tree", *order, "seat"]
    # the seat splits a run of rows that are equal in all else: which of them comes first changes nothing
    placed = tables.put(f"{name}-placed", rows.withColumn("seat", F.monotonically_increasing_id())
                        .repartitionByRange(*keys).sortWithinPartitions(*keys)
                        .withColumn("at", F.monotonically_increasing_id()).drop("seat"))
    task = F.shiftright("at", 33)
    runs = placed.groupBy("tree", task.alias("task")).agg(F.min("at").alias("first"), F.count("*").alias("rows"))
    starts = tables.put(f"{name}-starts", runs.selectExpr(
        "tree as t_tree", "task as t_task",
        "coalesce(sum(rows) over (partition by tree order by task rows between unbounded preceding and 1 preceding), 0) - first as shift",
        "sum(rows) over (partition by tree) as n"))
    if starts.count() <= BROADCAST_ROWS:
        starts = F.broadcast(starts)
    return (placed.join(starts, (task == F.col("t_task")) & F.col("tree").eqNullSafe(F.col("t_tree")))
            .withColumn("rank", F.col("at") + F.col("shift")).drop("at", "shift", "t_tree", "t_task"))


def nest(nodes: DataFrame) -> DataFrame:
    """One row a block: tree, block, n, node (its hash and its kids, nested down to the leaves), path.
    nodes: tree, rank, n, hash, load, path. A row with a null hash only brings the path of its block."""
    digits = [f"d{k}" for k in range(BLOCK_DIGITS)]
    df = nodes.select("tree", F.shiftright("rank", RUN_BITS * BLOCK_DIGITS).alias("block"), "n", "path",
                      *[F.when(F.col("hash").isNotNull(), F.shiftright("rank", RUN_BITS * k).bitwiseAND(7)).cast("int").alias(d)
                        for k, d in enumerate(digits)],
                      F.struct("hash", "load").alias("node")).repartition("tree", "block")
    for k, digit in enumerate(digits):
        df = df.groupBy("tree", "block", *digits[k + 1:]).agg(
            F.max("n").alias("n"), F.first("path", ignorenulls=True).alias("path"),
            F.sort_array(F.collect_list(F.struct(digit, "node"))).alias("kids"))
        kids = F.transform(F.filter("kids", lambda x: x[digit].isNotNull()), lambda x: x["node"])
        df = df.withColumn("kids", kids)
        joined = F.sha2(F.concat_ws("", F.transform("kids", lambda x: x["hash"])), 256)
        # a tree of at most 8^k leaves ends below this level: its only node goes up as it is
        own = F.when(F.size("kids") > 0, F.when(F.col("n") > 8 ** k, joined).otherwise(F.col("kids")[0]["hash"]))
        df = df.withColumn("node", F.struct(own.alias("hash"), F.col("kids").alias("kids"))).drop("kids")
    return df


def unfold(blocks: DataFrame) -> DataFrame:
    """One row a leaf of nested blocks: tree, hash, load, subroot, root, steps (siblings left and right, from the leaf up)."""
    df = blocks.select("tree", "n", "node", F.col("path.subroot").alias("subroot"), F.col("path.steps").alias("steps"),
                       F.aggregate("path.steps", F.col("node.hash"), fold_step).alias("root"))
    for k in range(BLOCK_DIGITS - 1, -1, -1):
        beside = F.transform("node.kids", lambda x, i: F.struct(
            x.alias("node"),
            F.concat_ws("", F.transform(F.slice("node.kids", F.lit(1), i), lambda y: y["hash"])).alias("l"),
            F.concat_ws("", F.transform(F.slice("node.kids", i + 2, F.lit(8)), lambda y: y["hash"])).alias("r")))
        df = df.select("tree", "n", "subroot", "root", "steps", F.explode(beside).alias("kid"))
        step = F.array(F.struct(F.col("kid.l").alias("l"), F.col("kid.r").alias("r")))
        df = df.select("tree", "n", "subroot", "root", F.when(F.col("n") > 8 ** k, F.concat(step, F.col("steps"))).otherwise(F.col("steps")).alias("steps"),
                       F.col("kid.node").alias("node"))
    return df.select("tree", F.col("node.hash").alias("hash"), F.col("node.load").alias("load"), "subroot", "root", "steps")


def fold_step(node: Column, step: Column) -> Column:
    return F.sha2(F.concat(step["l"], node, step["r"]), 256)


def _proofs(tables: Tables, name: str, nodes: DataFrame, most: int, above) -> DataFrame:
    """unfold's rows for all nodes. nodes: tree, rank, n, hash, load; most: leaves of the largest tree;
    above: roots of the trees (tree, hash) -> (tree, path), the path from each tree's root upwards."""
    no_path = F.lit(None).cast(f"struct<subroot:string,steps:{STEPS}>")
    blocks = tables.put(f"{name}-blocks", nest(nodes.select("tree", "rank", "n", "hash", F.lit(None).cast("int").alias("load"), no_path.alias("path")))
                        .select("tree", "block", "n", F.col("node.hash").alias("hash")))
    if most > BLOCK:
        upper = blocks.select("tree", F.col("block").alias("rank"), F.ceil(F.col("n") / BLOCK).alias("n"), "hash",
                              F.struct("block").alias("load"))
        paths = (_proofs(tables, f"{name}-up", upper, -(-most // BLOCK), above)
                 .select("tree", F.col("load.block").alias("block"), F.struct("subroot", "steps").alias("path")))
    else:
        paths = above(blocks.select("tree", "hash")).select("tree", F.lit(0).cast("long").alias("block"), "path")
    arrivals = paths.select("tree", F.shiftleft("block", RUN_BITS * BLOCK_DIGITS).alias("rank"), F.lit(None).cast("long").alias("n"),
                            F.lit(None).cast("string").alias("hash"), F.lit(None).cast(nodes.schema["load"].dataType).alias("load"), "path")
    rows = nodes.select("tree", "rank", "n", "hash", "load", no_path.alias("path")).unionByName(arrivals)
    return unfold(nest(rows))


def manifest(docs: DataFrame, fields: list[str], tree_col: str, id_col: str, changed: dict[str, Column] | None = None,
             where: Column | None = None) -> DataFrame:
    """One row a row of docs: id, leaf, subroot, root, steps (siblings l, r from the leaf to the root) and
    changed_leaf: the leaf with the columns of `changed` in place of the table's, where `where` holds, else null."""
    tables = Tables(docs.sparkSession, "merkle")
    leaf = leaf_hash([F.col(c) for c in fields])
    other = F.lit(None).cast("string")
    if changed:
        other = F.when(where, leaf_hash([changed.get(c, F.col(c)) for c in fields]))
    leaves = docs.select(F.col(tree_col).alias("tree"), F.col(id_col).alias("id"), leaf.alias("hash"), other.alias("changed"))
    nodes = _ranked(tables, "leaves", leaves, ["id", "hash", "changed"])
    nodes = nodes.select("tree", "rank", "n", "hash", F.struct("id", "changed").alias("load"))
    most = nodes.agg(F.max("n")).first()[0] or 0

    def to_root(subroots: DataFrame) -> DataFrame:
        trees = subroots.select(F.lit(0).alias("tree"), F.col("tree").alias("name"), "hash")
        ranked = _ranked(tables, "trees", trees, ["name"]).select("tree", "rank", "n", "hash", F.struct("name", "hash").alias("load"))
        size = ranked.agg(F.max("n")).first()[0] or 0
        end = F.struct(F.lit(None).cast("string").alias("subroot"), F.array().cast(STEPS).alias("steps"))
        found = _proofs(tables, "trees", ranked, size, lambda top: top.select("tree", end.alias("path")))
        return found.select(F.col("load.name").alias("tree"), F.struct(F.col("load.hash").alias("subroot"), "steps").alias("path"))

    found = _proofs(tables, "leaves", nodes, most, to_root)
    return found.select(F.col("load.id").alias(id_col), F.col("hash").alias("leaf"), "subroot", "root", "steps", F.col("load.changed").alias("changed_leaf"))


def lower_ascii(c: Column) -> Column:
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def audit(docs: DataFrame) -> DataFrame:
    """The manifest of documents, checked against a copy in which every third document's text (by the CRC-32
    of its id) is lower-cased: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified."""
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    found = manifest(docs, ["doc_id", "source", "lang", "n_chars", "text"], "lang", "doc_id", {"text": lower_ascii(F.col("text"))}, tampered)
    proof = F.sha2(F.concat_ws("", F.transform("steps", lambda s: F.concat(s["l"], s["r"]))), 256)
    folded = F.aggregate("steps", F.coalesce("changed_leaf", "leaf"), fold_step)
    return (found.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), folded.alias("folded_root"))
            .withColumn("verified", F.col("folded_root") == F.col("root")))


AUDIT_SQL = """
with recursive fields as (
  select doc_id, lang, text, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as low,
    coalesce(strlen(cast(doc_id as varchar)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
      || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(cast(n_chars as varchar)) || ':' || n_chars, '-') as head
  from documents),
crc_table as (
  select i, list_reduce(list_prepend(i, range(8)), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as v
  from (select unnest(range(256)) as i)),
crc_bytes as (select list(v order by i) as v from crc_table),
leafs as (
  select doc_id, coalesce('1' || lang, '0') as tree, sha256(head || coalesce(strlen(text) || ':' || text, '-')) as leaf,
    case when xor(list_reduce(list_prepend(4294967295, list_transform(string_split(cast(doc_id as varchar), ''), lambda ch: cast(ascii(ch) as bigint))),
                lambda c, b: xor(v[xor(c, b) % 256 + 1], c >> 8)), 4294967295) % 3 = 0
      then sha256(head || coalesce(strlen(low) || ':' || low, '-')) end as changed
  from fields, crc_bytes),
ranked as (
  select *, row_number() over (partition by tree order by doc_id nulls first, leaf) - 1 as rank, count(*) over (partition by tree) as n from leafs),
nodes(tree, lvl, idx, h, n) as (
  select tree, 0, rank, leaf, n from ranked
  union all
  select tree, lvl + 1, idx // 8, sha256(string_agg(h, '' order by idx)), max(n + 7) // 8 from nodes where n > 1 group by tree, lvl, idx // 8),
subroots as (select tree, h, row_number() over (order by tree) - 1 as rank, count(*) over () as n from nodes where n = 1),
tops(lvl, idx, h, n) as (
  select 0, rank, h, n from subroots
  union all
  select lvl + 1, idx // 8, sha256(string_agg(h, '' order by idx)), max(n + 7) // 8 from tops where n > 1 group by lvl, idx // 8),
low_runs as (select tree, lvl, idx // 8 as run, list(h order by idx) as hs from nodes where n > 1 group by all),
top_runs as (select lvl, idx // 8 as run, list(h order by idx) as hs from tops where n > 1 group by all),
steps as (
  select r.tree, r.rank, l.lvl, cast(r.rank // cast(power(8, l.lvl) as bigint) % 8 as bigint) as pos, l.hs
  from ranked r join low_runs l on l.tree = r.tree and l.run = r.rank // cast(power(8, l.lvl + 1) as bigint)
  union all
  select r.tree, r.rank, 100 + l.lvl, cast(s.rank // cast(power(8, l.lvl) as bigint) % 8 as bigint), l.hs
  from ranked r join subroots s on s.tree = r.tree join top_runs l on l.run = s.rank // cast(power(8, l.lvl + 1) as bigint)),
paths as (
  select tree, rank, list({'l': array_to_string(hs[1:pos], ''), 'r': array_to_string(hs[pos + 2:], '')} order by lvl) as path
  from steps group by tree, rank),
folds(tree, rank, k, h, path) as (
  select r.tree, r.rank, 1, coalesce(r.changed, r.leaf), coalesce(p.path, []) from ranked r left join paths p using (tree, rank)
  union all
  select tree, rank, k + 1, sha256(path[k].l || h || path[k].r), path from folds where k <= len(path)),
folded as (select * from folds where k = len(path) + 1)
select r.doc_id, r.leaf, s.h as subroot, t.h as root,
  sha256(coalesce(array_to_string(list_transform(f.path, lambda x: x.l || x.r), ''), '')) as proof_sha256,
  f.h as folded_root, f.h = t.h as verified
from ranked r join subroots s using (tree) join (select h from tops where n = 1) t on true join folded f on f.tree = r.tree and f.rank = r.rank
"""
