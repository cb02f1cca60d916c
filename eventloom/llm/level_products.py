"""Source divergence audit: one-hot level products.

Terms are rows, and every (group, count level) that occurs is an indicator column: 1 where the term occurs
that often in that group. The matrix times its transpose holds, for every two groups, the table of how many
terms have level a in the one and level b in the other. A price depends on the two levels alone, so each
cell is priced once and weighted with its count.

Counting: a text part's (group, term) counts leave the worker, Spark sums them. Products: terms stand in
order of their whole count, so a block of them has few levels; each task multiplies blocks of at most
BLOCK_TERMS rows and BLOCK_COLUMNS columns (groups of columns in turn where one term has more) and hands
out the cells that are not 0. Sums of 0 and 1 below 2^24 are exact in single precision. Level 0 is no
column: its cells are what the others leave of a group's levels (inclusion and exclusion), so the work
grows with the pairs of groups that share a term, not with all pairs.

Columns carry the name of their group: "=" and the source, or "" for the language as a whole.

Defined cases: null text, language or source is the empty string; repeated rows count each; a group
without terms takes part with counts of 0; a language without kept terms has value 0 for every pair and
no terms; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.llm.common import Tables, bound_batches

MIN_DOCS = 10
SCALE = 1_000_000_000
TOP_TERMS = 10
BLOCK_TERMS = 4096
BLOCK_COLUMNS = 1024
#: Bytes of text counted together in a worker.
PART_BYTES = 4_000_000
#: Every byte that is no letter (ASCII) and no part of a longer character becomes a space; A-Z become a-z.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def letter_runs(texts):
    """Arrow strings -> (terms of all texts one after the other, number of terms of each)."""
    import pyarrow as pa
    import pyarrow.compute as pc
    texts = texts.cast(pa.large_string()).fill_null("")
    _, bounds, data = texts.buffers()
    # the part's own bytes: a slice shares the buffer of its whole batch
    bounds = np.frombuffer(bounds, np.int64)[texts.offset:texts.offset + len(texts) + 1]
    mine = data[int(bounds[0]):int(bounds[-1])].to_pybytes() if data else b""
    clean = pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer((bounds - bounds[0]).tobytes()), pa.py_buffer(mine.translate(LETTERS)))
    words = pc.split_pattern(clean, " ")
    flat, sizes = words.flatten(), pc.list_value_length(words).to_numpy(zero_copy_only=False)
    full = pc.greater(pc.binary_length(flat), 0)
    of = np.repeat(np.arange(len(texts)), sizes)[full.to_numpy(zero_copy_only=False)]
    return flat.filter(full), of


def _count_parts(batches):
    import pyarrow as pa
    import pyarrow.compute as pc
    for batch in batches:
        if not batch.num_rows:
            continue
        bytes_to = np.cumsum(pc.fill_null(pc.binary_length(batch.column(2)), 0).to_numpy(zero_copy_only=False))
        first = 0
        while first < batch.num_rows:
            base = bytes_to[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(bytes_to, base + PART_BYTES, "right")))
            part = batch.slice(first, last - first)
            first = last
            groups: dict[tuple, int] = {}
            group = np.array([groups.setdefault(g, len(groups)) for g in zip(part.column(0).to_pylist(), part.column(1).to_pylist())])
            flat, of = letter_runs(part.column(2))
            if not len(flat):
                continue
            coded = flat.dictionary_encode()
            code, width = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), len(coded.dictionary)
            cells, n = np.unique(group[of] * width + code, return_counts=True)
            once = np.unique(of * width + code)
            _, docs = np.unique(group[once // width] * width + once % width, return_counts=True)
            names = list(groups)
            which = pa.array(cells // width)
            yield pa.RecordBatch.from_arrays(
                [pa.array([g[0] for g in names], pa.string()).take(which), pa.array([g[1] for g in names], pa.string()).take(which),
                 coded.dictionary.cast(pa.string()).take(pa.array(cells % width)), pa.array(n, pa.int64()), pa.array(docs, pa.int64())],
                ["lang", "source", "term", "n", "docs"])


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents) for every term of a group. docs: lang, source, text, none null."""
    bound_batches(docs.sparkSession)
    parts = docs.select("lang", "source", "text").mapInArrow(_count_parts, "lang string, source string, term string, n long, docs long")
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def multiply(column_lists, block_columns: int = BLOCK_COLUMNS):
    """Cells (i, j, n) with i <= j and n > 0 of X^T X, exact. column_lists: for each row the columns that are 1."""
    sizes = np.array([len(x) for x in column_lists])
    rows = np.repeat(np.arange(len(sizes)), sizes)
    columns = np.concatenate([np.asarray(x, np.int64) for x in column_lists]) if len(sizes) else np.zeros(0, np.int64)
    width = int(columns.max()) + 1 if len(columns) else 0
    stripes = []
    for start in range(0, width, block_columns):
        here = (columns >= start) & (columns < start + block_columns)
        x = np.zeros((len(sizes), min(block_columns, width - start)), np.float32)
        x[rows[here], columns[here] - start] = 1
        stripes.append((start, x))
    for a, (i0, x) in enumerate(stripes):
        for j0, y in stripes[a:]:
            product = x.T @ y
            i, j = np.nonzero(np.triu(product) if i0 == j0 else product)
            yield i + i0, j + j0, product[i, j].astype(np.int64)


def _products(block_terms: int, block_columns: int):
    def run(batches):
        import pyarrow as pa
        lang, columns, block = None, {}, []

        def flush():
            nonlocal columns, block
            names = list(columns)
            who, level = pa.array([c[0] for c in names], pa.string()), pa.array([c[1] for c in names], pa.int64())
            for i, j, n in multiply(block, block_columns):
                for k in range(0, len(n), 100_000):
                    a, b = pa.array(i[k:k + 100_000]), pa.array(j[k:k + 100_000])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(a), pa.string()), who.take(a), level.take(a), who.take(b), level.take(b), pa.array(n[k:k + 100_000])],
                        ["lang", "group_a", "level_a", "group_b", "level_b", "terms"])
            columns, block = {}, []

        for batch in batches:
            for row_lang, groups in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if block and (row_lang != lang or len(block) >= block_terms or len(columns) + len(groups) > block_columns):
                    yield from flush()
                lang = row_lang
                # column order within a row by name, so that each pair of groups has one order
                block.append([columns.setdefault((g["name"], g["n"]), len(columns)) for g in groups])
        if block:
            yield from flush()
    return run


def joint_tables(terms: DataFrame, block_terms: int = BLOCK_TERMS, block_columns: int = BLOCK_COLUMNS) -> DataFrame:
    """lang, group_a, level_a, group_b, level_b, terms for levels above 0 and group_a <= group_b; where the
    groups are the same, so are the levels. terms: lang, term, total, groups (name, n, docs) with n > 0."""
    whole = F.struct(F.lit("").alias("name"), F.col("total").alias("n"))
    named = F.transform("groups", lambda g: F.struct(F.concat(F.lit("="), g["source"]).alias("name"), g["n"].alias("n")))
    rows = terms.select("lang", F.concat(F.array(whole), named).alias("columns"), "total", "term")
    rows = rows.repartitionByRange("lang", "total", "term").sortWithinPartitions("lang", "total", "term").select("lang", "columns")
    cells = rows.mapInArrow(_products(block_terms, block_columns),
                            "lang string, group_a string, level_a long, group_b string, level_b long, terms long")
    swap = F.col("group_a") > F.col("group_b")
    a, b = F.struct(F.col("group_a").alias("g"), F.col("level_a").alias("l")), F.struct(F.col("group_b").alias("g"), F.col("level_b").alias("l"))
    cells = cells.select("lang", F.when(swap, b).otherwise(a).alias("a"), F.when(swap, a).otherwise(b).alias("b"), "terms")
    return (cells.groupBy("lang", F.col("a.g").alias("group_a"), F.col("a.l").alias("level_a"), F.col("b.g").alias("group_b"),
                          F.col("b.l").alias("level_b")).agg(F.sum("terms").alias("terms")))


def share(count: str, n: str, v: str) -> Column:
    """p = 1 + floor(SCALE * (count + 2) / (n + 2 v)), exact (decimals: a count may be above 9 * 10^9)."""
    return F.expr(f"1L + cast((cast({SCALE} as decimal(10,0)) * cast({count} + 2 as decimal(20,0))) div cast({n} + 2 * {v} as decimal(20,0)) as long)")


def price(p: Column, q: Column) -> Column:
    """f = floor((p - q)^2 / (p + q)); p and q are at most SCALE + 1, so a long holds the square."""
    d = p - q
    return F.call_function("div", d * d, p + q)


def divergence(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text",
               min_docs: int = MIN_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """lang, source, part, item, value, rank: of every source its distance to each other source of the language
    (part pair) and the terms that set it apart from the whole language (part term, the first `top`)."""
    tables = Tables(docs.sparkSession, "level_products")
    docs = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name)
                         for c, name in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])
    listed = (term_counts(docs).groupBy("lang", "term")
              .agg(F.sum("n").alias("total"), F.sum("docs").alias("docs"), F.sort_array(F.collect_list(F.struct("source", "n"))).alias("groups")))
    terms = tables.put("terms", listed.filter(F.col("docs") >= min_docs).select("lang", "term", "total", "groups"))
    in_groups = terms.select("lang", "term", "total", F.inline("groups"))

    # every group with its own N and the language's V and N
    langs = terms.groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("lang_n"))
    sums = in_groups.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    groups = tables.put("groups", docs.select("lang", "source").distinct().join(sums, ["lang", "source"], "left").join(langs, "lang", "left")
                        .select("lang", F.concat(F.lit("="), "source").alias("name"), F.coalesce("n", F.lit(0).cast("long")).alias("n"),
                                F.coalesce("v", F.lit(0).cast("long")).alias("v"), F.coalesce("lang_n", F.lit(0).cast("long")).alias("lang_n")))
    joint = tables.put("joint", joint_tables(terms))

    zero = F.when(F.col("v") > 0, share("0", "n", "v"))
    a = groups.select("lang", F.col("name").alias("group_a"), F.col("n").alias("n_a"), "v", zero.alias("zero_a"))
    b = groups.select("lang", F.col("name").alias("group_b"), F.col("n").alias("n_b"), zero.alias("zero_b"))
    pairs = a.join(b, "lang").filter("group_a < group_b")
    level_a, level_b = share("level_a", "n_a", "v"), share("level_b", "n_b", "v")
    # inclusion and exclusion: cells of two levels, then of one level and all of the other group, then all terms
    none = price(F.col("zero_a"), F.col("zero_b"))
    both = (joint.filter("group_a <> '' and group_a < group_b").join(pairs, ["lang", "group_a", "group_b"])
            .withColumns({"p": level_a, "q": level_b})
            .select("lang", "group_a", "group_b", (F.col("terms") * (
                price(F.col("p"), F.col("q")) - price(F.col("p"), F.col("zero_b")) - price(F.col("zero_a"), F.col("q")) + none)).alias("value")))
    levels = joint.filter("group_a <> '' and group_a = group_b").select("lang", "group_a", "level_a", "terms")
    left = (levels.join(pairs, ["lang", "group_a"]).withColumn("p", level_a)
            .select("lang", "group_a", "group_b", (F.col("terms") * (price(F.col("p"), F.col("zero_b")) - none)).alias("value")))
    right = (levels.withColumnsRenamed({"group_a": "group_b", "level_a": "level_b"}).join(pairs, ["lang", "group_b"]).withColumn("q", level_b)
             .select("lang", "group_a", "group_b", (F.col("terms") * (price(F.col("zero_a"), F.col("q")) - none)).alias("value")))
    empty = pairs.select("lang", "group_a", "group_b", F.when(F.col("v") > 0, F.col("v") * none).otherwise(0).alias("value"))
    priced = (both.unionByName(left).unionByName(right).unionByName(empty)
              .groupBy("lang", "group_a", "group_b").agg(F.sum("value").cast("long").alias("value")))
    both_ways = F.explode(F.array(F.struct(F.col("group_a").alias("source"), F.col("group_b").alias("item")),
                                  F.struct(F.col("group_b").alias("source"), F.col("group_a").alias("item"))))
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    pair_rows = (priced.select("lang", "value", both_ways.alias("way"))
                 .select("lang", F.substr("way.source", F.lit(2)).alias("source"), F.substr("way.item", F.lit(2)).alias("item"), "value")
                 .withColumn("rank", F.row_number().over(by_value)))

    # the language as a whole is a group too: its cells with a source price every term of those two levels
    whole = (joint.filter("group_a = '' and group_b <> ''").join(
        groups.select("lang", F.col("name").alias("group_b"), F.col("n").alias("n_b"), "v", "lang_n"), ["lang", "group_b"])
        .withColumns({"p": level_b, "q": share("level_a", "lang_n", "v")}).filter("p > q")
        .select("lang", F.substr("group_b", F.lit(2)).alias("source"), F.col("level_b").alias("n"), F.col("level_a").alias("total"),
                price(F.col("p"), F.col("q")).alias("value")))
    # a term of the first `top` has fewer than `top` terms above it, so fewer than `top` cells
    cells = whole.withColumn("place", F.rank().over(Window.partitionBy("lang", "source").orderBy(F.desc("value")))).filter(F.col("place") <= top)
    term_rows = (in_groups.join(cells.drop("place"), ["lang", "source", "n", "total"]).select("lang", "source", F.col("term").alias("item"), "value")
                 .withColumn("rank", F.row_number().over(by_value)).filter(F.col("rank") <= top))
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return (pair_rows.withColumn("part", F.lit("pair")).select(*columns)
            .unionByName(term_rows.withColumn("part", F.lit("term")).select(*columns)))


DIVERGENCE_SQL = r"""
with d as (
  select row_number() over () as row, coalesce(lang, '') as lang, coalesce(source, '') as source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as words
  from documents),
w as (select row, lang, source, unnest(words) as term from d),
kept as (select lang, term, count(*) as total from w group by lang, term having count(distinct row) >= 10),
c as (select lang, source, term, count(*) as n from w semi join kept using (lang, term) group by all),
g as (select distinct lang, source from d),
lang_sums as (select lang, count(*) as v, sum(total) as lang_n from kept group by lang),
gn as (select g.lang, g.source, coalesce(sum(c.n), 0) as n from g left join c using (lang, source) group by all),
p as (
  select gn.lang, gn.source, kept.term, coalesce(c.n, 0) as n,
    1 + cast(1000000000 as hugeint) * (coalesce(c.n, 0) + 2) // cast(gn.n + 2 * v as hugeint) as p,
    1 + cast(1000000000 as hugeint) * (kept.total + 2) // cast(lang_n + 2 * v as hugeint) as q
  from gn join lang_sums using (lang) join kept using (lang) left join c on c.lang = gn.lang and c.source = gn.source and c.term = kept.term),
priced as (
  select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) as value
  from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
pairs as (
  select x.lang, x.source, 'pair' as part, y.source as item, cast(coalesce(value, 0) as bigint) as value
  from g x join g y on x.lang = y.lang and x.source <> y.source left join priced z on z.lang = x.lang and z.source = x.source and z.item = y.source),
apart as (
  select lang, source, 'term' as part, term as item, cast((p - q) * (p - q) // (p + q) as bigint) as value from p where n > 0 and p > q),
ranked as (
  select *, cast(row_number() over (partition by lang, source, part order by value desc, item) as integer) as rank
  from (select * from pairs union all select * from apart))
select lang, source, part, item, value, rank from ranked where part = 'pair' or rank <= 10
"""
