"""Mixing sources to target weights by Poisson replication, with DataFrame functions only.

Source s with n_s rows and target weight w_s gets the mean repetition rate
lambda_s = total * w_s / sum(w) / n_s. Every document draws a uniform u from a hash of seed and id, and
is emitted as often as the inverse Poisson distribution says: the number of k with P(X <= k) < u. The
copies then go through a global shuffle, in the order of a hash of seed, id and copy number.

Defined cases: a null source is a source of its own; a null id draws as the text "null"; rows that
repeat an id draw the same count; a source without a weight (or weight 0) goes; null and empty texts are
documents like any other; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.llm.common import Tables, fresh

SEED = 17
#: Target weight of a source: its row count to this power.
POWER = 0.5
#: Mean number of rows of the mix for each input row.
EPOCHS = 1.0
#: A rate table of at most this many entries (8 MB) is broadcast; a larger one is joined by shuffle.
BROADCAST_ENTRIES = 1 << 20


def uniform(seed: int, *parts: Column) -> Column:
    """53 bits from an MD5 of seed and parts, in (0, 1)."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def poisson_tables(rates: DataFrame) -> DataFrame:
    """rates(source, lambda) -> adds cdf: array of P(X <= k) for k = 0.. until the rest is below 2^-53."""
    top = F.ceil(F.col("lambda") + 12 * F.sqrt("lambda") + 40).cast("long")
    steps = rates.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), top)))
    # log of k!, then the probabilities, each by a running sum within one source
    steps = steps.withColumn("log_fact", F.expr("sum(ln(greatest(k, 1))) over (partition by source order by k)"))
    steps = steps.withColumn("p", F.exp(F.when(F.col("k") == 0, -F.col("lambda"))
                                        .otherwise(F.col("k") * F.ln("lambda") - F.col("lambda") - F.col("log_fact"))))
    steps = steps.withColumn("cdf", F.expr("sum(p) over (partition by source order by k)"))
    return (steps.groupBy("source", "lambda").agg(F.array_sort(F.collect_list("cdf")).alias("cdf")))


def mix_sources(docs: DataFrame, weights: DataFrame | None = None, epochs: float = EPOCHS, seed: int = SEED,
                id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """docs replicated to the target weights, in a global random order. Adds copy_no (from 0), copies,
    rate and shuffle_key. weights: (source, weight); without it a source's weight is n^POWER."""
    names = {n: fresh(docs, n) for n in ("copy_no", "copies", "rate", "shuffle_key", "mix_source", "mix_cdf")}
    counts = docs.groupBy(F.col(source_col).alias("source")).agg(F.count("*").alias("n"))
    counts = Tables(docs.sparkSession, "poisson_mix").put("counts", counts)
    if weights is None:
        weighed = counts.withColumn("weight", F.pow("n", F.lit(POWER)))
    else:
        w = weights.select(F.col("source").alias("w_source"), F.col("weight").cast("double"))
        weighed = counts.join(w, F.col("source").eqNullSafe(F.col("w_source")), "left").fillna(0.0, ["weight"]).drop("w_source")
    sums = weighed.agg(F.sum("n").alias("rows"), F.sum("weight").alias("mass")).first()  # two numbers
    rows, mass = sums["rows"] or 0, sums["mass"] or 1.0
    rates = weighed.select("source", F.round(epochs * rows * F.col("weight") / mass / F.col("n"), 9).alias("lambda"))
    tables = poisson_tables(rates.filter("lambda > 0"))
    tables = tables.select(F.col("source").alias(names["mix_source"]), F.col("lambda").alias(names["rate"]), F.col("cdf").alias(names["mix_cdf"]))
    entries = rates.agg(F.sum(F.col("lambda") + 12 * F.sqrt("lambda") + 41)).first()[0] or 0
    if entries <= BROADCAST_ENTRIES:
        tables = F.broadcast(tables)
    u = uniform(seed, F.col(id_col))
    drawn = (docs.join(tables, docs[source_col].eqNullSafe(F.col(names["mix_source"])))
             .withColumn(names["copies"], F.size(F.filter(F.col(names["mix_cdf"]), lambda c: c < u)).cast("long")))
    copies = drawn.filter(F.col(names["copies"]) > 0).withColumn(
        names["copy_no"], F.explode(F.sequence(F.lit(0).cast("long"), F.col(names["copies"]) - 1)))
    key = F.md5(F.concat_ws(":", F.lit(f"{seed}-order"), F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.col(names["copy_no"])))
    copies = copies.withColumn(names["shuffle_key"], F.substring(key, 1, 16))
    out = copies.select(*[F.col(f"`{c}`") for c in docs.columns], names["copy_no"], names["copies"], names["rate"], names["shuffle_key"])
    return out.orderBy(names["shuffle_key"])


#: The same rows in DuckDB SQL.
MIX_SQL = f"""
with counts as (select source, count(*) as n from documents group by source),
rates as (select source, round({EPOCHS} * (select sum(n) from counts) * pow(n, {POWER}) / (select sum(pow(n, {POWER})) from counts) / n, 9) as lam from counts),
steps as (select source, lam, k, sum(ln(greatest(k, 1))) over (partition by source order by k) as log_fact
          from rates, unnest(range(0, cast(ceil(lam + 12 * sqrt(lam) + 40) as bigint) + 1)) as t(k)),
cdfs as (select source, lam, k, sum(exp(case when k = 0 then -lam else k * ln(lam) - lam - log_fact end))
                over (partition by source order by k) as cdf from steps),
drawn as (select d.doc_id, any_value(d.text) as text, any_value(d.lang) as lang, any_value(d.source) as source, any_value(d.n_chars) as n_chars,
                 any_value(c.lam) as rate, count(*) filter (c.cdf < (cast('0x' || substr(md5('{SEED}:' || d.doc_id), 1, 13) as bigint) + 0.5) / 4503599627370496.0) as copies
          from documents d join cdfs c on d.source is not distinct from c.source group by d.doc_id)
select doc_id, text, lang, source, n_chars, copy_no, copies, rate,
       substr(md5('{SEED}-order:' || doc_id || ':' || copy_no), 1, 16) as shuffle_key
from drawn, unnest(range(0, copies)) as t(copy_no)
"""
