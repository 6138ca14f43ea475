"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._ranks import with_ties
from ._spark import Positional, cut, with_small

#: Bits of the hash that seeds a document's draw and its place in the shuffle.
BITS = 52


def _hash52(*parts) -> F.Column:
    """The first 13 hex digits of the md5 of the parts, joined by colons, as a long from 0 to 2**52 - 1."""
    joined = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    return F.conv(F.substring(F.md5(joined), 1, 13), 16, 10).cast("long")


def poisson_count(rate: F.Column, u: F.Column) -> F.Column:
    """The least k with P(X <= k) >= u for X Poisson of this mean; u from 0 (included) to 1.

    The sum runs over a window of 12 standard deviations about the mean, in steps from the smallest term on, so a
    large mean doesn't underflow: terms are exp(k log(rate) - rate - log k!).
    """
    reach = F.ceil(F.sqrt(rate) * 12 + 20).cast("long")
    low = F.greatest(F.lit(0).cast("long"), F.floor(rate).cast("long") - reach)
    ks = F.sequence(low, F.floor(rate).cast("long") + reach)
    start = F.struct(F.lit(0.0).alias("cdf"), low.alias("k"), F.lit(0.0).alias("log_fact"))
    # log k! by Stirling's series for the first term, then by adding logs
    x = low.cast("double") + 1
    stirling = (x - 0.5) * F.log(x) - x + 0.9189385332046727 + 1 / (12 * x) - 1 / (360 * x * x * x)
    first = F.when(low == 0, F.lit(0.0)).otherwise(stirling)

    def step(s, k):
        log_fact = F.when(k == low, first).otherwise(s["log_fact"] + F.log(k.cast("double")))
        term = F.exp(k * F.log(rate) - rate - log_fact)
        return F.when(s["cdf"] >= u, s).otherwise(
            F.struct((s["cdf"] + term).alias("cdf"), k.alias("k"), log_fact.alias("log_fact"))
        )

    return F.when(rate <= 0, F.lit(0).cast("long")).otherwise(F.aggregate(ks, start, step, lambda s: s["k"]))


def source_rates(docs: DataFrame, weights: dict[str, float] | None = None, epochs: float = 1.0, source_col: str = "source") -> DataFrame:
    """Mean repetitions of a document of each source.

    A source's share of the mixture is its weight over all weights of the sources present; weights names some of
    them, any other has weight 1. The mixture has epochs times the rows of docs on average. A null source is a source;
    repeated rows count each, an empty table has no sources. Columns: _source, _n_docs, _rate.
    """
    weight = F.lit(1.0)
    for name, value in (weights or {}).items():
        weight = F.when(F.col("_source") == F.lit(name), F.lit(float(value))).otherwise(weight)
    counts = cut(docs.groupBy(F.col(source_col).alias("_source")).agg(F.count("*").alias("_n_docs")))
    counts = counts.withColumn("_weight", weight)
    total = counts.agg(F.sum("_weight").alias("weight"), F.sum("_n_docs").alias("docs")).first()
    share = F.col("_weight") / F.lit(total["weight"] or 1.0)
    rate = share * F.lit((total["docs"] or 0) * float(epochs)) / F.col("_n_docs")
    return counts.select("_source", "_n_docs", rate.alias("_rate"))


def mix_poisson(
    docs: DataFrame,
    weights: dict[str, float] | None = None,
    epochs: float = 1.0,
    seed: int = 17,
    id_col: str = "doc_id",
    source_col: str = "source",
) -> DataFrame:
    """Replicate rows to target source weights and shuffle them: docs' columns and mix_rate, mix_copies, mix_copy, mix_key.

    Each row is kept mix_copies times (0: not at all), the inverse Poisson distribution with its source's mean at a
    uniform number hashed from seed and id. Rows that share an id, or have none, are drawn each for itself: the first
    (see with_ties) by the id alone, the others by the id and their number, so that however many they are, the mixture
    keeps its target. mix_key orders all copies at random; they are dealt to partitions by it and sorted within. A null
    source is a source of its own. Null, empty and very long texts and other columns don't matter; columns of docs with
    these names are replaced. Empty tables give empty results.
    """
    p = Positional(docs, ["mix_rate", "mix_copies", "mix_copy", "mix_key"])
    id_name, source = p.name(id_col), p.name(source_col)
    rates = source_rates(p.df, weights, epochs, source).select(F.col("_source"), F.col("_rate").alias("mix_rate"))
    drawn = with_ties(p.df, id_name)
    key = F.coalesce(F.col(id_name).cast("string"), F.lit("null"))
    key = F.when(F.col("tie") > 0, F.concat_ws(":", key, "tie")).otherwise(key)
    drawn = with_small(drawn.withColumn("_key", key), rates, F.col(source).eqNullSafe(F.col("_source")))
    u = _hash52(F.lit(seed), F.col("_key")) / F.lit(float(2**BITS))
    drawn = drawn.withColumn("mix_copies", poisson_count(F.col("mix_rate"), u))
    copies = drawn.where("mix_copies > 0").withColumn("mix_copy", F.explode(F.sequence(F.lit(1).cast("long"), "mix_copies")))
    keyed = copies.withColumn("mix_key", _hash52(F.lit(seed), F.col("_key"), F.col("mix_copy")))
    return p.restore(keyed.repartition("mix_key").sortWithinPartitions("mix_key"))


def op9_mix_poisson(spark, sf_dir: str) -> DataFrame:
    """All documents, mixed to equal weights of their sources, with the columns of the operator."""
    return mix_poisson(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP9_SQL = """
WITH counts AS (SELECT source, count(*) AS n_docs FROM documents GROUP BY source),
rates AS (
  SELECT source, ((1.0::DOUBLE / (SELECT count(*)::DOUBLE FROM counts)) * ((SELECT sum(n_docs) FROM counts)::DOUBLE * 1.0::DOUBLE)) / n_docs AS mix_rate
  FROM counts),
u AS (
  SELECT d.*, r.mix_rate,
    ('0x' || substr(md5('17:' || coalesce(CAST(d.doc_id AS VARCHAR), 'null')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u
  FROM documents d JOIN rates r ON d.source IS NOT DISTINCT FROM r.source),
steps AS (SELECT range AS k FROM range(0, 400)),
terms AS (
  SELECT r.source, r.mix_rate, s.k,
    sum(exp(s.k * ln(r.mix_rate) - r.mix_rate - lgamma(s.k + 1.0))) OVER (PARTITION BY r.source ORDER BY s.k) AS cdf
  FROM rates r, steps s WHERE s.k <= floor(r.mix_rate) + ceil(sqrt(r.mix_rate) * 12 + 20)),
drawn AS (
  SELECT u.doc_id, u.text, u.lang, u.source, u.n_chars, u.mix_rate,
    (SELECT min(t.k) FROM terms t WHERE t.source IS NOT DISTINCT FROM u.source AND t.cdf >= u.u) AS mix_copies
  FROM u)
SELECT doc_id, text, lang, source, n_chars, mix_rate, mix_copies::BIGINT AS mix_copies, c.c::BIGINT AS mix_copy,
  ('0x' || substr(md5('17:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || c.c), 1, 13))::BIGINT AS mix_key
FROM drawn, LATERAL (SELECT unnest(range(1, mix_copies + 1)) AS c) c
"""
