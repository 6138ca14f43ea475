"""Internal consistency of reported statistics: recomputed p-values, and means that no whole sample can have."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import distribution
from ..functions.grammar import matches
from ..functions.plan import pinned

LABELS = INCONSISTENT, CONSISTENT, NOT_APPLICABLE = ("INTERNAL_INCONSISTENCY", "CONSISTENT", "NOT_APPLICABLE")
# A test result with its p-value, a mean, a sample size, and what stands between sentences.
STATISTIC = (
    r"(?U)(?<![\w.])(t|F|χ2|χ²|chi2|X2|z|r)\s*(?:\(\s*(\d+)\s*(?:,\s*(\d+)\s*)?\))?\s*=\s*"
    r"([-−]?\d*\.?\d+)\s*,\s*(?:p|P)\s*([=<>])\s*(\.?\d*\.?\d+)"
)
MEAN = r"(?U)\b(?:mean|M)\b\s*(?:was|is|of|=|\()?\s*[=(]?\s*(-?\d+\.\d+)"
SAMPLE = r"(?U)\b[Nn]\s*=\s*(\d+)\b"
BETWEEN = r"(?U)(?<=[.!?])\s+"


@F.arrow_udf(T.DoubleType())
def _p(kind: pa.Array, df1: pa.Array, df2: pa.Array, value: pa.Array) -> pa.Array:
    rows = zip(*(x.to_pylist() for x in (kind, df1, df2, value)), strict=True)
    return pa.array([None if v is None else distribution.p_value(k, a, b, v) for k, a, b, v in rows], pa.float64())


def statistics(papers: DataFrame) -> DataFrame:
    """doc_id, start, end, kind, reported, reported_p, p, label of every test result with a p-value.

    t, r, F and chi-square need degrees of freedom over zero, r a value within (-1, 1), else NOT_APPLICABLE. A p written
    with `=` agrees within half a unit of its last place; t, z and r may agree one-sided.
    """
    d = papers.select("doc_id", F.explode(matches(F.coalesce("text", F.lit("")), STATISTIC)).alias("m"))
    part = lambda i: F.regexp_extract("m.value", STATISTIC, i)
    kind = F.when(part(1).isin("χ2", "χ²", "chi2", "X2"), "chi2").otherwise(part(1))
    d = d.select(
        "doc_id", F.col("m.start").alias("start"), (F.col("m.start") + F.length("m.value")).alias("end"), kind.alias("test"), part(2).try_cast("double").alias("df1"),
        part(3).try_cast("double").alias("df2"), part(4).alias("shown"), F.replace(part(4), F.lit("−"), F.lit("-")).try_cast("double").alias("value"), part(5).alias("op"), part(6).alias("reported_p"),
    )
    c = F.col
    said = c("reported_p").try_cast("double")
    lacking = (c("test").isin("t", "r", "chi2") & c("df1").isNull()) | ((c("test") == "F") & (c("df1").isNull() | c("df2").isNull()))
    unfit = lacking | (c("df1") <= 0) | (c("df2") <= 0) | ((c("test") == "r") & (F.abs("value") >= 1)) | c("value").isNull() | said.isNull()
    unfit = F.coalesce(unfit, F.lit(False))
    d = d.withColumn("p", _p("test", "df1", "df2", F.when(~unfit, c("value"))))
    half = F.lit(0.5) * F.pow(F.lit(10.0), -F.length(F.regexp_extract("reported_p", r"\.(\d*)\z", 1)))

    def agrees(p: Column) -> Column:
        return F.when(c("op") == "<", p < said).when(c("op") == ">", p > said).otherwise(F.abs(p - said) <= half)

    fits = agrees(c("p")) | (c("test").isin("t", "z", "r") & agrees(c("p") / 2))
    label = F.when(c("p").isNull(), NOT_APPLICABLE).when(fits, CONSISTENT).otherwise(INCONSISTENT)
    reported = F.concat("test", F.lit("("), F.coalesce(c("df1").cast("long").cast("string"), F.lit("None")), F.lit(") = "), "shown", F.lit(", p "), "op", F.lit(" "), "reported_p")
    return d.select("doc_id", "start", "end", F.lit("statcheck").alias("kind"), reported.alias("reported"), "reported_p", "p", pinned(label).alias("label"))


def grim(samples: DataFrame, mean: str = "mean", n: str = "n") -> DataFrame:
    """samples with possible: some whole total over n rounds to the written mean (decimal text) at its precision.

    All in whole numbers: with d decimals, |mean * n - nearest whole| <= n * 5 / 10**(d + 1).
    """
    places = F.length(F.regexp_extract(mean, r"\.(\d*)\z", 1))
    total = F.try_multiply(F.abs(F.replace(mean, F.lit("."), F.lit("")).cast("decimal(38,0)")), F.col(n).cast("decimal(18,0)"))
    unit = F.rpad(F.lit("1"), places + 1, F.lit("0")).cast("decimal(38,0)")
    rest = F.col("_total") % F.col("_unit")
    off = F.least(rest, F.col("_unit") - rest)
    d = samples.withColumns({"_total": total.cast("decimal(38,0)"), "_unit": unit})
    return d.withColumn("possible", off * 2 <= F.col(n)).drop("_total", "_unit")


def _sentences(text: Column) -> Column:
    """array of struct(start, sentence): parts between BETWEEN, with their code-point offsets."""
    parts = F.split(text, BETWEEN, -1)
    gaps = F.concat(F.transform(F.regexp_extract_all(text, F.lit(BETWEEN), F.lit(0)), lambda g: F.length(g)), F.array(F.lit(0)))
    zipped = F.zip_with(parts, gaps, lambda s, g: F.struct(s.alias("s"), g.alias("g")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,sentence:string>>").alias("out"))

    def step(a, x):
        row = F.struct(a["at"].alias("start"), x["s"].alias("sentence"))
        return F.struct((a["at"] + F.length(x["s"]) + x["g"]).alias("at"), F.array_append(a["out"], row).alias("out"))

    return F.aggregate(zipped, start, step, lambda a: a["out"])


def means(papers: DataFrame) -> DataFrame:
    """doc_id, start, end, kind, reported, label of each sentence with exactly one mean and one sample size."""
    d = papers.select("doc_id", F.explode(_sentences(F.coalesce("text", F.lit("")))).alias("s"))
    d = d.select("doc_id", F.col("s.start").alias("at"), matches(F.col("s.sentence"), MEAN).alias("ms"), matches(F.col("s.sentence"), SAMPLE).alias("ns"))
    d = d.where((F.size("ms") == 1) & (F.size("ns") == 1)).select("doc_id", "at", F.get("ms", F.lit(0)).alias("m"), F.get("ns", F.lit(0)).alias("n0"))
    mean, n = F.regexp_extract("m.value", MEAN, 1), F.regexp_extract("n0.value", SAMPLE, 1)
    d = d.select(
        "doc_id", (F.col("at") + F.col("m.start")).alias("start"), (F.col("at") + F.col("n0.start") + F.length("n0.value")).alias("end"),
        F.concat(F.lit("mean "), mean, F.lit(", N = "), n).alias("reported"), mean.alias("mean"), n.try_cast("long").alias("n"),
    )
    label = F.when(F.coalesce(F.col("n"), F.lit(0)) <= 0, NOT_APPLICABLE).when(F.col("possible"), CONSISTENT).otherwise(INCONSISTENT)
    return grim(d).select("doc_id", "start", "end", F.lit("grim").alias("kind"), "reported", label.alias("label"))


def check(papers: DataFrame) -> DataFrame:
    """doc_id, start, end, kind, reported, label of every finding on normalized papers."""
    columns = ("doc_id", "start", "end", "kind", "reported", "label")
    return statistics(papers).select(*columns).unionByName(means(papers).select(*columns))


def counts(findings: DataFrame) -> DataFrame:
    """doc_id and a count of each label, zeros included."""
    return findings.groupBy("doc_id").agg(*[F.count_if(F.col("label") == x).alias(x) for x in LABELS])
