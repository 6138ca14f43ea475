"""Queries of the verdict operators, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.decimals import NUMBER, strict_decimal, written
from ..operators import verdicts as V
from ._tables import table

QUERIES: dict = {}
SQL: dict = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def _text(column, kind: str = "decimal(18,2)"):
    return F.col(column).cast(kind).cast("string")


def _lines(spark, d):
    return table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax")


_KEYS = ("l_orderkey", "l_linenumber")


def _decided(rows, *keys):
    return V.decide(rows).select(*keys, "verdict", "cause")


@query(
    "verdict_point",
    """
WITH x AS (SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(18,2)) AS re, CAST(trunc(CAST(o_totalprice AS DECIMAL(18,2))) AS BIGINT) AS v FROM orders),
s AS (SELECT o_orderkey, CASE WHEN v <> 0 AND v % 10 = 0 THEN 'PRECISION_AMBIGUOUS' WHEN abs(re - v) <= 0.5 THEN 'REPRODUCED' ELSE 'DIVERGED' END AS s FROM x)
SELECT o_orderkey, CASE WHEN s = 'PRECISION_AMBIGUOUS' THEN 'UNVERIFIED' ELSE s END AS verdict, CASE WHEN s = 'PRECISION_AMBIGUOUS' THEN s END AS cause FROM s
""",
)
def verdict_point(spark, d):
    """Order totals reported as their truncated whole part against the located amount."""
    rows = table(spark, d, "orders", "o_orderkey", "o_totalprice").select(
        "o_orderkey",
        F.lit(V.POINT).alias("kind"),
        written(F.col("o_totalprice").cast("decimal(18,2)").cast("bigint").cast("string")).alias("value"),
        strict_decimal(_text("o_totalprice")).alias("located"),
    )
    return _decided(rows, "o_orderkey")


@query(
    "verdict_bound",
    """
WITH x AS (SELECT l_orderkey, l_linenumber, CAST(l_discount AS DECIMAL(18,2)) AS re, CAST(0.05 AS DECIMAL(18,3)) AS m, 0.005 AS a, l_linenumber % 4 AS o FROM lineitem),
y AS (SELECT *, CASE o WHEN 0 THEN re < m WHEN 1 THEN re <= m WHEN 2 THEN re > m ELSE re >= m END AS h,
  CASE o WHEN 0 THEN re - a < m WHEN 1 THEN re - a <= m WHEN 2 THEN re - a > m ELSE re - a >= m END AS h1,
  CASE o WHEN 0 THEN re + a < m WHEN 1 THEN re + a <= m WHEN 2 THEN re + a > m ELSE re + a >= m END AS h2 FROM x)
SELECT l_orderkey, l_linenumber, CASE WHEN h1 <> h2 THEN 'UNVERIFIED' WHEN h THEN 'REPRODUCED' ELSE 'DIVERGED' END AS verdict,
  CASE WHEN h1 <> h2 THEN 'ARTIFACT_PRECISION_COARSER' END AS cause FROM y
""",
)
def verdict_bound(spark, d):
    """Discounts against a bound of 0.05 under each operator; a discount at the bound straddles it."""
    op = F.element_at(F.array(F.lit("<"), F.lit("<="), F.lit(">"), F.lit(">=")), (F.col("l_linenumber") % 4 + 1).cast("int"))
    rows = _lines(spark, d).select(
        *_KEYS, F.lit(V.BOUND).alias("kind"), op.alias("op"), written(F.lit("0.050")).alias("magnitude"), strict_decimal(_text("l_discount")).alias("located")
    )
    return _decided(rows, *_KEYS)


_BAND_SQL = """
s AS (SELECT *, CASE
  WHEN re BETWEEN lo AND hi THEN 'REPRODUCED'
  WHEN a > CASE WHEN re < lo THEN lh ELSE hh END AND abs(CASE WHEN re < lo THEN lo ELSE hi END - re) <= a THEN 'ARTIFACT_PRECISION_COARSER'
  WHEN w IS NOT NULL AND re BETWEEN lo - w AND hi + w THEN 'WITHIN-TOLERANCE' ELSE 'DIVERGED' END AS s FROM x)
SELECT l_orderkey, l_linenumber, CASE WHEN s = 'ARTIFACT_PRECISION_COARSER' THEN 'UNVERIFIED' ELSE s END AS verdict,
  CASE WHEN s = 'ARTIFACT_PRECISION_COARSER' THEN s END AS cause FROM s
"""


@query(
    "verdict_plus_minus",
    f"""
WITH x AS (SELECT l_orderkey, l_linenumber, CAST(l_extendedprice / 1000 AS DECIMAL(18,1)) AS re, 0.05 AS a, 25.00 - (12.5 + 0.005 + 0.05) AS lo, 25.00 + (12.5 + 0.005 + 0.05) AS hi,
  0.05 AS lh, 0.05 AS hh, CASE WHEN l_linenumber % 2 = 0 THEN 5.0 END AS w FROM lineitem), {_BAND_SQL}""",
)
def verdict_plus_minus(spark, d):
    """Prices in thousands against 25.00 with a margin of 12.5; every other line has a tolerance of 5."""
    rows = _lines(spark, d).select(
        *_KEYS,
        F.lit(V.PLUS_MINUS).alias("kind"),
        written(F.lit("25.00")).alias("center"),
        written(F.lit("12.5")).alias("margin"),
        strict_decimal((F.col("l_extendedprice") / 1000).cast("decimal(18,1)").cast("string")).alias("located"),
        F.when(F.col("l_linenumber") % 2 == 0, "abs").alias("tolerance_kind"),
        F.when(F.col("l_linenumber") % 2 == 0, strict_decimal(F.lit("5"))).alias("tolerance"),
    )
    return _decided(rows, *_KEYS)


@query(
    "verdict_interval",
    f"""
WITH x AS (SELECT l_orderkey, l_linenumber, CAST(l_extendedprice / 1000 AS DECIMAL(18,0)) AS re, 0.5 AS a, 10.5 - 0.05 AS lo, 20.25 + 0.005 AS hi, 0.05 AS lh, 0.005 AS hh,
  CASE WHEN l_linenumber % 3 = 0 THEN 0.2 * (10.5 + 20.25) / 2 END AS w FROM lineitem), {_BAND_SQL}""",
)
def verdict_interval(spark, d):
    """Whole prices in thousands against the interval 10.5 to 20.25; every third line has a relative tolerance of 0.2 of the midpoint."""
    rows = _lines(spark, d).select(
        *_KEYS,
        F.when(F.col("l_linenumber") % 2 == 0, V.INTERVAL).otherwise(V.RANGE).alias("kind"),
        written(F.lit("10.5")).alias("low"),
        written(F.lit("20.25")).alias("high"),
        strict_decimal((F.col("l_extendedprice") / 1000).cast("decimal(18,0)").cast("string")).alias("located"),
        F.when(F.col("l_linenumber") % 3 == 0, "rel").alias("tolerance_kind"),
        F.when(F.col("l_linenumber") % 3 == 0, strict_decimal(F.lit("0.2"))).alias("tolerance"),
    )
    return _decided(rows, *_KEYS)


def _point_sql(v: str, h: str, re: str, a: str, w: str, zero: str = "false") -> str:
    return f"""
WITH x AS (SELECT l_orderkey, l_linenumber, {v} AS v, {h} AS h, {re} AS re, {a} AS a, {w} AS w FROM lineitem),
s AS (SELECT *, CASE WHEN a > h AND abs(v - re) <= a THEN 'ARTIFACT_PRECISION_COARSER' WHEN abs(re - v) <= h THEN 'REPRODUCED'
  WHEN w IS NOT NULL AND {zero} THEN 'NO_TOLERANCE' WHEN w IS NOT NULL AND abs(re - v) <= w THEN 'WITHIN-TOLERANCE' ELSE 'DIVERGED' END AS s FROM x)
SELECT l_orderkey, l_linenumber, CASE WHEN s IN ('ARTIFACT_PRECISION_COARSER', 'NO_TOLERANCE') THEN 'UNVERIFIED' ELSE s END AS verdict,
  CASE WHEN s IN ('ARTIFACT_PRECISION_COARSER', 'NO_TOLERANCE') THEN s END AS cause FROM s
"""


def _point_rows(spark, d, value, located, **more):
    columns = [F.lit(V.POINT).alias("kind"), value.alias("value"), located.alias("located"), *[c.alias(k) for k, c in more.items()]]
    return _decided(_lines(spark, d).select(*_KEYS, *columns), *_KEYS)


@query("verdict_tolerance_abs", _point_sql("CAST(l_tax AS DECIMAL(18,2))", "0.005", "CAST(l_discount AS DECIMAL(18,2))", "0.005", "0.02"))
def verdict_tolerance_abs(spark, d):
    """Taxes against discounts with a tolerance of 0.02."""
    return _point_rows(
        spark, d, written(_text("l_tax")), strict_decimal(_text("l_discount")), tolerance_kind=F.lit("abs"), tolerance=strict_decimal(F.lit("0.02"))
    )


@query(
    "verdict_tolerance_rel",
    _point_sql("CAST(l_tax AS DECIMAL(18,2))", "0.005", "CAST(l_discount AS DECIMAL(18,2))", "0.005", "0.25 * abs(CAST(l_tax AS DECIMAL(18,2)))", "v = 0"),
)
def verdict_tolerance_rel(spark, d):
    """Taxes against discounts with a relative tolerance of 0.25; a tax of zero has none."""
    return _point_rows(
        spark, d, written(_text("l_tax")), strict_decimal(_text("l_discount")), tolerance_kind=F.lit("rel"), tolerance=strict_decimal(F.lit("0.25"))
    )


@query("verdict_coarser", _point_sql("CAST(l_extendedprice AS DECIMAL(18,2))", "0.005", "CAST(l_extendedprice + l_linenumber - 1 AS DECIMAL(18,0))", "0.5", "NULL"))
def verdict_coarser(spark, d):
    """Prices to the cent against artifacts that wrote whole numbers."""
    located = strict_decimal((F.col("l_extendedprice") + F.col("l_linenumber") - 1).cast("decimal(18,0)").cast("string"))
    return _point_rows(spark, d, written(_text("l_extendedprice")), located)


@query(
    "verdict_scale",
    """
WITH x AS (SELECT l_orderkey, l_linenumber, CAST(l_tax * 100 AS DECIMAL(18,1)) AS v, CAST(l_discount AS DECIMAL(18,2)) * 100 AS re, l_linenumber % 2 = 1 AS scaled FROM lineitem),
s AS (SELECT *, CASE WHEN NOT scaled THEN 'UNIT_UNDECLARED' WHEN 0.5 > 0.05 AND abs(v - re) <= 0.5 THEN 'ARTIFACT_PRECISION_COARSER' WHEN abs(v - re) <= 0.05 THEN 'REPRODUCED' ELSE 'DIVERGED' END AS s FROM x)
SELECT l_orderkey, l_linenumber, CASE WHEN s IN ('ARTIFACT_PRECISION_COARSER', 'UNIT_UNDECLARED') THEN 'UNVERIFIED' ELSE s END AS verdict,
  CASE WHEN s IN ('ARTIFACT_PRECISION_COARSER', 'UNIT_UNDECLARED') THEN s END AS cause FROM s
""",
)
def verdict_scale(spark, d):
    """Taxes in percent against discounts as fractions: odd lines declare the scale 100, even ones none."""
    value = written((F.col("l_tax") * 100).cast("decimal(18,1)").cast("string"))
    scale = F.when(F.col("l_linenumber") % 2 == 1, strict_decimal(F.lit("100")))
    return _point_rows(spark, d, value, strict_decimal(_text("l_discount")), scale=scale, percent=F.lit(True))


_CLAIMS_SQL = """
claims AS (SELECT o_orderkey AS claim_id, o_custkey AS run_id, CAST(trunc(CAST(o_totalprice AS DECIMAL(18,2))) AS BIGINT) AS v FROM orders),
bindings AS (SELECT DISTINCT l_orderkey AS claim_id FROM lineitem WHERE l_linenumber = 1 AND l_orderkey % 7 <> 0),
located AS (SELECT o_orderkey AS claim_id, CASE WHEN o_orderkey % 11 <> 0 THEN CAST(o_totalprice AS DECIMAL(18,2)) END AS re,
  CASE WHEN o_orderkey % 11 = 0 THEN 'AMBIGUOUS_BINDING' END AS locate_cause FROM orders),
runs AS (SELECT c_custkey AS run_id, CASE WHEN c_custkey % 13 = 0 THEN 'WONT_RUN' WHEN c_custkey % 13 = 1 THEN 'TIMEOUT' END AS failure, c_custkey % 13 = 2 AS too_large,
  c_custkey % 13 IN (2, 3) AS limit_exceeded, CASE WHEN c_custkey % 13 = 4 THEN 0 ELSE 1 END AS artifacts FROM customer),
s AS (SELECT claims.*, re, CASE WHEN failure IS NOT NULL THEN failure WHEN too_large THEN 'ARTIFACT_TOO_LARGE' WHEN limit_exceeded THEN 'CAPTURE_LIMIT_EXCEEDED'
    WHEN coalesce(artifacts, 0) = 0 THEN 'NO_ARTIFACT' WHEN bindings.claim_id IS NULL THEN 'NO_BINDING' WHEN locate_cause IS NOT NULL THEN locate_cause
    WHEN v <> 0 AND v % 10 = 0 THEN 'PRECISION_AMBIGUOUS' WHEN abs(re - v) <= 0.5 THEN 'REPRODUCED' ELSE 'DIVERGED' END AS s
  FROM claims LEFT JOIN bindings USING (claim_id) LEFT JOIN located USING (claim_id) LEFT JOIN runs USING (run_id)),
verdicts AS (SELECT claim_id, run_id, CASE WHEN s IN ('REPRODUCED', 'DIVERGED') THEN s ELSE 'UNVERIFIED' END AS verdict,
  CASE WHEN s NOT IN ('REPRODUCED', 'DIVERGED') THEN s END AS cause, s = 'DIVERGED' AS review_required, s IN ('REPRODUCED', 'DIVERGED', 'PRECISION_AMBIGUOUS') AS bound FROM s)
"""


def _claims(spark, d):
    orders = table(spark, d, "orders", "o_orderkey", "o_custkey", "o_totalprice")
    whole = F.col("o_totalprice").cast("decimal(18,2)").cast("bigint").cast("string")
    return orders.select(F.col("o_orderkey").alias("claim_id"), F.col("o_custkey").alias("run_id"), F.lit(V.POINT).alias("kind"), written(whole).alias("value"))


def _bindings(spark, d):
    lines = table(spark, d, "lineitem", "l_orderkey", "l_linenumber").where("l_linenumber = 1 AND l_orderkey % 7 <> 0")
    return lines.select(F.col("l_orderkey").alias("claim_id")).distinct()


def verified(spark, d):
    """Orders as claims of their customer's run, first lines as bindings, with causes by the keys' remainders."""
    orders = table(spark, d, "orders", "o_orderkey", "o_totalprice")
    lost = F.col("o_orderkey") % 11 == 0
    located = orders.select(
        F.col("o_orderkey").alias("claim_id"),
        F.when(~lost, strict_decimal(_text("o_totalprice"))).cast(NUMBER).alias("located"),
        F.when(lost, "AMBIGUOUS_BINDING").alias("locate_cause"),
    )
    k = F.col("c_custkey") % 13
    runs = table(spark, d, "customer", "c_custkey").select(
        F.col("c_custkey").alias("run_id"),
        F.when(k == 0, "WONT_RUN").when(k == 1, "TIMEOUT").alias("failure"),
        (k == 2).alias("too_large"),
        k.isin(2, 3).alias("limit_exceeded"),
        F.when(k == 4, 0).otherwise(1).alias("artifacts"),
    )
    return V.verify(_claims(spark, d), _bindings(spark, d), located, runs).drop("kind", "value")


@query("cause_precedence", f"WITH {_CLAIMS_SQL} SELECT * FROM verdicts")
def cause_precedence(spark, d):
    return verified(spark, d)


@query("coverage_by_verdict", f"""WITH {_CLAIMS_SQL} SELECT count(*) AS claims, count(*) FILTER (WHERE bound) AS bound, count(*) FILTER (WHERE verdict = 'REPRODUCED') AS n_reproduced,
  count(*) FILTER (WHERE verdict = 'WITHIN-TOLERANCE') AS n_within_tolerance, count(*) FILTER (WHERE verdict = 'DIVERGED') AS n_diverged,
  count(*) FILTER (WHERE verdict = 'UNVERIFIED') AS n_unverified FROM verdicts""")
def coverage_by_verdict(spark, d):
    return V.coverage(verified(spark, d))


@query("coverage_by_cause", f"WITH {_CLAIMS_SQL} SELECT cause, count(*) AS claims FROM verdicts WHERE cause IS NOT NULL GROUP BY cause")
def coverage_by_cause(spark, d):
    return V.causes(verified(spark, d))


@query("orphan_bindings", "SELECT DISTINCT l_orderkey + 3 AS claim_id FROM lineitem WHERE l_linenumber = 1 AND l_orderkey % 7 <> 0 AND l_orderkey + 3 NOT IN (SELECT o_orderkey FROM orders)")
def orphan_bindings(spark, d):
    """Bindings whose claim was renumbered away."""
    return V.orphan_bindings(_bindings(spark, d).select((F.col("claim_id") + 3).alias("claim_id")), _claims(spark, d))


@query(
    "pooled_report",
    f"""WITH {_CLAIMS_SQL}, labels AS (SELECT run_id AS case_id, claim_id, CASE WHEN claim_id % 4 = 0 THEN 'confirmed' ELSE 'refuted' END AS label FROM verdicts WHERE claim_id % 3 = 0),
g AS (SELECT v.run_id AS case_id, grouping(v.run_id) = 1 AS pooled, count(*) AS claims, count(*) FILTER (WHERE bound) AS bound, count(*) FILTER (WHERE verdict = 'DIVERGED') AS diverged,
    count(label) AS labeled, count(*) FILTER (WHERE verdict = 'DIVERGED' AND label = 'confirmed') AS confirmed, count(*) FILTER (WHERE verdict = 'DIVERGED' AND label = 'refuted') AS refuted
  FROM verdicts v LEFT JOIN labels l ON v.run_id = l.case_id AND v.claim_id = l.claim_id GROUP BY ROLLUP (v.run_id))
SELECT coalesce(case_id, -1) AS case_id, pooled, claims, bound, diverged, labeled, confirmed, refuted, round(CASE WHEN confirmed + refuted > 0 THEN confirmed / (confirmed + refuted) END, 6) AS precision, round(CASE WHEN labeled > 0 THEN confirmed / labeled END, 6) AS recall FROM g""",
)
def pooled_report(spark, d):
    """Customers as cases: coverage, precision and recall of each and of all together."""
    v = verified(spark, d).withColumnRenamed("run_id", "case_id")
    keys = table(spark, d, "orders", "o_orderkey", "o_custkey").where("o_orderkey % 3 = 0")
    labels = keys.select(
        F.col("o_custkey").alias("case_id"), F.col("o_orderkey").alias("claim_id"), F.when(F.col("o_orderkey") % 4 == 0, "confirmed").otherwise("refuted").alias("label")
    )
    report = V.pooled_report(v, labels).withColumn("case_id", F.coalesce("case_id", F.lit(-1).cast("long")))
    return report.withColumns({"precision": F.round("precision", 6), "recall": F.round("recall", 6)})


@query(
    "run_flips",
    """
WITH x AS (SELECT l_partkey AS claim_id, CAST(l_discount AS DECIMAL(18,2)) AS re FROM lineitem)
SELECT claim_id, count(*) AS runs, (max(re) - min(re))::DOUBLE AS spread, count(DISTINCT CASE WHEN abs(re - 0.05) <= 0.005 THEN 'REPRODUCED' ELSE 'DIVERGED' END) > 1 AS flips FROM x GROUP BY claim_id
""",
)
def run_flips(spark, d):
    """Parts as claims, their lines as runs: the spread of discounts and whether the verdict on 0.05 flips."""
    rows = table(spark, d, "lineitem", "l_partkey", "l_discount").select(
        F.col("l_partkey").alias("claim_id"),
        F.col("l_discount").cast("decimal(18,2)").alias("located_value"),
        F.lit(V.POINT).alias("kind"),
        written(F.lit("0.05")).alias("value"),
        strict_decimal(_text("l_discount")).alias("located"),
    )
    return V.run_flips(V.decide(rows)).withColumn("spread", F.col("spread").cast("double"))
