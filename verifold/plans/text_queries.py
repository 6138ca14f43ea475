"""Queries of the text, extraction, location and consistency operators, with SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.grammar import matches, with_parsed
from ..operators import consistency, extraction, locate
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


def _documents(spark, d):
    return table(spark, d, "documents", "doc_id", "text")


@query(
    "digit_spans",
    """
WITH x AS (SELECT doc_id, regexp_extract_all(text, '[0-9]+') AS m, string_split_regex(text, '[0-9]+') AS g FROM documents),
u AS (SELECT doc_id, m, g, unnest(range(1, len(m) + 1)) AS i FROM x)
SELECT doc_id, (coalesce(list_sum(list_transform(g[1:i], lambda s: length(s))), 0) + coalesce(list_sum(list_transform(m[1:i - 1], lambda s: length(s))), 0))::INTEGER AS start, m[i] AS value FROM u
""",
)
def digit_spans(spark, d):
    """Code-point spans of digit runs, by the scan that all patterns share."""
    return _documents(spark, d).select("doc_id", F.inline(matches(F.col("text"), "[0-9]+")))


@query("number_tokens")
def number_tokens(spark, d):
    """Every value of the number grammar in the normalized documents."""
    return extraction.scan(extraction.normalize(_documents(spark, d))).select("doc_id", "start", "end", "value")


@query(
    "line_offsets",
    """
WITH u AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents)
SELECT doc_id, line_no::INTEGER AS line_no, line, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INTEGER AS start FROM u
""",
)
def line_offsets(spark, d):
    return extraction.lines(_documents(spark, d))


def _papers(spark, d):
    """A paper per customer: a results section with a mean, a tolerance and a sample size, and a reference."""
    c = table(spark, d, "customer", "c_custkey", "c_name", "c_acctbal", "c_nationkey")
    amount = F.col("c_acctbal").cast("decimal(18,2)").cast("string")
    text = F.concat(
        F.lit("# Study of "), F.col("c_name"), F.lit("\n\n## Results\n\nThe mean balance was "), amount, F.lit(" kg with n = "), (F.col("c_nationkey") + 3).cast("string"),
        F.lit(" clients.\n### Detail\nThe error rate reached "), F.col("c_nationkey").cast("string"), F.lit(".5% ± 0.25%.\n\n## References\n\n1. Foo 2020.\n"),
    )
    return c.select(F.col("c_custkey").alias("doc_id"), text.alias("text"))


@query(
    "heading_sections",
    """
WITH p AS (SELECT c_custkey AS doc_id, '# Study of ' || c_name || chr(10) || chr(10) AS a, lower('Study of ' || c_name) AS t,
  chr(10) || 'The mean balance was ' || CAST(c_acctbal AS DECIMAL(18,2)) || ' kg with n = ' || (c_nationkey + 3) || ' clients.' || chr(10) AS b,
  'The error rate reached ' || c_nationkey || '.5% ± 0.25%.' || chr(10) || chr(10) AS c FROM customer)
SELECT doc_id, start::INTEGER AS start, level, title, hint FROM (
SELECT doc_id, 0 AS start, 1 AS level, t AS title, 'other' AS hint FROM p
UNION ALL SELECT doc_id, length(a), 2, 'results', 'results' FROM p
UNION ALL SELECT doc_id, length(a) + 11 + length(b), 3, 'detail', 'results' FROM p
UNION ALL SELECT doc_id, length(a) + 11 + length(b) + 11 + length(c), 2, 'references', 'references' FROM p)
""",
)
def heading_sections(spark, d):
    """Headings with the sections that they open or inherit."""
    return extraction.headings(_papers(spark, d))


@query(
    "extract_claims",
    """
WITH p AS (SELECT c_custkey AS doc_id, CAST(c_acctbal AS DECIMAL(18,2))::VARCHAR AS v, c_nationkey::VARCHAR AS n FROM customer)
SELECT doc_id, v AS value, 'mean balance' AS metric, 'kg' AS units, 'Point' AS kind FROM p
UNION ALL SELECT doc_id, n || '.5', 'error rate reached', NULL, 'Point' FROM p
""",
)
def extract_claims(spark, d):
    """All claims of the papers; the percent between a value and its margin keeps those two apart, so the margin is a refusal."""
    found, _ = extraction.extract(_papers(spark, d))
    return found.select("doc_id", "value", "metric", "units", F.col("parsed.kind").alias("kind"))


@query(
    "extract_refusals",
    """
SELECT c_custkey AS doc_id, unnest(['selection', 'selection', 'admission', 'selection', 'selection']) AS stage,
  unnest(['outside_sections', 'no_named_metric', 'partial_value', 'reference_numeral', 'reference_numeral']) AS cause,
  unnest([regexp_extract(c_name, '[0-9]+'), (c_nationkey + 3)::VARCHAR, '0.25', '1', '2020']) AS value FROM customer
""",
)
def extract_refusals(spark, d):
    """Values of the papers that are no claims, each with its one cause."""
    _, refusals = extraction.extract(_papers(spark, d))
    return refusals.select("doc_id", "stage", "cause", "value")


@query("study_parameters", "SELECT c_custkey AS doc_id, 'n' AS name, (c_nationkey + 3)::VARCHAR AS value FROM customer")
def study_parameters(spark, d):
    return extraction.study_parameters(_papers(spark, d)).select("doc_id", "name", "value")


@query(
    "parse_values",
    """
SELECT l_orderkey, l_linenumber, CASE l_linenumber % 6 WHEN 0 THEN 'Point' WHEN 1 THEN 'Bound' WHEN 2 THEN 'PlusMinus' WHEN 3 THEN 'Range' WHEN 4 THEN 'Approximate' ELSE 'Interval' END AS kind,
  CASE WHEN l_linenumber % 6 = 1 THEN '<=' END AS op, (l_quantity::BIGINT * 100 + 25)::BIGINT AS first_unscaled, -2 AS first_exp FROM lineitem
WHERE l_linenumber % 6 NOT IN (3, 5) OR l_quantity < 30
""",
)
def parse_values(spark, d):
    """Values in all six forms, read back; ranges whose ends are out of order have none."""
    rows = table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_quantity")
    x, k = F.concat(F.col("l_quantity").cast("long").cast("string"), F.lit(".25")), F.col("l_linenumber") % 6
    text = (
        F.when(k == 0, x).when(k == 1, F.concat(F.lit("≤ "), x)).when(k == 2, F.concat(x, F.lit(" ± 0.5"))).when(k == 3, F.concat(x, F.lit("–30")))
        .when(k == 4, F.concat(F.lit("~"), x)).otherwise(F.concat(F.lit("95% CI: "), x, F.lit(", 30.0")))
    )
    d = with_parsed(rows.withColumn("text", text), "text", "p").where("p IS NOT NULL")
    first = F.coalesce("p.value", "p.magnitude", "p.center", "p.low")
    return d.select("l_orderkey", "l_linenumber", "p.kind", "p.op", first["u"].cast("long").alias("first_unscaled"), first["e"].alias("first_exp"))


def _bindings(rows, kind: str, **fields):
    kinds = {"table_row": "int", "table_column": "int"}
    columns = [(fields.get(f, F.lit(None))).cast(kinds.get(f, "string")).alias(f) for f in locate.FIELDS]
    return rows.select("run_id", "artifact", F.lit(kind).alias("kind"), *columns, F.lit(False).alias("invalid"))


def _located(spark, bindings, artifacts, stale=None):
    artifacts = artifacts.select("run_id", "relpath", F.sha2("content", 256).alias("sha256"), "content", F.lit(False).alias("diagnostic_only"))
    stale = stale if stale is not None else spark.createDataFrame([], "run_id long, relpath string")
    return locate.locate(bindings, artifacts, stale).select("run_id", "text", "locate_cause")


@query("props_pointer", "SELECT event_id AS run_id, json_extract_string(props, '$.k') AS text, CAST(NULL AS VARCHAR) AS locate_cause FROM events")
def props_pointer(spark, d):
    """The number at /k of every event's properties, as it is written."""
    e = table(spark, d, "events", "event_id", "props").select(F.col("event_id").alias("run_id"), F.lit("out.json").alias("artifact"), F.encode("props", "UTF-8").alias("content"))
    return _located(spark, _bindings(e, "json_pointer", pointer=F.lit("/k")), e.withColumnRenamed("artifact", "relpath"))


@query(
    "csv_cells",
    """
SELECT o_orderkey AS run_id, CASE WHEN o_orderkey % 5 = 0 OR o_orderkey % 7 = 0 THEN NULL ELSE CAST(o_totalprice AS DECIMAL(18,2))::VARCHAR END AS text,
  CASE WHEN o_orderkey % 7 = 0 THEN 'STALE_ARTIFACT' WHEN o_orderkey % 5 = 0 THEN 'AMBIGUOUS_BINDING' END AS locate_cause FROM orders
""",
)
def csv_cells(spark, d):
    """A quoted CSV per order; a repeated row is ambiguous, a stale file is not read."""
    o = table(spark, d, "orders", "o_orderkey", "o_totalprice", "o_orderpriority")
    row = F.concat(F.lit('"a, b", '), F.col("o_totalprice").cast("decimal(18,2)").cast("string"), F.lit("\n"))
    text = F.concat(F.lit("﻿name , total\n"), row, F.when(F.col("o_orderkey") % 5 == 0, row).otherwise(F.lit("other,1\n")))
    a = o.select(F.col("o_orderkey").alias("run_id"), F.lit("t.csv").alias("artifact"), F.encode(text, "UTF-8").alias("content"))
    stale = a.where("run_id % 7 = 0").select("run_id", F.col("artifact").alias("relpath"))
    bound = _bindings(a, "csv_cell", column=F.lit("total"), row_key=F.lit("name"), row_value=F.lit("a, b"))
    return _located(spark, bound, a.withColumnRenamed("artifact", "relpath"), stale)


@query(
    "stdout_values",
    """
SELECT o_orderkey AS run_id, CASE WHEN o_orderkey % 3 <> 0 THEN CAST(o_totalprice AS DECIMAL(18,2))::VARCHAR END AS text,
  CASE WHEN o_orderkey % 3 = 0 THEN 'AMBIGUOUS_BINDING' END AS locate_cause FROM orders
""",
)
def stdout_values(spark, d):
    """A pattern over each run's output; two matches are ambiguous."""
    o = table(spark, d, "orders", "o_orderkey", "o_totalprice")
    line = F.concat(F.lit("total = "), F.col("o_totalprice").cast("decimal(18,2)").cast("string"), F.lit("\n"))
    text = F.concat(F.lit("start\n"), line, F.when(F.col("o_orderkey") % 3 == 0, line).otherwise(F.lit("")))
    a = o.select(F.col("o_orderkey").alias("run_id"), F.lit("<stdout>").alias("artifact"), F.encode(text, "UTF-8").alias("content"))
    return _located(spark, _bindings(a, "stdout_regex", pattern=F.lit(r"total = (\S+)")), a.withColumnRenamed("artifact", "relpath"))


@query("html_text_cell", "SELECT o_orderkey AS run_id, CAST(o_totalprice AS DECIMAL(18,2))::VARCHAR AS text, CAST(NULL AS VARCHAR) AS locate_cause FROM orders")
def html_text_cell(spark, d):
    """A cell of an HTML table in a notebook's output."""
    o = table(spark, d, "orders", "o_orderkey", "o_totalprice")
    amount = F.col("o_totalprice").cast("decimal(18,2)").cast("string")
    html = F.concat(F.lit("<table><tr><th>h</th></tr><tr><td>x</td><td><b>"), amount, F.lit("</b></td></tr></table>"))
    text = F.concat(F.lit('[{"data":{"text/html":["'), html, F.lit('"]}}]'))
    a = o.select(F.col("o_orderkey").alias("run_id"), F.lit("n.ipynb#cell-3").alias("artifact"), F.encode(text, "UTF-8").alias("content"))
    bound = _bindings(a, "notebook_cell", pointer=F.lit("/0/data/text/html"), table_row=F.lit(0), table_column=F.lit(1))
    return _located(spark, bound, a.withColumnRenamed("artifact", "relpath"))


@query(
    "grim",
    """
WITH x AS (SELECT l_orderkey, l_linenumber, (l_extendedprice * 100)::BIGINT % 100000 AS t, l_quantity::BIGINT AS n FROM lineitem)
SELECT l_orderkey, l_linenumber, n, least((t * n) % 100, 100 - (t * n) % 100) * 2 <= n AS possible FROM x
""",
)
def grim(spark, d):
    """Means to the cent of whole numbers over the line's quantity."""
    rows = table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity")
    cents = F.round(F.col("l_extendedprice") * 100).cast("long") % 100000
    mean = F.concat((cents / 100).cast("long").cast("string"), F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0"))
    d = consistency.grim(rows.select("l_orderkey", "l_linenumber", mean.alias("mean"), F.col("l_quantity").cast("long").alias("n")))
    return d.select("l_orderkey", "l_linenumber", "n", "possible")


@query("statcheck")
def statcheck(spark, d):
    """Test results written into sentences, their p-values recomputed."""
    c = table(spark, d, "customer", "c_custkey", "c_acctbal", "c_nationkey")
    value = F.abs(F.col("c_acctbal") / 3000).cast("decimal(18,2)").cast("string")
    text = F.concat(F.lit("We found t("), (F.col("c_nationkey") + 5).cast("string"), F.lit(") = "), value, F.lit(", p < .05 here."))
    return consistency.statistics(c.select(F.col("c_custkey").alias("doc_id"), text.alias("text"))).select("doc_id", "start", "end", "reported_p", F.round("p", 9).alias("p"), "label")


@query(
    "binding_problems",
    """
SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 1 THEN 'kind' WHEN l_linenumber = 2 THEN 'tolerance' WHEN l_linenumber = 3 THEN 'scale' WHEN l_linenumber = 4 THEN 'tolerance' END AS problem FROM lineitem
""",
)
def binding_problems(spark, d):
    """Bindings with a locator of the wrong kind, two tolerances, a scale of zero, a negative tolerance, or none of these."""
    k = F.col("l_linenumber")
    rows = table(spark, d, "lineitem", "l_orderkey", "l_linenumber").select(
        "l_orderkey", "l_linenumber", F.lit("csv_cell").alias("kind"), F.when(k == 1, "a.json").otherwise("a.csv").alias("artifact"),
        F.when(k == 2, "0.1").when(k == 4, "-0.1").alias("tolerance_abs"), F.when(k == 2, "0.1").alias("tolerance_rel"), F.when(k == 3, "0.0").otherwise("100").alias("scale"),
    )
    return rows.select("l_orderkey", "l_linenumber", locate.binding_problem(rows).alias("problem"))
