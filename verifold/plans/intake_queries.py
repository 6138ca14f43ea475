"""Queries of the intake and layout operators, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import intake, layout
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


def _files(spark, d):
    """A checkout per customer, whose files its key decides."""
    k = F.col("c_custkey")
    row = lambda when, path, text="": F.when(when, F.struct(F.lit(path).alias("relpath"), F.encode(F.lit(text), "UTF-8").alias("content")))
    rows = F.array(
        row(F.lit(True), "src/x.py"), row(k % 2 == 0, "main.py"), row(k % 3 == 0, "pyproject.toml", "[project]\nrequires-python = '>=3.9'\n[project.scripts]\ngo = 'a:b'\n"),
        row(k % 7 == 0, "uv.lock"), row(k % 5 == 0, "requirements.txt"), row(k % 5 == 0, "requirements-dev.txt"), row(k % 11 < 4, "a.ipynb"), row(k % 11 < 2, "b.ipynb"),
        row(k % 13 == 0, ".python-version", "3.12\n"), row(k % 17 == 0, "sub/main.py"),
    )
    c = table(spark, d, "customer", "c_custkey").select(k.cast("string").alias("checkout"), F.explode(rows).alias("f")).where("f IS NOT NULL")
    return c.select("checkout", "f.relpath", "f.content")


@query(
    "manifests",
    """
SELECT c_custkey::VARCHAR AS checkout, c_custkey % 7 = 0 AS uv_lock, c_custkey % 3 = 0 AS pyproject, c_custkey % 2 = 0 AS main_py,
  CASE WHEN c_custkey % 5 = 0 THEN 'requirements-dev.txt,requirements.txt' ELSE '' END AS requirements,
  CASE WHEN c_custkey % 11 < 2 THEN 'a.ipynb,b.ipynb' WHEN c_custkey % 11 < 4 THEN 'a.ipynb' ELSE '' END AS notebooks FROM customer
""",
)
def manifests(spark, d):
    join = lambda c: F.coalesce(F.array_join(c, ","), F.lit("")).alias(c)
    return intake.manifests(_files(spark, d)).select("checkout", "uv_lock", "pyproject", "main_py", join("requirements"), join("notebooks"))


@query(
    "environments",
    """
SELECT c_custkey::VARCHAR AS checkout, CASE WHEN c_custkey % 13 = 0 THEN '3.12' WHEN c_custkey % 3 = 0 THEN '>=3.9' ELSE '3.11' END AS python_pin,
  CASE WHEN c_custkey % 13 = 0 THEN '.python-version' WHEN c_custkey % 3 = 0 THEN 'pyproject.toml' ELSE 'default' END AS pin_source,
  CASE WHEN c_custkey % 7 = 0 THEN 'lockfile' WHEN c_custkey % 5 = 0 THEN 'declared' ELSE 'best-effort' END AS policy FROM customer
""",
)
def environments(spark, d):
    return intake.environments(_files(spark, d))


@query(
    "entry_points",
    """
WITH x AS (SELECT c_custkey, (c_custkey % 3 = 0)::INT + (c_custkey % 2 = 0)::INT AS n, CASE WHEN c_custkey % 11 < 2 THEN 2 WHEN c_custkey % 11 < 4 THEN 1 ELSE 0 END AS m FROM customer),
y AS (SELECT *, CASE WHEN n > 0 THEN n ELSE m END AS k FROM x)
SELECT c_custkey::VARCHAR AS checkout, CASE WHEN k <> 1 THEN '' WHEN n = 0 THEN 'jupyter nbconvert --to notebook --execute --inplace a.ipynb' WHEN c_custkey % 3 = 0 THEN 'uv run go' ELSE 'python main.py' END AS command,
  CASE WHEN k <> 1 THEN '' WHEN n = 0 THEN 'notebook' WHEN c_custkey % 3 = 0 THEN 'pyproject-script' ELSE 'main.py' END AS source,
  CASE WHEN k = 0 THEN 'ENTRYPOINT_MISSING' WHEN k > 1 THEN 'ENTRYPOINT_AMBIGUOUS' ELSE '' END AS cause FROM y
""",
)
def entry_points(spark, d):
    e = intake.entry_points(_files(spark, d))
    blank = lambda c: F.coalesce(c, F.lit(""))
    return e.select("checkout", blank(F.array_join("argv", " ")).alias("command"), blank(F.col("source")).alias("source"), blank(F.col("cause")).alias("cause"))


def _runs(spark, d):
    """Lines of orders as runs of text: ten documents, a page per part of the order key, whole coordinates."""
    r = table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    return r.select(
        (F.col("l_orderkey") % 10).alias("doc"), (F.col("l_orderkey") % 97).alias("page"), ((F.col("l_partkey") * 7 + F.col("l_orderkey") * 3) % 800).alias("y"),
        ((F.col("l_suppkey") * 13 + F.col("l_orderkey")) % 3000).alias("x"), (F.col("l_quantity").cast("long") % 5 + 8).alias("size"), F.concat(F.lit("w"), F.col("l_partkey")).alias("text"),
    ).distinct()


_RUNS_SQL = """runs AS (SELECT DISTINCT l_orderkey % 10 AS doc, l_orderkey % 97 AS page, (l_partkey * 7 + l_orderkey * 3) % 800 AS y, (l_suppkey * 13 + l_orderkey) % 3000 AS x,
  l_quantity::BIGINT % 5 + 8 AS size, 'w' || l_partkey AS text FROM lineitem)"""


@query(
    "layout_lines",
    f"""
WITH {_RUNS_SQL}, g AS (SELECT *, coalesce(lag(y) OVER w - y > 5, true)::INT AS n FROM runs WHERE NOT (x = 0 AND y = 0) WINDOW w AS (PARTITION BY doc, page ORDER BY y DESC, x)),
l AS (SELECT *, sum(n) OVER (PARTITION BY doc, page ORDER BY y DESC, x ROWS UNBOUNDED PRECEDING) - 1 AS line FROM g)
SELECT doc, page, line::BIGINT AS line, max(y) AS y, max(size) AS size, min(x) AS x, string_agg(text, ' ' ORDER BY x, text) AS text FROM l GROUP BY doc, page, line
""",
)
def layout_lines(spark, d):
    """Runs grouped by baseline."""
    return layout.lines(_runs(spark, d)).drop("items")


@query(
    "layout_body_size",
    f"WITH {_RUNS_SQL}, c AS (SELECT doc, size, count(*) AS n FROM runs GROUP BY ALL) SELECT doc, size FROM (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY n DESC, size) AS k FROM c) WHERE k = 1",
)
def layout_body_size(spark, d):
    """The most frequent size of each document."""
    return layout.mode_of(_runs(spark, d), ["doc"], "size")


@query(
    "layout_columns",
    f"""
WITH {_RUNS_SQL}, g AS (SELECT *, coalesce(x - lag(x) OVER w > 12, true)::INT AS n FROM runs WINDOW w AS (PARTITION BY doc, page ORDER BY x)),
c AS (SELECT *, sum(n) OVER (PARTITION BY doc, page ORDER BY x ROWS UNBOUNDED PRECEDING) - 1 AS cluster FROM g)
SELECT doc, page, cluster::BIGINT AS cluster, round(avg(x), 6) AS center, count(*) AS members FROM c GROUP BY doc, page, cluster HAVING count(*) >= 3
""",
)
def layout_columns(spark, d):
    """Clusters of starts of runs. Centers are rounded as the SQL's engine does it, by millionths as doubles: where the
    members are 640 or the like, a center lies on a half of them that its decimal digits would round the other way."""
    return layout.x_clusters(_runs(spark, d)).withColumn("center", F.round(F.col("center") * 1e6) / 1e6)


@query(
    "layout_headings",
    f"""
WITH {_RUNS_SQL}, c AS (SELECT doc, size, count(*) AS n FROM runs GROUP BY ALL), b AS (SELECT doc, size AS body FROM (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY n DESC, size) AS k FROM c) WHERE k = 1)
SELECT doc, size, least(dense_rank() OVER (PARTITION BY doc ORDER BY size DESC), 4)::INTEGER AS level FROM c JOIN b USING (doc) WHERE size > body * 1.05::DOUBLE AND n >= 4
""",
)
def layout_headings(spark, d):
    """Sizes over the body's, ranked."""
    runs = _runs(spark, d)
    return layout.heading_levels(runs, layout.mode_of(runs, ["doc"], "size"))
