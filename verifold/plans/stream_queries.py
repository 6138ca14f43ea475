"""Streams over the tables, run until they have read everything, with the SQL of their final state."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators.locate import FIELDS, ground_proposals
from ..streaming import pooled_counts, session_activity, windowed_counts
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


def _stream(spark, d, name: str):
    path = f"{d}/{name}.parquet"
    stream = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path}*")
    return stream.withColumn("ts", F.col("ts").cast("timestamp")) if "ts" in stream.columns else stream


def _final(stream):
    """The complete output of an aggregation over all that is there: a few rows of sums."""
    name = f"s{uuid.uuid4().hex}"
    stream.writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.table(name)


@query(
    "stream_windows",
    "SELECT date_trunc('hour', ts)::VARCHAR AS start, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY ALL",
)
def stream_windows(spark, d):
    """Tumbling hours of the events by type."""
    out = _final(windowed_counts(_stream(spark, d, "events"), "1 hour"))
    return out.select(F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", F.round("value", 4).alias("value"))


@query(
    "stream_sliding",
    """
SELECT (date_trunc('hour', ts) - to_hours(o.o))::VARCHAR AS start, event_type, count(*) AS n FROM events, range(0, 2) AS o(o) GROUP BY ALL
""",
)
def stream_sliding(spark, d):
    """Two-hour windows that begin every hour."""
    out = _final(windowed_counts(_stream(spark, d, "events"), "2 hours", "1 hour"))
    return out.select(F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n")


@query(
    "stream_sessions",
    """
WITH g AS (SELECT *, coalesce(ts - lag(ts) OVER w >= INTERVAL 12 HOUR, true)::INT AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, count(*) AS sessions, max(c)::BIGINT AS largest FROM (SELECT user_id, k, count(*) AS c FROM s GROUP BY ALL) GROUP BY user_id
""",
)
def stream_sessions(spark, d):
    """Sessions of each user, parted by twelve hours without an event."""
    out = _final(session_activity(_stream(spark, d, "events"), "12 hours"))
    return out.groupBy("user_id").agg(F.count("*").alias("sessions"), F.max("n").alias("largest"))


@query("stream_pooled", "SELECT CASE WHEN o_orderstatus = 'F' THEN 'DIVERGED' ELSE 'REPRODUCED' END AS verdict, count(*) AS claims FROM orders GROUP BY ALL")
def stream_pooled(spark, d):
    verdict = F.when(F.col("o_orderstatus") == "F", "DIVERGED").otherwise("REPRODUCED")
    return _final(pooled_counts(_stream(spark, d, "orders").select(verdict.alias("verdict"))))


@query(
    "proposals",
    """
WITH p AS (SELECT l_orderkey AS claim_id, l_linenumber AS idx, CASE WHEN l_orderkey % 5 = 0 THEN 'unknown_claim' WHEN l_linenumber % 4 = 1 THEN 'invalid' WHEN l_linenumber % 4 = 2 THEN 'not_located' END AS why
  FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)),
f AS (SELECT claim_id, min(idx) AS first FROM p WHERE why IS NULL GROUP BY claim_id)
SELECT p.claim_id, idx, coalesce(why, CASE WHEN idx <> first THEN 'repeat' END, '') AS refusal FROM p LEFT JOIN f USING (claim_id)
""",
)
def proposals(spark, d):
    """Lines as proposed bindings of their order: unknown, invalid, not located, repeated or kept."""
    k = F.col("l_linenumber")
    p = table(spark, d, "lineitem", "l_orderkey", "l_linenumber").distinct()
    kinds = {"table_row": "int", "table_column": "int"}
    fields = [(F.lit("/k") if f == "pointer" else F.lit(None)).cast(kinds.get(f, "string")).alias(f) for f in FIELDS]
    p = p.select(
        k.alias("idx"), F.col("l_orderkey").alias("claim_id"), F.lit(1).alias("run_id"), F.when(k % 4 == 2, "gone.json").otherwise("r.json").alias("artifact"),
        F.lit("json_pointer").alias("kind"), *fields, (k % 4 == 1).alias("invalid"),
    )
    claims = table(spark, d, "orders", "o_orderkey").where("o_orderkey % 5 <> 0").select(F.col("o_orderkey").alias("claim_id"))
    artifacts = spark.range(1).select(F.lit(1).alias("run_id"), F.lit("r.json").alias("relpath"), F.lit("x").alias("sha256"), F.lit(b'{"k": 0.5}').alias("content"), F.lit(False).alias("diagnostic_only"))
    stale = spark.createDataFrame([], "run_id int, relpath string")
    return ground_proposals(p, claims, artifacts, stale).select("claim_id", "idx", F.coalesce("refusal", F.lit("")).alias("refusal"))
