"""Queries of the joins, aggregates and store operators, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import capture, claims, joins, store
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


@query(
    "section_asof",
    """
SELECT e.event_id, e.user_id, coalesce(h.event_id, -1) AS heading FROM events e ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'signup') h
ON e.user_id = h.user_id AND e.event_id >= h.event_id
""",
)
def section_asof(spark, d):
    """Events as positions, sign-ups as headings: the latest one at or before each event of the user."""
    events = table(spark, d, "events", "event_id", "user_id", "event_type")
    heads = events.where("event_type = 'signup'").select("user_id", F.col("event_id").alias("at"), F.col("event_id").alias("heading"))
    return joins.asof_backward(events.select("event_id", "user_id"), heads, ["user_id"], "event_id", "at", ["heading"]).withColumn(
        "heading", F.coalesce("heading", F.lit(-1).cast("long"))
    )


@query(
    "cell_containment",
    """
SELECT e.event_id, e.user_id, coalesce(c.event_id, -1) AS cell FROM events e LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') c
ON e.user_id = c.user_id AND e.event_id >= c.event_id AND e.event_id < c.event_id + 300 + c.event_id % 500
""",
)
def cell_containment(spark, d):
    """Events in half-open intervals of places that purchases of their user open."""
    events = table(spark, d, "events", "event_id", "user_id", "event_type")
    low = F.col("event_id")
    cells = events.where("event_type = 'purchase'").select("user_id", low.alias("low"), (low + 300 + low % 500).alias("high"), low.alias("cell"))
    return joins.contained_in(events.select("event_id", "user_id"), cells, ["user_id"], "event_id", "low", "high").select(
        "event_id", "user_id", F.coalesce("cell", F.lit(-1).cast("long")).alias("cell")
    )


@query(
    "table_islands",
    """
WITH m AS (SELECT *, event_type = 'view' OR event_type = 'click' AS member FROM events),
s AS (SELECT *, member AND NOT coalesce(lag(member) OVER w, false) AS starts FROM m WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
n AS (SELECT *, sum(starts::INT) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS island FROM s)
SELECT user_id, island::BIGINT AS island, min(event_id) AS first, max(event_id) AS last, count(*) AS size FROM n WHERE member GROUP BY user_id, island
""",
)
def table_islands(spark, d):
    """Maximal runs of views and clicks of each user."""
    events = table(spark, d, "events", "event_id", "user_id", "event_type").withColumn("member", F.col("event_type").isin("view", "click"))
    runs = joins.islands(events, ["user_id"], ["event_id"], "member")
    return runs.groupBy("user_id", "island").agg(F.min("event_id").alias("first"), F.max("event_id").alias("last"), F.count("*").alias("size"))


@query(
    "first_grounding_wins",
    """
SELECT l_partkey, l_orderkey, l_linenumber FROM (
  SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber) AS n FROM lineitem WHERE l_quantity < 25) WHERE n = 1
""",
)
def first_grounding_wins(spark, d):
    rows = table(spark, d, "lineitem", "l_partkey", "l_orderkey", "l_linenumber", "l_quantity").withColumn("good", F.col("l_quantity") < 25)
    return joins.first_wins(rows, "l_partkey", ["l_orderkey", "l_linenumber"], "good").select("l_partkey", "l_orderkey", "l_linenumber")


@query(
    "member_full_outer",
    """
WITH a AS (SELECT c_custkey AS member, c_custkey % 10 AS digest FROM customer WHERE c_custkey % 7 <> 0),
b AS (SELECT DISTINCT o_custkey AS member, o_custkey % 10 + CASE WHEN o_custkey % 11 = 0 THEN 1 ELSE 0 END AS digest FROM orders)
SELECT member, CASE WHEN b.digest IS NULL THEN 'MEMBER_MISSING' WHEN a.digest IS NULL THEN 'MEMBER_UNLISTED' ELSE 'MEMBER_TAMPERED' END AS cause
FROM a FULL JOIN b USING (member) WHERE a.digest IS DISTINCT FROM b.digest
""",
)
def member_full_outer(spark, d):
    """Customers as listed members, ordering customers as found ones, some with another digest."""
    c, o = F.col("c_custkey"), F.col("o_custkey")
    listed = table(spark, d, "customer", "c_custkey").where(c % 7 != 0).select(c.alias("member"), (c % 10).alias("digest"))
    found = table(spark, d, "orders", "o_custkey").distinct().select(o.alias("member"), (o % 10 + F.when(o % 11 == 0, 1).otherwise(0)).alias("digest"))
    return joins.compare_members(listed, found, "member", "digest")


@query(
    "write_once_merge",
    """
WITH s AS (SELECT o_orderkey AS case_id, o_custkey AS digest FROM orders WHERE o_orderkey % 3 = 0),
b AS (SELECT o_orderkey AS case_id, o_custkey + CASE WHEN o_orderkey % 12 = 0 THEN 1 ELSE 0 END AS digest FROM orders WHERE o_orderkey % 2 = 0)
SELECT case_id, CASE WHEN s.digest IS NULL THEN 'new' ELSE 'CASE_CONFLICT' END AS outcome FROM b LEFT JOIN s USING (case_id) WHERE s.digest IS DISTINCT FROM b.digest
""",
)
def write_once_merge(spark, d):
    """A batch of every second order against a store of every third: new ones, and conflicts of changed ones."""
    orders, k = table(spark, d, "orders", "o_orderkey", "o_custkey"), F.col("o_orderkey")
    stored = orders.where(k % 3 == 0).select(k.alias("case_id"), F.col("o_custkey").alias("digest"))
    batch = orders.where(k % 2 == 0).select(k.alias("case_id"), (F.col("o_custkey") + F.when(k % 12 == 0, 1).otherwise(0)).alias("digest"))
    new, conflicts = store.bank(stored, batch)
    new = new.select(stored.columns)
    return new.select("case_id", F.lit("new").alias("outcome")).unionByName(conflicts.select("case_id", F.col("cause").alias("outcome")))


@query(
    "bundle_first_stage",
    """
WITH p AS (SELECT l_orderkey AS bundle_id, CASE l_linenumber % 4 WHEN 0 THEN 'MEMBER_MISSING' WHEN 1 THEN 'MEMBER_TAMPERED' WHEN 2 THEN 'VERDICTS_MISMATCH' ELSE 'MEMBER_REFUSED' END AS cause,
  CASE l_linenumber % 4 WHEN 0 THEN 1 WHEN 1 THEN 1 WHEN 2 THEN 4 ELSE 3 END AS r FROM lineitem WHERE l_quantity < 20)
SELECT bundle_id, cause FROM (SELECT *, min(r) OVER (PARTITION BY bundle_id) AS m FROM p) WHERE r = m
""",
)
def bundle_first_stage(spark, d):
    """Lines as problems of their order's bundle: those of its earliest failing stage."""
    k = F.col("l_linenumber") % 4
    cause = F.when(k == 0, "MEMBER_MISSING").when(k == 1, "MEMBER_TAMPERED").when(k == 2, "VERDICTS_MISMATCH").otherwise("MEMBER_REFUSED")
    rows = table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_quantity").where("l_quantity < 20")
    return store.first_failing_stage(rows.select(F.col("l_orderkey").alias("bundle_id"), cause.alias("cause"))).select("bundle_id", "cause")


@query(
    "merge_mentions",
    """
SELECT l_partkey AS text, l_returnflag AS metric, CASE WHEN l_linestatus = 'O' THEN 'O' END AS units, count(*) AS mentions,
  array_to_string(list_sort(list(DISTINCT lpad(l_orderkey::VARCHAR, 10, '0') || '-' || l_linenumber)), ',') AS locations,
  coalesce(array_to_string(list_sort(list(DISTINCT l_suppkey::VARCHAR) FILTER (WHERE l_suppkey % 2 = 0)), ','), '') AS hints
FROM lineitem GROUP BY ALL
""",
)
def merge_mentions(spark, d):
    """Lines as mentions of (part, return flag, status or null)."""
    rows = table(spark, d, "lineitem", "l_partkey", "l_returnflag", "l_linestatus", "l_orderkey", "l_linenumber", "l_suppkey").select(
        F.col("l_partkey").alias("text"),
        F.col("l_returnflag").alias("metric"),
        F.when(F.col("l_linestatus") == "O", "O").alias("units"),
        F.col("l_orderkey").alias("start"),
        F.col("l_linenumber").alias("end"),
        F.when(F.col("l_suppkey") % 2 == 0, F.col("l_suppkey").cast("string")).alias("hint"),
    )
    merged = claims.merge_mentions(rows, ["text", "metric", "units"])
    place = F.transform("locations", lambda x: F.concat_ws("-", F.lpad(x["start"].cast("string"), 10, "0"), x["end"]))
    return merged.withColumns({"locations": F.array_join(place, ","), "hints": F.array_join("hints", ",")})


@query(
    "claim_ids",
    """
SELECT o_orderkey, sha256('verifold.claim.v1' || chr(1) || ':' || strlen(t) || ':' || t || chr(1) || ':' || strlen(m) || ':' || m ||
  CASE WHEN u IS NULL THEN chr(0) || ':' ELSE chr(1) || ':' || strlen(u) || ':' || u END) AS claim_id
FROM (SELECT o_orderkey, o_custkey::VARCHAR AS t, o_orderpriority || ' é' AS m, CASE WHEN o_orderstatus <> 'F' THEN o_orderstatus END AS u FROM orders)
""",
)
def claim_ids(spark, d):
    rows = table(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus")
    units = F.when(F.col("o_orderstatus") != "F", F.col("o_orderstatus"))
    return rows.select("o_orderkey", claims.claim_id(F.col("o_custkey").cast("string"), F.concat("o_orderpriority", F.lit(" é")), units).alias("claim_id"))


@query(
    "objects_tree_hash",
    """
SELECT l_orderkey AS case_id, count(DISTINCT s) AS objects, sha256('["' || array_to_string(list_sort(list(DISTINCT s)), '","') || '"]' || chr(10)) AS objects_tree_hash
FROM (SELECT l_orderkey, sha256((l_partkey % 50)::VARCHAR) AS s FROM lineitem) GROUP BY l_orderkey
""",
)
def objects_tree_hash(spark, d):
    rows = table(spark, d, "lineitem", "l_orderkey", "l_partkey")
    objects = rows.select(F.col("l_orderkey").alias("case_id"), F.sha2((F.col("l_partkey") % 50).cast("string"), 256).alias("sha256"))
    return claims.objects_tree_hash(objects, ["case_id"])


@query(
    "confusion_score",
    """
WITH x AS (SELECT l.quality = 1 AS t, d.n_chars > 800 AS p FROM labels l JOIN documents d USING (doc_id)),
c AS (SELECT count(*) FILTER (WHERE t AND p) AS tp, count(*) FILTER (WHERE NOT t AND p) AS fp, count(*) FILTER (WHERE t AND NOT p) AS fn, count(*) FILTER (WHERE NOT t AND NOT p) AS tn FROM x)
SELECT *, tp::DOUBLE / (tp + fp) AS precision, tp::DOUBLE / (tp + fn) AS recall FROM c
""",
)
def confusion_score(spark, d):
    """Quality labels against a rule on length."""
    rows = table(spark, d, "labels", "doc_id", "quality").join(table(spark, d, "documents", "doc_id", "n_chars"), "doc_id")
    return claims.score(rows.select((F.col("quality") == 1).alias("t"), (F.col("n_chars") > 800).alias("p")), "t", "p")


@query(
    "label_errors",
    """
WITH a AS (SELECT doc_id, count(*) AS n, any_value(quality + CASE WHEN doc_id % 13 = 0 THEN 1 ELSE 0 END) AS given, any_value(CASE WHEN doc_id % 17 = 0 THEN 'maybe' ELSE 'claim' END) AS label
  FROM (SELECT * FROM labels UNION ALL SELECT * FROM labels WHERE doc_id % 29 = 0) WHERE doc_id % 19 <> 0 GROUP BY doc_id),
b AS (SELECT doc_id, quality FROM labels WHERE doc_id % 23 <> 0)
SELECT * FROM (SELECT doc_id, CASE WHEN b.quality IS NULL THEN 'unknown' WHEN n IS NULL THEN 'missing' WHEN n > 1 THEN 'duplicate' WHEN given <> quality THEN 'edited'
  WHEN label <> 'claim' THEN 'bad_label' END AS error FROM a FULL JOIN b USING (doc_id)) WHERE error IS NOT NULL
""",
)
def label_errors(spark, d):
    """A label file with rows removed, added, repeated and edited, against the rows it was made from."""
    rows, k = table(spark, d, "labels", "doc_id", "quality"), F.col("doc_id")
    file = rows.unionByName(rows.where(k % 29 == 0)).where(k % 19 != 0)
    file = file.select("doc_id", (F.col("quality") + F.when(k % 13 == 0, 1).otherwise(0)).alias("quality"), F.when(k % 17 == 0, "maybe").otherwise("claim").alias("label"))
    return claims.label_errors(file, rows.where(k % 23 != 0), "doc_id", ["quality"])


@query(
    "caps_fold",
    """
WITH RECURSIVE x AS (SELECT l_orderkey AS run_id, l_linenumber::BIGINT AS ord, l_quantity::BIGINT AS size, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity) AS n FROM lineitem),
f AS (
  SELECT run_id, ord, size, n, CASE WHEN size > 45 THEN 'ARTIFACT_TOO_LARGE' WHEN size > 80 THEN 'CAPTURE_LIMIT_EXCEEDED' END AS cause, CASE WHEN size > 45 THEN 0 ELSE size END AS used FROM x WHERE n = 1
  UNION ALL
  SELECT x.run_id, x.ord, x.size, x.n, CASE WHEN x.size > 45 THEN 'ARTIFACT_TOO_LARGE' WHEN f.used + x.size > 80 THEN 'CAPTURE_LIMIT_EXCEEDED' END,
    f.used + CASE WHEN x.size > 45 OR f.used + x.size > 80 THEN 0 ELSE x.size END FROM f JOIN x ON x.run_id = f.run_id AND x.n = f.n + 1)
SELECT run_id, ord, size, cause FROM f
""",
)
def caps_fold(spark, d):
    """Lines as outputs of their order's run: caps of 45 each and 80 a run, refused ones using nothing up."""
    rows = table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_quantity")
    outputs = rows.select(F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").alias("ord"), F.col("l_quantity").cast("long").alias("size"))
    return capture.apply_caps(outputs, 45, 80)


@query(
    "freshness_guard",
    """
WITH r AS (SELECT user_id AS run_id, min(epoch_us(ts)) * 1000 AS t0 FROM events WHERE event_type = 'signup' GROUP BY user_id)
SELECT e.user_id AS run_id, event_id::VARCHAR AS relpath, epoch_us(ts) * 1000 AS mtime_ns, epoch_us(ts) * 1000 < t0 AS stale FROM events e JOIN r ON e.user_id = r.run_id
""",
)
def freshness_guard(spark, d):
    """Events as outputs, the first sign-up of their user as the run's start."""
    events = table(spark, d, "events", "event_id", "user_id", "ts", "event_type").withColumn("ns", F.unix_micros(F.col("ts").cast("timestamp")) * 1000)
    runs = events.where("event_type = 'signup'").groupBy(F.col("user_id").alias("run_id")).agg(F.min("ns").alias("started_at_ns"))
    return capture.freshness(events.select(F.col("user_id").alias("run_id"), F.col("event_id").cast("string").alias("relpath"), F.col("ns").alias("mtime_ns")), runs)


@query(
    "run_digests",
    """
SELECT l_orderkey AS run_id, sha256('["' || coalesce(array_to_string(list_sort(list(s) FILTER (WHERE l_linenumber % 3 <> 0)), '","'), '') || '"]' || chr(10)) AS run_digest
FROM (SELECT l_orderkey, l_linenumber, sha256(l_partkey::VARCHAR) AS s FROM lineitem) GROUP BY l_orderkey
""",
)
def run_digests(spark, d):
    rows = table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_partkey")
    artifacts = rows.select(F.col("l_orderkey").alias("run_id"), F.sha2(F.col("l_partkey").cast("string"), 256).alias("sha256"), (F.col("l_linenumber") % 3 == 0).alias("diagnostic_only"))
    return capture.run_id(artifacts, ["run_id"])
