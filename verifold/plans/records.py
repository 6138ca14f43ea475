"""Replay of run records as one batch job: claims, bindings, trace and objects of any number of records become verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.decimals import NUMBER, strict_decimal
from ..functions.grammar import with_parsed
from ..operators import claims as C
from ..operators.locate import binding_problem, locate
from ..operators.verdicts import verify

CLAIMS = "struct<claims:array<struct<text:string,metric:string,units:string,context:string,start:int,end:int>>>"
LOCATOR = "struct<kind:string,pointer:string,pattern:string,column:string,row:map<string,string>,table:struct<row:int,column:int>>"
BINDINGS = f"struct<bindings:array<struct<claim_id:string,artifact:string,locator:{LOCATOR},tolerance:struct<abs:string,rel:string>,scale:string,float_repr:boolean>>>"
TRACE = (
    "struct<run_id:string,failure:struct<cause:string,detail:string>,causes:array<string>,stale:array<struct<relpath:string,cause:string>>,"
    "artifacts:array<struct<kind:string,relpath:string,sha256:string,size:bigint,diagnostic_only:boolean>>>"
)


def _member(files: DataFrame, name: str, schema: str) -> DataFrame:
    # the condition stands in the expression too: a filter on what is parsed may be moved before the one on the name
    text = F.when(F.col("member") == name, F.decode("content", "UTF-8"))
    return files.where(F.col("member") == name).select(F.col("record").alias("run_id"), F.from_json(text, schema, {"mode": "FAILFAST"}).alias("d"))


def read(files: DataFrame, tag: str = C.CLAIM_TAG) -> dict[str, DataFrame]:
    """The tables of records (record, member, content): claims, bindings, runs, artifacts, stale. run_id is the record."""
    c = _member(files, "claims.json", CLAIMS).select("run_id", F.inline("d.claims"))
    c = c.withColumn("claim_id", C.claim_id(F.col("text"), F.col("metric"), F.col("units"), tag)).dropDuplicates(["run_id", "claim_id"])
    b = _member(files, "bindings.json", BINDINGS).select("run_id", F.explode("d.bindings").alias("b"))
    keys = F.map_keys("b.locator.row")
    b = b.select(
        "run_id", "b.claim_id", "b.artifact", "b.locator.kind", "b.locator.pointer", "b.locator.pattern", "b.locator.column",
        F.get(keys, F.lit(0)).alias("row_key"), F.get(F.map_values("b.locator.row"), F.lit(0)).alias("row_value"),
        F.col("b.locator.table.row").alias("table_row"), F.col("b.locator.table.column").alias("table_column"),
        F.col("b.tolerance.abs").alias("tolerance_abs"), F.col("b.tolerance.rel").alias("tolerance_rel"), "b.scale", F.coalesce("b.float_repr", F.lit(False)).alias("float_repr"),
    )
    b = b.withColumn("invalid", binding_problem(b).isNotNull())
    t = _member(files, "trace.json", TRACE).select("run_id", F.col("d").alias("t"))
    runs = t.select(
        "run_id", F.col("t.failure.cause").alias("failure"), F.array_contains("t.causes", "ARTIFACT_TOO_LARGE").alias("too_large"),
        F.array_contains("t.causes", "CAPTURE_LIMIT_EXCEEDED").alias("limit_exceeded"),
        F.size(F.filter("t.artifacts", lambda a: ~a["diagnostic_only"])).alias("artifacts"),
    )
    listed = t.select("run_id", F.explode("t.artifacts").alias("a")).select("run_id", "a.relpath", "a.sha256", "a.diagnostic_only")
    objects = files.where(F.col("member").startswith("objects/")).select(F.col("record").alias("run_id"), F.substring_index("member", "/", -1).alias("sha256"), "content")
    objects = objects.where(F.sha2("content", 256) == F.col("sha256"))
    stale = t.select("run_id", F.explode("t.stale").alias("s")).select("run_id", "s.relpath")
    return {"claims": c, "bindings": b, "runs": runs, "artifacts": listed.join(objects, ["run_id", "sha256"], "left"), "stale": stale}


def refused(files: DataFrame, tag: str = C.CLAIM_TAG) -> DataFrame:
    """run_id, cause, claim_id of records whose bindings can't be read as they stand: a binding of no claim, or two of one.
    Such a record has no verdicts."""
    r = read(files, tag)
    named = r["bindings"].select("run_id", "claim_id")
    orphans = named.join(r["claims"].select("run_id", "claim_id"), ["run_id", "claim_id"], "left_anti").distinct()
    twice = named.groupBy("run_id", "claim_id").count().where("count > 1")
    problem = lambda d, cause: d.select("run_id", F.lit(cause).alias("cause"), "claim_id")
    return problem(orphans, "ORPHAN_BINDING").unionByName(problem(twice, "DUPLICATE_BINDING"))


def replay(files: DataFrame, tag: str = C.CLAIM_TAG) -> DataFrame:
    """run_id, claim_id, text, verdict, cause, review_required, bound of every claim of the records that aren't refused()."""
    r = read(files, tag)
    bad = refused(files, tag).select("run_id").distinct()
    r = {name: rows.join(bad, "run_id", "left_anti") for name, rows in r.items()}
    found = locate(r["bindings"], r["artifacts"], r["stale"])
    located = found.select("run_id", "claim_id", F.col("text").alias("located_text"), "locate_cause").withColumn("located", strict_decimal(F.col("located_text")).cast(NUMBER))
    parsed = with_parsed(r["claims"], "text", "p").select(
        "run_id", "claim_id", "text", "p.*", (F.coalesce(F.col("units") == "%", F.lit(False)) | F.col("text").contains("%")).alias("percent")
    )
    kind = F.when(F.col("tolerance_abs").isNotNull(), "abs").when(F.col("tolerance_rel").isNotNull(), "rel")
    bound = r["bindings"].select(
        "run_id", "claim_id", kind.alias("tolerance_kind"), strict_decimal(F.coalesce("tolerance_abs", "tolerance_rel")).alias("tolerance"),
        strict_decimal(F.col("scale")).alias("scale"), "float_repr",
    )
    key = lambda d: d.withColumn("claim_id", F.concat_ws("|", "run_id", "claim_id"))  # noqa: E731  ids repeat over runs
    out = verify(key(parsed), key(bound).drop("run_id"), key(located).drop("run_id", "located_text"), r["runs"])
    return out.select("run_id", F.substring_index("claim_id", "|", -1).alias("claim_id"), "text", "verdict", "cause", "review_required", "bound")

