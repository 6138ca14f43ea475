"""Capture of a run's outputs: freshness, size caps as a fold, notebooks by cell, run ids."""

from __future__ import annotations

import hashlib
import json

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ARTIFACT_CAP, RUN_CAP = 64 << 20, 256 << 20


def freshness(outputs: DataFrame, runs: DataFrame) -> DataFrame:
    """outputs (run_id, relpath, mtime_ns) with stale: written strictly before the run's started_at_ns, in nanoseconds."""
    d = outputs.join(runs.select("run_id", "started_at_ns"), "run_id")
    return d.withColumn("stale", F.col("mtime_ns") < F.col("started_at_ns")).drop("started_at_ns")


def apply_caps(outputs: DataFrame, artifact_cap: int = ARTIFACT_CAP, run_cap: int = RUN_CAP, key: str = "run_id", order: str = "ord", size: str = "size") -> DataFrame:
    """key, order, size, cause per output, in order within a run: over the artifact cap, over what is left of the run's
    cap, or null for taken. Refused outputs use nothing up, so a later, smaller one may still fit: a fold per run."""
    item = F.struct(F.col(order).alias("ord"), F.col(size).cast("long").alias("size"))
    out = "array<struct<ord:bigint,size:bigint,cause:string>>"

    def step(s, x):
        cause = F.when(x["size"] > artifact_cap, "ARTIFACT_TOO_LARGE").when(s["used"] + x["size"] > run_cap, "CAPTURE_LIMIT_EXCEEDED")
        row = F.struct(x["ord"].cast("long").alias("ord"), x["size"].alias("size"), cause.alias("cause"))
        return F.struct((s["used"] + F.when(cause.isNull(), x["size"]).otherwise(0)).alias("used"), F.array_append(s["out"], row).alias("out"))

    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast(out).alias("out"))
    runs = outputs.groupBy(key).agg(F.array_sort(F.collect_list(item)).alias("_items"))
    return runs.select(key, F.inline(F.aggregate("_items", start, step, lambda s: s["out"])))


_CELLS = T.ArrayType(T.StructType().add("index", "integer").add("content", "binary").add("sha256", "string"))


@F.arrow_udf(_CELLS)
def _decompose(data: pa.Array) -> pa.Array:
    kind = pa.list_(pa.struct([("index", pa.int32()), ("content", pa.binary()), ("sha256", pa.string())]))
    out = []
    for x in data.to_pylist():
        try:
            cells = [c.get("outputs") if isinstance(c, dict) else None for c in json.loads(x)["cells"]]
            made = [(i, json.dumps(c, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False) + "\n") for i, c in enumerate(cells) if isinstance(c, list) and c]
            out.append([{"index": i, "content": (b := t.encode()), "sha256": hashlib.sha256(b).hexdigest()} for i, t in made])
        except (ValueError, KeyError, TypeError):
            out.append([])
    return pa.array(out, kind)


def notebook_cells(notebooks: DataFrame) -> DataFrame:
    """run_id, relpath (file#cell-i), content, sha256 of each cell with outputs; all cells of a notebook or none."""
    d = notebooks.select("run_id", "relpath", F.inline(_decompose("content")))
    return d.select("run_id", F.concat("relpath", F.lit("#cell-"), "index").alias("relpath"), "content", "sha256")


def run_id(artifacts: DataFrame, keys: list[str]) -> DataFrame:
    """A digest per run over its command and the sorted digests of what can be located in it."""
    listed = F.concat(F.lit('["'), F.concat_ws('","', F.array_sort(F.collect_list(F.when(~F.col("diagnostic_only"), F.col("sha256"))))), F.lit('"]\n'))
    return artifacts.groupBy(*keys).agg(F.sha2(listed.cast("binary"), 256).alias("run_digest"))
