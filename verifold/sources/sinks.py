"""Writers: canonical JSON, text tables, and the write-once case store."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.store import bank


@F.arrow_udf(T.StringType())
def _canonical(texts: pa.Array) -> pa.Array:
    dump = lambda x: json.dumps(json.loads(x), sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False) + "\n"
    return pa.array([None if x is None else dump(x) for x in texts.to_pylist()], pa.string())


def canonical_json(column: Column) -> Column:
    """A struct as JSON with sorted keys, no spaces, unescaped UTF-8 and a newline at the end."""
    return _canonical(F.to_json(column, {"ignoreNullFields": "false"}))


def render_table(rows: DataFrame, widths: dict[str, int]) -> DataFrame:
    """One text column of fixed-width cells: cut to their width with an ellipsis, newlines shown."""

    def cell(name: str, width: int) -> Column:
        text = F.replace(F.coalesce(F.col(name).cast("string"), F.lit("-")), F.lit("\n"), F.lit("␤"))
        return F.rpad(F.when(F.length(text) > width, F.concat(F.substring(text, 1, width - 1), F.lit("…"))).otherwise(text), width, " ")

    return rows.select(F.rtrim(F.concat_ws("  ", *[cell(k, w) for k, w in widths.items()])).alias("line"))


def write_cases(batch: DataFrame, path: str, key: str = "case_id", digest: str = "digest") -> DataFrame:
    """Append the cases of a batch that the store at path lacks; gives the conflicts. A stored case is never rewritten.

    The conflicts are read against the files that were there before: cases of this batch never conflict with themselves.
    """
    spark = batch.sparkSession
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    exists = jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath)
    stored = spark.read.parquet(path) if exists else batch.limit(0)
    new, conflicts = bank(stored, batch, key, digest)
    new.write.mode("append").parquet(path)
    return conflicts


def documents_of(rows: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """keys and document: canonical JSON {name: [rows in order]} per key, the form that records and reports are stored in."""
    fields = [c for c in rows.columns if c not in keys]
    ranked = F.struct(F.struct(*order).alias("o"), F.struct(*fields).alias("r"))
    listed = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(ranked)).alias("_rows"))
    return listed.select(*keys, canonical_json(F.struct(F.transform("_rows", lambda x: x["r"]).alias(name))).alias("document"))


def write_objects(artifacts: DataFrame, path: str) -> None:
    """Contents by digest, each once, under the first two digits of it."""
    once = artifacts.select("sha256", "content").dropDuplicates(["sha256"]).withColumn("shelf", F.substring("sha256", 1, 2))
    once.write.mode("overwrite").partitionBy("shelf").parquet(path)
