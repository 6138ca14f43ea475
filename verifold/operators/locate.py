"""Locating bound values in artifacts, and checks of bindings."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import locators
from ..functions.decimals import STRICT, strict_decimal
from ..functions.plan import pinned

FIELDS = ("pointer", "pattern", "column", "row_key", "row_value", "table_row", "table_column")


@F.arrow_udf(T.StructType().add("text", "string").add("cause", "string"))
def _locate(kind: pa.Array, data: pa.Array, spec: pa.Array) -> pa.Array:
    found = [locators.locate(k, d, s or {}) for k, d, s in zip(kind.to_pylist(), data.to_pylist(), spec.to_pylist(), strict=True)]
    return pa.array([{"text": t, "cause": c} for t, c in found], pa.struct([("text", pa.string()), ("cause", pa.string())]))


def kind_mismatch(kind: Column, artifact: Column) -> Column:
    """True if a locator's kind doesn't go with its artifact's name, or reads stderr."""
    good = (
        F.when(kind == "json_pointer", artifact.rlike(r"(?i)\.json\z"))
        .when(kind == "stdout_regex", artifact == "<stdout>")
        .when(kind == "csv_cell", artifact.rlike(r"(?i)\.csv\z"))
        .when(kind == "notebook_cell", artifact.rlike(r"(?i)\.ipynb#cell-\d+\z"))
    )
    return ~F.coalesce(good, F.lit(False)) | (artifact == "<stderr>")


def binding_problem(bindings: DataFrame) -> Column:
    """Why a binding is unusable; null if it isn't. tolerance_abs, tolerance_rel and scale are decimal texts."""
    number = lambda c: F.col(c).isNull() | F.col(c).rlike(STRICT)
    return (
        F.when(kind_mismatch(F.col("kind"), F.col("artifact")), "kind")
        .when(F.col("tolerance_abs").isNotNull() & F.col("tolerance_rel").isNotNull(), "tolerance")
        .when(~number("tolerance_abs") | ~number("tolerance_rel") | F.coalesce(F.col("tolerance_abs"), F.col("tolerance_rel")).startswith("-"), "tolerance")
        .when(~number("scale") | F.col("scale").startswith("-") | (strict_decimal(F.col("scale"))["u"] == 0), "scale")
    )


def locate(bindings: DataFrame, artifacts: DataFrame, stale: DataFrame) -> DataFrame:
    """bindings with text and locate_cause (exactly one of them), sha256.

    bindings: run_id, artifact, kind, the locator FIELDS, invalid. artifacts: run_id, relpath, sha256, content,
    diagnostic_only. stale: run_id, relpath; a notebook's cells are as stale as the notebook.
    """
    usable = artifacts.where(~F.col("diagnostic_only")).select("run_id", F.col("relpath").alias("artifact"), "sha256", "content")
    old = stale.select("run_id", F.col("relpath").alias("_file")).distinct().withColumn("_stale", F.lit(True))
    d = bindings.withColumn("_file", F.regexp_replace("artifact", r"#cell-\d+$", ""))
    d = d.join(old, ["run_id", "_file"], "left").join(usable, ["run_id", "artifact"], "left")
    found = _locate("kind", "content", F.struct(*FIELDS))
    before = F.when(F.col("invalid"), locators.INVALID).when(F.col("_stale"), "STALE_ARTIFACT").when(F.col("content").isNull(), locators.NO_BINDING)
    d = d.withColumn("_before", before).withColumn("_found", found)
    cause = F.coalesce("_before", "_found.cause", F.when(strict_decimal(F.col("_found.text")).isNull(), locators.UNPARSEABLE))
    d = d.withColumn("locate_cause", pinned(cause))
    return d.select(*bindings.columns, "sha256", F.when(F.col("locate_cause").isNull(), F.col("_found.text")).alias("text"), "locate_cause")


def integrity(artifacts: DataFrame, objects: DataFrame) -> DataFrame:
    """Artifacts with content by digest; bad is true where it is missing or its bytes have another digest."""
    d = artifacts.join(objects.select("sha256", "content"), "sha256", "left")
    return d.withColumn("bad", F.coalesce(F.sha2("content", 256) != F.col("sha256"), F.lit(True)))


def ground_proposals(proposals: DataFrame, claims: DataFrame, artifacts: DataFrame, stale: DataFrame) -> DataFrame:
    """proposals (idx, claim_id, ...) with refusal: unknown_claim, invalid, not_located or repeat; null for the one kept per claim."""
    d = locate(proposals, artifacts, stale).join(claims.select("claim_id").distinct().withColumn("_known", F.lit(True)), "claim_id", "left")
    why = F.when(F.col("_known").isNull(), "unknown_claim").when(F.col("invalid"), "invalid").when(F.col("locate_cause").isNotNull(), "not_located")
    d = d.withColumn("_why", pinned(why))
    good = d.where("_why IS NULL").groupBy("claim_id").agg(F.min("idx").alias("_first"))
    d = d.join(good, "claim_id", "left")
    return d.withColumn("refusal", F.coalesce("_why", F.when(F.col("idx") != F.col("_first"), "repeat"))).drop("_known", "_why", "_first")
