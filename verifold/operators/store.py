"""The case store: written once, verified on reading; bundles checked member by member."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .joins import compare_members

#: Causes of a bundle by the stage that names them: signature, manifest, members, contents, paper, claims, verdicts.
STAGES = (
    ("SIGNATURE_MISSING", "SIGNATURE_INVALID"), ("MANIFEST_INVALID",), ("MEMBER_MISSING", "MEMBER_TAMPERED", "MEMBER_UNLISTED"), ("MEMBER_REFUSED",),
    ("PAPER_MISSING", "PAPER_MISMATCH"), ("CLAIMS_UNGROUNDED",), ("VERDICTS_MISMATCH",),
)


def bank(store: DataFrame, batch: DataFrame, key: str = "case_id", digest: str = "digest") -> tuple[DataFrame, DataFrame]:
    """(new, conflicts) of a batch: equal cases are left out as banked already, unequal ones under a stored id conflict.

    Within the batch, rows of one id must agree as well; those that don't conflict. New cases keep all their columns.
    """
    grouped = batch.groupBy(key).agg(F.min(digest).alias(digest), F.max(digest).alias("_other"))
    stored = store.select(key, F.col(digest).alias("_stored"))
    d = grouped.join(stored, key, "left")
    clash = (F.col(digest) != F.col("_other")) | (F.col("_stored").isNotNull() & (F.col("_stored") != F.col(digest)))
    new = d.where(~clash & F.col("_stored").isNull()).select(key)
    return batch.dropDuplicates([key]).join(new, key, "left_semi"), d.where(clash).select(key, F.lit("CASE_CONFLICT").alias("cause"))


def verify_members(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """case_id, path, cause of members whose bytes differ from the manifest, are missing, or aren't listed."""
    listed = manifest.select(F.struct("case_id", "path").alias("member"), "sha256")
    found = files.select(F.struct("case_id", "path").alias("member"), F.sha2("content", 256).alias("sha256"))
    return compare_members(listed, found, "member", "sha256").select("member.*", "cause")


def first_failing_stage(problems: DataFrame, key: str = "bundle_id") -> DataFrame:
    """Of each bundle the problems of its earliest failing stage: later stages aren't looked at."""
    rank = F.try_element_at(F.create_map(*[F.lit(x) for i, causes in enumerate(STAGES) for cause in causes for x in (cause, i)]), F.col("cause"))
    d = problems.withColumn("_rank", rank)
    least = d.groupBy(key).agg(F.min("_rank").alias("_least"))
    return d.join(least, key).where(F.col("_rank") == F.col("_least")).drop("_rank", "_least")


def bound_objects(artifacts: DataFrame, bindings: DataFrame) -> DataFrame:
    """Artifacts that bindings read: what a bundle discloses."""
    return artifacts.join(bindings.select("run_id", F.col("artifact").alias("relpath")).distinct(), ["run_id", "relpath"], "left_semi")


def refused_objects(objects: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Objects that no locatable artifact names: stderr or foreign."""
    return objects.join(artifacts.where(~F.col("diagnostic_only")).select("sha256"), "sha256", "left_anti")
