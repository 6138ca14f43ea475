"""Streams: write-once banking, freshness against runs, budgets per run, windows and pooled counts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.sinks import write_cases


def bank_stream(cases: DataFrame, path: str, checkpoint: str, conflicts: str | None = None):
    """Banks a stream of cases (case_id, digest, ...): batches that repeat a case change nothing. What conflicts is written
    below the folder of conflicts (path and `-conflicts` by default), by batch, so that a batch that runs again writes the same."""
    beside = conflicts or f"{path.rstrip('/')}-conflicts"

    def bank(batch: DataFrame, number: int) -> None:
        write_cases(batch, path).write.mode("overwrite").parquet(f"{beside}/batch={number}")

    return cases.writeStream.option("checkpointLocation", checkpoint).foreachBatch(bank).trigger(availableNow=True).start()


def fresh_outputs(outputs: DataFrame, runs: DataFrame) -> DataFrame:
    """A stream of outputs joined to the static table of runs, with stale as in batch."""
    d = outputs.join(runs.select("run_id", "started_at_ns"), "run_id")
    return d.withColumn("stale", F.col("mtime_ns") < F.col("started_at_ns")).drop("started_at_ns")


def run_budget(outputs: DataFrame, artifact_cap: int, run_cap: int) -> DataFrame:
    """run_id, ord, size, cause of a stream of outputs: what a run has used so far is its state; refused ones use nothing."""

    def spend(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        used = state.get[0] if state.exists else 0
        rows = pd.concat(frames).sort_values("ord", kind="stable")  # a run's rows of a batch may come in several frames
        causes = []
        for size in rows["size"]:
            cause = "ARTIFACT_TOO_LARGE" if size > artifact_cap else "CAPTURE_LIMIT_EXCEEDED" if used + size > run_cap else None
            used += 0 if cause else int(size)
            causes.append(cause)
        state.update((used,))
        yield rows[["run_id", "ord", "size"]].assign(cause=causes)

    return outputs.groupBy("run_id").applyInPandasWithState(spend, "run_id long, ord long, size long, cause string", "used long", "append", "NoTimeout")


def windowed_counts(events: DataFrame, size: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts and value sums per window and type; events later than the watermark are left out."""
    w = F.window("ts", size, slide or size)
    return events.withWatermark("ts", late).groupBy(w, "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))


def session_activity(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Events per user and session."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))


def pooled_counts(verdicts: DataFrame) -> DataFrame:
    """Running counts of verdicts, for the complete output mode."""
    return verdicts.groupBy("verdict").agg(F.count("*").alias("claims"))
