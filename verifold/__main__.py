"""Command line: verify records, check papers for consistency, report on a store, pack and verify bundles."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import claims, consistency, extraction, store, verdicts
from .plans.records import refused, replay
from .sources import files, sinks


def _session() -> SparkSession:
    spark = SparkSession.builder.appName("verifold").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _show(rows, as_json: bool, widths: dict[str, int]) -> None:
    lines = rows.select(F.to_json(F.struct("*")).alias("line")) if as_json else sinks.render_table(rows, widths)
    for row in lines.toLocalIterator():
        print(row["line"])


VERDICT_ROW = ("claim_id", "text", "verdict", "cause", "review_required", "bound")


def cmd_verify(spark, args) -> int:
    """Verdicts of the records below a folder; 1 if any claim is unverified, any record refused or any case in conflict."""
    found = files.record(spark, args.record)
    d = replay(found).orderBy("run_id", "claim_id").cache()
    _show(d, args.json, {"run_id": 16, "claim_id": 12, "text": 24, "verdict": 16, "cause": 28})
    bad = refused(found).orderBy("run_id", "cause", "claim_id").cache()
    _show(bad, args.json, {"run_id": 16, "cause": 20, "claim_id": 64})
    failed = not bad.isEmpty() or not d.where(F.col("verdict") == verdicts.UNVERIFIED).isEmpty()
    if args.bank:
        failed |= not sinks.write_cases(cases_of(d, labels_of(found)), args.bank).isEmpty()
    return int(failed)


def labels_of(found):
    """run_id, claim_id, label of the label files of records."""
    text = F.when(F.col("member") == "labels.json", F.decode("content", "UTF-8"))
    return found.where("member = 'labels.json'").select(F.col("record").alias("run_id"), F.explode(F.from_json(text, "map<string,string>")).alias("claim_id", "label"))


def cases_of(verdict_rows, labels):
    """A case per record: case_id, digest of its verdicts, and the verdicts and labels themselves, by claim."""
    text = F.concat_ws(",", F.array_sort(F.collect_list(F.concat_ws(":", "claim_id", "verdict", F.coalesce("cause", F.lit(""))))))
    rows = F.array_sort(F.collect_list(F.struct(*VERDICT_ROW))).alias("verdicts")
    cases = verdict_rows.groupBy(F.col("run_id").alias("case_id")).agg(F.sha2(text, 256).alias("digest"), rows)
    said = labels.groupBy(F.col("run_id").alias("case_id")).agg(F.array_sort(F.collect_list(F.struct("claim_id", "label"))).alias("labels"))
    return cases.join(said, "case_id", "left").withColumn("labels", F.coalesce("labels", F.array().cast("array<struct<claim_id:string,label:string>>")))


def cmd_extract(spark, args) -> int:
    """Claims and refusals of papers."""
    papers = files.papers(spark, args.papers).where("cause IS NULL")
    found, refused = extraction.extract(papers.select("doc_id", "text"))
    found = found.withColumn("id", claims.claim_id(F.col("value"), F.col("metric"), F.col("units")))
    _show(found.orderBy("doc_id", "start"), args.json, {"doc_id": 24, "value": 18, "metric": 24, "section": 10})
    if args.refusals:
        _show(refused.orderBy("doc_id", "start"), args.json, {"doc_id": 24, "stage": 10, "cause": 20, "value": 18})
    return 0


def cmd_consistency(spark, args) -> int:
    """Findings on papers; 1 if any is an inconsistency."""
    found = consistency.check(extraction.normalize(files.papers(spark, args.papers).where("cause IS NULL").select("doc_id", "text"))).cache()
    _show(found.orderBy("doc_id", "start", "kind"), args.json, {"doc_id": 24, "kind": 10, "label": 24, "reported": 40})
    return int(not found.where(F.col("label") == consistency.INCONSISTENT).isEmpty())


def cmd_report(spark, args) -> int:
    """Coverage, precision and recall per case and pooled; an unknown or bad label makes it an error."""
    cases = spark.read.parquet(args.store)
    v, labels = cases.select("case_id", F.inline("verdicts")), cases.select("case_id", F.inline("labels"))
    if not verdicts.orphan_labels(labels, v).isEmpty():
        print("LABEL_INVALID", file=sys.stderr)
        return 1
    report = verdicts.pooled_report(v, labels).orderBy(F.col("pooled"), "case_id")
    _show(report, args.json, {"case_id": 12, "claims": 8, "bound": 8, "diverged": 9, "confirmed": 10, "refuted": 8, "precision": 10, "recall": 10})
    return 0


def cmd_bundle(spark, args) -> int:
    """Members of bundles against their manifests; 1 with causes if any differs."""
    found = files.record(spark, args.bundles)
    manifest = found.where("member = 'manifest.json'").select(F.from_json(F.decode("content", "UTF-8"), "struct<members:array<struct<path:string,sha256:string>>>").alias("m"), "record")
    listed = manifest.select(F.col("record").alias("case_id"), F.inline("m.members"))
    rows = found.where("member <> 'manifest.json'").select(F.col("record").alias("case_id"), F.col("member").alias("path"), "content")
    bad = store.verify_members(listed, rows).cache()
    _show(bad.orderBy("case_id", "path"), args.json, {"case_id": 16, "path": 40, "cause": 20})
    return int(not bad.isEmpty())


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="verifold", description=__doc__)
    parser.add_argument("--version", action="version", version="0.1.0")
    sub = parser.add_subparsers(dest="command", required=True)
    for name, run, place in (("verify", cmd_verify, "record"), ("extract", cmd_extract, "papers"), ("consistency", cmd_consistency, "papers"), ("report", cmd_report, "store"), ("bundle", cmd_bundle, "bundles")):
        p = sub.add_parser(name, help=run.__doc__)
        p.add_argument(place)
        p.add_argument("--json", action="store_true")
        p.set_defaults(run=run)
        if name == "verify":
            p.add_argument("--bank")
        if name == "extract":
            p.add_argument("--refusals", action="store_true")
    args = parser.parse_args(argv)
    return args.run(_session(), args)


if __name__ == "__main__":
    sys.exit(main())
