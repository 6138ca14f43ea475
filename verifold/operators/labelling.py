"""Blind label files: written from candidates, read back strictly."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .claims import label_errors

#: What a labeller sees of a candidate; all but the label must come back unchanged.
FIELDS = ("document", "section", "column_header", "row_label", "text", "start", "end", "context_before", "context_after")
VALUES = ("claim", "not-claim")


def row_id(document: F.Column, text: F.Column, start: F.Column, end: F.Column) -> F.Column:
    """16 hex digits over a JSON list of document, text and span."""
    quoted = lambda c: F.to_json(F.array(c))
    inner = F.concat(F.expr("'['"), F.regexp_replace(quoted(document), r"^\[|\]$", ""), F.lit(", "), F.regexp_replace(quoted(text), r"^\[|\]$", ""), F.lit(", "), start.cast("string"), F.lit(", "), end.cast("string"), F.lit("]"))
    return F.substring(F.sha2(F.encode(inner, "UTF-8"), 256), 1, 16)


def rows(candidates: DataFrame) -> DataFrame:
    """Label rows of extraction.candidates(): id, the FIELDS, label (null: to be filled in), in order of document and span."""
    c = F.col
    before = F.substring(c("context"), 1, c("position"))
    after = F.substring(c("context"), c("position") + F.length("value") + 1, F.length("context"))
    d = candidates.select(
        c("doc_id").cast("string").alias("document"), "section", c("header").alias("column_header"), F.lit(None).cast("string").alias("row_label"), c("value").alias("text"),
        "start", "end", before.alias("context_before"), after.alias("context_after"),
    )
    d = d.select(row_id(c("document"), c("text"), c("start"), c("end")).alias("id"), *FIELDS, F.lit(None).cast("string").alias("label"))
    return d.orderBy("document", "start", "end", "text")


def to_jsonl(label_rows: DataFrame) -> DataFrame:
    """One JSON line per row, nulls written."""
    return label_rows.select(F.to_json(F.struct("id", *FIELDS, "label"), {"ignoreNullFields": "false"}).alias("value"))


def from_jsonl(lines: DataFrame) -> DataFrame:
    kinds = {"start": "int", "end": "int"}
    schema = ", ".join(f"{f} {kinds.get(f, 'string')}" for f in ("id", *FIELDS, "label"))
    return lines.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def errors(labels: DataFrame, candidates: DataFrame) -> DataFrame:
    """id, error of every label row that is unknown, missing, duplicate, edited or badly labelled."""
    return label_errors(labels, rows(candidates), "id", list(FIELDS))
