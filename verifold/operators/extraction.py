"""From papers to claims: normalize, scan for values, give each its section, context and cell, select, admit."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import documents, grammar, phrases
from ..functions.plan import pinned
from .joins import asof_backward, contained_in

SELECTION_CAUSES = (
    "reference_numeral", "outside_sections", "layout_numeral", "year", "figure_number", "version_string", "doi_digits", "hyperparameter",
    "axis_label", "related_work", "no_named_metric",
)
ADMISSION_CAUSES = ("ungrounded", "partial_value", "study_parameter", "unnamed_metric", "unparsed_value")

_REGION = T.StructType().add("start", "integer").add("kind", "string").add("context", "string").add("first", "integer")
_CELL = T.StructType()
for _name, _kind in (("table_no", "integer"), ("form", "string"), ("row", "integer"), ("col", "integer"), ("start", "integer"), ("end", "integer"), ("text", "string"), ("header", "string")):
    _CELL = _CELL.add(_name, _kind)


def _arrow(struct: T.StructType) -> pa.DataType:
    kinds = {"integer": pa.int32(), "string": pa.string()}
    return pa.list_(pa.struct([(f.name, kinds[f.dataType.typeName()]) for f in struct]))


@F.arrow_udf(T.StringType())
def _normalize(texts: pa.Array) -> pa.Array:
    return pa.array([documents.normalize(x.as_py()) for x in texts], pa.string())


@F.arrow_udf(T.ArrayType(_REGION))
def _regions(texts: pa.Array) -> pa.Array:
    return pa.array([documents.regions_of(x.as_py() or "") for x in texts], _arrow(_REGION))


@F.arrow_udf(T.ArrayType(_CELL))
def _cells(texts: pa.Array) -> pa.Array:
    names = _CELL.fieldNames()
    return pa.array([[{k: c[k] for k in names} for c in documents.cells_of(x.as_py() or "")] for x in texts], _arrow(_CELL))


@F.arrow_udf(T.StringType())
def _metric(values: pa.Array, contexts: pa.Array, positions: pa.Array, befores: pa.Array, headers: pa.Array) -> pa.Array:
    out = []
    for v, c, p, b, h in zip(*(x.to_pylist() for x in (values, contexts, positions, befores, headers)), strict=True):
        out.append(phrases.metric_of(v, c, p, b or "") or phrases.header_metric(h))
    return pa.array(out, pa.string())


@F.arrow_udf(T.StringType())
def _after(values: pa.Array, contexts: pa.Array, positions: pa.Array) -> pa.Array:
    rows = zip(*(x.to_pylist() for x in (values, contexts, positions)), strict=True)
    return pa.array([phrases.word_after(c, p + len(v)) for v, c, p in rows], pa.string())


def normalize(papers: DataFrame) -> DataFrame:
    """papers (doc_id, text) with CRLF as LF and NFC: the form that all spans count in."""
    return papers.withColumn("text", _normalize("text"))


def lines(papers: DataFrame) -> DataFrame:
    """doc_id, line_no, start, line: split at LF alone; offsets are running sums of lengths, per document."""
    d = papers.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    w = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    return d.withColumn("start", F.coalesce(F.sum(F.length("line") + 1).over(w), F.lit(0)).cast("int"))


def headings(papers: DataFrame) -> DataFrame:
    """doc_id, start, level, title, hint of each ATX heading; a heading whose title names no section has the hint of the
    nearest one before it of a smaller level, other if there is none: a fold with a stack over a document's headings."""
    found = lines(papers).where(F.col("line").rlike(r"^[ \t]{0,3}#{1,6}(?:[ \t].*)?\z"))
    bare = F.regexp_replace(F.regexp_extract("line", r"^[ \t]{0,3}#{1,6}(?:[ \t]+(.*?))?[ \t]*\z", 1), r"\s+#+$", "")
    title = F.lower(F.regexp_replace(F.trim(F.regexp_replace(bare, r"^\d+(?:\.\d+)*\.?[ \t]+", "")), r"[.:]+$", ""))
    d = found.select("doc_id", "start", F.length(F.regexp_extract("line", r"^[ \t]{0,3}(#{1,6})", 1)).alias("level"), F.trim(title).alias("title"))
    named = F.create_map(*[F.lit(x) for pair in documents.SECTIONS.items() for x in pair])
    d = d.withColumn("own", F.try_element_at(named, "title"))
    stack = "array<struct<level:int,hint:string>>"
    out = "array<struct<start:int,level:int,title:string,hint:string>>"

    def step(s, h):
        outer = F.filter(s["stack"], lambda x: x["level"] < h["level"])
        hint = F.coalesce(h["own"], F.try_element_at(outer, F.lit(-1))["hint"], F.lit("other"))
        grown = F.array_append(outer, F.struct(h["level"].alias("level"), hint.alias("hint")))
        row = F.struct(h["start"].alias("start"), h["level"].alias("level"), h["title"].alias("title"), hint.alias("hint"))
        return F.struct(grown.alias("stack"), F.array_append(s["out"], row).alias("out"))

    ordered = F.array_sort(F.collect_list(F.struct("start", "level", "title", "own")))
    none = F.struct(F.array().cast(stack).alias("stack"), F.array().cast(out).alias("out"))
    folded = d.groupBy("doc_id").agg(ordered.alias("hs")).select("doc_id", F.aggregate("hs", none, step, lambda s: s["out"]).alias("hs"))
    return folded.select("doc_id", F.inline("hs"))


def scan(papers: DataFrame) -> DataFrame:
    """doc_id, start, end, value, before, after, line and its offset, of every value in the normalized text.

    before and after are the 32 and 16 characters around. A `>` that opens a line is a quote mark and compares nothing.
    """
    quoted = F.regexp_replace("text", r"(?m)^([ \t]*)>", f"$1{grammar.QUOTE}")
    d = papers.where(F.col("text").rlike(r"(?U)\d"))  # no value is without a digit
    d = d.select("doc_id", "text", F.explode(grammar.matches(quoted, f"(?U){grammar.VALUE}")).alias("m"))
    start, end = F.col("m.start"), F.col("m.start") + F.length("m.value")
    low = F.greatest(start - 32, F.lit(0))
    return d.select("doc_id", start.alias("start"), end.alias("end"), F.col("m.value").alias("value"),
                    F.substring("text", low + 1, start - low).alias("before"), F.substring("text", end + 1, F.lit(16)).alias("after"))


def regions(papers: DataFrame) -> DataFrame:
    return papers.select("doc_id", F.inline(_regions("text")))


def cells(papers: DataFrame) -> DataFrame:
    return papers.select("doc_id", F.inline(_cells("text")))


def candidates(papers: DataFrame) -> DataFrame:
    """scan() with section (abstract, results, table, references, other), context, position in it, line and cell header.

    The section is that of the latest heading at or before the value, the context the latest region's, by as-of joins;
    a table cell that holds the value overrides both.
    """
    d = asof_backward(scan(papers), headings(papers).select("doc_id", "start", "hint"), ["doc_id"], "start", "start", ["hint"])
    d = asof_backward(d, regions(papers).withColumnRenamed("start", "r_start"), ["doc_id"], "start", "r_start", ["r_start", "kind", "context", "first"])
    d = asof_backward(d, lines(papers).withColumnRenamed("start", "l_start"), ["doc_id"], "start", "l_start", ["l_start", "line"])
    held = cells(papers).select("doc_id", F.col("start").alias("c_start"), F.col("end").alias("c_end"), F.col("text").alias("cell"), "header")
    d = contained_in(d, held, ["doc_id"], "start", "c_start", "c_end")
    inside = F.col("cell").isNotNull()
    context = F.when(inside, F.col("cell")).otherwise(F.col("context"))
    first = F.when(inside, F.col("c_start")).otherwise(F.col("first"))
    relative = F.col("start") - first
    fits = (relative >= 0) & (relative + F.length("value") <= F.length(context))
    position = F.when(fits, relative).otherwise(F.instr(context, F.col("value")) - 1)
    return d.select(
        "doc_id", "start", "end", "value", "before", "after", F.when(inside, "table").otherwise(F.coalesce("hint", F.lit("other"))).alias("section"),
        context.alias("context"), position.cast("int").alias("position"), F.col("line"), (F.col("start") - F.col("l_start")).alias("line_offset"), "header",
    )


# Cues near a value that say what it is not, and patterns of its own text and of what stands around it.
YEAR_CUES = r"(?iU)\b(in|between|from|since|during|to)\b|[\(–—]"
FIGURE_CUES = r"(?iU)\b(fig(?:ure)?s?\.?|table|page|pp\.?|eq(?:uation)?s?\.?|suppl(?:ementary)?)\b"
VERSION_CUES = r"(?iU)\b(version|release|build|python)\b|\br\b"
DOI_CUES = r"(?iU)\b10\.\d{4,}/|\bdoi[:.]|\borcid\b|\bgrant\b"
HYPERPARAMETER_CUES = r"(?iU)\b(learning rate|batch size|epochs?|dropout|kernel size|window size|hidden unit|seed|lr)\b"
SIGNIFICANCE_CUES = r"(?iU)\b(significance level|alpha)\b|α"
SIGNIFICANCE_LEVELS = ("0.05", "0.01", "0.001", "0.1", "0.10")
AXIS_CUES = r"(?iU)\b(x-?axis|y-?axis|tick|scale)\b"
RELATED_CUES = r"(?iU)\b(reported|found|showed|observed|estimated|previous|prior|study by|according to|performed by)\b"
SURNAME_YEAR = r"\([A-Z][A-Za-z' -]{1,30},\s*(?:19|20)\d{2}\)"
UNITS = ("kg", "g", "mg", "ml", "mm", "cm", "ms", "s", "ng")
HEADING_MARK = r"^(#{1,6}[ \t]+)"
WHOLE = r"^\d+\z"
LIST_MARK = r"^[.)][ \t]"
FOUR_DIGITS = r"^\d{4}\z"
VERSION_OF_THREE = r"^(>=|<=|>|<|=|≈|~)?\s*\d+(\.\d+){2,}\z"
VERSION_OF_TWO = r"^(>=|<=|>|<|=)?\s*\d+(\.\d+)+\z"
CITATION = r"^[\d\s,;–-]+\z"
VERSUS = r"(?i)\b(vs|versus)\s*$"
ET_AL = r"(?i)\bet al\b"
#: What stands before or after a value that is only a part of a longer one.
STARTS_INSIDE, DIGIT_BEFORE = r"^[-+.,\d]", r"\d[.,]?\z"
SIGN_BEFORE, RANGE_BEFORE = r"(?:<=|>=|[<>≤≥±¡¿]|\+/-|\+-)[ \t]*\z", r"\d[ \t]*[–—][ \t]*\z"
MARGIN_AFTER, RANGE_AFTER = r"^[ \t]*(?:±|\+/-|\+-)[ \t]*[+-]?[.\d]", r"^[ \t]*[–—][ \t]*[+-]?[.\d]"
DIGIT_AFTER = r"^[.,]?\d"
#: `n =` before a number, in balanced emphasis or none.
SAMPLE_SIZE = r"(?<![A-Za-z0-9_])(?:([*_]{1,2})([nN])\1|([nN]))[ \t]*=[ \t]*\z"


def _near(width: int) -> Column:
    low = F.greatest(F.col("position") - width, F.lit(0))
    return F.substring(F.col("context"), low + 1, F.col("position") - low)


def selection_cause() -> Column:
    """The first cause, in the order of the rule, for which a candidate is no claim; null if none but the metric is open."""
    c, near = F.col, _near(24)
    v = c("value")
    heading = (c("section") != "table") & (F.length(F.regexp_extract("line", HEADING_MARK, 1)) == c("line_offset")) & (c("line_offset") > 0)
    bare = (c("section") != "table") & v.rlike(WHOLE)
    marker = (c("line_offset") == 0) & F.substring(c("line"), F.length(v) + 1, F.lit(2)).rlike(LIST_MARK)
    year = v.rlike(FOUR_DIGITS) & (v.try_cast("int").between(1900, 2100)) & near.rlike(YEAR_CUES)
    version = v.rlike(VERSION_OF_THREE) | (near.rlike(VERSION_CUES) & v.rlike(VERSION_OF_TWO))
    opener = F.substring(c("context"), c("position"), F.lit(1))
    rest = F.substring(c("context"), c("position") + 2, F.lit(1000))
    close = F.instr(rest, F.when(opener == "[", "]").otherwise(")")) - 1
    inner = F.substring(c("context"), c("position") + 1, close + 1)
    cited = (c("position") > 0) & opener.isin("[", "(") & close.between(0, 12) & inner.rlike(CITATION)
    related = _near(8).rlike(VERSUS) | near.rlike(RELATED_CUES) | c("context").rlike(ET_AL) | c("context").rlike(SURNAME_YEAR)
    return (
        F.when(c("section") == "references", "reference_numeral")
        .when(c("section") == "other", "outside_sections")
        .when(heading | (bare & ((F.trim("line") == v) | marker)), "layout_numeral")
        .when(year, "year")
        .when(near.rlike(FIGURE_CUES), "figure_number")
        .when(version, "version_string")
        .when(c("context").rlike(DOI_CUES), "doi_digits")
        .when(near.rlike(HYPERPARAMETER_CUES) | (v.isin(*SIGNIFICANCE_LEVELS) & near.rlike(SIGNIFICANCE_CUES)), "hyperparameter")
        .when(near.rlike(AXIS_CUES), "axis_label")
        .when(cited, "reference_numeral")
        .when(related, "related_work")
    )


def select(found: DataFrame) -> DataFrame:
    """candidates() with metric, units and selection_cause: a cause or a metric, never both."""
    d = found.withColumn("_cause", selection_cause())
    d = d.withColumn("_metric", _metric("value", "context", "position", F.substring("before", -1, 1), "header"))
    cause = F.coalesce("_cause", F.when(F.col("_metric").isNull(), "no_named_metric"))
    d = d.withColumn("selection_cause", pinned(cause)).withColumn("_after", _after("value", "context", "position"))
    chosen = F.col("selection_cause").isNull()
    return d.withColumn("metric", F.when(chosen, F.col("_metric"))).withColumn("units", F.when(chosen & F.col("_after").isin(*UNITS), F.col("_after"))).drop("_cause", "_metric", "_after")


def admission_cause() -> Column:
    """Why a selected candidate is no claim: it cuts a longer value, is a sample size, has no name or no readable value."""
    v, before, after = F.col("value"), F.col("before"), F.col("after")
    cut_before = v.rlike(STARTS_INSIDE) & before.rlike(DIGIT_BEFORE)
    operand = before.rlike(SIGN_BEFORE) | before.rlike(RANGE_BEFORE)
    centre = after.rlike(MARGIN_AFTER) | after.rlike(RANGE_AFTER)
    return (
        F.when(cut_before | operand | centre | after.rlike(DIGIT_AFTER), "partial_value")
        .when(before.rlike(SAMPLE_SIZE), "study_parameter")
        .when(F.trim("metric") == "", "unnamed_metric")
        .when(F.col("parsed").isNull(), "unparsed_value")
    )


def admit(selected: DataFrame) -> DataFrame:
    """Selected rows with parsed (the typed value) and admission_cause; rows that selection refused stay as they are."""
    d = grammar.with_parsed(selected, "value", "parsed")
    return d.withColumn("admission_cause", pinned(F.when(F.col("selection_cause").isNull(), admission_cause())))


def ungrounded(claims: DataFrame, papers: DataFrame) -> DataFrame:
    """Claims whose span doesn't hold their text in the paper, is empty or padded."""
    d = claims.join(papers.select("doc_id", "text"), "doc_id", "left")
    held = F.substring(F.col("text"), F.col("start") + 1, F.col("end") - F.col("start"))
    good = (F.col("start") >= 0) & (F.col("start") < F.col("end")) & (held == F.col("value")) & (F.trim("value") == F.col("value"))
    return d.where(~F.coalesce(good, F.lit(False))).drop("text")


def extract(papers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(claims, refusals) of papers (doc_id, text): every value of a paper is in exactly one, a refusal with one cause."""
    d = admit(select(candidates(normalize(papers))))
    taken = F.col("selection_cause").isNull() & F.col("admission_cause").isNull()
    claims = d.where(taken).select("doc_id", "start", "end", "value", "metric", "units", "section", "context", "parsed")
    stage = F.when(F.col("selection_cause").isNotNull(), "selection").otherwise("admission")
    refusals = d.where(~taken).select("doc_id", stage.alias("stage"), F.coalesce("selection_cause", "admission_cause").alias("cause"), "value", "start", "end")
    return claims, refusals


def study_parameters(papers: DataFrame) -> DataFrame:
    """doc_id, name, value, start, end of every sample size `n = ...`."""
    d = scan(papers).where(F.col("before").rlike(SAMPLE_SIZE))
    name = F.coalesce(F.nullif(F.regexp_extract("before", SAMPLE_SIZE, 2), F.lit("")), F.regexp_extract("before", SAMPLE_SIZE, 3))
    return d.select("doc_id", name.alias("name"), "value", "start", "end")
