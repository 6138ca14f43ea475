"""Patterns of numbers in papers, and reading them into typed values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .decimals import shifted, written
from .plan import pinned

# The number grammar. Spans and kinds depend on its alternatives and their order.
OPERAND = r"(?<!\d)(?:(?<![\w%])[+-])?(?:\d{1,3}(?:,\d{3})+(?:\.\d+)?|\d+\.\d+|(?<!\w)\.\d+|\d+)(?:[eE][+-]?\d+)?"
GAP = r"[ \t]*"
#: Stands for a blockquote mark during the scan: the same length, no comparison, and none may follow it directly.
QUOTE = ""
CI = rf"(?:{OPERAND}{GAP}%{GAP})?(?<![A-Za-z])[Cc][Rr]?[Ii]"
#: What a value can begin with: most places of a text are passed over by this alone.
BEGIN = r"(?=[\d.+\-<>≤≥~∼≈≃Cc])"
VALUE = BEGIN + "(?:" + "|".join(
    (
        rf"{CI}{GAP}[\[(]{GAP}{OPERAND}{GAP},{GAP}{OPERAND}{GAP}[\])]",
        rf"{CI}{GAP}:?{GAP}(?:{OPERAND}{GAP}%{GAP}[-–—,]{GAP}{OPERAND}{GAP}%|{OPERAND}{GAP}[-–—,]{GAP}{OPERAND})",
        rf"{OPERAND}{GAP}(?:±|\+/-|\+-){GAP}{OPERAND}",
        rf"(?<![-=<>{QUOTE}])(?:<=|>=|≤|≥|<|>){GAP}{OPERAND}",
        rf"(?<![–—]){OPERAND}[–—]{OPERAND}(?![\d–—])",
        rf"[~∼≈≃]{GAP}{OPERAND}",
        OPERAND,
    )
) + ")"
# Numbers inside a claimed value, and its forms in the order in which they are tried.
_N = r"([+-]?(?:(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?|\.\d+)(?:[eE][+-]?\d+)?)"
_PERCENT = r"(?:\s*%)?"
_LEVEL = rf"(?:{_N.replace('(', '(?:', 1)}\s*%\s*)?"
FORMS = (
    ("Interval", rf"(?i)^{_LEVEL}(?:CI\s*)?[\[(]\s*{_N}\s*,\s*{_N}\s*[\])]\z"),
    ("Interval", rf"(?i)^{_LEVEL}CR?I\s*:?\s*{_N}\s*%?\s*[-–—,]\s*{_N}\s*%?\z"),
    ("PlusMinus", rf"^{_N}\s*(?:±|\+/-|\+-)\s*{_N}{_PERCENT}\z"),
    ("Bound", rf"^(?:[A-Za-z][A-Za-z0-9_.-]*\s*)?(<=|>=|≤|≥|<|>)\s*{_N}{_PERCENT}\z"),
    ("Range", rf"^{_N}\s*[–—]\s*{_N}{_PERCENT}\z"),
    ("Approximate", rf"^[~∼≈≃]\s*{_N}{_PERCENT}\z"),
    ("Point", rf"^{_N}{_PERCENT}\z"),
)


def matches(text: Column, pattern: str) -> Column:
    """All leftmost matches that don't overlap, as array of struct(start, value); start counts code points."""
    values, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)

    def step(s, x):
        start = s["at"] + F.length(x["gap"])
        return F.struct((start + F.length(x["value"])).alias("at"), F.array_append(s["out"], F.struct(start.alias("start"), x["value"].alias("value"))).alias("out"))

    none = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,value:string>>").alias("out"))
    zipped = F.zip_with(values, F.slice(gaps, F.lit(1), F.size(values)), lambda v, g: F.struct(g.alias("gap"), v.alias("value")))
    return F.aggregate(zipped, none, step, lambda s: s["out"])


def with_parsed(rows: DataFrame, column: str, name: str) -> DataFrame:
    """rows with name: struct(kind, op, value, magnitude, center, margin, low, high) of a value's text, numbers as struct(u, e).

    The first form that the whole text has decides; a low end above the high one or a margin below zero gives null.
    Staged over several projections: the form, its two parts, their numbers, the struct.
    """
    text = F.col(column)
    form = first = second = None
    for i, (kind, pattern) in enumerate(FORMS):
        test = text.rlike(f"(?U){pattern}")
        form = F.when(test, i) if form is None else form.when(test, i)
        one, two = F.regexp_extract(text, f"(?U){pattern}", 1), F.regexp_extract(text, f"(?U){pattern}", 2)
        two = two if kind not in ("Approximate", "Point") else F.lit(None).cast("string")
        first = F.when(F.col("_form") == i, one) if first is None else first.when(F.col("_form") == i, one)
        second = F.when(F.col("_form") == i, two) if second is None else second.when(F.col("_form") == i, two)
    d = rows.withColumn("_form", pinned(form))
    d = d.withColumns({"_a": pinned(first), "_b": pinned(second)})
    d = d.withColumns({"_x": pinned(written(F.col("_a"))), "_y": pinned(written(F.col("_b")))})
    kind = F.element_at(F.array(*[F.lit(k) for k, _ in FORMS]), F.col("_form") + 1)
    m = F.least("_x.e", "_y.e")
    ordered = shifted(F.col("_x"), m) <= shifted(F.col("_y"), m)
    op = F.when(F.col("_a") == "≤", "<=").when(F.col("_a") == "≥", ">=").otherwise(F.col("_a"))
    d = d.withColumn("_kind", kind)
    of = lambda *kinds: F.col("_kind").isin(*kinds)
    good = (
        F.when(of("Interval", "Range"), ordered).when(of("PlusMinus"), F.col("_x").isNotNull() & (F.col("_y.u") >= 0)).when(of("Bound"), F.col("_y").isNotNull()).otherwise(F.col("_x").isNotNull())
    )
    parsed = F.struct(
        F.col("_kind").alias("kind"),
        F.when(of("Bound"), op).alias("op"),
        F.when(of("Point", "Approximate"), F.col("_x")).alias("value"),
        F.when(of("Bound"), F.col("_y")).alias("magnitude"),
        F.when(of("PlusMinus"), F.col("_x")).alias("center"),
        F.when(of("PlusMinus"), F.col("_y")).alias("margin"),
        F.when(of("Interval", "Range"), F.col("_x")).alias("low"),
        F.when(of("Interval", "Range"), F.col("_y")).alias("high"),
    )
    return d.withColumn(name, F.when(F.col("_form").isNotNull() & good, parsed)).drop("_form", "_a", "_b", "_x", "_y", "_kind")
