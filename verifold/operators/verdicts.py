"""Verdicts of claims: exact comparison of reported and located values, cause precedence and coverage."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.decimals import NUMBER, WHOLE, power10, product, shifted
from ..functions.plan import pinned

REPRODUCED, WITHIN_TOLERANCE, DIVERGED, UNVERIFIED = VERDICTS = ("REPRODUCED", "WITHIN-TOLERANCE", "DIVERGED", "UNVERIFIED")
POINT, BOUND, PLUS_MINUS, INTERVAL, RANGE, APPROXIMATE = KINDS = ("Point", "Bound", "PlusMinus", "Interval", "Range", "Approximate")
#: Numbers of the input rows, each a struct (u, e); those a kind doesn't have are null.
NUMBERS = ("value", "magnitude", "center", "margin", "low", "high", "located", "scale", "tolerance")
OVERFLOW = "NUMERIC_OVERFLOW"


def _least_exponent(columns: list[Column]) -> Column:
    return reduce(lambda a, b: F.least(a, b), [F.coalesce(c, F.lit(2**30)) for c in columns])


def decide(rows: DataFrame) -> DataFrame:
    """rows with verdict and cause.

    Columns used: kind, op (of a Bound), the NUMBERS, tolerance_kind (abs or rel), float_repr (boolean: the artifact's
    own rounding is none), percent (boolean: the value is written in percent). All numbers are brought to one exponent
    and compared as twice their whole multiples, so half units and midpoints are whole too. A row whose numbers take
    over 38 digits there is UNVERIFIED with NUMERIC_OVERFLOW.
    """
    d = rows
    for name in NUMBERS:
        if name not in d.columns:
            d = d.withColumn(name, F.lit(None).cast(NUMBER))
    for name, value in (("op", F.lit(None).cast("string")), ("tolerance_kind", F.lit(None).cast("string")), ("float_repr", F.lit(False)), ("percent", F.lit(False))):
        if name not in d.columns:
            d = d.withColumn(name, value)
    c = F.col
    one = F.struct(F.lit(1).cast(WHOLE).alias("u"), F.lit(0).alias("e"))
    factor = F.coalesce("scale", one)
    # a margin of zero makes a value with a margin a plain one
    as_point = c("kind").isin(POINT, APPROXIMATE) | ((c("kind") == PLUS_MINUS) & (c("margin.u") == 0))
    d = d.withColumns(
        {
            "_as": F.when(as_point, POINT).when(c("kind") == RANGE, INTERVAL).otherwise(c("kind")),
            "_v": F.when(c("kind") == PLUS_MINUS, c("center")).otherwise(c("value")),
            "_re": product(c("located"), factor),
            "_a": F.struct(factor["u"].alias("u"), (c("located.e") + factor["e"]).alias("e")),
        }
    )
    relative = c("tolerance_kind") == "rel"
    reference_e = F.coalesce(c("_v.e"), c("magnitude.e"), F.least("low.e", "high.e"))
    width_e = F.when(relative, c("tolerance.e") + reference_e).otherwise(c("tolerance.e"))
    d = d.withColumn("_m", _least_exponent([c("_v.e"), c("magnitude.e"), c("margin.e"), c("low.e"), c("high.e"), c("_re.e"), width_e]))
    m = c("_m")
    two = lambda x: F.try_multiply(shifted(c(x), m), F.lit(2).cast(WHOLE))
    half = lambda x: power10(c(x)["e"] - m)  # noqa: E731  twice half a unit of the last written place
    d = d.withColumns({f"_{x}2": two(x) for x in ("_v", "magnitude", "margin", "low", "high", "_re")} | {f"_{x}_h": half(x) for x in ("_v", "margin", "low", "high")})
    d = d.withColumn("_a2", F.when(c("float_repr"), F.lit(0).cast(WHOLE)).otherwise(shifted(c("_a"), m)))
    zero = F.lit(0).cast(WHOLE)
    plus = lambda *xs: reduce(F.try_add, xs)
    # twice the midpoint is the sum of the ends
    reference2 = F.coalesce(c("__v2"), c("_magnitude2"), F.try_divide(plus(c("_low2"), c("_high2")), F.lit(2).cast(WHOLE)).cast(WHOLE))
    relative2 = F.try_multiply(c("tolerance.u"), F.try_divide(F.abs(reference2), power10(-c("tolerance.e"))).cast("decimal(38,0)"))
    # tolerance.e is at most 0 here or its power multiplies; the shift above left enough room for a whole result
    relative2 = F.when(c("tolerance.e") > 0, F.try_multiply(F.try_multiply(c("tolerance.u"), F.abs(reference2)), power10(c("tolerance.e")))).otherwise(relative2)
    d = d.withColumns(
        {
            "_w2": F.when(relative, relative2).otherwise(F.try_multiply(shifted(c("tolerance"), m), F.lit(2).cast(WHOLE))),
            "_no_width": relative & (reference2 == 0),
            "_has_tolerance": c("tolerance.u").isNotNull(),
            "_low_edge": F.when(c("_as") == POINT, F.try_subtract(c("__v2"), c("__v_h")))
            .when(c("_as") == PLUS_MINUS, F.try_subtract(c("__v2"), plus(c("_margin2"), c("__v_h"), c("_margin_h"))))
            .when(c("_as") == INTERVAL, F.try_subtract(c("_low2"), c("_low_h"))),
            "_high_edge": F.when(c("_as") == POINT, plus(c("__v2"), c("__v_h")))
            .when(c("_as") == PLUS_MINUS, plus(c("__v2"), c("_margin2"), c("__v_h"), c("_margin_h")))
            .when(c("_as") == INTERVAL, plus(c("_high2"), c("_high_h"))),
        }
    )
    re2, a2 = c("__re2"), c("_a2")
    low, high = c("_low_edge"), c("_high_edge")
    edge = F.when(re2 < low, low).otherwise(high)
    edge_h = F.when(c("_as") == PLUS_MINUS, F.greatest("__v_h", "_margin_h")).otherwise(F.when(re2 < low, c("_low_h")).otherwise(c("_high_h")))
    inside = (re2 >= low) & (re2 <= high)
    round_integer = (c("_v.e") == 0) & (c("_v.u") != 0) & (c("_v.u") % 10 == 0)
    # a plain value is held against its own tolerance band, the others against their band and the tolerance beyond it
    wide_low = F.when(c("_as") == POINT, F.try_subtract(c("__v2"), c("_w2"))).otherwise(F.try_subtract(low, c("_w2")))
    wide_high = F.when(c("_as") == POINT, plus(c("__v2"), c("_w2"))).otherwise(plus(high, c("_w2")))

    def holds(x: Column, limit: Column) -> Column:
        return F.when(c("op") == "<", x < limit).when(c("op") == "<=", x <= limit).when(c("op") == ">", x > limit).when(c("op") == ">=", x >= limit)

    limit = c("_magnitude2")
    widened = F.when(c("op").isin("<", "<="), plus(limit, c("_w2"))).otherwise(F.try_subtract(limit, c("_w2")))
    reported = F.when(c("_as") == POINT, c("_v.u").isNotNull()).when(c("_as") == BOUND, limit.isNotNull() & c("op").isNotNull()).otherwise(low.isNotNull() & high.isNotNull())
    overflow = c("__re2").isNull() | a2.isNull() | ~F.coalesce(reported, F.lit(False)) | (c("_has_tolerance") & c("_w2").isNull())
    coarser = (
        F.when(c("_as") == POINT, (a2 > c("__v_h")) & (F.abs(F.try_subtract(c("__v2"), re2)) <= a2))
        .when(c("_as") == BOUND, holds(F.try_subtract(re2, a2), limit) != holds(plus(re2, a2), limit))
        .otherwise(~inside & (a2 > edge_h) & (F.abs(F.try_subtract(edge, re2)) <= a2))
    )
    ambiguous = c("_as").isin(POINT, PLUS_MINUS) & ~c("_has_tolerance") & round_integer
    reproduced = F.when(c("_as") == BOUND, holds(re2, limit)).otherwise(inside)
    tolerated = F.when(c("_as") == BOUND, holds(re2, widened)).otherwise((re2 >= wide_low) & (re2 <= wide_high))
    state = (
        F.when(c("scale.u").isNull() & c("percent"), F.lit("UNIT_UNDECLARED"))
        .when(overflow, F.lit(OVERFLOW))
        .when(ambiguous, F.lit("PRECISION_AMBIGUOUS"))
        .when((c("_as") != POINT) & (c("_as") != BOUND) & inside, F.lit(REPRODUCED))
        .when(coarser, F.lit("ARTIFACT_PRECISION_COARSER"))
        .when(reproduced, F.lit(REPRODUCED))
        .when(c("_has_tolerance") & c("_no_width"), F.lit("NO_TOLERANCE"))
        .when(c("_has_tolerance") & tolerated, F.lit(WITHIN_TOLERANCE))
        .otherwise(F.lit(DIVERGED))
    )
    d = d.withColumn("_state", pinned(state))
    verdict = F.when(c("_state").isin(*VERDICTS), c("_state")).otherwise(UNVERIFIED)
    cause = F.when(~c("_state").isin(*VERDICTS), c("_state"))
    return d.select(*rows.columns, verdict.alias("verdict"), cause.alias("cause"))


def verify(claims: DataFrame, bindings: DataFrame, located: DataFrame, runs: DataFrame) -> DataFrame:
    """A verdict row per claim: claims left outer bindings (claim_id), located values (claim_id) and the claim's run (run_id).

    The first of these causes holds: the run's failure; its caps, ARTIFACT_TOO_LARGE before CAPTURE_LIMIT_EXCEEDED; no
    artifact; no binding; the cause of not locating; then what decide() says. runs has run_id, failure, too_large,
    limit_exceeded, artifacts; bindings has claim_id and its tolerance columns; located has claim_id, located, locate_cause.
    """
    bound = claims.join(bindings.withColumn("_bound", F.lit(True)), "claim_id", "left").join(located, "claim_id", "left").join(runs, "run_id", "left")
    before = (
        F.when(F.col("failure").isNotNull(), F.col("failure"))
        .when(F.col("too_large"), F.lit("ARTIFACT_TOO_LARGE"))
        .when(F.col("limit_exceeded"), F.lit("CAPTURE_LIMIT_EXCEEDED"))
        .when(F.coalesce("artifacts", F.lit(0)) == 0, F.lit("NO_ARTIFACT"))
        .when(F.col("_bound").isNull(), F.lit("NO_BINDING"))
        .otherwise(F.col("locate_cause"))
    )
    d = decide(bound.withColumn("_before", before))
    decided = F.col("_before").isNull()
    return d.select(
        *claims.columns,
        F.when(decided, F.col("verdict")).otherwise(UNVERIFIED).alias("verdict"),
        F.when(decided, F.col("cause")).otherwise(F.col("_before")).alias("cause"),
        (decided & (F.col("verdict") == DIVERGED)).alias("review_required"),
        (decided & F.col("located.u").isNotNull()).alias("bound"),
    )


def orphan_bindings(bindings: DataFrame, claims: DataFrame) -> DataFrame:
    """Bindings of unknown claims; any makes its binding file invalid."""
    return bindings.join(claims.select("claim_id"), "claim_id", "left_anti")


def coverage(verdicts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Claims, bound claims and a count of each verdict, zeros included."""
    counts = [F.count_if(F.col("verdict") == v).alias(f"n_{v.lower().replace('-', '_')}") for v in VERDICTS]
    return verdicts.groupBy(*(by or [])).agg(F.count("*").alias("claims"), F.count_if("bound").alias("bound"), *counts)


def causes(verdicts: DataFrame) -> DataFrame:
    """Claims by cause; causes that don't occur have no row."""
    return verdicts.where("cause IS NOT NULL").groupBy("cause").agg(F.count("*").alias("claims"))


def pooled_report(verdicts: DataFrame, labels: DataFrame, exact: str = "decimal(38,10)") -> DataFrame:
    """Per case and pooled (case_id null, pooled true): coverage, labels of diverged claims, precision and recall.

    verdicts has case_id, claim_id, verdict, bound; labels has case_id, claim_id, label (confirmed or refuted).
    Precision is confirmed over confirmed and refuted diverged claims, recall confirmed over all labels; the pooled
    rates come from pooled counts, and a rate over nothing is null.
    """
    d = verdicts.join(labels, ["case_id", "claim_id"], "left")
    hit = F.col("verdict") == DIVERGED
    out = d.rollup("case_id").agg(
        F.grouping("case_id").cast("boolean").alias("pooled"),
        F.count("*").alias("claims"),
        F.count_if("bound").alias("bound"),
        F.count_if(hit).alias("diverged"),
        F.count("label").alias("labeled"),
        F.count_if(hit & (F.col("label") == "confirmed")).alias("confirmed"),
        F.count_if(hit & (F.col("label") == "refuted")).alias("refuted"),
    )
    rate = lambda n, of: F.when(of > 0, (n.cast("decimal(20,0)") / of.cast("decimal(20,0)")).cast("double"))
    judged = F.col("confirmed") + F.col("refuted")
    return out.withColumns({"precision": rate(F.col("confirmed"), judged), "recall": rate(F.col("confirmed"), F.col("labeled"))})


def orphan_labels(labels: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Labels of unknown claims or outside the vocabulary: each makes a report an error."""
    unknown = labels.join(verdicts.select("case_id", "claim_id"), ["case_id", "claim_id"], "left_anti")
    return unknown.unionByName(labels.where(~F.col("label").isin("confirmed", "refuted"))).distinct()


def run_flips(verdicts: DataFrame) -> DataFrame:
    """Per claim over runs: the spread of its located values and whether its verdict flips."""
    return verdicts.groupBy("claim_id").agg(
        F.count("*").alias("runs"),
        (F.max("located_value") - F.min("located_value")).alias("spread"),
        (F.count_distinct("verdict") > 1).alias("flips"),
    )
