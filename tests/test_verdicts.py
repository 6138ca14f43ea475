"""decide() against a plain decimal version of the rules, cause precedence, and every verdict of the matrix."""

from decimal import Decimal, getcontext

import numpy as np
import pytest
from pyspark.sql import functions as F

from verifold.functions.decimals import strict_decimal, written
from verifold.operators import verdicts as V

getcontext().prec = 60


def half(x):
    return Decimal(5) * Decimal(10) ** (x.as_tuple().exponent - 1)


def plain(r):
    if r["scale"] is None and r["percent"]:
        return "UNIT_UNDECLARED"
    d = {k: Decimal(r[k]) for k in ("value", "magnitude", "center", "margin", "low", "high", "tolerance") if r.get(k) is not None}
    scale = Decimal(r["scale"] or 1)
    re, a = Decimal(r["located"]) * scale, Decimal(0) if r["float_repr"] else half(Decimal(r["located"])) * scale
    kind = r["kind"]
    if kind == "PlusMinus" and d["margin"] == 0:
        kind, d["value"] = "Point", d["center"]

    def width(reference):
        if r["tolerance_kind"] == "abs":
            return d["tolerance"]
        return None if reference == 0 else d["tolerance"] * abs(reference)

    def rounded(v):
        return v.as_tuple().exponent == 0 and v != 0 and v % 10 == 0

    def finish(low, high, edge_h, reference, plain_point=None):
        if low <= re <= high:
            return "REPRODUCED"
        edge = low if re < low else high
        if plain_point is None and a > edge_h(re < low) and re - a <= edge <= re + a:
            return "ARTIFACT_PRECISION_COARSER"
        if "tolerance" not in d:
            return "DIVERGED"
        w = width(reference)
        if w is None:
            return "NO_TOLERANCE"
        if plain_point is not None:
            low = high = plain_point
        return "WITHIN-TOLERANCE" if low - w <= re <= high + w else "DIVERGED"

    if kind in ("Point", "Approximate"):
        v = d["value"]
        if "tolerance" not in d and rounded(v):
            return "PRECISION_AMBIGUOUS"
        if a > half(v) and re - a <= v <= re + a:
            return "ARTIFACT_PRECISION_COARSER"
        return finish(v - half(v), v + half(v), None, v, v)
    if kind == "Bound":
        test = {"<": lambda x, m: x < m, "<=": lambda x, m: x <= m, ">": lambda x, m: x > m, ">=": lambda x, m: x >= m}[r["op"]]
        m = d["magnitude"]
        if test(re - a, m) != test(re + a, m):
            return "ARTIFACT_PRECISION_COARSER"
        if test(re, m):
            return "REPRODUCED"
        if "tolerance" not in d:
            return "DIVERGED"
        w = width(m)
        if w is None:
            return "NO_TOLERANCE"
        return "WITHIN-TOLERANCE" if test(re, m + w if r["op"][0] == "<" else m - w) else "DIVERGED"
    if kind == "PlusMinus":
        c, g = d["center"], d["margin"]
        if "tolerance" not in d and rounded(c):
            return "PRECISION_AMBIGUOUS"
        w = g + half(c) + half(g)
        return finish(c - w, c + w, lambda low: max(half(c), half(g)), c)
    low, high = d["low"], d["high"]
    return finish(low - half(low), high + half(high), lambda below: half(low) if below else half(high), (low + high) / 2)


NAMES = ("value", "magnitude", "center", "margin", "low", "high", "tolerance", "scale", "located")


def test_decide_matches_the_rules(spark):
    rng = np.random.default_rng(6)
    number = lambda: f"{'-' if rng.random() < 0.2 else ''}{rng.integers(0, 40)}" + (f".{rng.integers(0, 10 ** (n := int(rng.integers(1, 3)))):0{n}d}" if rng.random() < 0.6 else "")
    rows = []
    for i in range(4000):
        r = dict.fromkeys(NAMES) | {"i": i, "kind": str(rng.choice(V.KINDS)), "op": str(rng.choice(["<", "<=", ">", ">="])), "tolerance_kind": None}
        r |= {"float_repr": bool(rng.random() < 0.2), "percent": bool(rng.random() < 0.1), "located": number()}
        if r["kind"] in ("Point", "Approximate"):
            r["value"] = number()
        elif r["kind"] == "Bound":
            r["magnitude"] = number()
        elif r["kind"] == "PlusMinus":
            r["center"], r["margin"] = number(), str(rng.choice(["0", "2", "0.5", "1.25"]))
        else:
            r["low"], r["high"] = sorted((number(), number()), key=Decimal)
        if rng.random() < 0.5:
            r["tolerance_kind"], r["tolerance"] = str(rng.choice(["abs", "rel"])), str(rng.choice(["0.5", "2", "0.05", "0"]))
        if rng.random() < 0.3:
            r["scale"] = str(rng.choice(["100", "0.1", "1"]))
        rows.append(r)
    fields = ", ".join(f"{n} string" for n in NAMES)
    d = spark.createDataFrame([[r[k] for k in (*NAMES, "i", "kind", "op", "tolerance_kind", "float_repr", "percent")] for r in rows], f"{fields}, i int, kind string, op string, tolerance_kind string, float_repr boolean, percent boolean")
    got = V.decide(d.withColumns({n: strict_decimal(F.col(n)) for n in NAMES})).select("i", "verdict", "cause").collect()
    seen = set()
    for g in got:
        expected = plain(rows[g["i"]])
        assert (g["cause"] or g["verdict"]) == expected, (rows[g["i"]], g)
        seen.add(expected)
    assert seen == {"REPRODUCED", "DIVERGED", "WITHIN-TOLERANCE", "NO_TOLERANCE", "ARTIFACT_PRECISION_COARSER", "PRECISION_AMBIGUOUS", "UNIT_UNDECLARED"}


@pytest.mark.parametrize(("text", "u", "e"), [("0.870", "870", -3), ("-1.5e3", "-15", 2), (".5", "5", -1), ("+7.", "7", 0), ("1e-5", "1", -5), ("00", "0", 0)])
def test_strict_decimal(spark, text, u, e):
    r = spark.range(1).select(strict_decimal(F.lit(text)).alias("x")).first()["x"]
    assert (str(r["u"]), r["e"]) == (u, e)


@pytest.mark.parametrize("text", ["", "1e400", "NaN", "1,000", "1" * 41, "0x1", "1 ", "１", None])
def test_not_a_decimal(spark, text):
    assert spark.range(1).select(strict_decimal(F.lit(text).cast("string")).alias("x")).first()["x"] is None


def test_thousands(spark):
    assert spark.range(1).select(written(F.lit("10,000")).alias("x")).first()["x"]["u"] == 10000


def test_overflow_is_no_verdict(spark):
    d = spark.range(1).select(F.lit("Point").alias("kind"), strict_decimal(F.lit("1e-30")).alias("value"), strict_decimal(F.lit("1e30")).alias("located"))
    r = V.decide(d).first()
    assert (r["verdict"], r["cause"]) == ("UNVERIFIED", V.OVERFLOW)


def test_no_run_failure_diverges(spark):
    """Each cause that stands before comparison hides a value that would diverge; without it the claim diverges."""
    claims = spark.range(7).select(F.col("id").alias("claim_id"), F.col("id").alias("run_id"), F.lit("Point").alias("kind"), strict_decimal(F.lit("1")).alias("value"))
    bindings = claims.where("claim_id <> 4").select("claim_id")
    located = claims.select("claim_id", strict_decimal(F.lit("5")).alias("located"), F.when(F.col("claim_id") == 5, "STALE_ARTIFACT").alias("locate_cause"))
    runs = spark.createDataFrame([(0, "TIMEOUT", False, False, 1), (1, None, True, True, 1), (2, None, False, True, 1), (3, None, False, False, 0), (4, None, False, False, 1), (5, None, False, False, 1), (6, None, False, False, 1)],
                                 "run_id long, failure string, too_large boolean, limit_exceeded boolean, artifacts int")
    got = {r["claim_id"]: r["cause"] or r["verdict"] for r in V.verify(claims, bindings, located, runs).collect()}
    assert got == dict(enumerate(["TIMEOUT", "ARTIFACT_TOO_LARGE", "CAPTURE_LIMIT_EXCEEDED", "NO_ARTIFACT", "NO_BINDING", "STALE_ARTIFACT", "DIVERGED"]))
