"""Exact decimals as (unscaled, exponent) pairs in DECIMAL(38,0): the exponent keeps the written precision."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

WHOLE = "decimal(38,0)"
#: A strict decimal as artifacts write it.
STRICT = r"^[+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?\z"
MAX_DIGITS = 40
NUMBER = f"struct<u:{WHOLE},e:int>"


def strict_decimal(text: Column) -> Column:
    """struct(u, e) of an ASCII decimal text, so that its value is u * 10**e; null if it isn't one, has over 40 digits
    or an adjusted exponent beyond 40, or doesn't fit 38 digits."""
    low = F.lower(text)
    mantissa = F.substring_index(low, "e", 1)
    point = F.substring_index(low, "e", -1)
    power = F.when(~F.contains(low, F.lit("e")), 0).when(F.length(point) <= 6, point.try_cast("int"))
    places = F.when(F.contains(mantissa, F.lit(".")), F.length(F.substring_index(mantissa, ".", -1))).otherwise(0)
    digits = F.translate(mantissa, "+-.", "")
    exponent = power - places
    significant = F.length(F.ltrim(digits, F.lit("0")))
    adjusted = exponent + F.greatest(significant, F.lit(1)) - 1
    unscaled = F.concat(F.when(F.startswith(mantissa, F.lit("-")), "-").otherwise(""), digits).try_cast(WHOLE)
    good = F.coalesce(text.rlike(STRICT), F.lit(False)) & (F.length(digits) <= MAX_DIGITS) & (F.abs(adjusted) <= MAX_DIGITS)
    return F.when(good & unscaled.isNotNull(), F.struct(unscaled.alias("u"), exponent.alias("e")))


def written(text: Column) -> Column:
    """struct(u, e) of a number as papers write it: thousands separators are taken out first."""
    return strict_decimal(F.replace(text, F.lit(","), F.lit("")))


def from_decimal(value: Column, scale: int) -> Column:
    """struct(u, e) of a DECIMAL column of this scale, all of whose digits count as written."""
    return F.struct((value * F.lit(10**scale).cast("decimal(19,0)")).cast(WHOLE).alias("u"), F.lit(-scale).alias("e"))


def power10(n: Column) -> Column:
    """10**n as a whole decimal; null outside 0 to 37."""
    return F.when((n >= 0) & (n <= 37), F.element_at(F.array(*[F.lit(Decimal(10) ** i).cast(WHOLE) for i in range(38)]), n + 1))


def shifted(number: Column, exponent: Column) -> Column:
    """The number in units of 10**exponent (not above its own); null if that takes over 38 digits."""
    return F.try_multiply(number["u"], power10(number["e"] - exponent))


def product(x: Column, y: Column) -> Column:
    return F.struct(F.try_multiply(x["u"], y["u"]).alias("u"), (x["e"] + y["e"]).alias("e"))
