"""Native functions over arrays and spans whose time is in proportion to their length, or that times its logarithm."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Code points in a chunk, from whose start a place in a text is counted.
CHUNK = 512


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is computed once however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(x: Column, merge: Callable[[Column, Column], Column]) -> Column:
    """The running results of an associative merge over an array: each round merges every element with the one as many
    places before it as all earlier rounds have covered, so there are as many rounds as the length has bits."""
    bits = F.length(F.bin(F.size(x)))
    back = lambda acc, i, j: F.get(acc, i - F.call_function("shiftleft", F.lit(1), j))
    return F.aggregate(F.sequence(F.lit(0), bits - 1), x, lambda acc, j: F.transform(acc, lambda v, i: F.coalesce(merge(back(acc, i, j), v), v)))


def match_ends(found: Column, gaps: Column) -> Column:
    """Where each match ends, in code points, from the matches and the lengths of the texts between them."""
    steps = F.zip_with(found, F.slice(gaps, 1, F.size(found)), lambda m, g: F.length(m) + g)
    return F.when(F.size(found) > 0, running(steps, lambda a, b: a + b)).otherwise(F.array().cast("array<int>"))


def merged(spans: Column) -> Column:
    """Spans (kind, start, end) by start, those that overlap as one with the first one's kind: struct(start, end, kind)."""
    by_start = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))

    def over(s: Column) -> Column:
        far = running(F.transform(s, lambda x: x["end"]), F.greatest)
        return let(far, lambda far: let(heads(s, far), lambda h: F.transform(h, lambda i, k: whole(s, far, h, i, k))))

    def heads(s: Column, far: Column) -> Column:
        return F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i)["start"] >= F.get(far, i - 1)))

    def whole(s: Column, far: Column, h: Column, i: Column, k: Column) -> Column:
        last = F.coalesce(F.get(h, k + 1), F.size(s)) - 1
        return F.struct(F.get(s, i)["start"].alias("start"), F.get(far, last).alias("end"), F.get(s, i)["kind"].alias("kind"))

    none = F.array().cast("array<struct<start:int,end:int,kind:string>>")
    return F.when(F.size(spans) > 0, let(by_start, over)).otherwise(none)


def replaced(text: Column, spans: Column, by: Callable[[Column, Column], Column]) -> Column:
    """text with each of the merged() spans replaced by by(span, what it holds)."""

    def between(chunks: Column, a: Column, b: Column) -> Column:
        first, last = F.floor(a / CHUNK).cast("int"), F.floor(b / CHUNK).cast("int")
        head, tail = F.coalesce(F.get(chunks, first), F.lit("")), F.coalesce(F.get(chunks, last), F.lit(""))
        start = (a - first * CHUNK + 1).cast("int")
        long = F.concat(
            F.substring(head, start, F.lit(CHUNK)),
            F.array_join(F.slice(chunks, first + 2, F.greatest(last - first - 1, F.lit(0))), ""),
            F.substring(tail, F.lit(1), b - last * CHUNK),
        )
        return F.when(first == last, F.substring(head, start, b - a)).otherwise(long)

    def pieces(chunks: Column, spans: Column) -> Column:
        n = F.size(spans)
        before = lambda i: F.coalesce(F.get(spans, i - 1)["end"], F.lit(0))
        parts = F.transform(spans, lambda s, i: F.concat(between(chunks, before(i), s["start"]), by(s, between(chunks, s["start"], s["end"]))))
        return F.concat(F.array_join(parts, ""), between(chunks, before(n), F.length(text)))

    chunks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))
    return F.when(F.size(spans) > 0, let(chunks, lambda c: let(spans, lambda s: pieces(c, s)))).otherwise(text)
