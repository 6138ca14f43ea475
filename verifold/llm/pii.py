"""Personal data: validated patterns, and contextual extraction bootstrapped from them, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._arrays import match_ends, merged, replaced
from ._spark import Positional, cut, with_small

#: Kinds in the order in which spans are listed.
KINDS = ("email", "ip", "card", "phone", "context")
BASE_KINDS = KINDS[:4]
_SPANS = "array<struct<kind:string,start:int,end:int>>"
#: Patterns of the base kinds. Repeats are possessive, and none begins inside a run that it would read whole, except
#: where the last match ended: they match the same, and read no place more than a few times. A lone digit also matches
#: the card pattern here; its digit count drops it.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a kind to be searched at all.
_CUES = {"email": r"@[A-Za-z0-9-]++\.", "ip": r"[0-9]\.[0-9]++\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){12}", "phone": r"\+[0-9]"}
#: Stand-ins of the characters that base spans hold, one for one: a span stays as long and as distinct as it is, and is
#: read as one unit that no pattern of text matches.
_PLAIN = "".join(map(chr, range(0x20, 0x7F)))
_SHADES = "".join(chr(0xE000 + ord(c)) for c in _PLAIN)
_SHADE = "\ue020-\ue07e"
#: Join what is written in groups: a space between groups of digits, a bracket that opens and one that closes such a group.
_SPACE, _OPEN, _CLOSE = "\x1f", "\x1e", "\x1d"
#: A text is read in units: characters up to punctuation and with it; white space, quotes and opening brackets lie
#: between. What of a unit is no value: punctuation that ends it, also that of other scripts.
_SKIP = r"\x09-\x0D\x20\x85\xA0\"'`(\[<"
_ENDS = r"!$%&)*,:;=>?\\\]^{|}~"
_UNIT = rf"[^{_ENDS}{_SKIP}]*+[{_ENDS}]++|[^{_ENDS}{_SKIP}]++"
_TRAIL = "".join(c for c in _PLAIN if not c.isalnum() and c != " ") + "…’”»›„“–—·•、。，；：！？）】」،؛؟" + _SPACE + _OPEN
#: Values of so many digits, or with an @ inside, are identifiers by their form: unseen ones don't count against a pattern.
FORM_DIGITS = 5
_FORMED = rf"(?:[0-9][^0-9]*+){{{FORM_DIGITS}}}|[\p{{L}}\p{{N}}]@[\p{{L}}\p{{N}}]"
#: What a text must hold to have a unit of such a form, or a base span.
_SOME_FORMED = rf"[0-9](?:[^{_ENDS}{_SKIP}0-9]*+[0-9]){{{FORM_DIGITS - 1}}}|@[\p{{L}}\p{{N}}]|[{_SHADE}]"
_BASE_MARK, _START = "\x02", "\x01"


def _digits(x: F.Column) -> F.Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(digits: F.Column) -> F.Column:
    """True if the digits pass the Luhn test: from the right, every second one doubled, its digits summed."""
    n = F.length(digits)

    def step(total, i):
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        doubled = F.when(d * 2 > 9, d * 2 - 9).otherwise(d * 2)
        return total + F.when(i % 2 == 1, doubled).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), step) % 10 == 0


def _valid(kind: str, x: F.Column) -> F.Column:
    if kind == "ip":
        parts = F.transform(F.split(x, r"\."), lambda p: F.regexp_replace(p, "^0+", ""))
        return F.forall(parts, lambda p: (F.length(p) <= 3) & (F.coalesce(p.try_cast("int"), F.lit(0)) <= 255))
    n = F.length(_digits(x))
    if kind == "card":
        return F.when((n >= 13) & (n <= 19), luhn(_digits(x))).otherwise(F.lit(False))
    if kind == "phone":
        return (n >= 9) & (n <= 15)
    return F.lit(True)


def _matches(text: F.Column, pattern: str) -> tuple[F.Column, F.Column]:
    """All leftmost, non-overlapping matches, and the code points before each since the last."""
    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.length(g))
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), gaps


def _spans(kind: str, found: F.Column, gaps: F.Column) -> F.Column:
    """Valid matches as (kind, start, end) in code points."""
    span = lambda m, end: F.struct(F.lit(kind).alias("kind"), (end - F.length(m)).alias("start"), end.alias("end"))
    made = F.zip_with(found, match_ends(found, gaps), lambda m, end: F.when(_valid(kind, m), span(m, end)))
    return F.filter(made, lambda s: s.isNotNull()).cast(_SPANS)


def _with_base_spans(d: DataFrame) -> DataFrame:
    """d with base: the spans of the base kinds in text, by kind as listed, then start."""
    text, cols = F.col("text"), {}
    for kind, pattern in PATTERNS.items():
        found, gaps = _matches(text, pattern)
        cued = text.rlike(_CUES[kind])
        cols[kind] = F.when(cued, found).otherwise(F.array().cast("array<string>"))
        cols[f"{kind}_gaps"] = F.when(cued, gaps).otherwise(F.array().cast("array<int>"))
    spans = [_spans(kind, F.col(kind), F.col(f"{kind}_gaps")) for kind in PATTERNS]
    return d.withColumns(cols).withColumn("base", F.concat(*spans)).drop(*cols)


def _with_reading(d: DataFrame) -> DataFrame:
    """d with read: text as units are read from it, character for character: base spans in stand-ins, groups of digits
    and of IBANs joined. Each step is a column of its own, as steps name the one before more than once."""

    def joined(d: DataFrame, cue: str, pattern: str, by: str) -> DataFrame:
        return d.withColumn("read", F.when(F.col("read").rlike(cue), F.regexp_replace("read", pattern, by)).otherwise(F.col("read")))

    d = joined(d.withColumn("read", F.col("text")), f"[{_SHADE}]", f"[{_SHADE}]", "\ufffd").withColumn("over", merged(F.col("base")))
    d = d.withColumn("read", replaced(F.col("read"), F.col("over"), lambda s, x: F.translate(x, _PLAIN, _SHADES))).drop("over")
    d = joined(d, r"\([0-9]{1,5}\)", r"\((?=[0-9]{1,5}\))", _OPEN)
    d = joined(d, _OPEN, rf"(?<={_OPEN}[0-9]{{1,5}})\)", _CLOSE)
    iban = r"(?<=(?<![\p{L}\p{N}])[A-Z]{2}[0-9]{2}(?:\x20[A-Z0-9]{4}){0,7})\x20(?=[A-Z0-9]{1,4}(?![\p{L}\p{N}]))"
    d = joined(d, r"[A-Z]{2}[0-9]{2}\x20[A-Z0-9]{4}\x20[A-Z0-9]", iban, _SPACE)
    return joined(d, rf"[0-9{_CLOSE}]\x20[0-9{_OPEN}]", rf"(?<=[0-9{_CLOSE}])\x20(?={_OPEN}?[0-9]++(?![\p{{L}}\p{{N}}@_]))", _SPACE)


def _units(texts: DataFrame, keep=None) -> DataFrame:
    """row, i, unit and the two units before it, lower-cased, first and last, for every unit of every text that has one
    before it (what is before the start of a text is _START); if keep is given, for those that it holds for. A base span
    among first and last is _BASE_MARK, whatever it holds."""
    d = texts.select("row", F.regexp_extract_all(F.col("read"), F.lit(_UNIT), F.lit(0)).alias("u"), F.col("read").rlike(f"[{_SHADE}]").alias("shaded"))
    if keep is not None:
        wanted = F.filter(F.transform("u", lambda x, i: F.when(keep(x), i)), lambda i: i.isNotNull())
        d = d.withColumn("at", wanted).where("size(at) > 0")
        low = lambda i: F.when(i < 0, F.lit(_START)).otherwise(_plain(F.lower(F.get("u", i))))
        fields = lambda i: F.struct(i.alias("i"), F.get("u", i).alias("unit"), low(i - 2).alias("first"), low(i - 1).alias("last"))
        return d.select("row", F.explode(F.transform("at", fields)).alias("at")).select("row", "at.*").where("i > 0")
    lower = F.transform("u", lambda x: F.lower(x))
    d = d.withColumn("low", F.when(F.col("shaded"), F.transform(lower, _plain)).otherwise(lower))
    start = F.array(F.lit(_START))
    zipped = F.arrays_zip(F.col("u").alias("unit"), F.concat(start, start, "low").alias("first"), F.concat(start, "low").alias("last"))
    d = d.select("row", F.posexplode(zipped).alias("i", "at")).select("row", "i", "at.unit", "at.first", "at.last")
    return d.where("i > 0 and unit is not null")


def _plain(unit: F.Column) -> F.Column:
    return F.when(unit.rlike(f"[{_SHADE}]"), F.lit(_BASE_MARK)).otherwise(unit)


def _value() -> F.Column:
    """The value that a unit holds: the unit without what ends it; empty if it touches a base span."""
    return F.when(F.col("unit").rlike(f"[{_SHADE}]"), F.lit("")).otherwise(F.rtrim(F.col("unit"), F.lit(_TRAIL)))


def _patterns() -> tuple[F.Column, F.Column]:
    """The lexical patterns of a unit's left context: its last two units; and the last one alone, null unless it ends in
    a colon, an equals sign or a number sign."""
    alone = F.endswith("last", F.lit(":")) | F.endswith("last", F.lit("=")) | F.endswith("last", F.lit("#"))
    return F.concat("first", F.lit(" "), "last"), F.when(alone, F.col("last"))


def _with_patterns(d: DataFrame) -> DataFrame:
    """A row per lexical pattern of each unit."""
    pair, alone = _patterns()
    return d.withColumn("pattern", F.explode(F.array_compact(F.array(pair, alone)))).drop("first", "last")


def _after(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """The units that follow one of the patterns: row, i, unit, and pair and alone, the one or two that they follow."""
    pair, alone = _patterns()
    names = [patterns.select(F.col("pattern").alias(x), F.lit(True).alias(f"is_{x}")) for x in ("pair", "alone")]
    d = _units(texts).withColumns({"pair": pair, "alone": alone}).drop("first", "last")
    d = with_small(with_small(d, names[0], "pair", "left"), names[1], "alone", "left").where("is_pair or is_alone")
    own = lambda x: F.when(F.col(f"is_{x}"), F.col(x)).alias(x)
    return d.select("row", "i", "unit", own("pair"), own("alone"))


def _counted(d: DataFrame) -> DataFrame:
    return cut(d.groupBy("pattern", "value").agg(F.count(F.lit(1)).alias("n")))


def _formed(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """pattern, value, n of every base span (by its stand-ins), and of every value of an identifier's form."""
    has = lambda u: u.rlike(f"[0-9@{_SHADE}]") & u.rlike(rf"{_FORMED}|[{_SHADE}]")
    found = _with_patterns(_units(texts.where(F.col("read").rlike(_SOME_FORMED)), has))
    shade = F.regexp_extract("unit", f"[{_SHADE}]+", 0)
    value = F.when(shade != "", shade).otherwise(_value())
    both = _counted(found.select("pattern", value.alias("value")).where(F.col("value").rlike(rf"{_FORMED}|[{_SHADE}]")))
    seed = F.col("value").rlike(f"[{_SHADE}]")
    return both.where(seed), both.where(~seed)


def _followers(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """pattern, value, n of every value without an identifier's form that follows one of the patterns."""
    # counted first, so that values aren't made of every unit
    units = cut(_after(texts, patterns).groupBy("pair", "alone", "unit").agg(F.count(F.lit(1)).alias("n")))
    of = lambda x: units.where(F.col(x).isNotNull()).select(F.col(x).alias("pattern"), _value().alias("value"), "n")
    d = of("pair").unionByName(of("alone")).where((F.col("value") != "") & ~F.col("value").rlike(_FORMED))
    return cut(d.groupBy("pattern", "value").agg(F.sum("n").alias("n")))


def _occurrences(texts: DataFrame, values: DataFrame) -> tuple[DataFrame, DataFrame]:
    """value and total, how often it occurs; and pattern, value, n of its occurrences."""
    d = _units(texts).withColumn("value", F.rtrim(F.col("unit"), F.lit(_TRAIL)))  # what touches a base span equals none of values
    d = with_small(d, values, "value")
    found = _counted(_with_patterns(d).select("pattern", "value"))
    pair = F.when(F.col("pattern").contains(" "), F.col("n")).otherwise(F.lit(0))  # a place has one pattern of two units
    return cut(found.groupBy("value").agg(F.sum(pair).alias("total"))), found


def _without(d: DataFrame, seen: DataFrame | None, on: str) -> DataFrame:
    return d if seen is None else d.join(seen, on, "left_anti")


def _and(seen: DataFrame | None, more: DataFrame) -> DataFrame:
    return more if seen is None else seen.unionByName(more)


def bootstrap(texts: DataFrame, min_seeds: int = 3, confidence: float = 0.8) -> tuple[DataFrame, DataFrame] | None:
    """The patterns and values that are accepted when nothing changes any more; None if there are none.

    texts has row and read (see _with_reading). Nodes of the graph are lexical patterns and the values that follow them. Base
    spans are known. A pattern that min_seeds distinct known values follow scores r * min(log2(1 + known), 4) / 2
    (Riloff), where r is the share of known values among known ones and the background: distinct others that have no
    identifier's form. What follows a pattern that scores confidence is accepted if it has such a form, or if at least
    half of all its occurrences follow such patterns. Accepted values are known wherever they occur. Known values and
    good patterns only grow, so this ends, and the result doesn't depend on the order.

    Texts are read once for all values of an identifier's form, whose part of the graph is then scored in rounds on
    written tables; once for what else follows the patterns that can come into question; and twice for each layer of
    values without such a form.
    """
    seeds, formed = _formed(texts)
    known = seeds.select("pattern", "value")
    looked = cut(_and(known, formed.select("pattern", "value")).groupBy("pattern").count().where(F.col("count") >= min_seeds).select("pattern"))
    if looked.isEmpty():
        return None
    others = _followers(texts, looked)
    accepted = totals = places = good = None
    while True:
        counts = known.groupBy("pattern").agg(F.count(F.lit(1)).alias("known")).where(F.col("known") >= min_seeds)
        left = _without(others, accepted, "value").groupBy("pattern").agg(F.count(F.lit(1)).alias("others"))
        share = F.col("known") / (F.col("known") + F.coalesce("others", F.lit(0)))
        score = share * F.least(F.log2(F.col("known") + 1), F.lit(4.0)) / 2
        good = cut(counts.join(left, "pattern", "left").where(score >= confidence).select("pattern"))
        found = cut(_without(with_small(formed, good, "pattern").select("value").distinct(), accepted, "value"))
        where = formed
        if found.isEmpty():
            pair = F.when(F.col("pattern").contains(" "), F.col("n")).otherwise(F.lit(0))  # a place may follow one pattern of each length
            plain = with_small(others, good, "pattern").groupBy("value").agg(F.greatest(F.sum(pair), F.sum(F.col("n") - pair)).alias("n"))
            plain = cut(_without(plain, accepted, "value"))
            fresh = cut(_without(plain.select("value"), totals, "value"))
            if not fresh.isEmpty():
                total, at = _occurrences(texts, fresh)
                totals, places = _and(totals, total), _and(places, at)
            found = cut(plain.join(totals, "value").where(2 * F.col("n") >= F.col("total")).select("value")) if totals is not None else plain
            where = places
        if found.isEmpty():
            return None if accepted is None else (good, accepted)
        accepted = _and(accepted, found)
        known = cut(known.unionByName(with_small(where, found, "value").select("pattern", "value")))
        if where is places:  # patterns that come into question by values without form only
            more = known.groupBy("pattern").count().where(F.col("count") >= min_seeds).select("pattern")
            more = cut(_without(more, looked, "pattern"))
            if not more.isEmpty():
                looked, others = looked.unionByName(more), others.unionByName(_followers(texts, more))


def _hits(texts: DataFrame, good: DataFrame, accepted: DataFrame) -> DataFrame:
    """row and more: the spans of accepted values that follow accepted patterns, by start."""
    d = cut(_after(texts, good)).select("row", "i", _value().alias("value"))
    d = with_small(d, cut(accepted), "value").groupBy("row").agg(F.map_from_entries(F.collect_set(F.struct("i", F.length("value")))).alias("lengths"))
    d = with_small(texts, cut(d), "row")
    found, gaps = _matches(F.col("read"), _UNIT)
    d = d.select("row", "lengths", found.alias("found"), gaps.alias("gaps")).withColumn("ends", match_ends(F.col("found"), F.col("gaps")))

    def span(i):
        start = F.get("ends", i) - F.length(F.get("found", i))
        return F.struct(F.lit("context").alias("kind"), start.alias("start"), (start + F.element_at("lengths", i)).alias("end"))

    return d.select("row", F.transform(F.array_sort(F.map_keys("lengths")), span).cast(_SPANS).alias("more"))


def find_pii(docs: DataFrame, text_col: str = "text", **scoring) -> DataFrame:
    """docs with pii_spans: kind, start and end (code points, end exclusive) of the whole text, by kind, then start.

    Base kinds come from their patterns. They are the seeds of bootstrap() over all of docs, whose accepted values
    after accepted patterns are the spans of kind context. Null and empty texts have no spans; texts are read whole, and
    time is about linear in their length, whatever they hold; repeated rows get equal spans, and count as often as they
    occur; null ids don't matter; empty tables give empty results; a column named pii_spans is replaced, all others stay,
    whatever their names. Rows are written once with their base spans, then read back.
    """
    p = Positional(docs, ["pii_spans"])
    d = _with_base_spans(p.df.withColumn("text", F.coalesce(p.col(text_col), F.lit(""))).withColumn("row", F.monotonically_increasing_id()))
    d = _with_reading(d).withColumn("read", F.when(F.col("read") != F.col("text"), F.col("read")))  # null where it is the text
    rows = cut(d.drop("text"))
    own = F.coalesce(p.col(text_col), F.lit(""))
    texts = rows.select("row", F.coalesce("read", own).alias("read"))
    scored = bootstrap(texts, **scoring)
    if scored is None:
        return p.restore(rows.withColumnRenamed("base", "pii_spans"))
    joined = with_small(rows.drop("read"), cut(_hits(texts, *scored)), "row", "left")
    return p.restore(joined.withColumn("pii_spans", F.concat("base", F.coalesce("more", F.array().cast(_SPANS)))))


def redact(docs: DataFrame, text_col: str = "text", **scoring) -> DataFrame:
    """docs with every span of personal data replaced by its kind in brackets, spans that overlap by the first one's.
    n_chars, if there is one, counts the new text.

    Every row stays: null texts stay null, empty ones empty, very long ones are read whole, repeated rows get equal texts,
    an empty table gives an empty result; docs' other columns stay as they are, whatever their names.
    """
    p = Positional(docs)
    d = find_pii(p.df, text_col=p.name(text_col), **scoring)
    text = p.col(text_col)
    tag = lambda s, x: F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))
    d = d.withColumn("over", merged(F.col("pii_spans"))).withColumn(p.name(text_col), replaced(text, F.col("over"), tag))
    if "n_chars" in docs.columns:
        d = d.withColumn(p.name("n_chars"), F.length(text).cast(docs.schema["n_chars"].dataType))
    return p.restore(d)


def span_text(spans: F.Column) -> F.Column:
    """kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op5_pii_bootstrap(spark, sf_dir: str) -> DataFrame:
    """Counts, digest and spans of every document's personal data."""
    d = find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).drop("text")
    of = lambda *kinds: F.filter("pii_spans", lambda s: s["kind"].isin(*kinds))
    return d.select(
        "doc_id",
        *[F.size(of(kind)).cast("long").alias(f"n_{kind}") for kind in BASE_KINDS],
        F.sha2(F.encode(span_text(of(*BASE_KINDS)), "UTF-8"), 256).alias("base_sha256"),
        span_text(F.col("pii_spans")).alias("spans"),
        F.size(of("context")).cast("long").alias("n_context"),
    )
