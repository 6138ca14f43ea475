"""Line-first quality rules with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import Positional

#: White space between words; a word is a run of anything else.
SPACE = r"[\x20\x09-\x0D]+"
#: Patterns of lines that are navigation: link trails, menus of separated labels, paging and sharing controls.
NAVIGATION = (
    r"(?i)^\s*(?:home|menu|skip to (?:main )?content|back to top|previous|next|read more|click here|log ?in|sign ?(?:in|up)|"
    r"subscribe|share(?: this)?(?: on .{1,20})?|tweet|print|search|next page|page \d+ of \d+)\s*[>»|:.]*\s*$"
)
TRAIL = r"^(?:[^|»›>•·]{1,30}\s[|»›>•·]\s){2,}+[^|»›>•·]{0,30}$"  # possessive: no recursion on long trails
#: NAVIGATION matches no line of more words; a trail has one of these marks.
NAVIGATION_WORDS = 14
MARKS = r"[|»›>•·]"
#: Phrases of boilerplate; a line that holds one and has few words fails.
BOILERPLATE = (
    r"(?i)(?:all rights reserved|terms (?:of (?:use|service)|and conditions)|privacy policy|cookie policy|(?:uses?|accept) cookies|"
    r"enable javascript|javascript (?:is|must be)|lorem ipsum|powered by|copyright (?:©|\(c\)|\d{4})|©\s*\d{4})"
)
#: Ends of sentences, with closing quotes and brackets after them.
ENDING = r"[.!?:;…。！？][\"'”’»)\]]*\s*$"
SYMBOLS = "#*$%&|<>"


def words(text: F.Column) -> F.Column:
    return F.array_remove(F.split(text, SPACE), "")


def line_passes(
    line: F.Column, n_words: F.Column, max_bare_words: int = 6, max_boilerplate_words: int = 30, max_symbol_share: float = 0.3
) -> F.Column:
    """False for a line that breaks a rule: no sentence end and few words, navigation, boilerplate, or symbols.

    Counts come before patterns, so long lines of prose meet none but the one for marks between labels.
    """
    symbols = F.length(line) - F.length(F.translate(line, SYMBOLS, ""))
    bare = (n_words <= max_bare_words) & ~line.rlike(ENDING)
    navigation = ((n_words <= NAVIGATION_WORDS) & line.rlike(NAVIGATION)) | (line.rlike(MARKS) & line.rlike(TRAIL))
    boilerplate = (n_words <= max_boilerplate_words) & line.rlike(BOILERPLATE)
    noisy = symbols > n_words * max_symbol_share
    return (n_words > 0) & ~(noisy | bare | navigation | boilerplate)


def score(docs: DataFrame, text_col: str = "text", window: int = 8, min_kept_share: float = 0.5, min_words: int = 20) -> DataFrame:
    """docs with the quality columns: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long), base_failed,
    n_kept_words (long), kept, cleaned_text.

    Lines that break a rule of line_passes() are left out of cleaned_text, the others stay as they are. kept is false
    if base_failed (under min_words words, or over 30 % of the words in repeated windows), else whether at least
    min_kept_share of the words are in passing lines. A null or empty text has no words and fails; very long texts are
    read whole; repeated rows give equal results; columns of docs with these names are replaced, all others stay,
    whatever their names; empty tables give empty results.
    """
    p = Positional(docs, ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_kept_words", "kept", "cleaned_text"])
    long = lambda c: c.cast("long")
    d = p.df.withColumn("_t", F.coalesce(p.col(text_col), F.lit("")))
    split = F.transform(F.split("_t", "\n"), lambda x: F.struct(x.alias("line"), words(x).alias("words")))
    d = d.withColumn("_rows", split).withColumn("_words", F.flatten(F.transform("_rows", lambda r: r["words"])))
    n = F.size("_words")
    d = d.withColumns(
        {
            "n_words": long(n),
            "word_chars": long(F.length(F.translate("_t", " \t\n\x0b\x0c\r", ""))),
            "n_symbols": long(F.length("_t") - F.length(F.translate("_t", SYMBOLS, ""))),
            "_full": F.transform(F.filter("_rows", lambda r: F.size(r["words"]) > 0), lambda r: r["line"]),
            "_good": F.filter("_rows", lambda r: line_passes(r["line"], F.size(r["words"]))),
            "_hash": F.transform("_words", lambda w: F.xxhash64(w)),
        }
    )
    d = d.withColumn(
        "_windows",
        F.when(
            F.size("_hash") >= window,  # several references to _hash: the optimizer doesn't inline it into the lambda
            F.transform(F.sequence(F.lit(1), F.greatest(F.size("_hash") - (window - 1), F.lit(1))), lambda i: F.xxhash64(F.slice("_hash", i, window))),
        ).otherwise(F.array().cast("array<bigint>")),
    )
    repeats = F.size("_windows") > F.size(F.array_distinct("_windows"))
    pairs = F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    d = d.withColumn("_pairs", F.when(repeats, pairs))
    last = F.size("_pairs")
    twice = F.filter(
        F.transform(
            "_pairs",
            lambda x, i: F.when(
                ((i > 0) & (F.get("_pairs", i - 1)["h"] == x["h"])) | ((i < last - 1) & (F.get("_pairs", i + 1)["h"] == x["h"])), x["i"]
            ),
        ),
        lambda i: i.isNotNull(),
    )
    d = d.withColumn("_starts", F.when(F.col("_pairs").isNotNull(), F.array_sort(twice)))
    covered = F.aggregate(
        "_starts",
        F.struct(F.lit(0).alias("n"), F.lit(-(window + 1)).alias("at")),
        lambda s, x: F.struct((s["n"] + F.least(F.lit(window), x - s["at"])).alias("n"), x.alias("at")),
        lambda s: s["n"],
    )
    d = d.withColumns(
        {
            "n_dup_lines": long(F.size("_full") - F.size(F.array_distinct("_full"))),
            "n_repeat_words": long(F.coalesce(covered, F.lit(0))),
            "n_kept_words": long(F.aggregate("_good", F.lit(0), lambda n, r: n + F.size(r["words"]))),
            "cleaned_text": F.array_join(F.transform("_good", lambda r: r["line"]), "\n"),
        }
    )
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    d = d.withColumn("base_failed", failed)
    kept = ~F.col("base_failed") & (F.col("n_kept_words") >= F.col("n_words") * min_kept_share)
    return p.restore(d.withColumn("kept", kept))


def quality_filter(docs: DataFrame, text_col: str = "text", **rules) -> DataFrame:
    """The kept rows of docs, their text without failing lines; n_chars, if there is one, counts the new text.

    Null and empty texts are rejected, rows that repeat are kept or rejected alike, very long texts are read whole, an
    empty table gives an empty result; docs' other columns stay as they are, whatever their names.
    """
    p = Positional(docs)
    scored = score(p.df, p.name(text_col), **rules)
    # a filter is pushed below projections with its columns' whole expressions in place of their names, nested here
    # many times over; a column that isn't deterministic holds it where it stands
    d = scored.withColumn("_row", F.monotonically_increasing_id()).where(F.col("kept") & (F.col("_row") >= 0))
    d = d.withColumn(p.name(text_col), F.col("cleaned_text"))
    if "n_chars" in docs.columns:
        d = d.withColumn(p.name("n_chars"), F.length("cleaned_text").cast(docs.schema["n_chars"].dataType))
    return p.restore(d)


def op1_quality_lines(spark, sf_dir: str) -> DataFrame:
    """The figures and the verdict of every document."""
    d = score(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return d.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_kept_words")


_W = r"[^\x20\x09-\x0D]+"
_LINE_SQL = f"""
  (nw > 0 AND NOT (
    (NOT regexp_matches(line, '{ENDING.replace("'", "''")}') AND nw <= 6)
    OR regexp_matches(line, '{NAVIGATION}') OR regexp_matches(line, '{TRAIL.replace('}+', '}')}')
    OR (regexp_matches(line, '{BOILERPLATE}') AND nw <= 30)
    OR (length(line) - length(regexp_replace(line, '[#*$%&|<>]', '', 'g')) > nw * 0.3::DOUBLE)))
"""
OP1_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, regexp_extract_all(t, '{_W}') AS ws FROM d),
win AS (SELECT r, p, array_to_string(ws[p:p + 7], ' ') AS s FROM (SELECT r, ws, unnest(range(1, len(ws) - 6)) AS p FROM w WHERE len(ws) >= 8)),
twice AS (SELECT r, p, count(*) OVER (PARTITION BY r, s) AS n FROM win),
covered AS (SELECT r, count(DISTINCT p + o) AS n FROM twice, range(0, 8) AS o(o) WHERE n > 1 GROUP BY r),
lines AS (SELECT r, line, len(regexp_extract_all(line, '{_W}')) AS nw FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d)),
per AS (SELECT r, count(*) FILTER (WHERE nw > 0) - count(DISTINCT line) FILTER (WHERE nw > 0) AS dup,
  coalesce(sum(nw) FILTER (WHERE {_LINE_SQL}), 0) AS kept_words FROM lines GROUP BY r),
f AS (
  SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '[\\x20\\x09-\\x0D]+', '', 'g'))::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, per.dup::BIGINT AS n_dup_lines,
    coalesce(covered.n, 0)::BIGINT AS n_repeat_words, per.kept_words::BIGINT AS n_kept_words
  FROM w JOIN per USING (r) LEFT JOIN covered USING (r))
SELECT *, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND n_kept_words >= n_words * 0.5::DOUBLE AS kept
FROM f
"""
