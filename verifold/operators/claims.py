"""Identity and merging of claims, digests of sets, and scores against labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Domain tags of the digests; another tag gives other ids.
CLAIM_TAG, PAPER_TAG = "verifold.claim.v1", "verifold.paper.v1"


def encoded(field: Column) -> Column:
    """A field of a preimage: byte 0 and a colon if null, else byte 1, a colon, the length in bytes, a colon and the UTF-8."""
    raw = F.encode(field, "UTF-8")
    some = F.concat(F.lit(b"\x01:"), F.encode(F.octet_length(raw).cast("string"), "UTF-8"), F.lit(b":"), raw)
    return F.when(field.isNull(), F.lit(b"\x00:")).otherwise(some)


def claim_id(text: Column, metric: Column, units: Column, tag: str = CLAIM_TAG) -> Column:
    """SHA-256 over the tag and the encoded text, metric and units: the verbatim text, never the number, is the identity."""
    return F.sha2(F.concat(F.lit(tag.encode()), encoded(text), encoded(metric), encoded(units)), 256)


def paper_hash(text: Column, tag: str = PAPER_TAG) -> Column:
    return F.sha2(F.concat(F.lit(tag.encode()), F.encode(text, "UTF-8")), 256)


def merge_mentions(claims: DataFrame, keys: list[str] = ("doc_id", "text", "metric", "units"), hint: str = "hint") -> DataFrame:
    """One row per identity in its paper (nulls are equal): its mentions' distinct locations and hints, sorted, nulls left
    out. Locations are places of one paper, so a phrase that many papers share is a row of each."""
    return claims.groupBy(*keys).agg(
        F.count("*").alias("mentions"),
        F.array_sort(F.collect_set(F.struct("start", "end"))).alias("locations"),
        F.array_sort(F.collect_set(hint)).alias("hints"),
    )


def incoherent(claims: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Identities whose mentions were read as different values."""
    return claims.groupBy(*keys).agg(F.count_distinct(value).alias("readings")).where("readings > 1")


def objects_tree_hash(objects: DataFrame, keys: list[str], sha: str = "sha256") -> DataFrame:
    """Per key the digest of the canonical JSON list of its distinct object digests, sorted."""
    listed = F.concat(F.lit('["'), F.concat_ws('","', F.array_sort(F.collect_set(sha))), F.lit('"]\n'))
    return objects.groupBy(*keys).agg(F.count_distinct(sha).alias("objects"), F.sha2(listed.cast("binary"), 256).alias("objects_tree_hash"))


def score(labelled: DataFrame, truth: str, predicted: str) -> DataFrame:
    """One row: tp, fp, fn, tn, and precision and recall, null where undefined."""
    t, p = F.col(truth), F.col(predicted)
    d = labelled.agg(F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"), F.count_if(~t & ~p).alias("tn"))
    rate = lambda of: F.when(of > 0, F.col("tp").cast("double") / of)
    return d.withColumns({"precision": rate(F.col("tp") + F.col("fp")), "recall": rate(F.col("tp") + F.col("fn"))})


def label_errors(labels: DataFrame, found: DataFrame, key: str, same: list[str]) -> DataFrame:
    """Labels against the rows they were made from: key, error (unknown, missing, duplicate, edited, bad_label)."""
    a = labels.groupBy(key).agg(F.count("*").alias("_n"), F.first(F.struct(*same)).alias("_given"), F.first("label").alias("label"))
    b = found.select(key, F.struct(*same).alias("_real"))
    error = (
        F.when(F.col("_real").isNull(), "unknown").when(F.col("_n").isNull(), "missing").when(F.col("_n") > 1, "duplicate")
        .when(~F.col("_given").eqNullSafe(F.col("_real")), "edited").when(~F.coalesce(F.col("label").isin("claim", "not-claim"), F.lit(False)), "bad_label")
    )
    return a.join(b, key, "full_outer").select(key, error.alias("error")).where("error IS NOT NULL")
