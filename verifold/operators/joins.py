"""Ordered and interval joins on equal keys, islands, and full-outer comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof_backward(left: DataFrame, right: DataFrame, keys: list[str], left_at: str, right_at: str, take: list[str]) -> DataFrame:
    """left with the columns take of the latest right row of its keys at or before it; nulls if there is none.

    Both sides are united and read once in order: one shuffle by keys, no pairs. Of right rows at one place the
    greatest, by the taken columns, counts.
    """
    row = F.struct(*[F.col(c) for c in left.columns])
    taken = F.struct(*[F.col(c) for c in take])
    kinds = (left.select(row.alias("r")).schema["r"].dataType, right.select(taken.alias("t")).schema["t"].dataType)
    a = left.select(*keys, F.col(left_at).alias("_at"), F.lit(1).alias("_side"), row.alias("_row"), F.lit(None).cast(kinds[1]).alias("_take"))
    b = right.select(*keys, F.col(right_at).alias("_at"), F.lit(0).alias("_side"), F.lit(None).cast(kinds[0]).alias("_row"), taken.alias("_take"))
    w = Window.partitionBy(*keys).orderBy("_at", "_side", "_take").rowsBetween(Window.unboundedPreceding, 0)
    d = a.unionByName(b).withColumn("_last", F.last("_take", ignorenulls=True).over(w)).where("_side = 1")
    return d.select("_row.*", *[F.col(f"_last.{c}").alias(c) for c in take])


def contained_in(points: DataFrame, intervals: DataFrame, keys: list[str], at: str, low: str, high: str, width: int = 256) -> DataFrame:
    """points left outer intervals with low <= at < high on equal keys.

    Intervals are dealt to the bins of width positions that they touch, so a point meets those of its bin alone.
    """
    binned = intervals.withColumn("_bin", F.explode(F.sequence((F.col(low) / width).cast("long"), (F.greatest(F.col(high) - 1, F.col(low)) / width).cast("long"))))
    p = points.withColumn("_bin", (F.col(at) / width).cast("long"))
    q = binned.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("_bin").alias("_b"), *[c for c in intervals.columns if c not in keys])
    same = [p[k] == q[f"_{k}"] for k in keys] + [p["_bin"] == q["_b"], p[at] >= q[low], p[at] < q[high]]
    return p.join(q, same, "left").drop("_bin", "_b", *[f"_{k}" for k in keys])


def islands(rows: DataFrame, keys: list[str], order: list[str], member: str) -> DataFrame:
    """Maximal runs of rows whose member column is true, in order within keys: adds island, a running number per key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    starts = F.col(member) & ~F.coalesce(F.lag(member).over(w), F.lit(False))
    return rows.withColumn("island", F.sum(starts.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))).where(F.col(member))


def first_wins(rows: DataFrame, key: str, order: list[str], accepted: str) -> DataFrame:
    """Of each key the first accepted row."""
    w = Window.partitionBy(key).orderBy(*order)
    return rows.where(F.col(accepted)).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def compare_members(listed: DataFrame, found: DataFrame, key: str, digest: str) -> DataFrame:
    """A row per member that is missing, unlisted or tampered with: key, cause."""
    a = listed.select(F.col(key), F.col(digest).alias("_listed"), F.lit(True).alias("_a"))
    b = found.select(F.col(key), F.col(digest).alias("_found"), F.lit(True).alias("_b"))
    cause = (
        F.when(F.col("_b").isNull(), "MEMBER_MISSING").when(F.col("_a").isNull(), "MEMBER_UNLISTED").when(~F.col("_listed").eqNullSafe(F.col("_found")), "MEMBER_TAMPERED")
    )
    return a.join(b, key, "full_outer").select(key, cause.alias("cause")).where("cause IS NOT NULL")
