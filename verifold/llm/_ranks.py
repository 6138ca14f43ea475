"""Ranks within classes of any size, without a class in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._spark import cut, with_small

#: Rows that a window ranks in one piece, about, if one class holds them all.
PIECE_ROWS = 20_000


def ranked(df: DataFrame, keys: list[str], salt: F.Column, order: list[str], name: str, n: int) -> DataFrame:
    """df (a written table of n rows, its salt in it) with a rank from 0 within keys (null is a key): by piece of the salt,
    then by order. Ranks come within salted pieces, to which the counts of earlier pieces are added."""
    pieces = max(16, n // PIECE_ROWS)
    df = df.withColumn("_piece", F.pmod(salt, F.lit(pieces)))
    counts = df.groupBy(*[F.col(k).alias(f"_of_{k}") for k in keys], F.col("_piece").alias("_of_piece")).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*[f"_of_{k}" for k in keys]).orderBy("_of_piece").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    within = F.row_number().over(Window.partitionBy(*keys, "_piece").orderBy(*order))
    same = F.col("_piece") == F.col("_of_piece")
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"_of_{k}"))
    ranked_rows = df.withColumn("_in", within).join(counts, same)
    rank = (F.col("_before") + F.col("_in") - 1).cast("long")
    return ranked_rows.withColumn(name, rank).drop("_piece", "_of_piece", "_before", "_in", *[f"_of_{k}" for k in keys])


def with_ties(df: DataFrame, id_col: str) -> DataFrame:
    """df with tie: 0 for a row whose id no other row has, else the row's number from 0 among those of its id (null is
    an id), by the digest of all columns, so that only rows that repeat can change places.

    Ids are counted first, pre-aggregated; usually none repeats, and that is all. Else the rows that share an id are
    written with their numbers, which come from salted pieces: however many rows share an id, none meet in one task.
    """
    of = F.col(id_col)
    counted = df.groupBy(of.alias("_id")).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1 or _id is null")
    shared = cut(counted)
    if shared.isEmpty():
        return df.withColumn("tie", F.lit(0).cast("long"))
    same = of.eqNullSafe(F.col("_id"))
    alone = with_small(df, shared, same, "left_anti").withColumn("tie", F.lit(0).cast("long"))
    digest = F.md5(F.to_json(F.struct(*df.columns)))
    rows = with_small(df, shared, same).drop("_id", "_n").withColumn("_digest", digest)
    rows = cut(rows.withColumn("_spread", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(64))))
    first = F.conv(F.substring("_digest", 1, 2), 16, 10).cast("long")
    placed = ranked(rows, [id_col], first * 64 + F.col("_spread"), ["_digest"], "tie", 16384 * PIECE_ROWS)
    return alone.unionByName(cut(placed.drop("_digest", "_spread")))
