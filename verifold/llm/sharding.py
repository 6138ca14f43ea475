"""Sharding by longest-processing-time scheduling: groups stay together, big ones first, to the least-loaded shard."""

from __future__ import annotations

import heapq

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._ranks import ranked
from ._spark import cut, with_small

#: Significant bits of the sizes that the schedule tells apart.
CLASS_BITS = 11


def schedule(classes: list[tuple[int, int, int]], n_shards: int) -> list[tuple[int, list[int], list[int]]]:
    """Longest-processing-time over size classes [(size, how many groups, name)].

    Gives (name, shards, cumulative counts) per class: the groups of a class, in rank order, fill those shards up to
    those counts. Equal to popping the least-loaded shard from a heap once per group (ties: lowest shard); a class
    of many equal groups is dealt in whole rounds while all shards take part, so its cost doesn't grow with its count.
    """
    heap = [(0, shard) for shard in range(n_shards)]
    out = []
    for size, count, name in sorted(classes, reverse=True):
        got: dict[int, int] = {}
        left = count
        if count > 4 * n_shards:
            # Popping equal sizes fills the lowest loads up to a common level. Start just below that level.
            loads = sorted(heap)
            low, high = 0, count
            base = loads[0][0]
            while low < high:  # largest level whose whole steps need no more than count groups
                mid = (low + high + 1) // 2
                if sum(max(0, (base + mid * size - load) // size) for load, _ in loads) <= count:
                    low = mid
                else:
                    high = mid - 1
            level = base + max(0, low - 1) * size
            heap = []
            for load, shard in loads:
                n = max(0, (level - load) // size)
                got[shard] = n
                left -= n
                heap.append((load + n * size, shard))
            heapq.heapify(heap)
        for _ in range(left):
            load, shard = heap[0]
            heapq.heapreplace(heap, (load + size, shard))
            got[shard] = got.get(shard, 0) + 1
        shards, ends, end = [], [], 0
        for shard in sorted(s for s in got if got[s]):
            end += got[shard]
            shards.append(shard)
            ends.append(end)
        out.append((name, shards, ends))
    return out


def lpt_shards(docs: DataFrame, n_shards: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Put every row into a shard: doc_id, size, text_crc32, group_rows, shard, slot.

    size is the UTF-8 bytes of the text plus 16. Rows of equal text form a group, which stays in one shard, however
    large; a null text counts as empty and shares the empty group. Repeated rows keep their count, null ids are
    rows like others, other columns don't matter whatever their names, and an empty table gives an empty result. What
    reaches the driver is the histogram of group sizes in classes of CLASS_BITS significant bits, under 100,000 for any
    corpus: sizes to 2,047 are exact, larger ones of a class differ by under 0.1 % and are dealt as their mean.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = cut(
        docs.select(
            F.col(id_col).alias("doc_id"),
            (F.octet_length(text) + F.lit(16)).cast("long").alias("size"),
            F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
            F.unhex(F.md5(F.encode(text, "UTF-8"))).alias("_group"),
        )
    )
    groups = base.groupBy("_group").agg(F.count("*").alias("group_rows"), F.max("size").alias("_one"))
    whole = F.col("group_rows") * F.col("_one")
    step = F.greatest(F.floor(F.log2(whole.cast("double"))).cast("int") - (CLASS_BITS - 1), F.lit(0))
    groups = cut(groups.select("_group", "group_rows", whole.alias("_bytes"), step.alias("_step")))
    groups = groups.withColumn("_class", F.call_function("shiftright", F.col("_bytes"), F.col("_step")) * 64 + F.col("_step"))
    classes = groups.groupBy("_class").agg(F.count("*").alias("n"), F.sum("_bytes").alias("bytes")).toArrow().to_pydict()
    mean = [max(1, round(b / n)) for b, n in zip(classes["bytes"], classes["n"], strict=True)]
    dealt = schedule([(size, n, c) for size, n, c in zip(mean, classes["n"], classes["_class"], strict=True)], n_shards)
    rows = [(c, shard, a, b) for c, shards, ends in dealt for shard, a, b in zip(shards, [0, *ends], ends, strict=False)]
    columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int32(), pa.int64(), pa.int64()))]
    plan = cut(docs.sparkSession.createDataFrame(pa.table(columns, names=["_class", "shard", "_from", "_to"])))
    in_class = ranked(groups, ["_class"], F.xxhash64("_group"), ["_group"], "_rank", sum(classes["n"]))
    here = (in_class["_class"] == plan["_class"]) & (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to"))
    placed = with_small(in_class, plan, here).select("_group", "group_rows", "shard")
    rows = cut(base.join(placed, "_group").drop("_group").withColumn("_salt", F.xxhash64(F.monotonically_increasing_id())))
    return ranked(rows, ["shard"], F.col("_salt"), ["doc_id", "text_crc32"], "slot", rows.count()).drop("_salt")


def op6_shard_lpt(spark, sf_dir: str) -> DataFrame:
    """Law `bytes`: doc_id, size, text_crc32, law, shard, slot, grown_shard (null), group_rows of all documents in 40 shards."""
    rows = lpt_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return rows.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "group_rows"
    )
