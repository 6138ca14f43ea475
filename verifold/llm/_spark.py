"""Session helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side joined by broadcast has at most this many rows, counted before the join is planned.
BROADCAST_ROWS = 10_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where that is unset, a folder of our own if the
    executors run in this process; on a cluster that is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="verifold-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Write df once to the shared folder and read it back: later stages restart from the files, not from its lineage."""
    path = f"{shared_dir(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def with_small(df: DataFrame, small: DataFrame, on, how: str = "inner") -> DataFrame:
    """Join with a written table; broadcast only if it is counted at BROADCAST_ROWS or fewer."""
    fits = small.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return df.join(F.broadcast(small) if fits else small, on, how)


def lean(f: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """f for mapInArrow, whose process gives back what memory it has freed after each batch that f makes and at its end:
    workers stay for later tasks, and would keep the most that any task took beside what the executor's JVM needs then."""

    def run(batches: Iterator) -> Iterator:
        try:
            for made in f(batches):
                yield made
                give_back()
        finally:
            give_back()

    return run


def give_back() -> None:
    """Freed memory of this process goes back to the system, where its allocators can tell."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # a C library without it
        ctypes.CDLL(None).malloc_trim(0)


class Positional:
    """A table whose columns are called x0, x1, ... in place of their own names, so that no name clashes with an inner
    one; restore() gives the names back and adds the columns that an operator makes, in place of any called alike."""

    def __init__(self, df: DataFrame, made: list[str] | None = None):
        self.names, self.made = df.columns, made or []
        self.df = df.toDF(*[f"x{i}" for i in range(len(self.names))])

    def name(self, of: str) -> str:
        """The inner name of a column."""
        found = [i for i, n in enumerate(self.names) if n == of] or [i for i, n in enumerate(self.names) if n.lower() == of.lower()]
        if len(found) != 1:
            raise ValueError(f"{len(found)} columns are named {of}")
        return f"x{found[0]}"

    def col(self, of: str) -> F.Column:
        return F.col(self.name(of))

    def restore(self, df: DataFrame) -> DataFrame:
        made = {m.lower() for m in self.made}
        kept = [i for i, n in enumerate(self.names) if n.lower() not in made]
        return df.select(*[f"x{i}" for i in kept], *self.made).toDF(*[self.names[i] for i in kept], *self.made)
