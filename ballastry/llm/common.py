"""Helpers that several training-data operators share."""

from __future__ import annotations

import ctypes
import tempfile
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, and where checkpoints go.

    It is the one named by ``spark.checkpoint.dir``. Only a local session without that setting
    (a test) gets a temporary folder; a cluster without it is an error.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir")
    if not named:
        named = sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="ballastry-")
        sc.setCheckpointDir(named)
    elif sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return named.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """df, written once to the shared folder, so that a lost executor costs no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def gathered(df: DataFrame, rows_a_task: int = 250_000) -> DataFrame:
    """df, checkpointed, in as many partitions as its rows need (8 at least): near-empty ones cost files in every later shuffle."""
    df = checkpointed(df)
    return df.coalesce(max(8, -(-df.count() // rows_a_task)))


def give_back() -> None:
    """Gives memory that has been freed back to the system, where Arrow and the C library can."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError, TypeError):  # another C library than glibc
        pass


def tidy(batches_to_batches: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function for mapInArrow or mapInPandas that gives back what it took once it ends: Python workers live on between tasks and stages."""

    def run(batches: Iterator) -> Iterator:
        yield from batches_to_batches(batches)
        give_back()

    return run


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else. Pure ASCII texts take the faster built-in."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, LOWER)
    )


def same_keys(left: DataFrame, right: DataFrame, keys: list[tuple[str, str]]) -> Column:
    """A null-safe equality over pairs of column names."""
    return reduce(lambda a, b: a & b, (left[x].eqNullSafe(right[y]) for x, y in keys))
