"""Small helpers that the training-data operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import Scratch, cut, remove, shared_dir

__all__ = ["Scratch", "ascii_lower", "cut", "partitions", "remove", "shared_dir", "small", "table", "uniform", "unused"]

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small(df: DataFrame, rows: int, most: int) -> DataFrame:
    """``df`` marked for broadcast if its counted ``rows`` are at most ``most``."""
    return F.broadcast(df) if rows <= most else df


def ascii_lower(col: Column | str) -> Column:
    return F.translate(col, UPPER, LOWER)


def uniform(*cols: Column) -> Column:
    """A number in (0, 1) fixed by the values of ``cols``."""
    return (F.shiftrightunsigned(F.xxhash64(*cols), 11).cast("double") + F.lit(0.5)) / F.lit(float(2**53))


def unused(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
