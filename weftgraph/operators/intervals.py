"""Interval joins: a prefix is the range of the keys that begin with it."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Range bounds are cut to so many characters; nothing but the ranges' sizes depends on it.
BOUND = 64
LAST = "\U0010ffff"


def prefix_join(prefixes: DataFrame, rows: DataFrame, tasks: int | None = None) -> DataFrame:
    """(prefix, value) for each row of ``rows`` (key, value; strings) and each distinct prefix of ``prefixes`` (prefix) that its key begins with.

    Keys are dealt out by ranges of them; a prefix goes to the ranges that its own range meets, one for most. Each range is sorted, prefixes before the keys
    that begin with them, and swept once with the stack of the prefixes that the sweep is inside of. So rows are shuffled once each, however
    long keys and prefixes are, and no key is compared with prefixes that it doesn't have. The empty prefix is every key's; null keys and prefixes
    match nothing. The bounds (one for each range) go through the driver."""
    spark = rows.sparkSession
    tasks = tasks or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    keyed = rows.where("key is not null").select(F.col("key").cast("string"), F.col("value").cast("string"))
    ranged = keyed.select("key").repartitionByRange(tasks, "key").groupBy(F.spark_partition_id().alias("p")).agg(F.min("key").alias("low"))
    bounds = sorted({r["low"] for r in ranged.select(F.substring("low", 1, BOUND).alias("low")).collect()})[1:]
    kinds = "task int, key string, is_key boolean, value string"

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("key").to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array([bisect_right(bounds, k) for k in keys], pa.int32()), batch.column("key"), pa.array([True] * len(keys)), batch.column("value")], ["task", "key", "is_key", "value"])

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            met = [(i, p) for p in batch.column("prefix").to_pylist() for i in range(bisect_right(bounds, p), bisect_right(bounds, p + LAST * 2) + 1)]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in met], pa.int32()), pa.array([p for _, p in met], pa.string()), pa.array([False] * len(met), pa.bool_()), pa.nulls(len(met), pa.string())], ["task", "key", "is_key", "value"])

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inside: list[str] = []
        for batch in batches:
            found, values = [], []
            for key, is_key, value in zip(batch.column("key").to_pylist(), batch.column("is_key").to_pylist(), batch.column("value").to_pylist(), strict=True):
                while inside and not key.startswith(inside[-1]):
                    inside.pop()
                if not is_key:
                    inside.append(key)
                else:
                    found += inside
                    values += [value] * len(inside)
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array(values, pa.string())], ["prefix", "value"])

    wanted = prefixes.where("prefix is not null").select(F.col("prefix").cast("string")).distinct()
    met = keyed.mapInArrow(deal, kinds).unionByName(wanted.mapInArrow(spread, kinds))
    return met.repartitionById(len(bounds) + 1, "task").sortWithinPartitions("key", "is_key").mapInArrow(sweep, "prefix string, value string")
