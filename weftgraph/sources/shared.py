"""Tables that a run writes for itself in the folder that driver and executors share, and helpers that need them."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Checkpoint folders of applications of this process, each to be removed once when it ends.
_OWN: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. In local mode (tests on one machine), a
    temporary folder takes its place where the session names none; on a cluster that is an error."""
    sc = spark.sparkContext
    set_dir = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not set_dir:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-checkpoint-"))
        set_dir = sc.getCheckpointDir()
    elif sc.getCheckpointDir() is None:
        sc.setCheckpointDir(set_dir)
    own = sc.getCheckpointDir()  # a folder of this application's own under the shared one
    if own not in _OWN:
        _OWN.add(own)
        _remove_at_exit(spark, own)
    return set_dir


def _remove_at_exit(spark: SparkSession, path: str) -> None:
    """Results are read lazily, so what holds them can go only when the program does."""

    def go() -> None:
        # A JVM that is gone already can't be asked; its cluster's own clean-up of the shared folder is all that is left then.
        with contextlib.suppress(Exception):
            remove(spark, path)

    atexit.register(go)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from there: the lineage ends, later uses don't compute it
    again, and a lost executor costs no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Rows of a part where rows are dealt out by their number. As texts in a hash map they take some 100 MB of a task's memory.
PART = 500_000


def dealt_by_count(df: DataFrame, rows: int, *by: str) -> DataFrame:
    """``df`` dealt out by the hash of ``by`` into parts of about ``PART`` of its ``rows`` each, but one per core at least. Spark keeps to the number of
    parts; of an exchange of its own it puts partitions together by their compressed size, so a task's share would grow with the input."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // PART)), *by)


class Scratch:
    """Written tables of one run, in a folder of their own under the shared one; ``drop`` removes them all. Used as a context, it drops them
    at the end of its block, also when the run fails."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path, self.n = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", 0
        self.kept: list[tuple[DataFrame, str]] = []

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *failure: object) -> None:
        self.drop()

    def keep(self, df: DataFrame) -> DataFrame:
        """``df`` written as Parquet and read back: as ``cut``, but columnar and removable."""
        self.n += 1
        path = f"{self.path}/{self.n}"
        df.write.parquet(path)
        self.kept.append((self.spark.read.schema(df.schema).parquet(path), path))
        return self.kept[-1][0]

    def forget(self, *kept: DataFrame) -> None:
        """Remove kept tables that nothing reads any more, before the run ends."""
        for df, path in self.kept:
            if any(df is k for k in kept):
                remove(self.spark, path)
        self.kept = [(df, path) for df, path in self.kept if not any(df is k for k in kept)]

    def result(self, df: DataFrame, name: str = "result") -> DataFrame:
        """``df`` written beside the run's folder, where it stays until the session's program ends."""
        path = f"{self.path}-{name}"
        _remove_at_exit(self.spark, path)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        remove(self.spark, self.path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete ``path`` with all that is in it, on any file system that Spark knows."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is something at ``path``, on any file system that Spark knows."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def numbered(df: DataFrame, by: str, name: str, first: int = 1) -> DataFrame:
    """``df`` with ``name``: consecutive numbers in the order of ``by``, whose values differ.

    Rows are dealt to ranges and written, each range is counted and ranked by itself, and a range starts where the ones before end;
    only one row per range meets in one task."""
    dealt = cut(df.repartitionByRange(by).withColumn("_range", F.spark_partition_id()))
    counts = dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("_size"))
    before = F.coalesce(F.sum("_size").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("_range", before.alias("_before"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(by))
    # One row per range, of which there are spark.sql.shuffle.partitions.
    return dealt.join(F.broadcast(starts), "_range").withColumn(name, (F.col("_before") + place + (first - 1)).cast("bigint")).drop("_range", "_before")
