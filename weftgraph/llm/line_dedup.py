"""Exact line dedup that returns keep bitmaps (DataFrame operations only).

Every long line becomes a row (hash, document, position), without its text. Rows are range-partitioned by hash and
document, so that a line found in a third of all documents still spreads over many ranges, and sorted by
hash, then document downwards, then position. One streaming pass per range keeps a hash's first document and drops the
others. A hash that runs on into other ranges gets its totals from a table of the ranges' first
and last hashes: two rows a range, the only thing that is broadcast.

A line is known by 96 bits of hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, ascii_lower, cut, partitions, unused

STRIP = " \t\n\x0b\x0c\r"


def lines(text: Column | str) -> Column:
    return F.split(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(STRIP)))


def text_id(text: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def repeated_lines(docs: DataFrame, least_chars: int = 20, least_docs: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_id, dropped): the positions (from 0, sorted) that each document loses."""
    n = partitions(docs.sparkSession)
    keys = F.transform(lines(text_col), lambda x, i: F.struct(i.alias("pos"), line_key(x).alias("key")))
    hashed = F.transform(F.filter(keys, lambda x: F.length(x["key"]) >= least_chars), lambda x: F.struct(x["pos"].alias("pos"), F.xxhash64(x["key"]).alias("h"), F.hash(x["key"]).alias("g")))
    rows = docs.select(F.col(id_col).alias("doc_id"), text_id(text_col).alias("text_id"), F.explode(hashed).alias("x")).select("doc_id", "text_id", "x.*")
    # Ranges are drawn from a first pass over their input: written once, so that texts are split and hashed once.
    order = [F.col("h"), F.col("g"), F.col("doc_id").desc(), F.col("pos")]
    with Scratch(docs.sparkSession, "lines") as scratch:
        ranges = cut(scratch.keep(rows).repartitionByRange(n, *order).withColumn("pid", F.spark_partition_id()))
    here = Window.partitionBy("pid", "h", "g")
    swept = ranges.withColumn("rank", F.dense_rank().over(here.orderBy(F.col("doc_id").desc())))
    swept = swept.withColumn("n_docs", F.max("rank").over(here))
    # Hashes at the ends of ranges may go on in others: their documents over all ranges.
    ends = ranges.groupBy("pid").agg(F.min(F.struct("h", "g")).alias("lo"), F.max(F.struct("h", "g")).alias("hi"))
    edge = ends.select(F.explode(F.array("lo", "hi")).alias("e")).select("e.*").distinct()
    # Two rows a range, and ``n`` ranges: what is broadcast here grows with the number of partitions, not with the input.
    docs_of = ranges.join(F.broadcast(edge), ["h", "g"]).select("h", "g", "doc_id").distinct()
    totals = cut(docs_of.groupBy("h", "g").agg(F.count(F.lit(1)).alias("total"), F.max("doc_id").alias("last")))
    judged = swept.join(F.broadcast(totals), ["h", "g"], "left").where(
        F.when(F.col("total").isNull(), (F.col("n_docs") >= least_docs) & (F.col("rank") > 1)).otherwise((F.col("total") >= least_docs) & ~F.col("doc_id").eqNullSafe(F.col("last")))
    )
    return judged.groupBy("doc_id", "text_id").agg(F.array_sort(F.collect_set("pos")).alias("dropped"))


def keep_bitmap(n_lines: Column, dropped: Column) -> Column:
    """Run lengths of lines kept and dropped, in turn, beginning with kept: ``3,1,5`` keeps three lines, drops
    one and keeps five."""
    start = F.struct(F.lit(0).alias("next"), F.lit(0).alias("runs_end"), F.lit("").alias("out"), F.lit(-1).alias("begin"))

    def step(acc: Column, pos: Column) -> Column:
        goes_on = (acc["begin"] >= 0) & (pos == acc["next"])
        closed = F.when(acc["begin"] >= 0, F.concat(acc["out"], (acc["begin"] - acc["runs_end"]).cast("string"), F.lit(","), (acc["next"] - acc["begin"]).cast("string"), F.lit(","))).otherwise(acc["out"])
        ended = F.when(acc["begin"] >= 0, acc["next"]).otherwise(acc["runs_end"])
        return F.struct((pos + 1).alias("next"), F.when(goes_on, acc["runs_end"]).otherwise(ended).alias("runs_end"), F.when(goes_on, acc["out"]).otherwise(closed).alias("out"), F.when(goes_on, acc["begin"]).otherwise(pos).alias("begin"))

    def finish(acc: Column) -> Column:
        closed = F.when(acc["begin"] >= 0, F.concat(acc["out"], (acc["begin"] - acc["runs_end"]).cast("string"), F.lit(","), (acc["next"] - acc["begin"]).cast("string"), F.lit(","))).otherwise(acc["out"])
        return F.concat(closed, (n_lines - F.when(acc["begin"] >= 0, acc["next"]).otherwise(F.lit(0))).cast("string"))

    return F.aggregate(dropped, start, step, finish)


def apply_bitmap(text_lines: Column, bitmap: Column) -> Column:
    """The lines that a keep bitmap keeps."""
    runs = F.transform(F.split(bitmap, ","), lambda x: x.cast("int"))
    start = F.struct(F.lit(1).alias("at"), F.lit(True).alias("keep"), F.array().cast("array<array<string>>").alias("out"))

    def step(acc: Column, n: Column) -> Column:
        return F.struct((acc["at"] + n).alias("at"), (~acc["keep"]).alias("keep"), F.when(acc["keep"] & (n > 0), F.concat(acc["out"], F.array(F.slice(text_lines, acc["at"], n)))).otherwise(acc["out"]).alias("out"))

    return F.aggregate(runs, start, step, lambda acc: F.flatten(acc["out"]))


def keep_bitmaps(docs: DataFrame, least_chars: int = 20, least_docs: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, text_id, n_lines, n_dropped, keep.

    Keys (lines with ``[\\x20\\x09-\\x0D]`` stripped at both ends, A-Z lower-cased) of at least ``least_chars`` code points
    found in at least ``least_docs`` documents lose all their lines but those in the largest doc_id. A null or empty
    text is one empty line. A null id is smaller than any other; rows that share an id count as one document, and
    each loses its own lines; rows repeated in full come back as often as they came.
    """
    slim = docs.select(F.col(id_col).alias("doc_id"), text_id(text_col).alias("text_id"), F.size(lines(text_col)).alias("n_lines"))
    lost = repeated_lines(docs, least_chars, least_docs, id_col, text_col)
    same = slim["doc_id"].eqNullSafe(lost["doc_id"]) & (slim["text_id"] == lost["text_id"])
    gone = F.coalesce(lost["dropped"], F.array().cast("array<int>"))
    return slim.join(lost, same, "left").select(
        slim["doc_id"], slim["text_id"], F.col("n_lines").cast("bigint").alias("n_lines"), F.size(gone).cast("bigint").alias("n_dropped"), keep_bitmap(F.col("n_lines"), gone).alias("keep")
    )


def dedup_lines(docs: DataFrame, least_chars: int = 20, least_docs: int = 3, id_col: str = "doc_id", text_col: str = "text", out_col: str = "_kept") -> DataFrame:
    """``docs`` with the kept text in ``out_col`` and the counts ``_n_lines`` and ``_n_dropped`` (columns of these names are
    replaced); all rows and other columns stay.

    A document's bitmap meets its text in one join by document; the texts are shuffled once."""
    key, tid, gone_col, keep = (unused(docs, x) for x in ("_key", "_tid", "_gone", "_keep"))
    lost = repeated_lines(docs, least_chars, least_docs, id_col, text_col).select(F.col("doc_id").alias(key), F.col("text_id").alias(tid), F.col("dropped").alias(gone_col))
    same = F.col(id_col).eqNullSafe(F.col(key)) & (text_id(text_col) == F.col(tid))
    gone = F.coalesce(gone_col, F.array().cast("array<int>"))
    kept = F.when(F.size(gone) == 0, F.coalesce(F.col(text_col), F.lit(""))).otherwise(F.array_join(apply_bitmap(lines(text_col), F.col(keep)), "\n"))
    n = F.size(lines(text_col))
    joined = docs.join(lost, same, "left").withColumn(keep, keep_bitmap(n, gone))
    return joined.withColumn(out_col, kept).withColumn("_n_lines", n.cast("bigint")).withColumn("_n_dropped", F.size(gone).cast("bigint")).drop(key, tid, gone_col, keep)
