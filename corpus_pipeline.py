"""A corpus pipeline over ``documents``: five stages, each written as Parquet and read again as the next one's input.

Language ID drops documents without a letter or without a clear language; line dedup drops lines that repeat across
documents; near-dedup keeps one document of each group; decontamination drops contaminated documents; mixing
gives the copies that each document has in the mix. All but the last return the columns of ``documents``, with n_chars kept
true to the text.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm import decontam, language, line_dedup, mixing, neardup
from weftgraph.llm.common import cut, remove, shared_dir, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A document goes if its language's score is lower: no word, or hardly any, tells a language. Of 2,499 held-out rows none is lower.
LEAST_SCORE = 0.02
#: Near duplicates in the pipeline: shingles of five words, similarity of 0.8 or more.
SHINGLE, PERCENT = 5, 80


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a letter and a clear language. The model learns from all labelled input rows."""
    rows = docs.select(*COLUMNS)
    named = language.identify(rows, language.train(rows), spans=False)
    return named.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).select(*COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, less the lines that repeat across documents; a document whose lines all go has an empty text."""
    kept = line_dedup.dedup_lines(docs.select(*COLUMNS))
    changed = F.col("_n_dropped") > 0
    return kept.select(
        "doc_id",
        F.when(changed, F.col("_kept")).otherwise(F.col("text")).alias("text"),
        "lang",
        "source",
        F.when(changed, F.length("_kept").cast("bigint")).otherwise(F.col("n_chars")).alias("n_chars"),
    )


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group, with the smallest id; documents without words stay. Rows are told apart by id and text, not by id alone."""
    rows = docs.select(*COLUMNS)
    judged = neardup.judged(rows, PERCENT, SHINGLE).where("n_shingles > 0")
    key = [F.col("doc_id").alias("_id"), F.col("mark").alias("_mark")]
    fate = cut(judged.groupBy(*key).agg(F.bool_or(~F.col("chosen")).alias("_gone"), F.count(F.lit(1)).alias("_times")).where("_gone or _times > 1"))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_mark"))
    left = rows.join(fate, same, "left_anti")
    repeated = fate.where("not _gone")
    if not repeated.isEmpty():
        left = left.unionByName(rows.join(repeated, same).dropDuplicates(["_id", "_mark"]).select(*COLUMNS))
    return left.select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth of the words is in windows of the benchmark."""
    return decontam.decontaminate(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each document that is left."""
    return mixing.mix_sources(docs)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix),
]

#: SQL can't express the language model nor the rounding; tests hold the stages against plain Python versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. Each stage is written to the shared folder, and removed once the next one is."""
    docs, done = table(spark, sf_dir, "documents"), None
    base = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        path = f"{base}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        if done:
            remove(spark, done)
        docs, done = spark.read.parquet(path), path
    return docs
