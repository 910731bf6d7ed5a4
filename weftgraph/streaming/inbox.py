"""The inbox as a stream: each new file once, chunked, extracted, stored and submitted.

Spark's file source keeps the set of processed files in its checkpoint. Entities are a keyed table, into which each micro-batch is merged once
(``sources.writers.merge_entities``): a document that comes again replaces its entities, and one that comes without any leaves a tombstone. What
else a batch tells is written under its own id, so a batch that runs again after a failure replaces what it wrote.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import derive_doc_id
from ..operators.graph import ENTITY
from ..operators.ingest import chunk_documents, extract_entities, locate_evidence, locate_page
from ..plans.pack import Pack
from ..sources.readers import SUFFIXES, file_name, stem
from ..sources.writers import merge_entities, read_entities


def inbox_stream(spark: SparkSession, path: str, per_batch: int = 1000, archive: str | None = None) -> DataFrame:
    """(doc_id, file, text, modified): files right under ``path``, those that are there first. Files should be moved in whole
    (an atomic rename). ``archive`` moves files there once they are processed."""
    reader = spark.readStream.format("text").option("wholetext", "true").option("recursiveFileLookup", "false").option("maxFilesPerTrigger", per_batch)
    if archive:
        reader = reader.option("cleanSource", "archive").option("sourceArchiveDir", archive)
    rows = reader.load(path).select(F.col("value").alias("text"), file_name().alias("file"), F.col("_metadata.file_modification_time").alias("modified"))
    rows = rows.where(F.lower(F.regexp_extract("file", r"(\.[^.]*)$", 1)).isin(*SUFFIXES))
    return rows.select(derive_doc_id(stem(F.col("file"))).alias("doc_id"), "file", "text", "modified")


def guarded(extractor: Callable[[pd.DataFrame], pd.DataFrame]) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """An extractor that gives a document that fails back as one row with the error, instead of failing the batch. A frame is taken whole; only one that fails
    is taken again document by document."""
    names = [x.split()[0] for x in ENTITY.replace("map<string, array<string>>", "map").split(", ")]

    def by_document(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = []
        for doc, part in pdf.groupby("doc_id", sort=False):
            try:
                parts.append(extractor(part).assign(error=None))
            except Exception as e:  # the document goes to quarantine, the batch goes on
                parts.append(pd.DataFrame([dict.fromkeys(names) | {"source_document": doc, "error": f"{type(e).__name__}: {e}"}], dtype=object))
        return pd.concat([p.astype(object) for p in parts]) if parts else pd.DataFrame(columns=[*names, "error"])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        try:
            rows = extractor(pdf.copy()).assign(error=None).astype(object)
        except Exception:
            rows = by_document(pdf)
        return rows.where(rows.notna(), None)[[*names, "error"]]

    return run


def form_feed_pages(docs: DataFrame) -> DataFrame:
    """(doc, page_no, page_text) of the documents that have pages: texts with form feeds between them, as PDF converters write. A text without
    a form feed has no pages."""
    paged = docs.where(F.contains("text", F.lit("\f")))
    rows = paged.select(F.col("doc_id").alias("doc"), F.posexplode(F.split("text", "\f", -1)).alias("page_no", "page_text"))
    return rows.withColumn("page_no", F.col("page_no") + 1)


def with_pages(entities: DataFrame, pages: DataFrame) -> DataFrame:
    """``entities`` with source_page where their source_text is found on a page of their document; others keep what they have."""
    key = F.xxhash64("source_document", "source_text")
    needles = entities.where("source_text <> ''").select(key.alias("needle_id"), F.col("source_document").alias("doc"), F.col("source_text").alias("snippet"))
    found = locate_page(needles.dropDuplicates(["needle_id"]), pages).where("page_no is not null")
    placed = entities.withColumn("_k", key).join(found.select(F.col("needle_id").alias("_k"), "page_no"), "_k", "left")
    return placed.withColumn("source_page", F.coalesce("page_no", "source_page")).select(*entities.columns)


def ingest_batch(docs: DataFrame, batch_id: int, out: str, extractor: Callable[[pd.DataFrame], pd.DataFrame], pack: Pack, style: str = "default") -> None:
    """One micro-batch into ``out``: entities, and under this batch's id submissions (documents with entities), quarantine (documents that failed, with
    the error), waiting (documents without entities), superseded (files whose document id another file of the batch has, which was modified
    later, or as late and has the greater name) and evidence (where the texts of entities with a page stand on it, by the search variants of
    ``style``). A document that fails keeps the entities of its last delivery. A batch that was taken whole is not taken again."""
    delivered = docs = docs.cache()  # each table of the batch reads it
    named = docs.select("doc_id", F.struct("modified", "file").alias("_f"))
    last = named.groupBy("doc_id").agg(F.max("_f").alias("_f"))
    mine = [docs["doc_id"] == F.col("_d"), F.struct("modified", "file").eqNullSafe(F.col("_f"))]
    superseded = docs.join(last.withColumnRenamed("doc_id", "_d"), mine, "left_anti").select("doc_id", "file", "modified")
    docs = docs.join(last.withColumnRenamed("doc_id", "_d"), mine, "left_semi")
    chunks = chunk_documents(docs, pack.window_chars)
    found = extract_entities(chunks, guarded(extractor), f"{ENTITY}, error string").cache()
    bad = found.where("error is not null").select(F.col("source_document").alias("doc_id"), "error").dropDuplicates(["doc_id"])
    good = found.where("error is null").drop("error").join(bad.select(F.col("doc_id").alias("source_document")), "source_document", "left_anti")
    pages = form_feed_pages(docs)
    good = with_pages(good, pages).cache()
    evidence = locate_evidence(good, pages, style)
    counts = good.groupBy(F.col("source_document").alias("doc_id")).agg(F.count(F.lit(1)).alias("n_entities"), F.array_sort(F.collect_set("file")).alias("files"))
    stamped = docs.select("doc_id", "file", "modified").dropDuplicates(["doc_id"])
    submitted = stamped.join(counts, "doc_id").select("doc_id", F.col("file").alias("source_file"), "modified", "n_entities", "files", F.lit("PENDING").alias("status"))
    waiting = stamped.join(counts, "doc_id", "left_anti").join(bad, "doc_id", "left_anti")
    dated = good.join(stamped.select(F.col("doc_id").alias("source_document"), "modified"), "source_document")
    seq = F.lit(batch_id).cast("bigint")
    for name, rows in (("submissions", submitted), ("quarantine", stamped.join(bad, "doc_id")), ("waiting", waiting), ("superseded", superseded), ("evidence", evidence)):
        rows.withColumn("seq", seq).write.mode("overwrite").parquet(f"{out}/{name}/batch={batch_id}")
    taken = stamped.join(bad, "doc_id", "left_anti").select(F.col("doc_id").alias("source_document"))
    merge_entities(dated.withColumn("seq", seq), taken, f"{out}/entities", batch_id)
    good.unpersist()
    found.unpersist()
    delivered.unpersist()


def start(spark: SparkSession, inbox: str, out: str, checkpoint: str, extractor: Callable[[pd.DataFrame], pd.DataFrame], pack: Pack, once: bool = False, archive: str | None = None) -> StreamingQuery:
    """The running ingest; ``once`` takes what is there and ends."""
    writer = inbox_stream(spark, inbox, archive=archive).writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, i: ingest_batch(df, i, out, extractor, pack))
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 second")).start()


def current_entities(spark: SparkSession, out: str) -> DataFrame:
    """The entities of each document's last delivery. Of entities of two documents with one id, that of the later batch; of one batch, that of the smaller
    file name."""
    rows = read_entities(spark, f"{out}/entities")
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy("id").orderBy(F.col("seq").desc(), "file"))).where("_n = 1").drop("_n")
