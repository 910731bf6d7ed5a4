"""Writing entities, triples, Markdown and JSON."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import sanitize_id, wrap_links
from ..operators.graph import entity_uri
from ..plans.pack import Pack
from .shared import exists, remove


def upsert_entities(existing: DataFrame | None, new: DataFrame, seq: str = "seq") -> DataFrame:
    """One record per sanitised id: the last of ``new`` by ``seq``, else the existing one. Records without an id are left out."""
    named = new.where("id is not null and id <> ''").withColumn("_key", sanitize_id("id"))
    last = named.withColumn("_n", F.row_number().over(Window.partitionBy("_key").orderBy(F.col(seq).desc()))).where("_n = 1").drop("_n")
    if existing is None:
        return last.drop("_key")
    kept = existing.withColumn("_key", sanitize_id("id")).join(last.select("_key"), "_key", "left_anti")
    return kept.unionByName(last, allowMissingColumns=True).drop("_key")


#: Folders of a keyed table. A table keeps the number that it was begun with.
BUCKETS = 64


def _bucketed(rows: DataFrame, key: str, buckets: int) -> DataFrame:
    """``rows`` dealt out by bucket; Spark puts small buckets together in a task and splits large ones, so a document with very many entities
    is not one task's."""
    return rows.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")).hint("rebalance", "bucket")


def write_entities(entities: DataFrame, path: str, key: str = "source_document", buckets: int = BUCKETS) -> None:
    """``entities`` as a keyed table, bucketed by the hash of their document, in place of what is at ``path``."""
    _bucketed(entities, key, buckets).write.mode("overwrite").partitionBy("bucket").parquet(path)


def merge_entities(new: DataFrame, delivered: DataFrame, path: str, batch: int, key: str = "source_document", buckets: int = BUCKETS) -> bool:
    """Put batch number ``batch`` into the keyed table at ``path``: all rows whose ``key`` is among ``delivered`` (a table with that column) give way to those of ``new``. A
    key that is delivered without a row leaves a tombstone, a row with nothing but the key. False if the table has the batch already.

    Only the buckets of delivered keys are read and written. They are written beside the table first, then put in place by dynamic partition
    overwrite, then noted in a ledger. A batch that comes again after it is noted changes nothing; one that broke off while its buckets were put in place
    is finished from what stands beside the table, whatever state the table is in. So each bucket has one writer at a time: batches of one table
    don't run at once. Null keys are a key of their own."""
    spark = new.sparkSession
    ledger, staged = f"{path}-ledger/batch={batch}", f"{path}-staged/batch={batch}"
    if exists(spark, f"{ledger}/_SUCCESS"):
        return False
    if exists(spark, f"{path}-ledger") and (begun := [r["buckets"] for r in spark.read.parquet(f"{path}-ledger").select("buckets").distinct().collect()]) not in ([], [buckets]):
        raise ValueError(f"the table has {begun} buckets")
    if not exists(spark, f"{staged}/_SUCCESS"):
        keys = delivered.select(F.col(key).alias("_key")).distinct().cache()
        same = F.col(key).eqNullSafe(F.col("_key"))
        merged = new.join(keys, same, "left_semi")
        gone = keys.join(new.select(key).distinct(), same, "left_anti").select(*[(F.col("_key") if f.name == key else F.lit(None)).cast(f.dataType).alias(f.name) for f in new.schema])
        merged = merged.unionByName(gone)
        if exists(spark, path):
            hit = [r[0] for r in keys.select(F.pmod(F.xxhash64("_key"), F.lit(buckets)).cast("int")).distinct().collect()]  # as many as there are buckets at most
            old = spark.read.parquet(path).where(F.col("bucket").isin(hit)).drop("bucket")
            merged = merged.unionByName(old.join(keys, same, "left_anti"), allowMissingColumns=True)
        _bucketed(merged, key, buckets).write.mode("overwrite").partitionBy("bucket").parquet(staged)
        keys.unpersist()
    spark.read.parquet(staged).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    spark.createDataFrame([(buckets,)], "buckets int").write.mode("overwrite").parquet(ledger)
    remove(spark, staged)
    return True


def read_entities(spark: SparkSession, path: str, key: str = "source_document") -> DataFrame:
    """The rows of a keyed table, without tombstones."""
    rows = spark.read.parquet(path)
    return rows.where(reduce(lambda a, b: a | b, [F.col(c).isNotNull() for c in rows.columns if c not in (key, "bucket")])).drop("bucket")


def escape_literal(c: Column) -> Column:
    for raw, safe in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return c


def triple_lines(triples: DataFrame, pack: Pack) -> DataFrame:
    """(line): N-Triples with full IRIs; each line stands for itself, so files split and sort freely."""
    names = {
        f"{pack.prefix}e:": pack.entity_iri, f"{pack.prefix}:": pack.base_iri, "rdf:": "http://www.w3.org/1999/02/22-rdf-syntax-ns#", "rdfs:": "http://www.w3.org/2000/01/rdf-schema#",
        "owl:": "http://www.w3.org/2002/07/owl#", "xsd:": "http://www.w3.org/2001/XMLSchema#", "dcterms:": "http://purl.org/dc/terms/", "skos:": "http://www.w3.org/2004/02/skos/core#",
    }

    def full(name: str) -> Column:
        out = F.col(name)
        for short, iri in names.items():
            out = F.when(F.col(name).startswith(short), F.concat(F.lit(iri), F.expr(f"substring({name}, {len(short) + 1})"))).otherwise(out)
        return F.concat(F.lit("<"), out, F.lit(">"))

    tag = F.coalesce(F.concat(F.lit("@"), F.col("o_lang")), F.lit(""))
    obj = F.when(F.col("o_kind") == "iri", full("o")).otherwise(F.concat(F.lit('"'), escape_literal(F.col("o")), F.lit('"'), tag))
    return triples.select(F.concat(full("s"), F.lit(" "), full("p"), F.lit(" "), obj, F.lit(" .")).alias("line"))


def write_triples(triples: DataFrame, pack: Pack, path: str) -> None:
    triple_lines(triples, pack).write.mode("overwrite").text(path)


def _yaml(c: Column) -> Column:
    """A string as a quoted scalar."""
    return F.to_json(F.struct(c.alias("x")), {"ignoreNullFields": "false"}).substr(F.lit(6), F.length(F.to_json(F.struct(c.alias("x")), {"ignoreNullFields": "false"})) - 6)


def entity_markdown(entities: DataFrame, pack: Pack, link_base: str = "evidence") -> DataFrame:
    """(file, markdown): front matter, and a body with the source line (with a page, a link to it), quote and note."""
    props = F.map_entries(wrap_links("properties", pack.datatype_props))
    one = lambda v: F.when(F.size(v) == 1, F.concat(F.lit(" "), _yaml(F.get(v, F.lit(0))))).otherwise(F.array_join(F.transform(v, lambda x: F.concat(F.lit("\n  - "), _yaml(x))), ""))
    listed = F.array_join(F.transform(props, lambda e: F.concat(F.lit("\n  "), e["key"], F.lit(":"), one(e["value"]))), "")
    properties = F.when(F.size(props) == 0, F.lit("properties: {}\n")).otherwise(F.concat(F.lit("properties:"), listed, F.lit("\n")))
    line = lambda name, c: F.concat(F.lit(f"{name}: "), _yaml(c), F.lit("\n"))
    section, text = F.coalesce("source_section", F.lit("")), F.coalesce("source_text", F.lit(""))
    page = F.col("source_page").cast("string")
    front = F.concat(
        line("class", F.col("class")), line("id", F.col("id")), line("label", F.col("label")), line("uri", entity_uri(pack, F.col("id"))), line("source_document", F.col("source_document")),
        line("source_section", section), F.coalesce(F.concat(F.lit("source_page: "), page, F.lit("\n")), F.lit("")), line("source_text", text), properties, F.lit("validation: PENDING\n"),
    )
    linked = F.concat(F.lit("**Source:** ["), section, F.lit(" — page "), page, F.lit(f"]({link_base}/"), F.col("id"), F.lit(".pdf#page="), page, F.lit(")"))
    source = F.when(F.coalesce("source_page", F.lit(0)) > 0, linked).otherwise(F.concat(F.lit("**Source:** "), section, F.lit(" — "), F.col("source_document")))
    body = F.concat(F.lit("## "), F.col("label"), F.lit("\n\n**Class:** `"), F.lit(f"{pack.prefix}:"), F.col("class"), F.lit("`\n"), source, F.lit("\n\n> "), text, F.lit("\n\n*Extracted automatically. Review before merging.*\n"))
    return entities.select(F.concat(sanitize_id("id"), F.lit(".md")).alias("file"), F.concat(F.lit("---\n"), front, F.lit("---\n\n"), body).alias("markdown"))


def as_json(rows: DataFrame) -> DataFrame:
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("json"))


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)
