"""Graphs and records over plain tables: how each pack's entities, edges and literals are read from the driver's tables.

Edge tables are unions whose branches carry their property as a literal, so a pattern with a constant predicate prunes all
other branches at planning time, and ids are made from the base tables' keys without any lookup.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import ENTITY, GraphTables
from ..operators.ingest import dealt_by_size
from ..sources.shared import dealt_by_count
from .pack import COMPLIANCE, LITERATURE, REGULATORY, THEMATIC


def texts(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    """A table whose texts take long work per row. A file that gives fewer tasks than there are cores is dealt out first, by the length of
    its texts; a large table has enough tasks and is not shuffled."""
    rows, n = table(spark, sf_dir, name), spark.sparkContext.defaultParallelism
    return dealt_by_size(rows, n) if rows.rdd.getNumPartitions() < n else rows


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ref(kind: str, col: Column | str) -> Column:
    col = F.col(col) if isinstance(col, str) else col
    return F.concat(F.lit(f"{kind}_"), col.cast("string"))


def union(*parts: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def ent(df: DataFrame, cls: str, id_: Column, label: Column) -> DataFrame:
    return df.select(id_.alias("id"), F.lit(cls).alias("class"), label.cast("string").alias("label"))


def edge(df: DataFrame, src: Column, prop: str, dst: Column) -> DataFrame:
    return df.select(src.alias("src"), F.lit(prop).alias("prop"), dst.alias("dst"))


def literal(df: DataFrame, id_: Column, prop: str, value: Column) -> DataFrame:
    return df.select(id_.alias("id"), F.lit(prop).alias("prop"), value.cast("string").alias("value")).where("value is not null")


def regulatory(spark: SparkSession, sf_dir: str) -> GraphTables:
    """Customers issue, orders are filings with the customer's nation, order lines disclose, parts oblige. Order lines, of which there are most, are
    dealt out by their number before ids are made of them."""
    t = lambda n: table(spark, sf_dir, n)
    customer, orders, nation, part = t("customer"), t("orders"), t("nation"), t("part")
    lines = t("lineitem")
    lines = dealt_by_count(lines.select("l_orderkey", "l_linenumber", "l_partkey"), lines.count(), "l_orderkey", "l_linenumber")
    disclosure = lines.select("l_orderkey", "l_linenumber").distinct()
    did = lambda: F.concat(F.lit("dis_"), F.col("l_orderkey").cast("string"), F.lit("_"), F.col("l_linenumber").cast("string"))
    entities = union(
        ent(customer, "Issuer", ref("iss", "c_custkey"), F.col("c_name")),
        ent(orders, "Filing", ref("fil", "o_orderkey"), ref("Order", "o_orderkey")),
        ent(nation, "Regulator", ref("nat", "n_nationkey"), F.col("n_name")),
        ent(disclosure, "Disclosure", did(), F.concat(F.lit("Line "), F.col("l_linenumber").cast("string"), F.lit(" of "), F.col("l_orderkey").cast("string"))),
        ent(part, "Obligation", ref("obl", "p_partkey"), F.col("p_name")),
    )
    placed = orders.select("o_orderkey", "o_custkey").join(customer.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    edges = union(
        edge(orders, ref("fil", "o_orderkey"), "filedBy", ref("iss", "o_custkey")),
        edge(placed, ref("fil", "o_orderkey"), "filedWith", ref("nat", "c_nationkey")),
        edge(disclosure, ref("fil", "l_orderkey"), "containsDisclosure", did()),
        edge(lines.distinct(), did(), "triggersObligation", ref("obl", "l_partkey")),
    )
    literals = union(
        literal(orders, ref("fil", "o_orderkey"), "filingDate", F.date_format("o_orderdate", "yyyy-MM-dd")),
        literal(customer, ref("iss", "c_custkey"), "tickerSymbol", F.col("c_mktsegment")),
    )
    return GraphTables(REGULATORY, entities, edges, literals)


def thematic(spark: SparkSession, sf_dir: str) -> GraphTables:
    """Documents are excerpts coded by source (one code is unused) under their language's theme; the speaker is the label's quality.
    Conversation turns are excerpts too, spoken by their role, with section, text, and a code for even conversations."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    labels = table(spark, sf_dir, "labels")
    turns = table(spark, sf_dir, "conversations")
    tid = lambda: F.concat(F.lit("turn_"), F.col("conv_id").cast("string"), F.lit("_"), F.col("turn").cast("string"))
    sources = docs.select("source").where("source is not null").distinct()
    unused = spark.range(1).select(F.lit("unused").alias("source"))
    none = F.lit(None).cast("string")
    plain = lambda df: df.withColumns({"source_section": none, "source_text": none})
    entities = union(
        plain(ent(docs.select("lang").where("lang is not null").distinct(), "Theme", ref("theme", "lang"), F.concat(F.lit("Theme "), F.col("lang")))),
        plain(ent(union(sources, unused), "Code", ref("code", "source"), F.concat(F.lit("Code "), F.col("source")))),
        plain(ent(spark.range(1).select(F.explode(F.array(F.lit("even"))).alias("k")), "Code", ref("code", "k"), F.lit("Code even"))),
        plain(ent(docs, "Excerpt", ref("doc", "doc_id"), F.concat(F.lit("Document "), F.col("doc_id").cast("string")))),
        turns.select(tid().alias("id"), F.lit("Excerpt").alias("class"), F.concat(F.lit("Turn "), F.col("conv_id").cast("string"), F.lit("."), F.col("turn").cast("string")).alias("label"), F.concat(F.lit("turn "), F.col("turn").cast("string")).alias("source_section"), F.col("text").alias("source_text")),
    )
    edges = union(
        edge(docs.where("source is not null"), ref("doc", "doc_id"), "codedAs", ref("code", "source")),
        edge(turns.where("conv_id % 2 = 0"), tid(), "codedAs", F.lit("code_even")),
        edge(docs.where("lang is not null"), ref("doc", "doc_id"), "supportsTheme", ref("theme", "lang")),
    )
    literals = union(literal(labels, ref("doc", "doc_id"), "spokenBy", ref("Q", "quality")), literal(turns, tid(), "spokenBy", F.col("role")))
    return GraphTables(THEMATIC, entities, edges, literals.distinct())


def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, item_id): documents that contain a benchmark item's text after normalisation."""
    from ..functions.text import normalize_for_match
    from ..operators.ingest import anchored

    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("needle_id"), F.lit(None).cast("string").alias("doc"), normalize_for_match("text").alias("norm"))
    docs = texts(spark, sf_dir).select(F.col("doc_id").cast("string").alias("doc"), F.lit(1).alias("place"), "text")
    return anchored(items, docs).select(F.col("doc").alias("doc_id"), F.col("needle_id").alias("item_id")).distinct()


def literature(spark: SparkSession, sf_dir: str) -> GraphTables:
    """Documents and benchmark items are papers, languages the entities studied, labels claims by quality; a document cites the
    items whose text it contains."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    labels = table(spark, sf_dir, "labels").where("doc_id is not null")
    items = table(spark, sf_dir, "benchmark").select("item_id")
    entities = union(
        ent(docs, "Paper", ref("doc", "doc_id"), F.concat(F.lit("Document "), F.col("doc_id").cast("string"))),
        ent(items, "Paper", ref("item", "item_id"), F.concat(F.lit("Item "), F.col("item_id").cast("string"))),
        ent(docs.select("lang").where("lang is not null").distinct(), "Entity", ref("lang", "lang"), F.col("lang")),
        ent(labels, "Claim", ref("claim", "doc_id"), F.concat(F.lit("Claim on "), F.col("doc_id").cast("string"))),
        ent(labels.select("quality").where("quality is not null").distinct(), "Methodology", ref("method", "quality"), F.concat(F.lit("Quality "), F.col("quality").cast("string"))),
    )
    edges = union(
        edge(docs.where("lang is not null"), ref("doc", "doc_id"), "studiesEntity", ref("lang", "lang")),
        edge(labels.where("quality is not null"), ref("claim", "doc_id"), "usesMethodology", ref("method", "quality")),
        edge(labels, ref("doc", "doc_id"), "makesClaim", ref("claim", "doc_id")),
        edge(citations(spark, sf_dir), ref("doc", "doc_id"), "citesPaper", ref("item", "item_id")),
    )
    return GraphTables(LITERATURE, entities, edges, literal(labels, ref("doc", "doc_id"), "publishedYear", F.col("quality")))


def compliance(spark: SparkSession, sf_dir: str) -> GraphTables:
    """Suppliers owe obligations to their nation and (even keys) are part of its region's statute; nations are statutes that
    their region enforces; parts are definitions in their brand, with a section where the size is even."""
    t = lambda n: table(spark, sf_dir, n)
    supplier, nation, region, part = t("supplier"), t("nation"), t("region"), t("part")
    none = F.lit(None).cast("string")
    plain = lambda df: df.withColumns({"source_section": none, "source_text": none})
    entities = union(
        plain(ent(supplier, "Obligation", ref("sup", "s_suppkey"), F.col("s_name"))),
        plain(ent(nation, "Statute", ref("nat", "n_nationkey"), F.col("n_name"))),
        plain(ent(region, "Regulator", ref("reg", "r_regionkey"), F.col("r_name"))),
        plain(ent(part.select("p_brand").distinct(), "Provision", ref("brand", "p_brand"), F.col("p_brand"))),
        part.select(ref("part", "p_partkey").alias("id"), F.lit("Definition").alias("class"), F.concat(F.lit("Part "), F.col("p_partkey").cast("string")).alias("label"), F.when(F.col("p_size") % 2 == 0, F.col("p_type")).alias("source_section"), F.col("p_name").alias("source_text")),
    )
    edges = union(
        edge(supplier, ref("sup", "s_suppkey"), "imposesObligationOn", ref("nat", "s_nationkey")),
        edge(supplier.where("s_suppkey % 2 = 0"), ref("sup", "s_suppkey"), "partOfStatute", ref("nat", "s_nationkey")),
        edge(nation, ref("nat", "n_nationkey"), "enforcedBy", ref("reg", "n_regionkey")),
        edge(part, ref("part", "p_partkey"), "partOfStatute", ref("brand", "p_brand")),
    )
    literals = spark.range(0).select(F.lit("").alias("id"), F.lit("").alias("prop"), F.lit("").alias("value"))
    return GraphTables(COMPLIANCE, entities, edges, literals)


def vault(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entity records with every kind of defect that the linter knows, made from documents, labels and sources by rules on their keys.

    Excerpts are documents, codes their sources, themes their languages, subthemes the label qualities."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    d, i = docs.join(labels, "doc_id", "left"), F.col("doc_id")
    empty = F.array().cast("array<string>")
    key = i.cast("string")
    eid = F.when(i % 83 == 1, F.lit("")).when(i % 89 == 2, ref("Doc", key)).otherwise(ref("doc", key))
    coded = F.when(i % 53 == 4, F.lit("[[code_nowhere]]")).otherwise(F.concat(F.lit("[["), ref("code", "source"), F.lit("]]")))
    own = F.when(i % 71 == 5, F.array(F.concat(F.lit("[["), ref("doc", key), F.lit("]]"))))
    props = F.map_filter(
        F.map_from_entries(
            F.array(
                F.struct(F.lit("codedAs").alias("key"), F.array(coded).alias("value")),
                F.struct(F.lit("supportsTheme").alias("key"), F.coalesce(own, F.array(F.concat(F.lit("[["), ref("theme", "lang"), F.lit("]]")))).alias("value")),
                F.struct(F.lit("spokenBy").alias("key"), F.coalesce(F.when(F.col("quality").isNotNull(), F.array(ref("Q", "quality"))), empty).alias("value")),
                F.struct(F.lit("mood").alias("key"), F.when(i % 97 == 6, F.array(F.lit("calm"))).otherwise(empty).alias("value")),
                F.struct(F.lit("hasSubtheme").alias("key"), F.when(i % 101 == 7, F.array(F.lit("[[sub_0]]"))).otherwise(empty).alias("value")),
            )
        ),
        lambda k, v: F.size(v) > 0,
    )
    uri = F.when(i % 79 == 8, F.lit("https://ontology.example.org/elsewhere")).otherwise(F.concat(F.lit(f"{THEMATIC.entity_iri}"), eid))
    excerpts = d.select(
        F.when(i % 61 == 9, F.lit("Quote")).otherwise(F.lit("Excerpt")).alias("class"), eid.alias("id"), F.when(i % 67 == 10, F.lit("")).otherwise(F.concat(F.lit("Document "), key)).alias("label"), uri.alias("uri"),
        F.coalesce("source", F.lit("")).alias("source_document"), F.when(i % 59 == 11, F.lit("")).otherwise(F.concat(F.lit("chars "), F.col("n_chars").cast("string"))).alias("source_section"), F.lit(1).alias("source_page"), F.col("text").alias("source_text"), props.alias("properties"),
        F.when(i % 73 == 12, F.concat(ref("file", key), F.lit(".md"))).otherwise(F.concat(ref("doc", key), F.lit(".md"))).alias("file"), (i % 103 == 13).alias("corrupt"),
    )
    copies = excerpts.where(i % 107 == 14).withColumn("file", F.concat(F.lit("z_"), F.col("file")))

    def plain(df: DataFrame, cls: str, kind: str, col: str, props: Column) -> DataFrame:
        id_ = ref(kind, col)
        return df.select(
            F.lit(cls).alias("class"), id_.alias("id"), F.concat_ws(" ", F.lit(cls), F.col(col).cast("string")).alias("label"), F.concat(F.lit(THEMATIC.entity_iri), id_).alias("uri"), F.lit("tables").alias("source_document"),
            F.lit("").alias("source_section"), F.lit(None).cast("int").alias("source_page"), F.lit("").alias("source_text"), props.cast("map<string,array<string>>").alias("properties"), F.concat(id_, F.lit(".md")).alias("file"), F.lit(False).alias("corrupt"),
        )

    none = F.create_map().cast("map<string,array<string>>")
    themes = plain(docs.select("lang").where("lang is not null").distinct(), "Theme", "theme", "lang", F.when(F.col("lang") == "en", F.create_map(F.lit("hasSubtheme"), F.array(F.lit("[[sub_1]]")))).otherwise(none))
    codes = plain(docs.select("source").where("source is not null").distinct().unionByName(spark.range(1).select(F.lit("unused").alias("source"))), "Code", "code", "source", none)
    subs = plain(labels.select("quality").where("quality is not null").distinct(), "Subtheme", "sub", "quality", none)
    return union(excerpts, copies, themes, codes, subs).select(*[x.split()[0] for x in ENTITY.replace("map<string, array<string>>", "map").split(", ")], "corrupt")
