"""Rollups, lookups and the one-hop subgraph."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize_for_lookup
from ..plans.pack import Pack
from ..sources.shared import cut, numbered
from .intervals import prefix_join
from .pattern import LABEL, TYPE, filter_in, local_name, type_name

SUFFIX = r"_e\d+$"
#: Entities of a result that are sent to all tasks at most; more are joined by a shuffle.
MOST_SENT = 200_000


def document_of() -> Column:
    """A record's document: its trimmed source_document, else its file's stem without ``_e<digits>``."""
    src = F.trim("source_document")
    return F.when(src != "", src).otherwise(F.regexp_replace(F.regexp_replace("file", r"\.md$", ""), SUFFIX, ""))


def document_rollup(entities: DataFrame) -> DataFrame:
    rows = entities.groupBy(document_of().alias("doc_id"))
    return rows.agg(F.count(F.lit(1)).alias("entity_count"), F.array_sort(F.collect_set(F.nullif("class", F.lit("")))).alias("classes"))


def entities_for_document(entities: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc, file) for each wanted ``doc`` (a table of them): files that begin with it; where there is none, records whose
    source_document equals it. Prefixes meet files in an interval join, so each file is shuffled once."""
    wanted = docs.select("doc").distinct()
    by_prefix = cut(prefix_join(wanted.withColumnRenamed("doc", "prefix"), entities.select(F.regexp_replace("file", r"\.md$", "").alias("key"), F.col("file").alias("value"))))
    by_prefix = by_prefix.select(F.col("prefix").alias("doc"), F.col("value").alias("file"))
    rest = wanted.join(by_prefix.select("doc").distinct(), "doc", "left_anti")
    by_field = entities.select(F.col("source_document").alias("doc"), "file").join(rest, "doc")
    return by_prefix.unionByName(by_field.select("doc", "file"))


def entity_card(entities: DataFrame) -> DataFrame:
    return entities.select("file", "class", "label", "source_section", "source_page", "source_text", F.coalesce("properties", F.create_map().cast("map<string,array<string>>")).alias("properties"))


def vault_search(rollup: DataFrame, needle: str) -> DataFrame:
    """Documents whose id or any class contains the needle, in any case."""
    low = F.lit(needle.lower())
    return rollup.where(F.contains(F.lower("doc_id"), low) | F.exists("classes", lambda c: F.contains(F.lower(c), low)))


def read_entity(entities: DataFrame, file: str) -> DataFrame:
    return entities.where(F.col("file") == file)


def result_entities(result: DataFrame, entity_prefix: str) -> DataFrame:
    """Distinct entities in any column of a select result."""
    columns = F.array(*[F.col(c).cast("string") for c in result.columns])
    return result.select(F.explode(columns).alias("entity")).where(F.col("entity").startswith(entity_prefix)).distinct()


def entities_in_order(result: DataFrame, entity_prefix: str) -> DataFrame:
    """(entity, position): the distinct entities of a select result, numbered from 0 in the order in which they are first seen: row by row as the result is
    sorted, in a row from the first column to the last. A row's place grows with the ranges that the sort has dealt rows to and inside each; the least place of an
    entity is found map-side, and entities are numbered range by range."""
    columns = F.array(*[F.col(c).cast("string") for c in result.columns])
    placed = result.select(F.monotonically_increasing_id().alias("_row"), columns.alias("_all")).select("_row", F.posexplode("_all").alias("_column", "entity"))
    seen = placed.where(F.col("entity").startswith(entity_prefix)).groupBy("entity").agg(F.min(F.struct("_row", "_column")).alias("_first"))
    return numbered(seen, "_first", "position", 0).select("entity", "position")


def cq_subgraph(triples: DataFrame, result: DataFrame, entity_prefix: str) -> DataFrame:
    """Outgoing triples of the entities in a query's result. The query runs once: its entities are written, as
    the filter is pushed into every branch of the triples. Up to ``MOST_SENT`` of them, counted, are sent to all tasks, so that no branch is shuffled for it."""
    wanted = cut(result_entities(result, entity_prefix))
    return filter_in(triples, "s", F.broadcast(wanted) if wanted.count() <= MOST_SENT else wanted)


def graph_edges(triples: DataFrame) -> DataFrame:
    """(src, label, dst): links between IRIs; types, labels, literals and blank subjects are left out."""
    keep = (F.col("o_kind") == "iri") & ~F.col("p").isin(TYPE, LABEL) & ~F.col("s").startswith("_:")
    return triples.where(keep).select(F.col("s").alias("src"), type_name("p").alias("label"), F.col("o").alias("dst"))


def graph_nodes(triples: DataFrame, pack: Pack, palette: int = 8) -> DataFrame:
    """(node, label, class, color): every labelled, typed or linked node. A label is the local name where there is none, a
    color the class's place in the pack modulo ``palette`` (null for others)."""
    label, cls = F.when(F.col("p") == LABEL, F.col("o")), F.when((F.col("p") == TYPE) & (F.col("o_kind") == "iri"), type_name("o"))
    facts = triples.where(~F.col("s").startswith("_:") & F.col("p").isin(TYPE, LABEL)).select(F.col("s").alias("node"), label.alias("_label"), cls.alias("class"))
    # An end says that there is a node, and nothing of it; so all rows meet in one grouping, whose hubs are combined before the shuffle.
    none = F.lit(None).cast("string")
    ends = graph_edges(triples).select(F.explode(F.array("src", "dst")).alias("node"), none.alias("_label"), none.alias("class"))
    nodes = facts.unionByName(ends).groupBy("node").agg(F.max("_label").alias("_label"), F.max("class").alias("class"))
    color = F.lit(None).cast("int")
    for i, name in enumerate(pack.class_names):
        color = F.when(F.col("class") == name, F.lit(i % palette)).otherwise(color)
    return nodes.select("node", F.coalesce("_label", local_name(F.regexp_replace("node", "^[a-z]+:", ""))).alias("label"), F.coalesce("class", F.lit("")).alias("class"), color.alias("color"))


def resolve_file(names: DataFrame, entities: DataFrame) -> DataFrame:
    """(name, file) for each ``name``: the last file whose stem (less ``_e<digits>``) or label is the same but for case,
    spaces, hyphens and underscores; ``<name>.md`` where there is none."""
    stem = F.regexp_replace(F.regexp_replace("file", r"\.md$", ""), SUFFIX, "")
    keys = [normalize_for_lookup(stem), normalize_for_lookup(F.trim("label"))]
    table = reduce(lambda a, b: a.unionByName(b), [entities.select(k.alias("key"), "file") for k in keys]).where("key <> ''").groupBy("key").agg(F.max("file").alias("file"))
    wanted = names.select("name", normalize_for_lookup("name").alias("key"))
    return wanted.join(table, "key", "left").select("name", F.coalesce("file", F.concat("name", F.lit(".md"))).alias("file"))


def batch_result(outcomes: DataFrame) -> DataFrame:
    """One row for a run's outcomes (name, ok, error): processed, succeeded and failed. An unknown outcome failed."""
    ok = F.coalesce("ok", F.lit(False))
    return outcomes.agg(F.count(F.lit(1)).alias("processed"), F.count_if(ok).alias("succeeded"), F.count_if(~ok).alias("failed"))


def batch_errors(outcomes: DataFrame) -> DataFrame:
    """(name, error) of the outcomes that failed, a row each, by name."""
    return outcomes.where(~F.coalesce("ok", F.lit(False))).select("name", F.coalesce("error", F.lit("")).alias("error")).orderBy("name", "error")
