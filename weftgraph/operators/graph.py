"""From entity records to edges, literals and triples.

Entities: class, id, label, uri, source_document, source_section, source_page, source_text, file and
properties (map of string to array of strings; links may be wrapped as ``[[id]]``).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import strip_link
from ..plans.pack import Pack
from ..sources.shared import dealt_by_count
from .pattern import DEFINITION, LABEL, SOURCE, TYPE

ENTITY = "class string, id string, label string, uri string, source_document string, source_section string, source_page int, source_text string, properties map<string, array<string>>, file string"


@dataclass(frozen=True)
class GraphTables:
    """Entities (id, class, label, ...), edges (src, prop, dst) and literals (id, prop, value) under a pack."""

    pack: Pack
    entities: DataFrame
    edges: DataFrame
    literals: DataFrame

    def triples(self, classes: bool = False) -> DataFrame:
        """Type and label of each entity, its edges and literals, with definition and source where the columns exist. With ``classes`` there is
        a column s_class: the class of the entity that a row was made from, null for edges and literals. Its ids must be of one class each."""
        p, e = self.pack, self.entities
        iri, lit, none, en = F.lit("iri"), F.lit("lit"), F.lit(None).cast("string"), F.lit("en")
        me = entity_ref(p, F.col("id"))

        mine = F.concat(F.lit(f"{p.prefix}:"), F.col("class"))

        def rows(df: DataFrame, s: Column, pred: Column, o: Column, kind: Column, lang: Column) -> DataFrame:
            known = [(mine if "class" in df.columns else none).alias("s_class")] if classes else []
            return df.select(s.alias("s"), pred.alias("p"), o.alias("o"), kind.alias("o_kind"), lang.alias("o_lang"), *known)

        out = rows(e, me, F.lit(TYPE), mine, iri, none)
        out = out.unionAll(rows(e, me, F.lit(LABEL), F.col("label"), lit, en))
        if "source_text" in e.columns:
            out = out.unionAll(rows(e.where("source_text <> ''"), me, F.lit(DEFINITION), F.col("source_text"), lit, en))
        if "source_section" in e.columns:
            out = out.unionAll(rows(e.where("source_section <> ''"), me, F.lit(SOURCE), F.col("source_section"), lit, none))
        pred = predicate(p, "prop")
        out = out.unionAll(rows(self.edges, entity_ref(p, F.col("src")), pred, entity_ref(p, F.col("dst")), iri, none))
        return out.unionAll(rows(self.literals, me, pred, F.col("value"), lit, none))


def entity_ref(pack: Pack, col: Column) -> Column:
    return F.concat(F.lit(f"{pack.prefix}e:"), col)


def entity_uri(pack: Pack, col: Column | str) -> Column:
    return F.concat(F.lit(pack.entity_iri), col)


def predicate(pack: Pack, col: str) -> Column:
    """A property's name as predicate: its declared IRI or the pack's prefix and its name."""
    special = [(p.name, p.iri) for p in pack.properties if p.iri]
    out = F.concat(F.lit(f"{pack.prefix}:"), F.col(col))
    for name, iri in special:
        out = F.when(F.col(col) == name, F.lit(iri)).otherwise(out)
    return out


def values(entities: DataFrame) -> DataFrame:
    """(id, class, file, prop, value): one row per property value, links unwrapped, empty ones left out."""
    pairs = entities.select("id", "class", "file", F.explode(F.map_entries("properties")).alias("kv")).select("id", "class", "file", F.col("kv.key").alias("prop"), F.explode("kv.value").alias("value"))
    return pairs.where("value is not null and value <> ''").withColumn("value", strip_link(F.col("value")))


def entities_to_edges(entities: DataFrame, pack: Pack, keep_self: bool = False) -> DataFrame:
    """(src, prop, dst): the set of declared object-property values. Self links go unless ``keep_self``."""
    rows = values(entities).where(F.col("prop").isin(pack.object_props)).select(F.col("id").alias("src"), "prop", F.col("value").alias("dst"))
    return (rows if keep_self else rows.where("src <> dst")).distinct()


def entities_to_literals(entities: DataFrame, pack: Pack) -> DataFrame:
    """(id, prop, value): the set of declared datatype-property values."""
    return values(entities).where(F.col("prop").isin(pack.datatype_props)).select("id", "prop", "value").distinct()


def graph_of(entities: DataFrame, pack: Pack) -> GraphTables:
    """A graph of entity records. An unknown class becomes the pack's first, a missing label the id, undeclared properties
    and records without an id are left out; definitions are trimmed and on one line."""
    known = entities.where("id is not null and id <> ''")
    tidy = known.withColumn("class", F.when(F.col("class").isin(pack.class_names), F.col("class")).otherwise(F.lit(pack.class_names[0])))
    tidy = tidy.withColumn("label", F.coalesce("label", "id")).withColumn("source_text", F.replace(F.trim("source_text"), F.lit("\n"), F.lit(" ")))
    return GraphTables(pack, tidy, entities_to_edges(known, pack), entities_to_literals(known, pack))


def schema_triples(spark: SparkSession, pack: Pack) -> DataFrame:
    rows = [(pack.class_iri(c.name), TYPE, "owl:Class", "iri", None) for c in pack.classes]
    rows += [(pack.class_iri(c.name), "rdfs:subClassOf", pack.class_iri(c.parent), "iri", None) for c in pack.classes if c.parent]
    for p in pack.properties:
        me = pack.property_iri(p.name)
        rows.append((me, TYPE, "owl:DatatypeProperty" if p.datatype else "owl:ObjectProperty", "iri", None))
        rows += [(me, "rdfs:domain", pack.class_iri(p.domain), "iri", None)] if p.domain else []
        rows += [(me, "rdfs:range", p.range if ":" in p.range else pack.class_iri(p.range), "iri", None)] if p.range else []
    return spark.createDataFrame(rows, "s string, p string, o string, o_kind string, o_lang string")


def load_graph(*triples: DataFrame | None, rows: int | None = None) -> DataFrame:
    """The union of triple tables as a set; missing ones (None) are skipped. Rows hardly repeat, so they are dealt out by their number at once, and each part
    is made a set by itself. ``rows`` says about how many there are; they are counted where it is not given."""
    out = None
    for t in triples:
        if t is not None:
            out = t if out is None else out.unionByName(t)
    return dealt_by_count(out, out.count() if rows is None else rows, *out.columns).distinct()


def store_graph(triples: DataFrame, name: str, path: str, buckets: int = 64) -> DataFrame:
    """``triples`` written as the table ``name`` at ``path`` and read back: a folder for each predicate, bucketed and sorted by subject inside. A pattern with a
    constant predicate reads its folder only, and patterns that share their subject join bucket by bucket, without an exchange. Predicates
    are few, as packs declare them. Subjects that many triples have make large files, which such a join reads whole."""
    dealt = triples.select("s", "o", "o_kind", "o_lang", "p").repartition(buckets, "s")
    dealt.write.mode("overwrite").option("path", path).partitionBy("p").bucketBy(buckets, "s").sortBy("s").saveAsTable(name)
    return triples.sparkSession.table(name).select("s", "p", "o", "o_kind", "o_lang")
