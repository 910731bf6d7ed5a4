"""Graph patterns over triples (s, p, o, o_kind, o_lang): every operator is a DataFrame of variable columns.

Constants become filters that reach the scan (or fold away whole branches of a union of typed edge tables); variables
become columns; patterns join on the variables they share. Triples are a set, results are bags.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import Scratch, cut

TYPE, LABEL, DEFINITION, SOURCE = "rdf:type", "rdfs:label", "skos:definition", "dcterms:source"


@dataclass(frozen=True)
class Lit:
    """A literal constant; a plain one does not match a language-tagged one."""

    value: str
    lang: str | None = None


def is_var(x: object) -> bool:
    return isinstance(x, str) and x.startswith("?")


def triple_pattern(triples: DataFrame, s: str, p: str, o: str | Lit, cls: str | None = None) -> DataFrame:
    """Bindings of the variables (``?name``) in one pattern; a variable used twice must be equal. ``cls`` says that only subjects of
    this class are wanted: where ``triples`` tell the class a row comes from (s_class), rows of others are left out, so
    that tables of other classes are not read. It is a hint; ``of_class`` makes sure."""
    cond, columns = [], {}
    for place, term in (("s", s), ("p", p), ("o", o)):
        if isinstance(term, Lit):
            cond += [F.col(place) == term.value, F.col("o_kind") == "lit", F.col("o_lang").eqNullSafe(F.lit(term.lang))]
        elif not is_var(term):
            cond.append(F.col(place) == term)
            if place == "o":
                cond.append(F.col("o_kind") == "iri")
        elif term[1:] in columns:
            cond.append(F.col(place) == F.col(columns[term[1:]]))
        else:
            columns[term[1:]] = place
    if cls is not None and "s_class" in triples.columns:
        cond.append(F.coalesce(F.col("s_class") == cls, F.lit(True)))
    rows = triples.where(reduce(lambda a, b: a & b, cond)) if cond else triples
    return rows.select(*[F.col(place).alias(name) for name, place in columns.items()])


def bgp(*patterns: DataFrame) -> DataFrame:
    """Inner join of patterns on the variables they share, in the order given; each must share one with those before."""

    def both(left: DataFrame, right: DataFrame) -> DataFrame:
        shared = [c for c in right.columns if c in left.columns]
        if not shared:
            raise ValueError(f"pattern {right.columns} shares no variable with {left.columns}")
        return left.join(right, shared)

    return reduce(both, patterns)


def of_class(rows: DataFrame, triples: DataFrame, var: str, cls: str) -> DataFrame:
    """``rows`` whose ``var`` is of the class: a semi join, for a triple occurs once."""
    return rows.join(triple_pattern(triples, f"?{var}", TYPE, cls, cls), var, "left_semi")


def labelled(triples: DataFrame, var: str, label: str, cls: str) -> DataFrame:
    """(var, label) of the members of a class."""
    return of_class(triple_pattern(triples, f"?{var}", LABEL, f"?{label}", cls), triples, var, cls)


def optional(rows: DataFrame, *group: DataFrame) -> DataFrame:
    """Left join of a group of patterns, matched as a unit."""
    inner = bgp(*group)
    return rows.join(inner, [c for c in inner.columns if c in rows.columns], "left")


def filter_in(rows: DataFrame, var: str, ids: DataFrame) -> DataFrame:
    """``rows`` whose ``var`` is in the first column of ``ids``."""
    return rows.join(ids.select(F.col(ids.columns[0]).alias(var)).distinct(), var, "left_semi")


def group_count(rows: DataFrame, by: list[str], var: str, alias: str, distinct: bool = False) -> DataFrame:
    """COUNT of a variable per group; unbound ones don't count, so optional groups give zero."""
    return rows.groupBy(*by).agg((F.count_distinct(F.col(var)) if distinct else F.count(F.col(var))).alias(alias))


def order_by(rows: DataFrame, *keys: str) -> DataFrame:
    """Keys ascending, ``-key`` descending; unbound comes first ascending and last descending."""
    return rows.orderBy(*[F.col(k[1:]).desc_nulls_last() if k.startswith("-") else F.col(k).asc_nulls_first() for k in keys])


def top_k(rows: DataFrame, k: int, *keys: str) -> DataFrame:
    return order_by(rows, *keys).limit(k)


def if_bound(var: str, other: str) -> Column:
    return F.coalesce(F.col(var), F.col(other))


def local_name(iri: Column | str) -> Column:
    """What follows the last ``#``, or without one the last ``/``."""
    iri = F.col(iri) if isinstance(iri, str) else iri
    return F.when(F.contains(iri, F.lit("#")), F.substring_index(iri, "#", -1)).otherwise(F.substring_index(iri, "/", -1))


def type_name(iri: Column | str) -> Column:
    """The local name by the pattern ``^.*[/#:]`` on an IRI or prefixed name."""
    return F.regexp_replace(iri, r"^.*[/#:]", "")


def ask(rows: DataFrame) -> DataFrame:
    """One row: whether there is a match. Stops at the first."""
    return rows.limit(1).agg((F.count(F.lit(1)) > 0).alias("answer"))


def construct(rows: DataFrame, *template: tuple[Column, Column, Column, str]) -> DataFrame:
    """Triples (s, p, o, o_kind) of each template for each match; a set, unbound parts leave a triple out."""
    parts = [rows.select(s.alias("s"), p.alias("p"), o.alias("o"), F.lit(kind).alias("o_kind")) for s, p, o, kind in template]
    return reduce(lambda a, b: a.unionByName(b), parts).dropna(subset=["s", "p", "o"]).distinct()


def entity_catalog(triples: DataFrame, entity_prefix: str) -> DataFrame:
    """(id, class, label) of every labelled entity in the namespace, by class and label."""
    rows = bgp(triple_pattern(triples, "?entity", TYPE, "?type"), triple_pattern(triples, "?entity", LABEL, "?label"))
    mine = rows.where(F.col("entity").startswith(entity_prefix))
    return mine.select(F.expr(f"substring(entity, {len(entity_prefix) + 1})").alias("id"), type_name("type").alias("class"), "label").orderBy("class", "label")


def rows_as_strings(rows: DataFrame) -> DataFrame:
    return rows.select(*[F.col(c).cast("string").alias(c) for c in rows.columns])


# Beyond what the shipped queries use: free over the same bindings.
def union(*rows: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), rows)


def minus(rows: DataFrame, other: DataFrame) -> DataFrame:
    return rows.join(other, [c for c in other.columns if c in rows.columns], "left_anti")


def exists(rows: DataFrame, other: DataFrame) -> DataFrame:
    return rows.join(other, [c for c in other.columns if c in rows.columns], "left_semi")


def path_plus(edges: DataFrame) -> DataFrame:
    """(src, dst) joined by one or more of ``edges`` (src, dst); cycles close, ends that are null join nothing.

    Paths double: each round joins those that the last one found with all that are known, so a chain of any length takes as many
    rounds as its logarithm. Each round is checkpointed, which keeps the plan short; there is no limit on rounds, as every one
    finds a new pair or ends the loop."""
    new = known = cut(edges.select("src", "dst").where("src is not null and dst is not null").distinct())
    ahead = lambda df: df.select(F.col("src").alias("dst"), F.col("dst").alias("_to"))
    while not new.isEmpty():
        longer = new.join(ahead(known), "dst").unionByName(known.join(ahead(new), "dst")).select("src", F.col("_to").alias("dst"))
        new = cut(longer.distinct().join(known, ["src", "dst"], "left_anti"))
        known = cut(known.unionByName(new))
    return known


def path_from(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(src, dst): what is reached from ``starts`` (src) by one or more of ``edges`` (src, dst), for paths with a bound begin.

    Only nodes that are reached are looked at: each round goes one edge on from the pairs that the last one found, and an anti-join drops those that are known,
    so cycles end. Rounds are as many as the longest of the shortest paths; the whole closure (``path_plus``) takes fewer, but makes all its pairs. All
    starts go together, and a pair is joined once."""
    with Scratch(edges.sparkSession, "path") as scratch:
        steps = scratch.keep(edges.select("src", "dst").where("src is not null and dst is not null").distinct())
        new = known = scratch.keep(steps.join(starts.select("src").distinct(), "src", "left_semi"))
        ahead = steps.select(F.col("src").alias("dst"), F.col("dst").alias("_to"))
        while not new.isEmpty():
            further = new.join(ahead, "dst").select("src", F.col("_to").alias("dst")).distinct()
            new = scratch.keep(further.join(known, ["src", "dst"], "left_anti"))
            known = known.unionByName(new)
        return scratch.result(known)


def path_to(edges: DataFrame, ends: DataFrame) -> DataFrame:
    """(src, dst): what reaches ``ends`` (dst), as ``path_from`` over the edges turned round."""
    back = path_from(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), ends.select(F.col("dst").alias("src")))
    return back.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
