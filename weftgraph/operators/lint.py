"""Quality rules over entity records, and ``lint``, which applies them all.

Findings: severity, rule, entity_id, file, message, suggested_fix. Records (``ENTITY`` columns and optionally ``corrupt``)
pass three gates first: unparsable ones, ones without an id, and later files of an id already seen are reported and
take no part in the other rules. A pack's declarations are literals in the plan; only links between entities shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import sanitize_id, strip_link
from ..plans.pack import Pack

REQUIRED = ("class", "id", "label", "uri", "source_document")
EXCERPT_PROPS = ("spokenBy",)
SEVERITIES = ("error", "warn", "info")
FINDING = ("severity", "rule", "entity_id", "file", "message", "suggested_fix")
FOUND = f"array<struct<{','.join(f'{x}:string' for x in FINDING)}>>"


def _falsy(c: Column) -> Column:
    return F.coalesce(c, F.lit("")) == ""


def _found(severity: str, rule: str, message: Column, fix: Column | None = None, entity: Column | None = None) -> Column:
    """A finding on the row at hand."""
    fields = (F.lit(severity), F.lit(rule), F.col("id") if entity is None else entity, F.col("file"), message, F.lit(None).cast("string") if fix is None else fix)
    return F.struct(*[c.cast("string").alias(name) for c, name in zip(fields, FINDING, strict=True)])


def _if(cond: Column, found: Column) -> Column:
    return F.when(cond, F.array(found)).otherwise(F.array().cast(FOUND))


def _finding(rows: DataFrame, severity: str, rule: str, message: Column, fix: Column | None = None) -> DataFrame:
    return rows.select(_found(severity, rule, message, fix).alias("x")).select("x.*")


def _gated(records: DataFrame) -> DataFrame:
    """``records`` with _gate: null for those that the other rules look at, else what is wrong (L1 to L3); and _first, the
    file that declared the id. Rows without an id are told apart by their file, so that they don't meet in one task."""
    corrupt = F.coalesce(F.col("corrupt"), F.lit(False)) if "corrupt" in records.columns else F.lit(False)
    why = F.when(corrupt, "no_frontmatter").when(_falsy(F.col("id")), "missing_id")
    rows = records.withColumn("_gate", why)
    by_id = Window.partitionBy(F.when(F.col("_gate").isNull(), F.col("id")), F.when(F.col("_gate").isNotNull(), F.col("file"))).orderBy("file")
    ranked = rows.withColumns({"_n": F.row_number().over(by_id), "_first": F.first("file").over(by_id)})
    return ranked.withColumn("_gate", F.coalesce("_gate", F.when(F.col("_n") > 1, "duplicate_id"))).drop("_n")


def gate(records: DataFrame) -> DataFrame:
    """The records that other rules look at: parsed, with an id, and the first file of it."""
    return _gated(records).where("_gate is null").drop("_gate", "_first")


def gate_rules() -> Column:
    """L1 to L3, of a row with _gate and _first."""
    at = lambda name: F.coalesce(F.col("_gate") == name, F.lit(False))
    return F.concat(
        _if(at("no_frontmatter"), _found("error", "no_frontmatter", F.lit("file has no front matter"), entity=F.lit(""))),
        _if(at("missing_id"), _found("error", "missing_id", F.lit("front matter has no id"), entity=F.lit(""))),
        _if(at("duplicate_id"), _found("error", "duplicate_id", F.concat(F.lit("id "), F.col("id"), F.lit(" already declared in "), F.col("_first")))),
    )


def record_rules(pack: Pack) -> Column:
    """L4 to L9 and L16: what a record shows by itself."""
    fields = F.filter(F.array(*[F.struct(F.lit(f).alias("f"), F.col(f).alias("v")) for f in REQUIRED]), lambda x: _falsy(x["v"]))
    missing = F.transform(fields, lambda x: _found("error", "missing_required_field", F.concat(F.lit("required field missing or empty: "), x["f"])))
    cls, stem = F.col("class"), F.regexp_replace("file", r"\.md$", "")
    excerpt = F.coalesce(cls == "Excerpt", F.lit(False))
    has = lambda prop: F.exists(F.coalesce(F.try_element_at("properties", F.lit(prop)), F.array().cast("array<string>")), lambda v: ~_falsy(v))
    lacks = lambda prop: F.coalesce(~has(prop), F.lit(True))
    out = [
        missing,
        _if(~_falsy(cls) & ~cls.isin(pack.class_names), _found("error", "unknown_class", F.concat(F.lit("class "), cls, F.lit(" is not declared")))),
        _if(stem != sanitize_id("id"), _found("warn", "filename_mismatch", F.concat(F.lit("file name does not match "), sanitize_id("id")))),
        _if(~_falsy(F.col("uri")) & ~F.endswith("uri", F.col("id")), _found("warn", "uri_id_mismatch", F.concat(F.lit("uri does not end with "), F.col("id")))),
        _if(excerpt & _falsy(F.col("source_section")), _found("warn", "excerpt_missing_source_section", F.lit("excerpt has no source_section"))),
        _if(F.coalesce(cls == "Theme", F.lit(False)) & lacks("hasSubtheme"), _found("info", "theme_without_subthemes", F.lit("theme has no hasSubtheme"))),
    ]
    out += [_if(excerpt & lacks(p), _found("warn", "excerpt_missing_property", F.lit(f"excerpt has no {p}"))) for p in EXCERPT_PROPS]
    return F.concat(*out)


def property_rules(pack: Pack) -> Column:
    """L10 and L11: undeclared properties, and declared ones on classes that are not under their domain."""
    names = F.coalesce(F.map_keys("properties"), F.array().cast("array<string>"))
    allowed: dict[str, list[str]] = {}
    for child, ancestor in pack.ancestors():
        allowed.setdefault(ancestor, []).append(child)
    unknown = F.filter(names, lambda p: ~p.isin([x.name for x in pack.properties]))
    out = [F.transform(unknown, lambda p: _found("error", "unknown_property", F.concat(F.lit("property "), p, F.lit(" is not declared"))))]
    for prop in pack.properties:
        if prop.domain:
            wrong = F.array_contains(names, prop.name) & ~_falsy(F.col("class")) & ~F.col("class").isin(allowed[prop.domain])
            message = F.concat(F.lit(f"property {prop.name} is only valid on {prop.domain}, not "), F.col("class"))
            out.append(_if(wrong, _found("error", "domain_violation", message, F.lit(f"move this triple onto a {prop.domain}"))))
    return F.concat(*out)


def links(entities: DataFrame, pack: Pack) -> DataFrame:
    """(id, class, file, prop, target): every value of a property that is not a datatype property, declared or not."""
    pairs = entities.select("id", "class", "file", F.explode(F.map_entries("properties")).alias("kv"))
    rows = pairs.where(~F.col("kv.key").isin(pack.datatype_props)).select("id", "class", "file", F.col("kv.key").alias("prop"), F.explode("kv.value").alias("v"))
    return rows.where(~_falsy(F.col("v"))).select("id", "class", "file", "prop", strip_link("v").alias("target"))


def self_rules(pack: Pack) -> Column:
    """L13: declared links of an entity to itself."""
    pairs = F.flatten(F.transform(F.map_entries("properties"), lambda kv: F.transform(kv["value"], lambda v: F.struct(kv["key"].alias("prop"), v.alias("v")))))
    own = F.filter(pairs, lambda x: x["prop"].isin(pack.object_props) & ~_falsy(x["v"]) & (strip_link(x["v"]) == F.col("id")))
    found = F.transform(own, lambda x: _found("warn", "self_reference", F.concat(F.lit("property "), x["prop"], F.lit(" links to its own entity"))))
    return F.coalesce(found, F.array().cast(FOUND))


def link_rules(entities: DataFrame, pack: Pack) -> list[DataFrame]:
    """L12, L14 and L15: links to nothing, and codes and subthemes that nothing links to."""
    edges = links(entities, pack)
    arrow = F.concat(F.lit("property "), F.col("prop"), F.lit(" links to "), F.col("target"), F.lit(", which does not exist"))
    dangling = edges.where(F.col("prop").isin(pack.object_props)).join(entities.select(F.col("id").alias("target")), "target", "left_anti")
    # A target that an excerpt links to is coded, one that a theme has as subtheme has a parent.
    made = F.when(F.col("class") == "Excerpt", "Code").when((F.col("class") == "Theme") & (F.col("prop") == "hasSubtheme"), "Subtheme")
    linked = edges.select(F.col("target").alias("id"), made.alias("class")).where("class is not null").distinct()
    orphans = entities.where("class in ('Code', 'Subtheme')").select("id", "file", "class").join(linked, ["id", "class"], "left_anti")
    fix = F.concat(F.lit("add hasSubtheme: [["), F.col("id"), F.lit("]] to its theme"))
    code = _found("warn", "orphan_code", F.lit("code is not linked from any excerpt"))
    subtheme = _found("warn", "orphan_subtheme", F.lit("subtheme is not linked from any theme"), fix)
    alone = orphans.select(F.when(F.col("class") == "Code", code).otherwise(subtheme).alias("x")).select("x.*")
    return [_finding(dangling, "warn", "dangling_wikilink", arrow), alone]


def lint(records: DataFrame, pack: Pack) -> DataFrame:
    """All findings. What a record shows by itself is one array per row, so one pass over the records; only links meet
    other entities."""
    rows = _gated(records)
    alone = F.when(F.col("_gate").isNull(), F.concat(record_rules(pack), property_rules(pack), self_rules(pack))).otherwise(gate_rules())
    found = [rows.select(F.inline(alone)), *link_rules(rows.where("_gate is null").drop("_gate", "_first"), pack)]
    return reduce(DataFrame.unionByName, found)


def severity_rank(c: str = "severity") -> Column:
    return F.when(F.col(c) == "error", 0).when(F.col(c) == "warn", 1).when(F.col(c) == "info", 2).otherwise(3)


def in_order(findings: DataFrame) -> DataFrame:
    return findings.orderBy(severity_rank(), "rule", "file")


def lint_summary(findings: DataFrame) -> DataFrame:
    """(severity, n) for all three severities, zeros included."""
    every = findings.sparkSession.createDataFrame([(s,) for s in SEVERITIES], "severity string")
    counts = findings.groupBy("severity").agg(F.count(F.lit(1)).alias("n"))
    return every.join(counts, "severity", "left").select("severity", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def strict_gate(findings: DataFrame, strict: bool = False) -> DataFrame:
    """One row: whether the records pass (no error; ``strict``: no warning either)."""
    bad = ("error", "warn") if strict else ("error",)
    return findings.where(F.col("severity").isin(*bad)).limit(1).agg((F.count(F.lit(1)) == 0).alias("passed"))
