"""Domain packs: the declared classes, properties and namespaces of a graph, as plain driver-side values.

A pack is tiny. Operators turn it into literal columns or one-row-per-declaration tables, which are safe to broadcast.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.pattern import path_plus

CLASS_NAME = re.compile(r"^[A-Z][A-Za-z0-9]*$")
PROPERTY_NAME = re.compile(r"^[a-z][A-Za-z0-9]*$")
ID_PATTERN = "^[a-z][a-z0-9_]*$"


@dataclass(frozen=True)
class Cls:
    name: str
    parent: str | None = None


@dataclass(frozen=True)
class Prop:
    name: str
    domain: str | None = None
    range: str | None = None
    iri: str | None = None
    datatype: bool = False


@dataclass(frozen=True)
class Pack:
    name: str
    prefix: str
    classes: tuple[Cls, ...]
    properties: tuple[Prop, ...]
    window_chars: int = 8000
    system_template: str = "Extract typed entities from document {doc_id}."
    user_template: str = "{few_shot}\nDocument: {doc_id}\nVersion: {prompt_version}\nText:\n{text_window}"
    few_shot: str = ""
    prompt_version: str = "v1"
    warnings: tuple[str, ...] = field(default=(), compare=False)

    def __post_init__(self) -> None:
        errors, warnings = check_references(self)
        if errors:
            raise ValueError("; ".join(errors))
        object.__setattr__(self, "warnings", tuple(warnings))

    @property
    def base_iri(self) -> str:
        return f"https://ontology.example.org/{self.name}/"

    @property
    def entity_iri(self) -> str:
        return f"{self.base_iri}entity/"

    @property
    def class_names(self) -> list[str]:
        return [c.name for c in self.classes]

    @property
    def datatype_props(self) -> list[str]:
        return [p.name for p in self.properties if p.datatype]

    @property
    def object_props(self) -> list[str]:
        return [p.name for p in self.properties if not p.datatype]

    def class_iri(self, name: str) -> str:
        return f"{self.prefix}:{name}"

    def property_iri(self, name: str) -> str:
        return next((p.iri for p in self.properties if p.name == name and p.iri), None) or f"{self.prefix}:{name}"

    def property_map(self) -> dict[str, str]:
        return {p.name: p.iri or f"{self.prefix}:{p.name}" for p in self.properties}

    def ancestors(self) -> list[tuple[str, str]]:
        """(class, ancestor) pairs, every class under itself; a cycle of parents ends where it closes."""
        parent = {c.name: c.parent for c in self.classes}
        pairs = []
        for name in parent:
            seen, at = set(), name
            while at is not None and at not in seen:
                seen.add(at)
                pairs.append((name, at))
                at = parent.get(at)
        return pairs


def check_references(pack: Pack) -> tuple[list[str], list[str]]:
    """Errors (bad names, unknown parents or domains, no class) and warnings (unknown ranges of object properties)."""
    names = {c.name for c in pack.classes}
    errors = [] if names else ["a pack needs a class"]
    errors += [f"bad class name {c.name}" for c in pack.classes if not CLASS_NAME.match(c.name)]
    errors += [f"bad property name {p.name}" for p in pack.properties if not PROPERTY_NAME.match(p.name)]
    errors += [f"class {c.name} has unknown parent {c.parent}" for c in pack.classes if c.parent and c.parent not in names]
    errors += [f"property {p.name} has unknown domain {p.domain}" for p in pack.properties if p.domain and p.domain not in names]
    warnings = [f"property {p.name} has unknown range {p.range}" for p in pack.properties if p.range and not p.datatype and p.range not in names]
    return errors, warnings


def classes_table(spark: SparkSession, pack: Pack) -> DataFrame:
    return spark.createDataFrame([(c.name, c.parent, pack.class_iri(c.name)) for c in pack.classes], "name string, parent string, iri string")


def props_table(spark: SparkSession, pack: Pack) -> DataFrame:
    rows = [(p.name, p.domain, p.range, pack.property_iri(p.name), p.datatype) for p in pack.properties]
    return spark.createDataFrame(rows, "name string, domain string, range string, iri string, datatype boolean")


def closure_table(spark: SparkSession, pack: Pack) -> DataFrame:
    return spark.createDataFrame(pack.ancestors(), "child string, ancestor string")


def class_closure(classes: DataFrame) -> DataFrame:
    """(child, ancestor) of a classes table (name, parent) of any size; each class under itself.

    Parents that are not declared end a chain; cycles close. The rounds are those of ``path_plus``."""
    declared = classes.select(F.col("name").alias("parent")).distinct()
    steps = classes.join(declared, "parent", "left_semi").select(F.col("name").alias("src"), F.col("parent").alias("dst"))
    above = path_plus(steps).select(F.col("src").alias("child"), F.col("dst").alias("ancestor"))
    return above.unionByName(classes.select(F.col("name").alias("child"), F.col("name").alias("ancestor"))).distinct()


COMPLIANCE = Pack(
    "compliance",
    "cco",
    (Cls("Statute"), Cls("Provision"), Cls("Definition", "Provision"), Cls("Regulator"), Cls("Obligation")),
    (
        Prop("definedIn", "Definition", "Provision"),
        Prop("enforcedBy", "Statute", "Regulator"),
        Prop("imposesObligationOn", "Obligation"),
        Prop("applicableTo"),
        Prop("relatedTo"),
        Prop("partOfStatute", None, "Statute", "dcterms:isPartOf"),
    ),
    8000,
)
THEMATIC = Pack(
    "thematic",
    "tha",
    (Cls("Theme"), Cls("Subtheme", "Theme"), Cls("Code"), Cls("Excerpt")),
    (
        Prop("hasSubtheme", "Theme", "Subtheme"),
        Prop("codedAs", "Excerpt", "Code"),
        Prop("supportsTheme", "Excerpt", "Theme"),
        Prop("spokenBy", "Excerpt", "xsd:string", datatype=True),
    ),
    12000,
)
LITERATURE = Pack(
    "literature",
    "lit",
    (Cls("Paper"), Cls("Claim"), Cls("Entity"), Cls("Methodology")),
    (
        Prop("citesPaper", None, "Paper"),
        Prop("makesClaim", "Paper", "Claim"),
        Prop("studiesEntity", "Paper", "Entity"),
        Prop("usesMethodology", "Claim", "Methodology"),
        Prop("supportsClaim", "Claim", "Claim"),
        Prop("publishedYear", "Paper", "xsd:integer", datatype=True),
        Prop("authorList", "Paper", "xsd:string", datatype=True),
    ),
    10000,
)
REGULATORY = Pack(
    "regulatory",
    "reg",
    (Cls("Filing"), Cls("Issuer"), Cls("Disclosure"), Cls("Regulator"), Cls("Obligation")),
    (
        Prop("filedBy", "Filing", "Issuer"),
        Prop("filedWith", "Filing", "Regulator"),
        Prop("containsDisclosure", "Filing", "Disclosure"),
        Prop("triggersObligation", "Disclosure", "Obligation"),
        Prop("filingDate", "Filing", "xsd:string", datatype=True),
        Prop("tickerSymbol", "Issuer", "xsd:string", datatype=True),
    ),
    10000,
)
PACKS = {p.name: p for p in (COMPLIANCE, THEMATIC, LITERATURE, REGULATORY)}
