"""The named competency questions: each a function of a graph's triples (and its constant, where it asks about one thing).

Rows come in the question's order; where that leaves ties, their order is open. Ranges are sorted in parallel.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from ..operators.pattern import LABEL, Lit, bgp, group_count, if_bound, labelled, of_class, optional, order_by, triple_pattern, type_name


def obligations_on(t: DataFrame, party: str) -> DataFrame:
    own = bgp(triple_pattern(t, "?obligation", "cco:imposesObligationOn", party), labelled(t, "obligation", "obligationLabel", "cco:Obligation"))
    rows = optional(own, triple_pattern(t, "?obligation", "dcterms:isPartOf", "?statute"), triple_pattern(t, "?statute", LABEL, "?statuteLabel"))
    return order_by(rows.select("obligation", "obligationLabel", "statute", "statuteLabel"), "obligationLabel")


def regulators(t: DataFrame) -> DataFrame:
    statutes = labelled(t, "statute", "statuteLabel", "cco:Statute")
    rows = bgp(triple_pattern(t, "?statute", "cco:enforcedBy", "?regulator"), statutes, labelled(t, "regulator", "regulatorLabel", "cco:Regulator"))
    return order_by(rows.select("regulator", "regulatorLabel", "statute", "statuteLabel"), "statuteLabel")


def definitions(t: DataFrame, statute: str) -> DataFrame:
    rows = bgp(triple_pattern(t, "?definition", "dcterms:isPartOf", statute), labelled(t, "definition", "label", "cco:Definition"))
    rows = optional(rows, triple_pattern(t, "?definition", "dcterms:source", "?section", "cco:Definition"))
    rows = optional(rows, triple_pattern(t, "?definition", "skos:definition", "?definitionText", "cco:Definition"))
    return order_by(rows.select("definition", "label", "section", "definitionText"), "label")


def codes_recur(t: DataFrame) -> DataFrame:
    # Counted per code before the join: a hot code is combined map-side and the optional side has one row per code.
    counts = group_count(triple_pattern(t, "?excerpt", "tha:codedAs", "?code"), ["code"], "excerpt", "n")
    rows = labelled(t, "code", "label", "tha:Code").join(counts, "code", "left").selectExpr("code", "label", "coalesce(n, 0) as nExcerpts")
    return order_by(rows, "-nExcerpts", "label")


def excerpts_per_theme(t: DataFrame) -> DataFrame:
    themes, excerpts = labelled(t, "theme", "themeLabel", "tha:Theme"), labelled(t, "excerpt", "excerptLabel", "tha:Excerpt")
    rows = optional(bgp(triple_pattern(t, "?excerpt", "tha:supportsTheme", "?theme"), themes, excerpts), triple_pattern(t, "?excerpt", "tha:spokenBy", "?speaker"))
    return order_by(rows.select("theme", "themeLabel", "excerpt", "excerptLabel", "speaker"), "themeLabel", "excerptLabel")


def excerpts_by_speaker(t: DataFrame, speaker: str) -> DataFrame:
    rows = bgp(triple_pattern(t, "?excerpt", "tha:spokenBy", Lit(speaker)), labelled(t, "excerpt", "excerptLabel", "tha:Excerpt"))
    rows = optional(rows, triple_pattern(t, "?excerpt", "skos:definition", "?text", "tha:Excerpt"))
    rows = optional(rows, triple_pattern(t, "?excerpt", "dcterms:source", "?section", "tha:Excerpt"))
    rows = optional(rows, triple_pattern(t, "?excerpt", "tha:codedAs", "?code"), triple_pattern(t, "?code", LABEL, "?codeLabel"))
    return order_by(rows.select("excerpt", "excerptLabel", "section", "text", "code", "codeLabel"), "section", "codeLabel")


def papers_per_concept(t: DataFrame) -> DataFrame:
    entities, papers = labelled(t, "entity", "entityLabel", "lit:Entity"), labelled(t, "paper", "paperLabel", "lit:Paper")
    rows = optional(bgp(triple_pattern(t, "?paper", "lit:studiesEntity", "?entity"), entities, papers), triple_pattern(t, "?paper", "lit:publishedYear", "?year"))
    return order_by(rows.select("entity", "entityLabel", "paper", "paperLabel", "year"), "entityLabel", "paperLabel")


def claims_by_methodology(t: DataFrame) -> DataFrame:
    methods, claims = labelled(t, "methodology", "methodLabel", "lit:Methodology"), labelled(t, "claim", "claimLabel", "lit:Claim")
    rows = bgp(triple_pattern(t, "?claim", "lit:usesMethodology", "?methodology"), methods, claims)
    return order_by(rows.select("methodology", "methodLabel", "claim", "claimLabel"), "methodLabel", "claimLabel")


def citing(t: DataFrame) -> DataFrame:
    """The label of what cites is in the order only."""
    cited = labelled(t, "citedPaper", "citedPaperLabel", "lit:Paper")
    rows = bgp(triple_pattern(t, "?claimOrPaper", "lit:citesPaper", "?citedPaper"), cited, triple_pattern(t, "?claimOrPaper", "rdf:type", "?type"))
    rows = optional(rows, triple_pattern(t, "?claimOrPaper", LABEL, "?label")).withColumn("by", if_bound("label", "claimOrPaper"))
    return order_by(rows, "citedPaperLabel", "by").select("claimOrPaper", type_name("type").alias("typeLabel"), "citedPaper", "citedPaperLabel")


def filings_by_issuer(t: DataFrame) -> DataFrame:
    issuers, filings = labelled(t, "issuer", "issuerLabel", "reg:Issuer"), labelled(t, "filing", "filingLabel", "reg:Filing")
    rows = bgp(triple_pattern(t, "?filing", "reg:filedBy", "?issuer"), issuers, filings)
    rows = optional(optional(rows, triple_pattern(t, "?issuer", "reg:tickerSymbol", "?ticker")), triple_pattern(t, "?filing", "reg:filingDate", "?date"))
    return order_by(rows.select("issuer", "ticker", "filing", "filingLabel", "date"), "ticker", "date", "filingLabel")


def disclosures_by_obligation(t: DataFrame) -> DataFrame:
    duties, disclosures = labelled(t, "obligation", "obligationLabel", "reg:Obligation"), labelled(t, "disclosure", "disclosureLabel", "reg:Disclosure")
    rows = bgp(triple_pattern(t, "?disclosure", "reg:triggersObligation", "?obligation"), disclosures, duties)
    rows = optional(rows, triple_pattern(t, "?filing", "reg:containsDisclosure", "?disclosure"), labelled(t, "filing", "filingLabel", "reg:Filing"))
    rows = rows.select("obligation", "obligationLabel", "disclosure", "disclosureLabel", "filing", "filingLabel")
    return order_by(rows, "obligationLabel", "disclosureLabel")


def obligations_by_regulator(t: DataFrame) -> DataFrame:
    """Three hops; pairs are made distinct before the labels are joined, which is the same as after."""
    filed = of_class(triple_pattern(t, "?filing", "reg:filedWith", "?regulator"), t, "filing", "reg:Filing")
    hops = bgp(triple_pattern(t, "?filing", "reg:containsDisclosure", "?disclosure"), filed, triple_pattern(t, "?disclosure", "reg:triggersObligation", "?obligation"))
    pairs = hops.select("regulator", "obligation").distinct()
    rows = bgp(pairs, labelled(t, "regulator", "regulatorLabel", "reg:Regulator"), triple_pattern(t, "?obligation", LABEL, "?obligationLabel"))
    return order_by(rows.select("regulator", "regulatorLabel", "obligation", "obligationLabel"), "regulatorLabel", "obligationLabel")


#: pack -> id -> question. A project's own questions go first, these are the fallback.
QUESTIONS: dict[str, dict[str, Callable[..., DataFrame]]] = {
    "compliance": {"cq1": obligations_on, "cq2": regulators, "cq3": definitions},
    "thematic": {"cq1": codes_recur, "cq2": excerpts_per_theme, "cq3": excerpts_by_speaker},
    "literature": {"cq1": papers_per_concept, "cq2": claims_by_methodology, "cq3": citing},
    "regulatory": {"cq1": filings_by_issuer, "cq2": disclosures_by_obligation, "cq3": obligations_by_regulator},
}


def resolve(pack: str, cq_id: str, own: dict[str, Callable[..., DataFrame]] | None = None) -> Callable[..., DataFrame]:
    found = (own or {}).get(cq_id) or QUESTIONS.get(pack, {}).get(cq_id)
    if found is None:
        raise KeyError(f"no question {cq_id} in pack {pack}")
    return found
