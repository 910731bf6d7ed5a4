"""Proposals to change a graph, and their application.

Proposals: proposal_id, operation, status, confidence, kept_id, removed_id, new_subtheme_label, parent_theme_id, member_code_ids,
from_id, property, to_id, entity_id, new_label, rationale, evidence, reviewer_notes, model_snapshot, created_at.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import subtheme_slug
from ..plans.pack import Pack
from ..sources.shared import Scratch, cut
from .components import components

OPERATIONS = ("merge_entities", "group_codes", "link_hierarchy", "rename_label")
STATUSES = ("pending", "approved", "rejected", "deferred", "applied")
PAYLOAD = {
    "merge_entities": ("kept_id", "removed_id"),
    "group_codes": ("new_subtheme_label", "parent_theme_id", "member_code_ids"),
    "link_hierarchy": ("from_id", "property", "to_id"),
    "rename_label": ("entity_id", "new_label"),
}
FIELDS = {
    "kept_id": "string", "removed_id": "string", "new_subtheme_label": "string", "parent_theme_id": "string", "member_code_ids": "array<string>",
    "from_id": "string", "property": "string", "to_id": "string", "entity_id": "string", "new_label": "string",
}
RAW = "operation string, rationale string, confidence string, evidence array<string>, " + ", ".join(f"{k} {v}" for k, v in FIELDS.items())


def _op(rows: DataFrame, operation: str, **given: Column) -> DataFrame:
    cols = [F.lit(operation).alias("operation")]
    cols += [given.get(k, F.lit(None)).cast(t).alias(k) for k, t in FIELDS.items()]
    return rows.select(*cols, given.get("rationale", F.lit("")).alias("rationale"), given.get("confidence", F.lit("medium")).alias("confidence"))


# ---- candidates -------------------------------------------------------------------------------------------------


def propose_merges(entities: DataFrame, threshold: float = 0.5, least: int = 1) -> DataFrame:
    """Pairs of one class whose label words have a Jaccard similarity of ``threshold`` or more (0.5 suits short labels).

    Prefix-filtered: words are ordered rarest first, and two sets as similar as that share one of their first
    n - ceil(t n) + 1; a common word alone never makes a candidate of two longer labels. Equal word sets are chained to the
    smallest id instead of expanded into pairs.
    """
    words = F.array_sort(F.array_distinct(F.filter(F.split(F.lower("label"), r"[^a-z0-9]+"), lambda w: w != "")))
    sets = entities.select("id", "class", words.alias("ws")).where(F.size("ws") >= least)
    heads = sets.groupBy("class", "ws").agg(F.min("id").alias("head"))
    same = sets.join(heads, ["class", "ws"]).where("id <> head").select(F.col("head").alias("kept_id"), F.col("id").alias("removed_id"))
    freq = heads.select("class", F.explode("ws").alias("w")).groupBy("class", "w").agg(F.count(F.lit(1)).alias("n"))
    ranked = heads.select("class", "head", "ws", F.explode("ws").alias("w")).join(freq, ["class", "w"]).groupBy("class", "head", "ws").agg(F.sort_array(F.collect_list(F.struct("n", "w"))).alias("r"))
    keep = (F.size("ws") - F.ceil(F.lit(threshold) * F.size("ws") - 1e-9) + 1).cast("int")
    prefix = ranked.select("class", "head", "ws", F.explode(F.slice("r", F.lit(1), keep)).alias("x")).select("class", F.col("x.w").alias("w"), "head", "ws")
    a, b = prefix.alias("a"), prefix.alias("b")
    near = F.size(F.array_intersect("a.ws", "b.ws")) >= F.lit(threshold) * F.size(F.array_union("a.ws", "b.ws")) - 1e-9
    found = a.join(b, (F.col("a.class") == F.col("b.class")) & (F.col("a.w") == F.col("b.w")) & (F.col("a.head") < F.col("b.head")) & near)
    pairs = found.select(F.col("a.head").alias("kept_id"), F.col("b.head").alias("removed_id")).distinct().unionByName(same)
    return _op(pairs, "merge_entities", kept_id=F.col("kept_id"), removed_id=F.col("removed_id"), rationale=F.lit("labels share most words"))


def propose_groups(edges: DataFrame, least: int = 2, code_prop: str = "codedAs", theme_prop: str = "supportsTheme") -> DataFrame:
    """Per theme the codes that at least ``least`` of its excerpts carry, where there are two or more.

    Counts are combined per (theme, code) before codes meet, so a theme with millions of excerpts stays a few rows."""
    codes = edges.where(F.col("prop") == code_prop).select("src", F.col("dst").alias("code"))
    themes = edges.where(F.col("prop") == theme_prop).select("src", F.col("dst").alias("theme"))
    shared = themes.join(codes, "src").groupBy("theme", "code").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    groups = shared.groupBy("theme").agg(F.array_sort(F.collect_list("code")).alias("codes")).where(F.size("codes") >= 2)
    return _op(groups, "group_codes", parent_theme_id=F.col("theme"), member_code_ids=F.col("codes"), new_subtheme_label=F.concat(F.lit("Group under "), F.col("theme")))


#: Labels of up to so many characters are keyed by what is left when one of them goes, longer ones by their halves.
SHORT_LABEL = 64
#: A key that more labels share is split.
CROWD = 1000


def _respelling_keys(text: Column) -> Column:
    """Keys of which two labels share one if a letter added, left out, changed or swapped with the next makes one of them the other."""
    n = F.length(text)
    left = F.transform(F.sequence(F.lit(1), n), lambda i: F.xxhash64(F.lit("short"), F.concat(F.substring(text, F.lit(1), i - 1), F.substring(text, i + 1, n))))
    short = F.when(n <= SHORT_LABEL + 1, F.concat(F.array(F.xxhash64(F.lit("short"), text)), F.when(n > 0, left).otherwise(F.array().cast("array<bigint>")))).otherwise(F.array().cast("array<bigint>"))

    # Of two labels the shorter one's length m tells how much of either end both have in common: one change leaves the first or the last (m - 1) / 2 alone.
    def halves(m: Column) -> Column:
        k = F.floor((m - 1) / 2).cast("int")
        return F.array(F.xxhash64(F.lit("begin"), m, F.substring(text, F.lit(1), k)), F.xxhash64(F.lit("end"), m, F.substring(text, n - k + 1, k)))

    long = F.when(n >= SHORT_LABEL, F.concat(halves(n), halves(n - 1))).otherwise(F.array().cast("array<bigint>"))
    return F.array_distinct(F.concat(short, long))


def _respelled(a: Column, b: Column) -> Column:
    """Whether one change makes b of a: a letter added, left out, changed, or swapped with the next."""
    swapped = lambda i: F.concat(F.substring(a, F.lit(1), i - 1), F.substring(a, i + 1, F.lit(1)), F.substring(a, i, F.lit(1)), F.substring(a, i + 2, F.length(a)))
    # The letters that differ are the first and second from where the two part.
    parts = F.coalesce(F.array_position(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: x == y), F.lit(False)), F.lit(0)).cast("int")
    return (F.levenshtein(a, b, 1) >= 0) | ((F.length(a) == F.length(b)) & (parts > 0) & (swapped(parts) == b))


def propose_respelled(entities: DataFrame, crowd: int = CROWD) -> DataFrame:
    """Pairs of one class whose labels differ by one letter that is added, left out, changed or swapped with the next; letter case, and space
    at the ends and between words, don't count. The entity with the smaller id is kept.

    Deletion neighbourhoods: a label is keyed by all that is left of it when one letter goes, so such labels share a key and meet in an equality
    join; labels of more than 64 characters are keyed by their halves instead. Equal labels are one row (their smallest id); those pairs are
    ``propose_merges``'. Keys that only one label has are left out before labels meet, a key that more than ``crowd`` share is
    split into as many parts. Null and empty labels are like none.
    """
    text = F.trim(F.regexp_replace(F.lower("label"), r"\s+", " "))
    heads = entities.select("id", "class", text.alias("text")).where("text <> ''").groupBy("class", "text").agg(F.min("id").alias("head"))
    keyed = heads.select("class", "head", "text", F.explode(_respelling_keys(F.col("text"))).alias("key"))
    shared = keyed.groupBy("class", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    met = keyed.join(shared.select("class", "key", F.ceil(F.col("n") / crowd).cast("int").alias("parts")), ["class", "key"])
    one = met.withColumn("part", F.pmod(F.xxhash64("head"), F.col("parts")).cast("int")).alias("a")
    every = met.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).alias("b")
    same = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("class", "key", "part")]
    pairs = one.join(every, reduce(lambda x, y: x & y, same) & (F.col("a.head") < F.col("b.head"))).select(F.col("a.head").alias("kept_id"), F.col("b.head").alias("removed_id"), F.col("a.text").alias("x"), F.col("b.text").alias("y")).distinct()
    found = pairs.where(_respelled(F.col("x"), F.col("y")))
    return _op(found, "merge_entities", kept_id=F.col("kept_id"), removed_id=F.col("removed_id"), rationale=F.lit("labels differ by one letter"))


def cohering_codes(edges: DataFrame, least: int = 2, lift: float = 1.2, wide: int = 50, code_prop: str = "codedAs", theme_prop: str = "supportsTheme") -> DataFrame:
    """(theme, group_id, code): codes that cohere under a theme; a group is named by its smallest code.

    Two codes of a theme cohere if ``least`` or more of its excerpts carry both, and ``lift`` times as many as if they came independently of each other:
    both * excerpts >= lift * one * other, counted over the theme's excerpts with codes. Groups are the components of these pairs.

    Two codes are together at most as often as the rarer one comes, so a code that more than 1 / ``lift`` of a theme's excerpts carry coheres with none, and is left out
    before codes are paired. Excerpts with the same other codes are counted first, and a set of codes is looked at once. Sets of up to ``wide`` codes are spelled out in pairs. In wider
    ones, codes that are in the same of them are a class, and classes are paired, not codes: over the pair's wide sets every two codes of
    two classes are together equally often, so a code coheres with some code of the other class if it does so with the rarest. So links to the
    rarest hold the groups together, and an excerpt with any number of codes makes a few rows for each. Pairs of narrow sets get what
    their classes add.
    """
    codes = edges.where(F.col("prop") == code_prop).select("src", F.col("dst").alias("code"))
    themes = edges.where(F.col("prop") == theme_prop).select("src", F.col("dst").alias("theme"))
    marks = lambda c: [F.bit_xor(F.xxhash64(c)).alias("m1"), F.sum(F.shiftright(F.xxhash64(F.lit("set"), c), 24)).alias("m2"), F.count(F.lit(1)).alias("k")]
    with Scratch(edges.sparkSession, "codes") as scratch:
        told = scratch.keep(themes.join(codes, "src").distinct())
        total = scratch.keep(told.select("theme", "src").distinct().groupBy("theme").agg(F.count(F.lit(1)).alias("total")))
        n = scratch.keep(told.groupBy("theme", "code").agg(F.count(F.lit(1)).alias("n")))
        # A little more than the bound, as products of floating point are rounded. Such codes are fewer than lift times the codes of a mean excerpt.
        common = scratch.keep(n.join(total, "theme").where(F.lit(lift) * F.col("n") > F.col("total") * (1 + 1e-9)).select("theme", "code"))
        told = told.join(common, ["theme", "code"], "left_anti")
        sets = told.groupBy("theme", "src").agg(*marks("code")).groupBy("theme", "m1", "m2", "k").agg(F.min("src").alias("src"), F.count(F.lit(1)).alias("w")).where("k > 1")
        sets = scratch.keep(sets.select("theme", "src", "w", "k"))
        held = scratch.keep(told.join(sets, ["theme", "src"]))  # each different set once: theme, src (its name), code, w, k
        narrow = held.where(F.col("k") <= wide).groupBy("theme", "src", "w").agg(F.array_sort(F.collect_list("code")).alias("codes"))
        first = narrow.select("theme", "w", "codes", F.posexplode("codes").alias("i", "a"))
        pairs = first.select("theme", "w", "a", F.explode(F.slice("codes", F.col("i") + 2, F.size("codes"))).alias("b")).groupBy("theme", "a", "b").agg(F.sum("w").alias("both"))
        pairs = scratch.keep(pairs)
        links = None
        if not held.where(F.col("k") > wide).isEmpty():
            broad = held.where(F.col("k") > wide)
            classed = broad.groupBy("theme", "code").agg(*marks("src")).select("theme", "code", F.struct("m1", "m2", "k").alias("class"))
            classed = scratch.keep(classed.join(n, ["theme", "code"]))
            sized = scratch.keep(broad.join(classed.select("theme", "code", "class"), ["theme", "code"]).select("theme", "src", "w", "class").distinct())
            x, y = sized.withColumnRenamed("class", "c"), sized.select("theme", "src", F.col("class").alias("d"))
            shared = scratch.keep(x.join(y, ["theme", "src"]).groupBy("theme", "c", "d").agg(F.sum("w").alias("both")))  # both orders, and each class with itself
            rare = classed.groupBy("theme", F.col("class").alias("d")).agg(F.min(F.struct("n", "code")).alias("r"))
            stars = classed.withColumnRenamed("class", "c").join(shared.where(F.col("both") >= least), ["theme", "c"]).join(rare, ["theme", "d"]).join(total, "theme")
            links = stars.where((F.col("code") != F.col("r.code")) & (F.col("both") * F.col("total") >= F.lit(lift) * F.col("n") * F.col("r.n"))).select("theme", F.col("code").alias("a"), F.col("r.code").alias("b"))
            side = lambda end, c: classed.select("theme", F.col("code").alias(end), F.col("class").alias(c))
            more = pairs.join(side("a", "c"), ["theme", "a"], "left").join(side("b", "d"), ["theme", "b"], "left").join(shared.withColumnRenamed("both", "more"), ["theme", "c", "d"], "left")
            pairs = more.select("theme", "a", "b", (F.col("both") + F.coalesce("more", F.lit(0))).alias("both"))
        side = lambda end: n.select("theme", F.col("code").alias(end), F.col("n").alias(f"n_{end}"))
        judged = pairs.where(F.col("both") >= least).join(side("a"), ["theme", "a"]).join(side("b"), ["theme", "b"]).join(total, "theme")
        found = judged.where(F.col("both") * F.col("total") >= F.lit(lift) * F.col("n_a") * F.col("n_b")).select("theme", "a", "b")
        found = found if links is None else found.unionByName(links)
        node = lambda c: F.struct("theme", F.col(c).alias("code")).alias(c)
        return components(found.select(node("a"), node("b"))).select("node.theme", F.col("root.code").alias("group_id"), "node.code")


def propose_coherent_groups(edges: DataFrame, least: int = 2, lift: float = 1.2, code_prop: str = "codedAs", theme_prop: str = "supportsTheme") -> DataFrame:
    """A new subtheme for each group of codes that cohere under a theme (``cohering_codes``)."""
    found = cohering_codes(edges, least, lift, code_prop=code_prop, theme_prop=theme_prop)
    groups = found.groupBy("theme", "group_id").agg(F.array_sort(F.collect_list("code")).alias("codes"))
    return _op(groups, "group_codes", parent_theme_id=F.col("theme"), member_code_ids=F.col("codes"), new_subtheme_label=F.concat(F.lit("Group of "), F.col("group_id")), rationale=F.lit("excerpts carry these codes together"))


def propose_links(edges: DataFrame, child_prop: str = "supportsTheme", parent_prop: str = "hasSubtheme") -> DataFrame:
    """The reverse link where a child points at a parent that does not point back."""
    gaps = edges.where(F.col("prop") == child_prop).select(F.col("dst").alias("src"), F.col("src").alias("dst")).distinct()
    missing = gaps.join(edges.where(F.col("prop") == parent_prop).select("src", "dst"), ["src", "dst"], "left_anti")
    return _op(missing, "link_hierarchy", from_id=F.col("src"), property=F.lit(parent_prop), to_id=F.col("dst"))


def propose_renames(entities: DataFrame) -> DataFrame:
    """Labels in a letter case that most of their class don't have get that case."""
    style = F.when(F.col("label") == F.lower("label"), "lower").when(F.col("label") == F.upper("label"), "upper").when(F.col("label") == F.initcap("label"), "title").otherwise("sentence")
    styled = entities.where("label is not null and label <> ''").select("id", "class", "label", style.alias("style"))
    counts = styled.groupBy("class", "style").agg(F.count(F.lit(1)).alias("n"))
    main = counts.groupBy("class").agg(F.max_by("style", F.struct("n", "style")).alias("main"), F.max("n").alias("n"), F.sum("n").alias("all")).where("2 * n > all")
    odd = styled.join(main, "class").where("style <> main")
    new = F.when(F.col("main") == "lower", F.lower("label")).when(F.col("main") == "upper", F.upper("label")).when(F.col("main") == "title", F.initcap("label")).otherwise(F.concat(F.upper(F.substring("label", 1, 1)), F.lower(F.expr("substring(label, 2)"))))
    return _op(odd.where(new != F.col("label")), "rename_label", entity_id=F.col("id"), new_label=new)


# ---- the proposal table -----------------------------------------------------------------------------------------


def normalize_proposals(raw: DataFrame, json_col: str = "response") -> DataFrame:
    """Proposals out of response JSON (an array under ``proposals``): each keeps its operation's payload only; confidence
    is ``medium`` and evidence empty where not given. Bad JSON gives no row, an unknown operation no payload."""
    parsed = raw.select(F.explode(F.from_json(json_col, f"struct<proposals:array<struct<{', '.join(x.replace(' ', ':', 1) for x in RAW.split(', '))}>>>")["proposals"]).alias("p")).select("p.*")
    keep = {k: F.when(F.col("operation").isin([op for op, ks in PAYLOAD.items() if k in ks]), F.col(k)) for k in FIELDS}
    return parsed.select(
        "operation", *[c.alias(k) for k, c in keep.items()], F.coalesce("rationale", F.lit("")).alias("rationale"), F.coalesce(F.nullif("confidence", F.lit("")), F.lit("medium")).alias("confidence"), F.coalesce("evidence", F.array().cast("array<string>")).alias("evidence")
    )


def _quoted(c: Column) -> Column:
    return F.coalesce(F.concat(F.lit("'"), c, F.lit("'")), F.lit("None"))


def fingerprint() -> Column:
    """The first 8 hex digits of the SHA-1 of operation and key fields, written as nested tuples of quoted strings."""
    c = F.col
    members = F.array_sort(F.coalesce("member_code_ids", F.array().cast("array<string>")))
    listed = F.array_join(F.transform(members, lambda m: F.concat(F.lit("'"), m, F.lit("'"))), ", ")
    member_tuple = F.concat(F.lit("("), listed, F.when(F.size(members) == 1, F.lit(",")).otherwise(F.lit("")), F.lit(")"))
    keys = {
        "merge_entities": F.concat(_quoted(c("kept_id")), F.lit(", "), _quoted(c("removed_id"))),
        "group_codes": F.concat(_quoted(c("parent_theme_id")), F.lit(", "), member_tuple),
        "link_hierarchy": F.concat(_quoted(c("from_id")), F.lit(", "), _quoted(c("property")), F.lit(", "), _quoted(c("to_id"))),
        "rename_label": F.concat(_quoted(c("entity_id")), F.lit(",")),
    }
    key = F.lit("'{}',")
    for op, k in keys.items():
        key = F.when(c("operation") == op, k).otherwise(key)
    return F.substring(F.sha1(F.concat(F.col("operation"), F.lit("|("), key, F.lit(")")).cast("binary")), 1, 8)


def with_ids(proposals: DataFrame) -> DataFrame:
    return proposals.withColumn("proposal_id", F.concat(F.lit("proposal_"), fingerprint())).dropDuplicates(["proposal_id"])


def upsert_proposals(existing: DataFrame, new: DataFrame) -> DataFrame:
    """``new`` over ``existing`` by proposal_id: fields are refreshed, the status and reviewer notes of known ones stay, and
    proposals that were not made again stay as they are."""
    fields = [c for c in new.columns if c not in ("proposal_id", "status", "reviewer_notes")]
    e, n = existing.alias("e"), new.alias("n")
    joined = e.join(n, F.col("e.proposal_id") == F.col("n.proposal_id"), "full_outer")
    fresh = F.col("n.proposal_id").isNotNull()
    return joined.select(
        F.coalesce("n.proposal_id", "e.proposal_id").alias("proposal_id"),
        F.coalesce("e.status", F.lit("pending")).alias("status"),
        F.col("e.reviewer_notes").alias("reviewer_notes"),
        *[F.when(fresh, F.col(f"n.{c}")).otherwise(F.col(f"e.{c}")).alias(c) for c in fields],
    )


def set_status(proposals: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(proposals with the latest valid decision, decisions refused). Decisions: proposal_id, status, notes, seq.
    Notes stay where a decision gives none; an unknown status or proposal is refused."""
    valid = F.col("status").isin(*STATUSES)
    known = decisions.join(proposals.select("proposal_id"), "proposal_id", "left_semi")
    refused = decisions.where(~F.coalesce(valid, F.lit(False))).withColumn("reason", F.lit("invalid status"))
    stray = decisions.where(valid).join(proposals.select("proposal_id"), "proposal_id", "left_anti").withColumn("reason", F.lit("unknown proposal"))
    last = Window.partitionBy("proposal_id").orderBy(F.col("seq").desc())
    latest = known.where(valid).withColumn("_n", F.row_number().over(last)).where("_n = 1").select("proposal_id", F.col("status").alias("_status"), F.col("notes").alias("_notes"))
    out = proposals.join(latest, "proposal_id", "left").withColumn("status", F.coalesce("_status", "status")).withColumn("reviewer_notes", F.coalesce("_notes", "reviewer_notes")).drop("_status", "_notes")
    return out, refused.unionByName(stray)


def proposal_counts(proposals: DataFrame) -> DataFrame:
    every = proposals.sparkSession.createDataFrame([(s,) for s in STATUSES], "status string")
    counts = proposals.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
    return every.join(counts, "status", "left").select("status", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def payload_summary() -> Column:
    """One English line on what a proposal does."""
    none = lambda c: F.coalesce(F.col(c), F.lit("None"))
    # The lines' wording is part of the output.
    lines = {
        "merge_entities": F.format_string("Keep `%s`, remove `%s`.", none("kept_id"), none("removed_id")),
        "group_codes": F.format_string("New Subtheme '%s' under `%s` (%d member code(s)).", none("new_subtheme_label"), none("parent_theme_id"), F.size(F.coalesce("member_code_ids", F.array().cast("array<string>")))),
        "link_hierarchy": F.format_string("`%s` —%s→ `%s`.", none("from_id"), none("property"), none("to_id")),
        "rename_label": F.format_string("`%s` → label '%s'.", none("entity_id"), none("new_label")),
    }
    out = F.coalesce(F.nullif("operation", F.lit("")), F.lit("?"))
    for op, line in lines.items():
        out = F.when(F.col("operation") == op, line).otherwise(out)
    return out


def preview_edges(proposals: DataFrame) -> DataFrame:
    """(proposal_id, src, dst, label, change): the edges that a proposal adds, implies or removes."""
    edge = lambda s, d, label, change: F.struct(s.cast("string").alias("src"), d.cast("string").alias("dst"), label.alias("label"), F.lit(change).alias("change"))
    c = F.col
    new = F.concat(F.lit("NEW:"), c("new_subtheme_label"))
    by_op = {
        "merge_entities": F.array(edge(c("removed_id"), c("kept_id"), F.lit("merge into"), "remove")),
        "group_codes": F.concat(
            F.array(edge(c("parent_theme_id"), new, F.lit("hasSubtheme"), "add")), F.transform(F.coalesce("member_code_ids", F.array().cast("array<string>")), lambda m: edge(new, m, F.lit("(implied)"), "imply"))
        ),
        "link_hierarchy": F.array(edge(c("from_id"), c("to_id"), c("property"), "add")),
        "rename_label": F.array(edge(c("entity_id"), c("entity_id"), c("new_label"), "relabel")),
    }
    return reduce(lambda a, b: a.unionByName(b), [proposals.where(c("operation") == op).select("proposal_id", F.inline(x)) for op, x in by_op.items()])


# ---- application ------------------------------------------------------------------------------------------------


def apply_renames(entities: DataFrame, renames: DataFrame) -> DataFrame:
    """``renames``: entity_id, new_label, seq; the last one counts."""
    last = renames.groupBy(F.col("entity_id").alias("id")).agg(F.max_by("new_label", "seq").alias("_label"))
    return entities.join(last, "id", "left").withColumn("label", F.coalesce("_label", "label")).drop("_label").select(*entities.columns)


def apply_links(edges: DataFrame, links: DataFrame) -> DataFrame:
    """``edges`` (src, prop, dst) with ``links`` added where absent; targets need not exist."""
    return edges.unionByName(links.select("src", "prop", "dst")).distinct()


def merge_roots(merges: DataFrame) -> DataFrame:
    """(removed, kept) of merges (kept_id, removed_id, seq) with chains followed to their end, by pointer jumping.

    A removed id's first merge counts; a merge whose kept id is already removed by an earlier one, or is itself, fails and is left out. So
    a valid merge's kept id is removed later or never, and chains end. Each jump doubles, and is checkpointed.
    """
    once = merges.where("kept_id <> removed_id").groupBy("removed_id").agg(F.min(F.struct("seq", "kept_id")).alias("m"))
    once = once.select("removed_id", "m.seq", "m.kept_id")
    gone = once.select(F.col("removed_id").alias("kept_id"), F.col("seq").alias("_seq"))
    valid = cut(once.join(gone, "kept_id", "left").where("_seq is null or _seq > seq").select(F.col("removed_id").alias("removed"), F.col("kept_id").alias("kept")))
    while True:
        up = valid.select(F.col("removed").alias("kept"), F.col("kept").alias("_up"))
        new = cut(valid.join(up, "kept", "left").select("removed", F.coalesce("_up", "kept").alias("kept"), F.col("_up").isNotNull().alias("moved")))
        if new.where("moved").isEmpty():
            return valid
        valid = new.select("removed", "kept")


#: A link inside a text (fixed value).
LINK = r"\[\[(.+?)\]\]"


def rewrite_links(rows: DataFrame, roots: DataFrame, text_col: str) -> DataFrame:
    """``rows`` with the links ``[[removed]]`` inside ``text_col`` pointing to the kept id of ``roots`` (removed, kept). Texts without a link
    aren't shuffled; of the others, equal texts are looked up once."""
    has = F.coalesce(F.col(text_col).rlike(LINK), F.lit(False))
    linked = rows.where(has).withColumn("_t", F.xxhash64(text_col))
    ids = F.transform(F.regexp_extract_all(text_col, F.lit(LINK), F.lit(1)), lambda x: F.trim(x))
    named = linked.select("_t", F.explode(F.array_distinct(ids)).alias("removed")).distinct().join(roots.select("removed", "kept"), "removed")
    maps = named.groupBy("_t").agg(F.map_from_entries(F.collect_list(F.struct("removed", "kept"))).alias("_to"))
    whole, between = F.regexp_extract_all(text_col, F.lit(LINK), F.lit(0)), F.split(text_col, LINK, -1)

    def piece(s: Column, i: Column) -> Column:
        kept = F.try_element_at(F.col("_to"), F.get(ids, i))
        return F.concat(s, F.coalesce(F.concat(F.lit("[["), kept, F.lit("]]")), F.get(whole, i), F.lit("")))

    new = F.when(F.col("_to").isNull(), F.col(text_col)).otherwise(F.array_join(F.transform(between, piece), ""))
    done = linked.join(maps, "_t", "left").withColumn(text_col, new).select(*rows.columns)
    return rows.where(~has).unionByName(done)


def apply_merges(entities: DataFrame, edges: DataFrame, merges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entities, edges) after merges: links to removed ids go to the kept ones, in edges and inside the texts (source_text and body, where
    there are such columns); removed rows and their own links go.

    A removed entity's properties are dropped, not moved. A kept entity that linked to the removed one now links to itself.
    A few hot targets don't hurt: the map of merges has a row per removed id, so each edge meets at most one."""
    roots = merge_roots(merges)
    left = entities.join(roots.select(F.col("removed").alias("id")), "id", "left_anti").select(*entities.columns)
    for text_col in ("source_text", "body"):
        if text_col in left.columns:
            left = rewrite_links(left, roots, text_col)
    moved = edges.join(roots.select(F.col("removed").alias("dst"), F.col("kept").alias("_to")), "dst", "left").select("src", "prop", F.coalesce("_to", "dst").alias("dst"))
    return left, moved.join(roots.select(F.col("removed").alias("src")), "src", "left_anti").select("src", "prop", "dst").distinct()


def subtheme_rows(groups: DataFrame, entities: DataFrame, pack: Pack) -> DataFrame:
    """What a valid group proposal creates: proposal_id, parent, id, label, uri, source_document, n_members."""
    parents = entities.select(F.col("id").alias("parent_theme_id"), F.col("source_document").alias("_doc"))
    rows = groups.where("new_subtheme_label <> '' and parent_theme_id <> ''").join(parents, "parent_theme_id")
    new_id = F.concat(F.coalesce(F.nullif("_doc", F.lit("")), F.lit("doc")), F.lit("_subtheme_"), subtheme_slug("new_subtheme_label"))
    named = rows.select("proposal_id", F.col("parent_theme_id").alias("parent"), new_id.alias("id"), F.col("new_subtheme_label").alias("label"), F.size(F.coalesce("member_code_ids", F.array().cast("array<string>"))).alias("n_members"))
    first = named.withColumn("_n", F.row_number().over(Window.partitionBy("id").orderBy("proposal_id"))).where("_n = 1").drop("_n")
    return first.join(entities.select("id"), "id", "left_anti").withColumn("uri", F.concat(F.lit(pack.entity_iri), F.col("id")))


def apply_groups(entities: DataFrame, edges: DataFrame, groups: DataFrame, pack: Pack) -> tuple[DataFrame, DataFrame]:
    """(entities, edges) with a Subtheme per valid group and its parent's link to it; codes get no new link."""
    new = subtheme_rows(groups, entities, pack)
    rows = new.select(
        *[
            {
                "class": F.lit("Subtheme"), "id": F.col("id"), "label": F.col("label"), "uri": F.col("uri"), "source_section": F.lit("consolidator"),
                "source_text": F.concat(F.lit("Subtheme grouping "), F.col("n_members").cast("string"), F.lit(" codes.")),
            }.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name)
            for f in entities.schema
        ]
    )
    return entities.unionByName(rows), apply_links(edges, new.select(F.col("parent").alias("src"), F.lit("hasSubtheme").alias("prop"), F.col("id").alias("dst")))


def _new_ids(groups: DataFrame, entities: DataFrame, scratch: Scratch) -> DataFrame:
    """(proposal_id, doc, makes) of group proposals whose parent is an entity or what another one makes: the document and the id of the new subtheme."""
    asked = entities.join(groups.select(F.col("need").alias("id")).distinct(), "id", "left_semi")
    docs = asked.select(F.col("id").alias("need"), F.coalesce(F.nullif("source_document", F.lit("")), F.lit("doc")).alias("doc")).groupBy("need").agg(F.min("doc").alias("doc"))
    made = groups.select("proposal_id", "need", subtheme_slug("new_subtheme_label").alias("slug"))
    named = None
    while True:
        new = scratch.keep(made.join(docs, "need").select("proposal_id", "doc", F.concat("doc", F.lit("_subtheme_"), "slug").alias("makes")))
        if named is not None and new.isEmpty():
            return named
        named = new if named is None else named.unionByName(new)
        # Parents that this round has named; what has its name already is done.
        made = made.join(new.select("proposal_id"), "proposal_id", "left_anti")
        docs = new.groupBy(F.col("makes").alias("need")).agg(F.min("doc").alias("doc"))


def in_order(proposals: DataFrame, entities: DataFrame, scratch: Scratch) -> DataFrame:
    """Approved proposals, each judged as it meets what those before it (by proposal_id) have left: proposal_id, operation, its fields, need, there,
    makes, doc, taken, complete and ok.

    A proposal needs an entity to exist (need), and a group its new id not to (makes). Entities come by groups and go by merges, if these are
    valid themselves. So every proposal looks up the last event on its ids before it, by a window over events and questions of an id; it is settled if
    no event in between is open. Each round settles all whose events are, the first open one at least; rounds are as many as
    the longest chain of proposals that hang on each other's success. A merge with nothing to remove succeeds, as does one that moves links only.
    """
    todo = proposals.where("status = 'approved'")
    op, has = F.col("operation"), lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    need = F.when(op == "rename_label", F.col("entity_id")).when(op == "link_hierarchy", F.col("from_id")).when(op == "merge_entities", F.col("kept_id")).when(op == "group_codes", F.col("parent_theme_id"))
    complete = (
        F.when(op == "rename_label", has("entity_id") & has("new_label"))
        .when(op == "link_hierarchy", has("from_id") & has("to_id") & has("property"))
        .when(op == "merge_entities", has("kept_id") & has("removed_id"))
        .when(op == "group_codes", has("new_subtheme_label") & has("parent_theme_id"))
    )
    fields = [*FIELDS]
    todo = scratch.keep(todo.select("proposal_id", "operation", *fields, need.alias("need"), complete.alias("complete")))
    makes = _new_ids(todo.where("operation = 'group_codes' and complete"), entities, scratch)
    base = todo.join(makes, "proposal_id", "left")
    possible = F.coalesce("complete", F.lit(False)) & ~((op == "merge_entities") & F.coalesce(F.col("kept_id") == F.col("removed_id"), F.lit(False)))
    base = base.withColumn("drops", F.when(op == "merge_entities", F.col("removed_id"))).withColumn("ok", F.when(~possible, F.lit(False)))
    base = base.withColumns({"there": F.lit(None).cast("boolean"), "taken": F.lit(None).cast("boolean")})
    state = scratch.keep(base)
    # Of the entities only those that some proposal asks for are looked up, once; rounds work on tables of proposals' size.
    ids = state.select(F.explode(F.array("need", "makes")).alias("id")).where("id is not null").distinct()
    first = scratch.keep(entities.select("id").join(ids, "id", "left_semi").distinct().withColumn("_old", F.lit(True)))
    before = Window.partitionBy("id").orderBy("proposal_id", "event").rowsBetween(Window.unboundedPreceding, -1)
    while True:
        open_ = state.where("ok is null")
        if open_.isEmpty():
            return state
        events = state.where("ok is null or ok").select(F.explode(F.array(F.struct(F.col("makes").alias("id"), F.lit(True).alias("comes")), F.struct(F.col("drops").alias("id"), F.lit(False).alias("comes")))).alias("e"), "proposal_id", "ok")
        events = events.select("e.id", "proposal_id", F.lit(1).alias("event"), F.col("ok"), F.col("e.comes").alias("comes"), F.lit(None).cast("string").alias("asks")).where("id is not null")
        asked = open_.select(F.explode(F.array(F.struct(F.col("need").alias("id"), F.lit("need").alias("asks")), F.struct(F.col("makes").alias("id"), F.lit("makes").alias("asks")))).alias("e"), "proposal_id")
        asked = asked.select("e.id", "proposal_id", F.lit(0).alias("event"), F.lit(None).cast("boolean").alias("ok"), F.lit(None).cast("boolean").alias("comes"), "e.asks").where("id is not null")
        met = events.unionByName(asked)
        done = F.last(F.when((F.col("event") == 1) & F.col("ok"), F.struct("proposal_id", "comes")), ignorenulls=True).over(before)
        hangs = F.last(F.when((F.col("event") == 1) & F.col("ok").isNull(), F.col("proposal_id")), ignorenulls=True).over(before)
        seen = met.withColumns({"_done": done, "_hangs": hangs}).where("event = 0").join(first, "id", "left")
        known = F.col("_hangs").isNull() | F.coalesce(F.col("_done.proposal_id") > F.col("_hangs"), F.lit(False))
        there = F.when(known, F.coalesce(F.col("_done.comes"), F.col("_old"), F.lit(False)))
        answers = seen.groupBy("proposal_id").agg(F.max(F.when(F.col("asks") == "need", there)).alias("_there"), F.max(F.when(F.col("asks") == "makes", there)).alias("_taken"))
        joined = state.join(answers, "proposal_id", "left")
        settled = F.when(~F.col("_there"), F.lit(False)).when(F.col("_there") & (F.col("makes").isNull() | ~F.col("_taken")), F.lit(True)).when(F.col("_there") & F.col("_taken"), F.lit(False))
        columns = {"ok": F.coalesce("ok", settled), "there": F.coalesce("there", "_there"), "taken": F.coalesce("taken", "_taken")}
        state = scratch.keep(joined.withColumns(columns).select(*state.columns))


def _results(judged: DataFrame) -> DataFrame:
    message = (
        F.when(F.col("ok"), F.lit(None).cast("string"))
        .when(F.col("complete").isNull(), F.lit("operation not implemented"))
        .when(~F.col("complete"), F.lit("fields missing"))
        .when(F.col("kept_id") == F.col("removed_id"), F.lit("kept_id equals removed_id"))
        .when(~F.col("there"), F.concat(F.lit("not found: "), F.col("need")))
        .otherwise(F.lit("target subtheme exists"))
    )
    return judged.select("proposal_id", "operation", "ok", F.coalesce(message, F.lit("applied")).alias("message"))


def apply_results(proposals: DataFrame, entities: DataFrame, pack: Pack) -> DataFrame:
    """(proposal_id, operation, ok, message) of every approved proposal, applied in the order of their ids."""
    with Scratch(proposals.sparkSession, "results") as scratch:
        return scratch.result(_results(in_order(proposals, entities, scratch)))


def _merge_ends(merges: DataFrame, scratch: Scratch) -> DataFrame:
    """(proposal_id, removed, kept, end) of valid merges: where what a merge points to ends up by the merges after it. Pointers double."""
    later = Window.partitionBy("id").orderBy(F.col("proposal_id").desc(), F.col("event").desc()).rowsBetween(Window.unboundedPreceding, -1)
    events = merges.select(F.col("removed").alias("id"), "proposal_id", F.lit(0).alias("event"))
    asked = merges.select(F.col("kept").alias("id"), "proposal_id", F.lit(1).alias("event"))
    then = events.unionByName(asked).withColumn("_next", F.last(F.when(F.col("event") == 0, F.col("proposal_id")), ignorenulls=True).over(later)).where("event = 1")
    found = scratch.keep(merges.join(then.select("proposal_id", "_next"), "proposal_id").withColumn("end", F.col("kept")))
    while not found.where("_next is not null").isEmpty():
        ahead = found.select(F.col("proposal_id").alias("_next"), F.col("end").alias("_end"), F.col("_next").alias("_then"))
        found = scratch.keep(found.join(ahead, "_next", "left").select("proposal_id", "removed", "kept", F.coalesce("_end", "end").alias("end"), F.col("_then").alias("_next")))
    return found.drop("_next")


def apply_approved(proposals: DataFrame, entities: DataFrame, edges: DataFrame, pack: Pack) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(proposals, entities, edges, results): approved proposals applied one after another by proposal_id, and marked ``applied`` where they succeed.
    Applying again changes nothing.

    A merge moves the links to the removed entity that there are when its turn comes, those inside texts too, and takes the entity with its own
    links away; a link made later to the removed id stays as it is, until another merge of that id. Each link so meets the merges
    as they stand at its own place in the order: the first merge of its target after it, and from there the end of that merge's chain. Labels
    take the last valid rename since the entity came."""
    with Scratch(proposals.sparkSession, "apply") as scratch:
        judged = in_order(proposals, entities, scratch)
        ok = judged.where("ok")
        merges = scratch.keep(ok.where("operation = 'merge_entities'").select("proposal_id", F.col("removed_id").alias("removed"), F.col("kept_id").alias("kept")))
        ends = _merge_ends(merges, scratch)
        gone = merges.groupBy("removed").agg(F.max("proposal_id").alias("_gone"))
        firsts = scratch.keep(ends.groupBy("removed").agg(F.min_by("end", "proposal_id").alias("kept")))

        # Entities: old ones that no merge has removed, and the last made of each new id if none has since.
        left = entities.join(gone.select(F.col("removed").alias("id")), "id", "left_anti").select(*entities.columns)
        for text_col in ("source_text", "body"):
            if text_col in left.columns:
                left = rewrite_links(left, firsts, text_col)
        made = ok.where("operation = 'group_codes'").withColumn("n_members", F.size(F.coalesce("member_code_ids", F.array().cast("array<string>"))))
        made = made.groupBy(F.col("makes").alias("id")).agg(F.max(F.struct("proposal_id", "new_subtheme_label", "doc", "n_members")).alias("g")).join(gone.withColumnRenamed("removed", "id"), "id", "left").where("_gone is null or _gone < g.proposal_id")
        given = {
            "class": F.lit("Subtheme"), "id": F.col("id"), "label": F.col("g.new_subtheme_label"), "uri": F.concat(F.lit(pack.entity_iri), F.col("id")), "source_document": F.col("g.doc"), "source_section": F.lit("consolidator"),
            "source_text": F.concat(F.lit("Subtheme grouping "), F.col("g.n_members").cast("string"), F.lit(" codes.")),
        }
        fresh = made.select(*[given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in entities.schema], F.col("g.proposal_id").alias("_born"))
        rows = left.withColumn("_born", F.lit(None).cast("string")).unionByName(fresh)
        renames = ok.where("operation = 'rename_label'").groupBy(F.col("entity_id").alias("id")).agg(F.max(F.struct("proposal_id", "new_label")).alias("_r"))
        label = F.when(F.col("_r").isNotNull() & (F.col("_born").isNull() | (F.col("_r.proposal_id") > F.col("_born"))), F.col("_r.new_label")).otherwise(F.col("label"))
        named = rows.join(renames, "id", "left").withColumn("label", label).select(*entities.columns)

        # Links: the old ones meet the first merge of their target; new ones the first after them.
        old = edges.join(gone.select(F.col("removed").alias("src")), "src", "left_anti").join(firsts.select(F.col("removed").alias("dst"), F.col("kept").alias("_to")), "dst", "left").select("src", "prop", F.coalesce("_to", "dst").alias("dst"))
        new = ok.where("operation = 'link_hierarchy'").select("proposal_id", F.col("from_id").alias("src"), F.col("property").alias("prop"), F.col("to_id").alias("dst"))
        new = new.unionByName(ok.where("operation = 'group_codes'").select("proposal_id", F.col("need").alias("src"), F.lit("hasSubtheme").alias("prop"), F.col("makes").alias("dst")))
        new = new.join(gone.withColumnRenamed("removed", "src"), "src", "left").where("_gone is null or _gone < proposal_id").drop("_gone")
        later = Window.partitionBy("dst").orderBy(F.col("proposal_id").desc()).rowsBetween(Window.unboundedPreceding, -1)
        events = ends.select("proposal_id", F.lit(None).cast("string").alias("src"), F.lit(None).cast("string").alias("prop"), F.col("removed").alias("dst"), "end")
        met = new.withColumn("end", F.lit(None).cast("string")).unionByName(events).withColumn("_to", F.last("end", ignorenulls=True).over(later)).where("src is not null")
        links = old.unionByName(met.select("src", "prop", F.coalesce("_to", "dst").alias("dst"))).distinct()

        results = scratch.result(_results(judged))
        done = results.where("ok").select("proposal_id", F.lit("applied").alias("_done"))
        marked = proposals.join(done, "proposal_id", "left").withColumn("status", F.coalesce("_done", "status")).drop("_done")
        return marked, scratch.result(named, "entities"), scratch.result(links, "edges"), results


def dry_run(proposals: DataFrame) -> DataFrame:
    return proposals.where("status = 'approved'").select("proposal_id", "operation", payload_summary().alias("summary"))
