"""Proposals: misspelt labels, codes that cohere, and application in order, against plain Python versions."""

from __future__ import annotations

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from weftgraph.operators import curate
from weftgraph.plans import pack as pk


def one_change(a: str, b: str) -> bool:
    if a == b:
        return False
    if len(a) == len(b):
        d = [i for i in range(len(a)) if a[i] != b[i]]
        return len(d) == 1 or (len(d) == 2 and d[1] == d[0] + 1 and a[d[0]] == b[d[1]] and a[d[1]] == b[d[0]])
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def changed(rng, s):
    i = rng.randrange(len(s))
    return rng.choice([s[:i] + s[i + 1 :], s[:i] + rng.choice("abç ") + s[i:], s[:i] + rng.choice("abç") + s[i + 1 :], s[:i] + s[i + 1 : i + 2] + s[i] + s[i + 2 :], s.upper()])


@pytest.mark.parametrize("crowd", [1000, 3])
def test_misspelt_labels_are_found(spark, crowd):
    """Short labels, and labels around and beyond the length at which halves are the keys; a crowded key is split and loses no pair."""
    rng = random.Random(7)
    labels = [None, "", "  ", "a", "b", "ab", "ba", "a b", "A  B"]
    for n in (3, 4, 8, 20, 62, 63, 64, 65, 66, 67, 300):
        for _ in range(2):
            base = "".join(rng.choice("abcdefgh ") for _ in range(n)).strip() + "x"
            labels += [base] + [changed(rng, base) for _ in range(5)]
    labels += [f"shared stem {x}" for x in "abcdefghijklmnop"]
    rows = [(f"id{i:03d}", "k" if i % 5 else "m", t, "clash") for i, t in enumerate(labels)]
    got = {(r["kept_id"], r["removed_id"]) for r in curate.propose_respelled(spark.createDataFrame(rows, "id string, class string, label string, key string"), crowd).collect()}
    heads = {}
    for i, c, t, _ in rows:
        text = " ".join((t or "").lower().split())
        if text:
            heads[c, text] = min(i, heads.get((c, text), i))
    want = {tuple(sorted((x, y))) for (c, s), x in heads.items() for (d, t), y in heads.items() if c == d and one_change(s, t)}
    assert got == want and len(want) > 100


def plain_groups(excerpts, least, lift):
    """excerpts: theme -> list of code sets. (theme, group, code)"""
    out = set()
    for theme, sets in excerpts.items():
        sets = [s for s in sets if s]
        n, both = defaultdict(int), defaultdict(int)
        for s in sets:
            for a in s:
                n[a] += 1
                for b in s:
                    if a < b:
                        both[a, b] += 1
        root = {c: c for c in n}
        find = lambda x: x if root[x] == x else find(root[x])  # noqa: E731, B023
        for (a, b), m in both.items():
            if m >= least and m * len(sets) >= lift * n[a] * n[b]:
                x, y = sorted((find(a), find(b)))
                root[y] = x
        size = defaultdict(int)
        for c in root:
            size[find(c)] += 1
        out |= {(theme, find(c), c) for c in root if size[find(c)] > 1}
    return out


def as_edges(spark, excerpts):
    rows, k = [], 0
    for theme, sets in excerpts.items():
        for s in sets:
            k += 1
            rows += [(f"x{k}", "supportsTheme", theme)] + [(f"x{k}", "codedAs", c) for c in sorted(s)]
    return spark.createDataFrame(rows, "src string, prop string, dst string")


@pytest.mark.parametrize(("seed", "wide", "least", "lift"), [(1, 50, 2, 1.2), (1, 2, 2, 1.2), (2, 3, 3, 1.5), (3, 1, 2, 2.0), (4, 4, 1, 0.5)])
def test_codes_cohere(spark, seed, wide, least, lift):
    """Whether a set counts as wide or not changes nothing."""
    rng = random.Random(seed)
    codes = [f"c{i:02d}" for i in range(24)]
    excerpts = {}
    for theme in ("t1", "t2"):
        sets = [set(rng.sample(codes[: rng.choice([6, 24])], rng.randrange(0, 5))) for _ in range(60)]
        sets += [set(rng.sample(codes, 15))] * rng.randrange(0, 4) + [set(rng.sample(codes, 10)) for _ in range(3)] + [{"c00", "c01", "c02"}] * 5
        excerpts[theme] = sets
    got = curate.cohering_codes(as_edges(spark, excerpts), least, lift, wide)
    assert {(r["theme"], r["group_id"], r["code"]) for r in got.collect()} == plain_groups(excerpts, least, lift)


def test_a_hub_excerpt_makes_no_pairs(spark):
    """Two excerpts carry 10,000 codes: one group, and no table of the run has a row per pair (50 million)."""
    hub = spark.range(10_000).select(F.explode(F.array(F.lit("h1"), F.lit("h2"))).alias("src"), F.lit("codedAs").alias("prop"), F.format_string("c%05d", "id").alias("dst"))
    rest = spark.createDataFrame([("h1", "supportsTheme", "t"), ("h2", "supportsTheme", "t"), *[(f"x{i}", p, v) for i in range(50) for p, v in (("supportsTheme", "t"), ("codedAs", "alone"))]], "src string, prop string, dst string")
    found = curate.cohering_codes(hub.unionByName(rest), 2, 2.0)
    assert found.count() == 10_000 and found.select("group_id").distinct().collect()[0][0] == "c00000"
    made = curate.propose_coherent_groups(hub.where("dst < 'c00004'").unionByName(rest), 2, 2.0).collect()
    assert [r["member_code_ids"] for r in made] == [["c00000", "c00001", "c00002", "c00003"]]
    assert curate.cohering_codes(rest.limit(0)).count() == 0


def one_by_one(ops, entities, edges):
    """ops in order; entities: id -> (label, doc). Returns results, id -> label, edges."""
    alive, links, results = {i: list(x) for i, x in entities.items()}, set(edges), {}
    for op in ops:
        kind, ok = op["operation"], False
        if kind == "rename_label":
            if ok := op["entity_id"] in alive:
                alive[op["entity_id"]][0] = op["new_label"]
        elif kind == "link_hierarchy":
            if ok := op["from_id"] in alive:
                links.add((op["from_id"], op["property"], op["to_id"]))
        elif kind == "merge_entities":
            kept, removed = op["kept_id"], op["removed_id"]
            if ok := kept != removed and kept in alive:
                links = {(s, p, kept if d == removed else d) for s, p, d in links if s != removed}
                alive.pop(removed, None)
        elif kind == "group_codes" and op["parent_theme_id"] in alive:
            doc = alive[op["parent_theme_id"]][1] or "doc"
            new = f"{doc}_subtheme_{op['new_subtheme_label'].lower()}"
            if ok := new not in alive:
                alive[new] = [op["new_subtheme_label"], doc]
                links.add((op["parent_theme_id"], "hasSubtheme", new))
        results[op["proposal_id"]] = ok
    return results, {i: x[0] for i, x in alive.items()}, links


@pytest.mark.parametrize("seed", range(5))
def test_proposals_apply_in_their_order(spark, seed):
    """Interleaved merges, links, renames and groups, on few ids, so that they hang on each other: as one after another."""
    rng = random.Random(seed)
    ids = [f"e{i}" for i in range(12)]
    entities = {i: (f"label {i}", rng.choice(["d1", "d2", ""])) for i in ids}
    edges = {(rng.choice(ids), "p", rng.choice([*ids, "nowhere"])) for _ in range(40)}
    names = [*ids, "nowhere", "d1_subtheme_g1", "d2_subtheme_g2", "doc_subtheme_g1", "d1_subtheme_g2"]
    ops = []
    for k in range(90):
        kind = rng.choice(["merge_entities", "merge_entities", "link_hierarchy", "rename_label", "group_codes", "group_codes", "split"])
        op = dict.fromkeys(curate.FIELDS) | {"proposal_id": f"p{k:03d}", "operation": kind}
        a, b = rng.choice(names), rng.choice(names)
        op |= {"merge_entities": {"kept_id": a, "removed_id": b}, "link_hierarchy": {"from_id": a, "property": rng.choice("pq"), "to_id": b}, "rename_label": {"entity_id": a, "new_label": f"L{k}"}, "group_codes": {"parent_theme_id": a, "new_subtheme_label": rng.choice(["G1", "G2"]), "member_code_ids": [b]}}.get(kind, {})
        ops.append(op)
    schema = "proposal_id string, operation string, status string, " + ", ".join(f"{k} {v}" for k, v in curate.FIELDS.items())
    p = spark.createDataFrame([(o["proposal_id"], o["operation"], "approved", *(o[f] for f in curate.FIELDS)) for o in rng.sample(ops, len(ops))], schema)
    ents = spark.createDataFrame([(i, "Code", *x) for i, x in entities.items()], "id string, class string, label string, source_document string")
    marked, left, links, results = curate.apply_approved(p, ents, spark.createDataFrame(list(edges), "src string, prop string, dst string"), pk.THEMATIC)
    ok, labels, want = one_by_one(ops, entities, edges)
    assert {r["proposal_id"]: r["ok"] for r in results.collect()} == ok
    assert {r["id"]: r["label"] for r in left.collect()} == labels
    assert {tuple(r) for r in links.collect()} == want
    assert {r["proposal_id"] for r in marked.where("status = 'applied'").collect()} == {k for k, v in ok.items() if v}
    assert 10 < sum(ok.values()) < 80


def test_a_long_chain_of_merges_ends(spark):
    schema = "proposal_id string, operation string, status string, " + ", ".join(f"{k} {v}" for k, v in curate.FIELDS.items())
    blank = dict.fromkeys(curate.FIELDS)
    rows = [(f"p{k:03d}", "merge_entities", "approved", *(blank | {"kept_id": f"e{k + 1:03d}", "removed_id": f"e{k:03d}"}).values()) for k in range(100)]
    ents = spark.createDataFrame([(f"e{k:03d}", "Code", "x", "d") for k in range(101)], "id string, class string, label string, source_document string")
    _, left, links, _ = curate.apply_approved(spark.createDataFrame(rows, schema), ents, spark.createDataFrame([("e100", "p", "e000")], "src string, prop string, dst string"), pk.THEMATIC)
    assert [tuple(r) for r in links.collect()] == [("e100", "p", "e100")] and left.count() == 1


def test_rounds_do_not_read_the_entities_again(spark, tmp_path):
    """Proposals that hang on each other's success take several rounds; the entities are looked up before, whatever their number."""
    spark.range(2000).select(F.concat(F.lit("e"), "id").alias("id"), F.lit("d").alias("source_document")).write.parquet(f"{tmp_path}/old")
    entities = spark.read.parquet(f"{tmp_path}/old")
    rows = [(f"p{k}", "merge_entities", "approved", f"e{k + 1}", f"e{k}") for k in range(9, 0, -1)]
    given = spark.createDataFrame(rows, "proposal_id string, operation string, status string, kept_id string, removed_id string")
    given = given.select("proposal_id", "operation", "status", *[(F.col(c) if c in ("kept_id", "removed_id") else F.lit(None)).cast(t).alias(c) for c, t in curate.FIELDS.items()])
    plans = []

    class Watched(curate.Scratch):
        def keep(self, df):
            plans.append(str(tmp_path) in "".join(df.inputFiles()))
            return super().keep(df)

    with Watched(spark, "watched") as scratch:
        judged = curate.in_order(given, entities, scratch)
        assert judged.where("ok").count() == 9
    assert len(plans) > 3 and sum(plans) <= 2


def test_codes_in_most_excerpts_are_not_paired(spark):
    """A code that more than 1 / lift of the excerpts carry coheres with none, so sets that differ in such codes only are one."""
    common = [f"every{i}" for i in range(8)]
    sets = [{*common[: 6 + i % 3], "a", "b"} if i < 10 else set(common[: 6 + i % 3]) for i in range(60)]
    edges = as_edges(spark, {"t": sets})
    kept = {}

    class Watched(curate.Scratch):
        def keep(self, df):
            out = super().keep(df)
            kept[tuple(df.columns)] = out.count()
            return out

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(curate, "Scratch", Watched)
        got = {tuple(r) for r in curate.cohering_codes(edges, 2, 2.0).collect()}
    assert got == plain_groups({"t": sets}, 2, 2.0) and kept["theme", "a", "b", "both"] <= 3
