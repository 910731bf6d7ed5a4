"""Goldens and properties of operators that SQL can't check, on small data."""

from __future__ import annotations

import dataclasses
import datetime
import hashlib
import random
import re
import shutil
import statistics

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weftgraph import queries
from weftgraph.functions import text as fx
from weftgraph.operators import curate, graph, ingest, lint
from weftgraph.operators import pattern as pt
from weftgraph.plans import mapping
from weftgraph.plans import pack as pk
from weftgraph.plans.questions import resolve
from weftgraph.sources import readers, writers
from weftgraph.streaming import inbox

# ---- chunks ------------------------------------------------------------------------------------------------------

TEXTS = st.lists(st.sampled_from(["A sentence. ", "Next one! ", "\n\n", "P03: hello ", "\nXY: said ", "\n# Head\n", "[00:14:22] ", "plain words ", "x" * 70, "   "]), max_size=60).map("".join)


@settings(max_examples=150, deadline=None)
@given(TEXTS, st.integers(5, 200))
def test_chunks_fit_and_tile_the_text(text, n):
    chunks = ingest.split_chunks(text, n, whole=True)
    assert [i for i, _, _ in chunks] == list(range(len(chunks)))
    assert all(len(c) <= n for _, c, _ in chunks)
    squeeze = lambda s: re.sub(r"\s+", "", s)
    assert squeeze("".join(c for _, c, _ in chunks)) == squeeze(text)


def test_chunk_rules():
    assert ingest.split_chunks("", 10) == [(0, "", "")]
    assert ingest.split_chunks(" short \n", 10)[0][1] == " short \n"
    two = ingest.split_chunks("One is here. Two is here. Three", 19)
    assert [c for _, c, _ in two] == ["One is here", ". Two is here", ". Three"]
    assert [c for _, c, _ in ingest.split_chunks("abcdefghij" * 3, 12)] == ["abcdefghijab", "cdefghijabcd", "efghij"]
    gap = "word" + " " * 50 + "lost"
    assert ingest.split_chunks(gap, 10, whole=False) == [(0, "word", "word")]
    assert [c for _, c, _ in ingest.split_chunks(gap, 10)][-1].strip() == "lost"
    with pytest.raises(ValueError):
        ingest.split_chunks("x", 0)


def test_boundaries_keep_the_highest_priority():
    text = "Intro. Words\n\nP03 [00:14]: hi\n(01:02) more\n# Head\nend"
    found = {k: text[p : p + 8] for p, k, _ in ingest.boundaries(text)}
    assert found["sentence"].startswith(". Words") and found["paragraph"].startswith("\n\n") and found["speaker_turn"].startswith("P03") and found["timestamp"].startswith("(01:02)") and found["heading"].startswith("# Head")
    assert ingest.boundaries("R: one letter is no name") == []
    assert ingest.boundaries("# Head\nP1: hi") == [(0, "heading", 3), (7, "speaker_turn", 5)]


def test_texts_are_dealt_out_by_length(spark):
    """Long texts stand together at the table's begin; the longest task has less than twice the median's characters, and no row is lost or changed."""
    rows = [(i, "x" * (20_000 if i < 100 else 0 if i == 100 else 200), None if i % 7 else "c") for i in range(4000)] + [(None, None, "null")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, `_n` string").repartitionByRange(3, "doc_id")
    dealt = ingest.dealt_by_size(df, 8)
    totals = [r["n"] for r in dealt.groupBy(F.spark_partition_id()).agg(F.sum(F.coalesce(F.length("text"), F.lit(0))).alias("n")).collect()]
    assert len(totals) == 8 and max(totals) < 2 * statistics.median(totals)
    assert sorted(map(str, map(tuple, dealt.collect()))) == sorted(map(str, rows)) and dealt.columns == df.columns
    assert ingest.dealt_by_size(df.limit(0), 4).count() == 0


def test_hints():
    assert ingest.hint("P03 [00:14]: hello") == "P03 [00:14]"
    assert ingest.hint("text\n[00:14:22] more") == "[00:14:22]"
    assert ingest.hint("# A head\nmore") == "# A head"
    assert ingest.hint("one two three four five six seven eight nine") == "one two three four five six seven eight"
    assert ingest.hint(" ".join(["w" * 20] * 8)).endswith("…")


def test_section_hints_are_those_of_plain_python(spark):
    rng = random.Random(2)
    parts = ["A sentence. ", "\n\n", "P03: hello ", "\nXY [00:14] : said ", "\n# Head of\n", "[00:14:22] ", "plain words ", "x" * 70, "   ", "\t§ 5 ", "#\n", "é\xa0ü ", "\n  Ann: "]
    texts = ["", "   ", "# A head", "# " + "h" * 200, "#\nnext", "w " * 600 + "\nAnn: late", *["".join(rng.choice(parts) for _ in range(rng.randrange(1, 30))) for _ in range(300)]]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(-1, None)], "i int, t string").select("i", ingest.section_hint("t").alias("h"))
    got = {r["i"]: r["h"] for r in df.collect()}
    assert got == {i: ingest.hint(t) for i, t in enumerate(texts)} | {-1: ""}


def test_chunk_documents(spark):
    df = spark.createDataFrame([("a", "One is here. Two is here. Three"), ("b", None), ("c", "fits")], "doc_id string, text string")
    rows = {(r["chunk_doc_id"], r["n_chunks"]) for r in ingest.chunk_documents(df, 19).collect()}
    assert rows == {("a_c0", 3), ("a_c1", 3), ("a_c2", 3), ("b", 1), ("c", 1)}


def test_chunks_reach_the_end_of_each_document(spark, tmp_path):
    texts = {1: "word" + " " * 5000 + "last words", 2: "".join(f"{i:09d} " for i in range(250_000)), 3: "short"}
    spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = queries.REGISTRY["chunk_documents"](spark, str(tmp_path)).orderBy("doc_id", "chunk_index").collect()
    for i, text in texts.items():
        assert "".join("".join(r["text"] for r in rows if r["doc_id"] == str(i)).split()) == "".join(text.split())


def test_the_inbox_takes_whole_files(spark, tmp_path):
    text = "".join(f"Ann: word{i} and some more words\n" for i in range(1500)) + " " * 200 + "\nAnn: the end"
    docs = spark.createDataFrame([("long", "long.txt", text, datetime.datetime(2024, 1, 1))], "doc_id string, file string, text string, modified timestamp")
    inbox.ingest_batch(docs, 0, str(tmp_path), ingest.rule_extractor, dataclasses.replace(pk.THEMATIC, window_chars=50))
    labels = {r["label"].split()[0] for r in spark.read.parquet(f"{tmp_path}/entities").collect()}
    assert labels == {f"word{i}" for i in range(1500)} | {"the"}


def test_requests_hold_whole_documents(spark, tmp_path):
    texts = {1: "".join(f"{i:06d} words. Then " for i in range(2000)), 2: "short", 3: "x" * 30_000}
    spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r["chunk_doc_id"], r["user_sha"]) for r in queries.REGISTRY["render_chunk_requests"](spark, str(tmp_path)).collect()}
    want = set()
    for i, text in texts.items():
        parts = [c for _, c, _ in ingest.split_chunks(text, 12_000, whole=True)]
        assert "".join("".join(parts).split()) == "".join(text.split())
        for k, part in enumerate(parts):
            name = f"d{i}_c{k}" if len(parts) > 1 else f"d{i}"
            want.add((name, hashlib.sha256(f"\nDocument: {name}\nVersion: v1\nText:\n{part}".encode()).hexdigest()))
    assert got == want and len(got) == 8


def test_variants(spark):
    df = spark.createDataFrame([("P07 [01:02:33]: 'We carried every box up the hill twice, and only then did it rain'",), ("short",), (None,)], "t string")
    thematic, default = (df.select(fx.search_variants("t", s).alias("v")).collect() for s in ("thematic", "default"))
    assert thematic[0]["v"][0].startswith("We carried every") and len(thematic[0]["v"]) == 3
    assert thematic[1]["v"] == [] and default[2]["v"] == []


def test_pages_are_found_first_and_by_their_head(spark):
    pages = spark.createDataFrame([("d", 1, "It was “cold” – very cold. Nothing else was said here but then it ended"), ("d", 2, "it was cold very cold nothing else"), ("e", 1, "other")], "doc string, page_no int, page_text string")
    needles = [("a", "d", "was 'cold', very cold"), ("b", "d", "nothing else was said here but it goes on elsewhere at length"), ("c", "e", "was cold very cold"), ("x", "d", "It was"), ("y", "d", "")]
    got = {r["needle_id"]: r["page_no"] for r in ingest.locate_page(spark.createDataFrame(needles, "needle_id string, doc string, snippet string"), pages).collect()}
    assert got == {"a": 1, "b": 1, "c": None, "x": 1, "y": None}
    # A head that ends in a space asks for the end of a word.
    texts = [("d", 1, "abcde fghij klmno pqrst uvwxystop"), ("d", 2, "abcde fghij klmno pqrst uvwxy and so on"), ("e", 5, "so long"), (None, 1, "so long")]
    rows = [("h", "d", "abcde fghij klmno pqrst uvwxy, then something else"), ("two", "e", "o lon"), ("none", None, "so long"), ("null", "e", None)]
    df = spark.createDataFrame(rows, "needle_id string, doc string, snippet string")
    found = ingest.locate_page(df, spark.createDataFrame(texts, "doc string, page_no int, page_text string"))
    assert {r["needle_id"]: r["page_no"] for r in found.collect()} == {"h": 2, "two": 5, "none": None, "null": None}


def test_needles_of_every_length_are_found(spark):
    rng = random.Random(4)
    vocab = ["a", "ab", "abc", "b", "bc", "c"]
    texts = {i: " ".join(rng.choice(vocab) for _ in range(rng.randrange(0, 30))) for i in range(60)}
    needles = {}
    for i in range(200):
        t = texts[rng.randrange(60)]
        at = rng.randrange(len(t) + 1)
        needles[str(i)] = (str(rng.randrange(60)) if i % 2 else None, " ".join(t[at : at + rng.randrange(1, 30)].split()))
    df = spark.createDataFrame([(k, d, n) for k, (d, n) in needles.items()], "needle_id string, doc string, norm string")
    rows = spark.createDataFrame([(str(i), 1, t) for i, t in texts.items()], "doc string, place int, text string")
    got = sorted((r["needle_id"], r["doc"]) for r in ingest.anchored(df, rows).collect())
    assert got == sorted((k, str(i)) for k, (d, n) in needles.items() for i, t in texts.items() if n and n in t and d in (None, str(i)))


def test_named_needles_make_no_keys_of_words(spark):
    """Needles that name their document go along with its texts, whatever their number; only a document with very many meets them by words."""
    texts = {f"d{i}": " ".join(f"w{i + j}" for j in range(40)) for i in range(8)}
    needles = [(f"{d}-{k}", d, " ".join(t.split()[k : k + 6])) for d, t in texts.items() for k in range(5 if d != "d3" else 30)] + [("not", "d1", "w1 w3 w2 w4 w5"), ("short", "d2", "w3"), ("nowhere", "d9", "w9")]
    df = spark.createDataFrame(needles, "needle_id string, doc string, norm string")
    rows = spark.createDataFrame([(d, 1, t) for d, t in texts.items()], "doc string, place int, text string")
    want = sorted((k, d) for k, d, n in needles if n in texts.get(d, ""))
    for along in (256, 10):
        assert sorted((r["needle_id"], r["doc"]) for r in ingest.anchored(df, rows, along=along).collect()) == want
    plan = ingest.anchored(df, rows)._jdf.queryExecution().optimizedPlan().toString()
    assert "xxhash64" not in plan and "split(" not in plan


def test_extractors_take_small_frames(spark):
    """What a worker holds as Python objects doesn't grow with its batches."""
    from weftgraph.functions.batches import PIECE

    chunks = ingest.chunk_documents(spark.range(1000).coalesce(1).select("id", F.lit("some text").alias("text")), 100, id_col="id")
    sizes = [r["n"] for r in ingest.extract_entities(chunks, lambda pdf: pdf[["doc_id"]].assign(n=len(pdf)), "doc_id string, n int").collect()]
    assert len(sizes) == 1000 and max(sizes) <= PIECE


def test_few_short_needles_take_one_pass(spark):
    rows = spark.createDataFrame([(1, 1, "Alpha, beta"), (2, 1, "zeta al"), (3, 1, None)], "doc bigint, place int, text string")
    df = spark.createDataFrame([("p", None, "pha b"), ("a", None, "al"), ("no", None, "q")], "needle_id string, doc string, norm string")
    found = ingest.anchored(df, rows)
    assert sorted(map(tuple, found.select("doc", "needle_id").collect())) == [(1, "a"), (1, "p"), (2, "a")]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Aggregate" not in plan and "Generate" not in plan


def test_short_needles_join_by_key(spark):
    """Needles of one and two words, of one and two characters, and beyond the basic plane, in texts on several lines: no plan compares all pairs."""
    texts = {1: "alpha beta\ngamma", 2: "zeta al", 3: "\U0001f600\U0001f601x y", 4: "", 5: None, 6: "a", 7: "alpha " * 3000 + "omega"}
    needles = ["alpha", "pha b", "beta gam", "al", "a", "\U0001f600\U0001f601x", "\U0001f601", "x y", "omega", "nowhere", "qq", "z"]
    df = spark.createDataFrame([(n, None, n) for n in needles], "needle_id string, doc string, norm string")
    rows = spark.createDataFrame([(i, 1, t) for i, t in texts.items()], "doc bigint, place int, text string")
    found = ingest.anchored(df, rows)
    norm = lambda t: " ".join((t or "").split())
    assert sorted((r["needle_id"], r["doc"]) for r in found.collect()) == sorted((n, i) for n in needles for i, t in texts.items() if n in norm(t))
    shown = found._jdf.queryExecution().toString() + ingest._by_grams(df.where("doc is null"), rows, [1, 2, 3], lambda x: x)._jdf.queryExecution().toString()
    assert "Cartesian" not in shown and "NestedLoop" not in shown


def test_short_items_are_cited(spark, tmp_path):
    items = {1: "Alp", 2: "beta gam", 3: "a the z", 4: "One, two three; four", 5: "v w longest x y", 6: "no such words here", 7: "q r s t u v w", 8: "!"}
    texts = {1: "alphabeta gamma the ending", 2: "alpha the zebra one two three fourteen", 3: "v w longest x y", 4: "uv w longest x yes", 5: "q r s t u v w", 6: None, 7: "one two three"}
    spark.createDataFrame(list(items.items()), "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    norm = lambda t: " ".join(re.sub(r"[,;.!]", " ", t.lower()).split())
    want = {(str(d), str(i)) for d, t in texts.items() for i, n in items.items() if t and norm(n) and norm(n) in norm(t)}
    got = [(r["doc_id"], r["item_id"]) for r in mapping.citations(spark, str(tmp_path)).collect()]
    assert set(got) == want and len(got) == len(want) and {i for _, i in want} == {"1", "2", "3", "4", "5", "7"}


def test_evidence_by_a_hook(spark, entities):
    pages = spark.createDataFrame([("doc", 4, "before Line and break after")], "doc string, page_no int, page_text string")
    got = ingest.locate_evidence(entities, pages, hook=lambda t: t.split("\n")).collect()
    assert [(r["id"], r["variant"], r["offset"]) for r in got] == [("e1", "Line", 7)]


# ---- packs and graphs --------------------------------------------------------------------------------------------


def test_packs_are_validated():
    with pytest.raises(ValueError):
        pk.Pack("p", "p", (pk.Cls("A", "Nowhere"),), ())
    with pytest.raises(ValueError):
        pk.Pack("p", "p", (), ())
    with pytest.raises(ValueError):
        pk.Pack("p", "p", (pk.Cls("A"),), (pk.Prop("has", "B"),))
    assert pk.Pack("p", "p", (pk.Cls("A"),), (pk.Prop("has", "A", "B"),)).warnings
    assert pk.COMPLIANCE.property_iri("partOfStatute") == "dcterms:isPartOf"
    ring = pk.Pack("p", "p", (pk.Cls("A", "B"), pk.Cls("B", "A")), ())
    assert sorted(ring.ancestors()) == [("A", "A"), ("A", "B"), ("B", "A"), ("B", "B")]
    _, rules = ingest.extraction_schema(pk.COMPLIANCE)
    assert "partOfStatute" not in rules["properties"] and rules["class"][0] == "Statute"
    with pytest.raises(KeyError):
        resolve("thematic", "cq9")


ENTITIES = [
    ("Theme", "t1", "Trust", "u/t1", "doc", "s", None, "", {"hasSubtheme": ["[[s1]]"]}, "t1.md"),
    ("Subtheme", "s1", "Sub", "u/s1", "doc", "s", None, "", {}, "s1.md"),
    ("Code", "c1", "Code one", "u/c1", "doc", "s", None, "", {}, "c1.md"),
    ("Code", "c2", "Code two", "u/c2", "doc", "s", None, "", {"codedAs": ["c2", "c1"]}, "c2.md"),
    ("Excerpt", "e1", "Said", "u/e1", "doc", "s", 4, "Line\nbreak", {"codedAs": ["[[c1]]", "[[c2]]"], "supportsTheme": ["[[t1]]"], "spokenBy": ["P03"], "odd": ["x"]}, "e1.md"),
    ("Thing", "x1", None, "u/x1", "doc", "", None, None, {}, "x1.md"),
]


@pytest.fixture
def entities(spark):
    return spark.createDataFrame(ENTITIES, graph.ENTITY)


def test_triples_of_records(entities):
    rows = graph.graph_of(entities, pk.THEMATIC).triples().collect()
    t = {(r["s"], r["p"], r["o"], r["o_lang"]) for r in rows}
    assert len(t) == len(rows)
    assert ("thae:x1", "rdf:type", "tha:Theme", None) in t and ("thae:x1", "rdfs:label", "x1", "en") in t
    assert ("thae:e1", "skos:definition", "Line break", "en") in t and ("thae:e1", "tha:spokenBy", "P03", None) in t
    assert ("thae:c2", "tha:codedAs", "thae:c1", None) in t and ("thae:c2", "tha:codedAs", "thae:c2", None) not in t
    assert not any(p == "tha:odd" for _, p, _, _ in t)


def test_optional_group_is_a_unit_and_labels_are_tagged(entities):
    t = graph.graph_of(entities, pk.THEMATIC).triples()
    own = pt.triple_pattern(t, "?code", "rdf:type", "tha:Code")
    group = pt.optional(own, pt.triple_pattern(t, "?x", "tha:codedAs", "?code"), pt.triple_pattern(t, "?x", "tha:spokenBy", pt.Lit("P03")))
    assert {(r["code"], r["x"]) for r in group.collect()} == {("thae:c1", "thae:e1"), ("thae:c2", "thae:e1")}
    assert pt.triple_pattern(t, "?x", "rdfs:label", pt.Lit("Trust")).count() == 0
    assert pt.triple_pattern(t, "?x", "rdfs:label", pt.Lit("Trust", "en")).count() == 1
    with pytest.raises(ValueError):
        pt.bgp(own, pt.triple_pattern(t, "?a", "tha:codedAs", "?b"))
    assert {r["code"]: r["nExcerpts"] for r in resolve("thematic", "cq1")(t).collect()} == {"thae:c1": 2, "thae:c2": 1}


def test_path_closes_cycles(spark):
    ring = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], "src string, dst string")
    assert pt.path_plus(ring).count() == 12


def test_lint_finds_each_defect(entities):
    got = {(r["rule"], r["entity_id"]) for r in lint.lint(entities, pk.THEMATIC).collect()}
    assert {("unknown_class", "x1"), ("missing_required_field", "x1"), ("unknown_property", "e1"), ("domain_violation", "c2"), ("self_reference", "c2")} <= got
    assert not any(r in ("orphan_code", "orphan_subtheme", "theme_without_subthemes", "dangling_wikilink") for r, _ in got)


# ---- curation ----------------------------------------------------------------------------------------------------


def test_fingerprints_are_those_of_python_tuples(spark):
    blank = dict.fromkeys(curate.FIELDS)
    rows = [
        {"operation": "merge_entities", **blank, "kept_id": "a", "removed_id": "b"}, {"operation": "merge_entities", **blank, "kept_id": "a"}, {"operation": "group_codes", **blank, "parent_theme_id": "t", "member_code_ids": ["y", "x"]},
        {"operation": "group_codes", **blank, "parent_theme_id": "t", "member_code_ids": ["x"]}, {"operation": "group_codes", **blank, "parent_theme_id": "t"}, {"operation": "link_hierarchy", **blank, "from_id": "a", "property": "p", "to_id": "b"}, {"operation": "rename_label", **blank, "entity_id": "a"},
    ]
    df = spark.createDataFrame([tuple(r.values()) for r in rows], "operation string, " + ", ".join(f"{k} {v}" for k, v in curate.FIELDS.items()))
    keys = [("a", "b"), ("a", None), ("t", ("x", "y")), ("t", ("x",)), ("t", ()), ("a", "p", "b"), ("a",)]
    want = [hashlib.sha1(f"{r['operation']}|{k}".encode()).hexdigest()[:8] for r, k in zip(rows, keys, strict=True)]
    assert [r[0] for r in df.select(curate.fingerprint()).collect()] == want


def proposals(spark, *rows):
    blank = dict.fromkeys(curate.FIELDS)
    full = [(f"p{i}", r.pop("status", "approved"), None, r.pop("operation"), *(blank | r).values()) for i, r in enumerate(rows)]
    return spark.createDataFrame(full, "proposal_id string, status string, reviewer_notes string, operation string, " + ", ".join(f"{k} {v}" for k, v in curate.FIELDS.items()))


def test_apply_approved_once_is_twice(spark, entities):
    p = proposals(
        spark,
        {"operation": "merge_entities", "kept_id": "c1", "removed_id": "c2"},
        {"operation": "merge_entities", "kept_id": "c2", "removed_id": "x1"},
        {"operation": "group_codes", "new_subtheme_label": "New Group!", "parent_theme_id": "t1", "member_code_ids": ["c1"]},
        {"operation": "rename_label", "entity_id": "t1", "new_label": "Belief"},
        {"operation": "link_hierarchy", "from_id": "t1", "property": "hasSubtheme", "to_id": "nowhere"},
        {"operation": "rename_label", "entity_id": "gone", "new_label": "x"},
        {"operation": "split", "entity_id": "t1"},
        {"operation": "rename_label", "entity_id": "s1", "new_label": "no", "status": "pending"},
        {"operation": "merge_entities", "kept_id": "c1", "removed_id": "c1"},
    )
    edges = graph.entities_to_edges(entities, pk.THEMATIC, keep_self=True)
    marked, ents, links, results = curate.apply_approved(p, entities, edges, pk.THEMATIC)
    ok = {r["proposal_id"]: r["ok"] for r in results.collect()}
    assert ok == {"p0": True, "p1": False, "p2": True, "p3": True, "p4": True, "p5": False, "p6": False, "p8": False}
    assert {r["id"]: r["label"] for r in ents.collect() if r["id"] in ("t1", "doc_subtheme_new_group")} == {"t1": "Belief", "doc_subtheme_new_group": "New Group!"}
    assert "c2" not in {r["id"] for r in ents.collect()}
    have = {(r["src"], r["prop"], r["dst"]) for r in links.collect()}
    assert ("e1", "codedAs", "c1") in have and ("t1", "hasSubtheme", "doc_subtheme_new_group") in have and ("t1", "hasSubtheme", "nowhere") in have and not any("c2" in x for x in have)
    assert {r["status"] for r in marked.where("proposal_id in ('p0', 'p2', 'p3', 'p4')").collect()} == {"applied"}
    again, ents2, links2, _ = curate.apply_approved(marked, ents, links, pk.THEMATIC)
    assert {(r["src"], r["prop"], r["dst"]) for r in links2.collect()} == have and ents2.count() == ents.count() and sorted(r["status"] for r in again.collect()) == sorted(r["status"] for r in marked.collect())


def test_merge_chains(spark):
    m = spark.createDataFrame([("b", "c", 1), ("a", "b", 2), ("c", "d", 3), ("a", "c", 4), ("a", "e", 5)], "kept_id string, removed_id string, seq int")
    assert {(r["removed"], r["kept"]) for r in curate.merge_roots(m).collect()} == {("c", "a"), ("b", "a"), ("e", "a")}


def test_statuses(spark):
    p = proposals(spark, {"operation": "rename_label", "entity_id": "a", "new_label": "b", "status": "pending"})
    d = spark.createDataFrame([("p0", "approved", "yes", 1), ("p0", "deferred", None, 2), ("p0", "bogus", None, 3), ("zz", "approved", None, 1)], "proposal_id string, status string, notes string, seq int")
    out, refused = curate.set_status(p, d)
    assert out.first()["status"] == "deferred" and {r["reason"] for r in refused.collect()} == {"invalid status", "unknown proposal"}


# ---- files and streams -------------------------------------------------------------------------------------------


def test_records_survive_files(spark, entities, tmp_path):
    made = writers.entity_markdown(entities.where("id <> 'x1'"), pk.THEMATIC).collect()
    for r in made:
        (tmp_path / r["file"]).write_text(r["markdown"])
    (tmp_path / "list.md").write_text("---\n- a\n- b\n---\nbody")
    (tmp_path / "none.md").write_text("no front matter")
    (tmp_path / "proposals").mkdir()
    (tmp_path / "proposals" / "proposal_1.md").write_text("---\nproposal_id: proposal_1\noperation: group_codes\nmember_code_ids:\n- a\n- b\nstatus: pending\n---\nwhy")
    rows = {r["file"]: r for r in readers.read_vault(spark, str(tmp_path)).collect()}
    assert set(rows) == {"t1.md", "s1.md", "c1.md", "c2.md", "e1.md", "list.md", "none.md"}
    assert rows["e1.md"]["properties"] == {"codedAs": ["[[c1]]", "[[c2]]"], "supportsTheme": ["[[t1]]"], "spokenBy": ["P03"], "odd": ["[[x]]"]}
    assert rows["e1.md"]["source_page"] == 4 and rows["e1.md"]["source_text"] == "Line\nbreak" and "page 4" in rows["e1.md"]["body"]
    assert rows["none.md"]["corrupt"] and not rows["list.md"]["corrupt"] and rows["list.md"]["id"] is None
    p = readers.read_proposals(spark, str(tmp_path / "proposals")).first()
    assert p["member_code_ids"] == ["a", "b"] and p["status"] == "pending"


def test_documents_are_read_by_suffix(spark, tmp_path):
    for name in ("Some File.TXT", "b-c.md", "d.pdf"):
        (tmp_path / name).write_text("text")
    assert sorted(r["doc_id"] for r in readers.read_documents(spark, str(tmp_path)).collect()) == ["b_c", "some_file"]


def test_upserts_and_triples_are_written(spark, entities, tmp_path):
    new = entities.where("id in ('c1', 'c2')").withColumn("seq", F.lit(1)).withColumn("label", F.lit("later"))
    merged = writers.upsert_entities(entities, new).drop("seq")
    assert merged.count() == 6 and merged.where("label = 'later'").count() == 2
    writers.write_entities(merged, str(tmp_path / "e"))
    assert spark.read.parquet(str(tmp_path / "e")).count() == 6
    t = graph.graph_of(entities, pk.THEMATIC).triples()
    writers.write_triples(t, pk.THEMATIC, str(tmp_path / "t"))
    lines = [r["value"] for r in spark.read.text(str(tmp_path / "t")).collect()]
    assert len(lines) == t.count() and all(x.startswith("<http") and x.endswith(" .") for x in lines)


def test_inbox(spark, tmp_path):
    box, out = tmp_path / "in", tmp_path / "out"
    box.mkdir()
    (box / "one.txt").write_text("Ann: hello there\nBob: good day")
    (box / "empty.txt").write_text("nothing to extract")
    (box / "bad.txt").write_text("Ann: boom")
    (box / "skip.pdf").write_text("Ann: not text")

    def extractor(pdf: pd.DataFrame) -> pd.DataFrame:
        if pdf["text"].str.contains("boom").any():
            raise RuntimeError("boom")
        return ingest.rule_extractor(pdf)

    go = lambda: inbox.start(spark, str(box), str(out), str(tmp_path / "state"), extractor, pk.THEMATIC, once=True).awaitTermination()
    go()
    assert sorted(r["label"] for r in inbox.current_entities(spark, str(out)).collect()) == ["good day", "hello there"]
    assert [r["doc_id"] for r in spark.read.parquet(f"{out}/quarantine").collect()] == ["bad"]
    assert [r["doc_id"] for r in spark.read.parquet(f"{out}/waiting").collect()] == ["empty"]
    go()
    assert spark.read.parquet(f"{out}/submissions").count() == 1
    (box / "one.md").write_text("Ann: a new version")
    go()
    assert [r["label"] for r in inbox.current_entities(spark, str(out)).collect()] == ["a new version"]


def test_redelivery_by_key(spark, tmp_path):
    """A file that comes again, one that comes again empty, two files with one id in a batch, a file that fails, and batches that come twice."""
    at, out = datetime.datetime(2024, 1, 1), str(tmp_path)
    day = lambda n: at + datetime.timedelta(days=n)

    def extractor(pdf: pd.DataFrame) -> pd.DataFrame:
        if pdf["text"].str.contains("boom").any():
            raise RuntimeError("boom")
        return ingest.rule_extractor(pdf)

    def batch(number, *files):
        docs = spark.createDataFrame([(fx_id, file, text, when) for fx_id, file, text, when in files], "doc_id string, file string, text string, modified timestamp")
        inbox.ingest_batch(docs, number, out, extractor, pk.THEMATIC)

    have = lambda: sorted((r["source_document"], r["label"]) for r in inbox.current_entities(spark, out).collect())
    first = [("a", "a.txt", "Ann: one", at), ("b", "b.txt", "Ann: two\nBob: three", at), ("c", "c.txt", "Ann: four", at), ("d", "d.txt", "Ann: five", at)]
    batch(0, *first)
    assert have() == [("a", "one"), ("b", "three"), ("b", "two"), ("c", "four"), ("d", "five")]
    second = [("a", "a.md", "Ann: six", day(1)), ("b", "b.md", "nobody speaks", day(1)), ("c", "c.txt", "Ann: boom", day(1)), ("a_b", "a b.txt", "Ann: old", at), ("a_b", "a-b.txt", "Ann: new", day(2))]
    batch(1, *second)
    want = [("a", "six"), ("a_b", "new"), ("c", "four"), ("d", "five")]
    assert have() == want
    assert [(r["doc_id"], r["file"]) for r in spark.read.parquet(f"{out}/superseded").collect()] == [("a_b", "a b.txt")]
    assert [r["doc_id"] for r in spark.read.parquet(f"{out}/waiting/batch=1").collect()] == ["b"] and [r["doc_id"] for r in spark.read.parquet(f"{out}/quarantine/batch=1").collect()] == ["c"]
    batch(1, *second)
    batch(0, *first)  # an old batch that comes again is known
    assert have() == want
    batch(2, ("b", "b.txt", "Bob: seven", day(3)))
    assert have() == sorted([*want, ("b", "seven")])


def test_a_broken_merge_is_finished(spark, tmp_path, monkeypatch):
    """A run that ends after its buckets stand beside the table, and has even lost one of the table's buckets, is finished when the batch comes again."""
    path = str(tmp_path / "t")
    rows = lambda label: spark.createDataFrame([(f"{k}{i}", f"d{k}", label) for k in range(9) for i in range(3)], "id string, source_document string, label string")
    keys = lambda df: df.select("source_document").distinct()
    assert writers.merge_entities(rows("old"), keys(rows("old")), path, 0, buckets=4)
    new = rows("new").where("source_document in ('d1', 'd2')")
    write = writers.remove
    monkeypatch.setattr(writers, "remove", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        writers.merge_entities(new, keys(new), path, 1, buckets=4)
    monkeypatch.setattr(writers, "remove", write)
    shutil.rmtree(f"{path}-ledger/batch=1")
    touched = sorted(p.name for p in (tmp_path / "t-staged" / "batch=1").glob("bucket=*"))
    shutil.rmtree(f"{path}/{touched[0]}")
    assert writers.merge_entities(new.limit(0), keys(new), path, 1, buckets=4)
    got = {(r["id"], r["label"]) for r in writers.read_entities(spark, path).collect()}
    assert got == {(r["id"], "new" if r["source_document"] in ("d1", "d2") else "old") for r in rows("old").collect()}
    assert not writers.merge_entities(new, keys(new), path, 1, buckets=4) and len(touched) < 4
    with pytest.raises(ValueError):
        writers.merge_entities(new, keys(new), path, 2, buckets=8)


def test_merges_rewrite_links_in_texts(spark):
    rows = [("k", "see [[old]] and [[ old ]], not [[other]] or old"), ("old", "[[old]]"), ("x", None), ("y", "no link"), ("z", "[[mid]][[old]]"), ("w", "[[other]]")]
    entities = spark.createDataFrame(rows, "id string, source_text string")
    merges = spark.createDataFrame([("mid", "old", 1), ("k", "mid", 2)], "kept_id string, removed_id string, seq bigint")
    left, _ = curate.apply_merges(entities, spark.createDataFrame([], "src string, prop string, dst string"), merges)
    got = {r["id"]: r["source_text"] for r in left.collect()}
    assert got == {"k": "see [[k]] and [[k]], not [[other]] or old", "x": None, "y": "no link", "z": "[[k]][[k]]", "w": "[[other]]"}


def test_inbox_finds_pages_and_evidence(spark, tmp_path):
    box, out = tmp_path / "in", tmp_path / "out"
    box.mkdir()
    (box / "paged.txt").write_text("a title page\f\nAnn: the second page says this at some length\f\nBob: and the third one that")
    (box / "flat.txt").write_text("Ann: without any pages here")
    inbox.start(spark, str(box), str(out), str(tmp_path / "state"), ingest.rule_extractor, pk.THEMATIC, once=True).awaitTermination()
    pages = {r["label"].split()[1]: r["source_page"] for r in inbox.current_entities(spark, str(out)).collect()}
    assert pages == {"second": 2, "the": 3, "any": None}
    found = spark.read.parquet(f"{out}/evidence").collect()
    assert sorted((r["variant"][:10], r["offset"]) for r in found) == [("and the th", 6), ("the second", 6)]


# ---- fixpoints ---------------------------------------------------------------------------------------------------


def test_chains_of_a_thousand(spark):
    mixed = random.Random(8).sample(range(1000), 1000)
    for order in (list(range(1000)), mixed):
        # Each merge keeps the next id; later merges come first in the chain, so all are valid.
        merges = [(str(order[i + 1]), str(order[i]), i) for i in range(999)]
        roots = curate.merge_roots(spark.createDataFrame(merges, "kept_id string, removed_id string, seq bigint")).collect()
        assert len(roots) == 999 and {r["kept"] for r in roots} == {str(order[-1])}


def test_paths_and_closures_of_long_chains(spark):
    mixed = random.Random(8).sample(range(300), 300)
    edges = [(mixed[i], mixed[i + 1]) for i in range(299)] + [(-1, -2), (-2, -1), (None, 5), (5, None)]
    got = {(r["src"], r["dst"]) for r in pt.path_plus(spark.createDataFrame(edges, "src int, dst int")).collect()}
    want = {(mixed[i], mixed[j]) for i in range(300) for j in range(i + 1, 300)} | {(-1, -2), (-2, -1), (-1, -1), (-2, -2)}
    assert got == want
    assert pt.path_plus(spark.createDataFrame([], "src int, dst int")).count() == 0
    classes = [(f"c{i}", f"c{i + 1}") for i in range(100)]  # the last parent is not declared
    closed = {(r["child"], r["ancestor"]) for r in pk.class_closure(spark.createDataFrame(classes, "name string, parent string")).collect()}
    assert closed == {(f"c{i}", f"c{j}") for i in range(100) for j in range(i, 100)}


# ---- questions ---------------------------------------------------------------------------------------------------

ORDER = {
    "cq_compliance_1": ["obligationLabel"], "cq_compliance_2": ["statuteLabel"], "cq_compliance_3": ["label"], "cq_thematic_1": ["-nExcerpts", "label"],
    "cq_thematic_2": ["themeLabel", "excerptLabel"], "cq_thematic_3": ["section", "codeLabel"], "cq_literature_1": ["entityLabel", "paperLabel"],
    "cq_literature_2": ["methodLabel", "claimLabel"], "cq_literature_3": ["citedPaperLabel"], "cq_regulatory_1": ["ticker", "date", "filingLabel"],
    "cq_regulatory_2": ["obligationLabel", "disclosureLabel"], "cq_regulatory_3": ["regulatorLabel", "obligationLabel"], "entity_catalog": ["class", "label"],
}


@pytest.mark.parametrize("name", sorted(ORDER))
def test_questions_come_in_order(spark, name):
    rows = queries.REGISTRY[name](spark, "/root/testdata/sf0.01").collect()
    key = lambda r: [(r[k[1:]] is None, -r[k[1:]]) if k[0] == "-" else (r[k] is not None, r[k] or "") for k in ORDER[name]]
    assert [key(r) for r in rows] == sorted(key(r) for r in rows) and rows


def test_questions_read_the_tables_of_their_classes(spark):
    plan = queries.REGISTRY["cq_regulatory_1"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    read = set(re.findall(r"\b([a-z]+)_[a-z]+#\d+[^\n]* parquet", plan))
    assert {"o", "c"} <= read and not read & {"l", "p", "n"}, plan


def test_numbers_follow_the_order(spark):
    from weftgraph.sources.shared import numbered

    names = [f"d{i:04d}" for i in range(700)]
    random.Random(3).shuffle(names)
    got = numbered(spark.createDataFrame([(x,) for x in names], "doc_id string"), "doc_id", "n", 5).collect()
    assert {r["doc_id"]: r["n"] for r in got} == {f"d{i:04d}": i + 5 for i in range(700)}


def test_findings_say_what_is_wrong(spark):
    kinds = "class string, id string, label string, uri string, source_document string, source_section string, properties map<string,array<string>>, file string, corrupt boolean"
    rows = [
        ("Excerpt", "a", "A", "x/a", "d", "s", {"spokenBy": ["P"], "codedAs": ["[[nobody]]", "a"], "odd": ["1"]}, "a.md", None),
        ("Excerpt", "a", "A", "x/a", "d", "s", {}, "b.md", None), ("Code", "c", "", "x/y", "d", None, None, "c.md", False),
        ("Theme", "t", "T", "x/t", "d", None, {"codedAs": []}, "t.md", None), (None, None, None, None, None, None, None, "n.md", None), (None, "z", None, None, None, None, None, "z.md", True),
    ]
    got = {(r["rule"], r["entity_id"], r["file"]): (r["message"], r["suggested_fix"]) for r in lint.lint(spark.createDataFrame(rows, kinds), pk.THEMATIC).collect()}
    assert got == {
        ("dangling_wikilink", "a", "a.md"): ("property codedAs links to nobody, which does not exist", None),
        ("self_reference", "a", "a.md"): ("property codedAs links to its own entity", None),
        ("unknown_property", "a", "a.md"): ("property odd is not declared", None),
        ("duplicate_id", "a", "b.md"): ("id a already declared in a.md", None),
        ("missing_required_field", "c", "c.md"): ("required field missing or empty: label", None),
        ("uri_id_mismatch", "c", "c.md"): ("uri does not end with c", None),
        ("orphan_code", "c", "c.md"): ("code is not linked from any excerpt", None),
        ("theme_without_subthemes", "t", "t.md"): ("theme has no hasSubtheme", None),
        ("domain_violation", "t", "t.md"): ("property codedAs is only valid on Excerpt, not Theme", "move this triple onto a Excerpt"),
        ("missing_id", "", "n.md"): ("front matter has no id", None),
        ("no_frontmatter", "", "z.md"): ("file has no front matter", None),
    }
