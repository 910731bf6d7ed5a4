"""Interval joins, stored graphs, bound paths and first-seen order against plain Python versions, and what their plans exchange."""

from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from weftgraph.operators import browse, graph
from weftgraph.operators import pattern as pt
from weftgraph.operators.intervals import prefix_join
from weftgraph.plans import mapping
from weftgraph.plans.pack import REGULATORY
from weftgraph.sources import shared


def shown(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_prefixes_meet_keys(spark):
    rng = random.Random(3)
    keys = [None, "", "a", "é", "\U0001f600x", "z" * 300] + ["".join(rng.choice("ab_é") for _ in range(rng.randrange(0, 9))) for _ in range(300)]
    prefixes = [None, "", "a", "a", "ab", "abba", "b_", "é", "\U0001f600", "z" * 299, "nothing", "z" * 400]
    rows = spark.createDataFrame([(k, f"v{i}", "clash") for i, k in enumerate(keys)], "key string, value string, prefix string")
    wanted = spark.createDataFrame([(p,) for p in prefixes], "prefix string")
    for tasks in (1, 7):
        got = sorted(tuple(r) for r in prefix_join(wanted, rows, tasks).collect())
        assert got == sorted((p, f"v{i}") for p in set(prefixes) - {None} for i, k in enumerate(keys) if k is not None and k.startswith(p))
    assert prefix_join(wanted, rows.limit(0), 4).count() == 0 and prefix_join(wanted.limit(0), rows, 4).count() == 0


def test_documents_entities_by_prefix_then_by_field(spark):
    rows = [("doc_1_e0.md", "x"), ("doc_1_e1.md", "doc_2"), ("doc_11.md", "doc_3"), ("other.md", "doc_2"), ("b.md", None)]
    entities = spark.createDataFrame(rows, "file string, source_document string")
    docs = spark.createDataFrame([("doc_1",), ("doc_2",), ("doc_9",), (None,)], "doc string")
    got = sorted(tuple(r) for r in browse.entities_for_document(entities, docs).collect())
    assert got == [("doc_1", "doc_11.md"), ("doc_1", "doc_1_e0.md"), ("doc_1", "doc_1_e1.md"), ("doc_2", "doc_1_e1.md"), ("doc_2", "other.md")]


def test_entities_in_first_seen_order(spark):
    rng = random.Random(5)
    rows = [(i, *(rng.choice([f"e:{rng.randrange(200)}", "x", None]) for _ in range(2))) for i in range(500)]
    df = spark.createDataFrame(rng.sample(rows, 500), "n int, a string, b string").repartition(6).orderBy("n").select("a", "b")
    got = [r["entity"] for r in browse.entities_in_order(df, "e:").orderBy("position").collect()]
    assert got == list(dict.fromkeys(x for _, a, b in rows for x in (a, b) if x and x.startswith("e:")))
    assert [r["position"] for r in browse.entities_in_order(df, "e:").orderBy("position").collect()] == list(range(len(got)))


def test_subject_joins_over_a_stored_graph_exchange_nothing(spark, tmp_path):
    rows = [(f"f{i}", "filedBy", f"i{i % 7}") for i in range(300)] + [(f"f{i}", "filedWith", f"r{i % 3}") for i in range(300)] + [(f"f{i}", "containsDisclosure", f"d{i}") for i in range(300)]
    rows += [(f"d{i}", "triggersObligation", f"o{i % 11}") for i in range(300)] + [(f"d{i}", "label", f"D {i}") for i in range(300)]
    triples = spark.createDataFrame([(s, p, o, "iri", None) for s, p, o in rows], "s string, p string, o string, o_kind string, o_lang string")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        t = graph.store_graph(triples, "stored_graph_test", str(tmp_path / "g"), 8)
        star = pt.bgp(*[pt.triple_pattern(t, "?f", p, f"?{v}") for p, v in (("filedBy", "i"), ("filedWith", "r"), ("containsDisclosure", "d"))])
        assert star.count() == 300 and "Exchange hashpartitioning" not in shown(star)
        assert len(re.findall(r"PartitionFilters: \[[^\]]*p#", shown(star))) == 3
        # On from an object to a subject: what has been found is shuffled, the stored side isn't.
        hops = pt.bgp(star, pt.triple_pattern(t, "?d", "triggersObligation", "?o"), pt.triple_pattern(t, "?d", "label", "?l"))
        assert hops.count() == 300 and shown(hops).count("Exchange hashpartitioning") <= 1
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        spark.sql("DROP TABLE IF EXISTS stored_graph_test")


def test_bound_paths_leave_the_rest_alone(spark):
    """Layers that are linked densely close to two million pairs; three starts see their own part, and a cycle ends."""
    layers = spark.range(3000).select((F.col("id") % 1000).alias("n"), F.floor(F.col("id") / 1000).alias("layer"))
    node = lambda layer, n: F.concat_ws("_", layer.cast("string"), n.cast("string"))
    dense = layers.select(node(F.col("layer"), F.col("n")).alias("src"), F.explode(F.sequence(F.lit(1), F.lit(20))).alias("k"), "layer", "n").select("src", node(F.col("layer") + 1, (F.col("n") * 7 + F.col("k") * 31) % 1000).alias("dst"))
    ring = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), (None, "a"), ("d", None)], "src string, dst string")
    edges = dense.unionByName(ring)
    ahead = {}
    for r in edges.where("src is not null and dst is not null").collect():
        ahead.setdefault(r["src"], set()).add(r["dst"])

    def reach(start):
        seen, todo = set(), [start]
        while todo:
            for x in ahead.get(todo.pop(), ()):
                if x not in seen:
                    seen.add(x)
                    todo.append(x)
        return {(start, x) for x in seen}

    starts = spark.createDataFrame([("2_5",), ("1_7",), ("a",), ("nowhere",), (None,)], "src string")
    assert {tuple(r) for r in pt.path_from(edges, starts).collect()} == reach("2_5") | reach("1_7") | reach("a")
    ends = spark.createDataFrame([("d",)], "dst string")
    assert {tuple(r) for r in pt.path_to(edges, ends).collect()} == {(x, "d") for x in "abc"}


def test_a_loaded_graph_has_parts_by_its_rows(spark, monkeypatch):
    """Parts grow in number with the triples, not in size, and so do those that order lines are read in."""
    monkeypatch.setattr(shared, "PART", 100)
    rows = [(f"s{i % 900}", "p", f"o{i % 900}", "iri", None if i % 2 else "en") for i in range(3600)]
    triples = spark.createDataFrame(rows, "s string, p string, o string, o_kind string, o_lang string")
    for got in (graph.load_graph(triples, None), graph.load_graph(triples.limit(0), triples, rows=3600)):
        assert got.rdd.getNumPartitions() == 36 and sorted(map(str, got.collect())) == sorted(map(str, triples.distinct().collect()))
    assert graph.load_graph(triples.limit(0)).count() == 0
    lines = "/root/testdata/sf0.001"
    held = mapping.regulatory(spark, lines).edges.where("prop = 'containsDisclosure'").groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert held < 200 < spark.read.parquet(f"{lines}/lineitem.parquet").count() / 10


def test_nodes_of_a_graph_meet_once(spark):
    """Labels, classes and ends in one grouping: no join, and one exchange; hubs, blank nodes, nulls and nodes that are only ends."""
    rows = [(f"rege:x{i}", "reg:filedBy", "rege:hub", "iri") for i in range(50)] + [("rege:hub", "rdf:type", "reg:Issuer", "iri"), ("rege:hub", "rdfs:label", "Hub", "lit"), ("rege:x1", "rdf:type", "reg:Filing", "iri")]
    rows += [("rege:x2", "rdfs:label", "A", "lit"), ("rege:x2", "rdfs:label", "B", "lit"), ("rege:lone", "rdf:type", "reg:Filing", "lit"), ("_:b", "rdfs:label", "blank", "lit"), ("_:b", "reg:filedBy", "rege:unseen", "iri")]
    rows += [("rege:x3", "reg:filedWith", "_:c", "iri"), ("rege:x4", "reg:filingDate", "2024-01-01", "lit"), (None, "rdfs:label", "none", "lit"), ("rege:x5", "reg:filedWith", None, "iri")]
    triples = spark.createDataFrame([(*r, None) for r in rows], "s string, p string, o string, o_kind string, o_lang string")
    got = browse.graph_nodes(triples, REGULATORY)
    assert "Join" not in shown(got) and shown(got).count("Exchange hashpartitioning") == 1
    color = {c: i for i, c in enumerate(REGULATORY.class_names)}
    want = {(f"rege:x{i}", f"x{i}", "", None) for i in range(50)} - {("rege:x1", "x1", "", None), ("rege:x2", "x2", "", None)}
    want |= {("rege:hub", "Hub", "Issuer", color["Issuer"]), ("rege:x1", "x1", "Filing", color["Filing"]), ("rege:x2", "B", "", None), ("rege:lone", "lone", "", None), ("_:c", "_:c", "", None), (None, None, "", None)}
    assert sorted(map(str, got.collect())) == sorted(str(r) for r in spark.createDataFrame(list(want), got.schema).collect())
