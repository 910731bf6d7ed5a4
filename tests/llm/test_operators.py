"""The training-data operators against their plain versions on small tables with every kind of odd row."""

from __future__ import annotations

import base64
import random
import re
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from . import brute
import corpus_pipeline
from weftgraph.llm import chat, decontam, language, line_dedup, mixing, neardup, spotsigs, url_filter, warc
from weftgraph.llm.common import shared_dir
from weftgraph.llm.components import components
from weftgraph.sources.shared import Scratch, exists

DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint, size string, _id string"


def make(seed: int = 7, n: int = 60) -> list[dict]:
    """Documents with nulls, empty, white-space and one very long text, copies, near copies, shared lines and passages."""
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)] + ["The", "of", "und", "É"]
    words = lambda k: [rng.choice(vocab) for _ in range(k)]
    shared = [" ".join(words(9)) for _ in range(3)]
    texts: list[str | None] = [None, "", " \t\n", "x", "two words", "\n\n", "12 34"]
    base = words(120)
    for i in range(n):
        kind = i % 6
        if kind == 0:
            t = " ".join(base)
        elif kind == 1:
            edit = base[:]
            for _ in range(rng.randrange(1, 6)):
                edit[rng.randrange(len(edit))] = rng.choice(vocab)
            t = " ".join(edit)
        elif kind == 2:
            t = "\n".join([" ".join(words(8)), f"  {rng.choice(shared).upper()}\t", " ".join(words(5)), rng.choice(shared)])
        else:
            t = " ".join(words(rng.randrange(1, 60)))
        texts.append(t)
    texts.append("\n".join(" ".join(words(10)) for _ in range(3000)))
    sources = ["a", "b", "Z", None, "é"]
    return [{"doc_id": 3 * i + 1, "text": t, "lang": None, "source": "a" if i % 3 == 0 else sources[i % 5], "n_chars": len(t or ""), "size": "clash", "_id": "clash"} for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs():
    return make()


@pytest.fixture(scope="module")
def frame(spark, docs):
    return spark.createDataFrame([tuple(d.values()) for d in docs], DOC)


def by_id(df, *cols, key="doc_id"):
    return {r[key]: tuple(r[c] for c in cols) for r in df.collect()}


def test_mixing_meets_targets(frame, docs):
    got = mixing.mix_sources(frame).collect()
    want = brute.targets(docs)
    assert sorted(r["doc_id"] for r in got) == sorted(d["doc_id"] for d in docs)
    taken = dict.fromkeys(want, 0)
    for r in got:
        assert r["source_size"] == want[r["source"]][0]
        assert r["target"] == pytest.approx(want[r["source"]][1])
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
    for s, (_, target) in want.items():
        assert abs(taken[s] - target) <= 1


def test_mixing_rounds_whole_copies_and_reruns_agree(spark):
    rows = [(i, " ".join(["w"] * (1 + i % 50)), "s" if i % 3 else None) for i in range(6000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    a, b = mixing.mix_sources(df), mixing.mix_sources(df.repartition(7))
    assert by_id(a, "taken") == by_id(b, "taken")
    assert sum(1 for r in a.collect() if r["part"]) <= 2


def test_mixing_repeated_rows_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a b c", "s"), (1, "a b c", "s"), (2, "a", "t"), (None, "a b", "t")], "doc_id bigint, text string, source string")
    assert mixing.mix_sources(df).count() == 4
    assert mixing.mix_sources(df.limit(0)).count() == 0


def test_mixing_is_unbiased(spark):
    df = spark.createDataFrame([(i, "w " * (1 + i % 7), s) for i in range(40) for s in ("a", "b", "c")], "doc_id bigint, text string, source string")
    total = 0
    for seed in range(12):
        total += sum(r["taken"] for r in mixing.mix_sources(df.where("doc_id < 4"), seed=seed).where("source = 'c' and doc_id = 3").collect())
    share = brute.targets([{"source": s, "text": "w " * (1 + i % 7)} for i in range(4) for s in ("a", "b", "c")])["c"]
    assert total / 12 == pytest.approx(4 * share[1] / share[0], abs=2.0)


URLS = [
    None, "", "no scheme", "http://", "http://com/x", "https://EXAMPLE.com/en/1", "https://www.example.com/en/", "https://a.www.example.com/en/x?q#f", "https://example.com/e", "https://notexample.com/en/", "http://x.net/fr/1",
    "http://x.net/es/1?x=://y", "http://net", "http://example.com?x/en/", "http://a.b.c.d.example.com/en/a/b", "http://example.org/en/", "x://y://z/en/", "http://é.net/es/", "http://example.com/en/1", "http://example.com/en/1",
]


def test_url_rules(spark):
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(URLS)], "page_id bigint, url string, host string")
    got = by_id(url_filter.judge_urls(pages, url_filter.rules_table(spark)), "host", "path", "rule", "verdict", key="page_id")
    assert got == {i: brute.judged(u, url_filter.RULES) for i, u in enumerate(URLS)}


def test_many_nested_url_rules(spark):
    rng = random.Random(3)
    hosts = ["com", "a.com", "b.a.com", "ba.com", "c.b.a.com", "org", "x.org"]
    paths = ["", "/", "/a", "/a/", "/a/b", "/ab", "/b/"]
    rules = [(h, p, rng.choice(["allow", "block"])) for h in hosts for p in paths if rng.random() < 0.6]
    urls = [f"http://{h}{p}" for h in [*hosts, "z.c.b.a.com", "net", "q.ba.com"] for p in ["", "/", "/a", "/a/b/c", "/abc", "/b", "/b/x"]]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string")
    got = by_id(url_filter.judge_urls(pages, spark.createDataFrame(rules, "host string, path string, verdict string")), "rule", "verdict", key="page_id")
    assert got == {i: brute.judged(u, rules)[2:] for i, u in enumerate(urls)}
    assert url_filter.judge_urls(pages.limit(0), url_filter.rules_table(spark)).count() == 0
    assert {r["verdict"] for r in url_filter.judge_urls(pages, url_filter.rules_table(spark, rules[:0] or [(None, None, "block")]), "block").collect()} == {"block"}


def items(docs):
    long = [d["text"] for d in docs if d["text"] and len(d["text"].split()) > 40]
    out = [(i, " ".join(long[i].split()[5 + i : 25 + i])) for i in range(8)]
    return [*out, (100, "two words"), (101, None), (102, "..."), (103, "X"), (104, out[0][1]), (105, "never seen at all in any of the documents here, I am sure of it, really")]


def test_decontamination(spark, frame, docs):
    bench = items(docs)
    got = decontam.find_hits(frame, spark.createDataFrame(bench, "item_id bigint, text string"))
    got = by_id(got.select("*", F.size("items").alias("k"), F.sha2(F.array_join("items", ","), 256).alias("sha")), "n_words", "n_hit", "k", "sha", "contaminated")
    assert got == brute.hits(docs, [{"item_id": i, "text": t} for i, t in bench])


def test_decontamination_removal(spark, frame, docs):
    bench = items(docs)[:8]
    table = spark.createDataFrame(bench, "item_id bigint, text string")
    want = brute.hits(docs, [{"item_id": i, "text": t} for i, t in bench])
    left = decontam.decontaminate(frame, table)
    assert left.columns == frame.columns
    assert {r["doc_id"] for r in left.collect()} == {i for i, w in want.items() if not w[4]}
    cut = by_id(decontam.decontaminate(frame, table, remove="spans"), "text")
    again = brute.hits([{"doc_id": i, "text": t} for i, (t,) in cut.items()], [{"item_id": i, "text": t} for i, t in bench])
    for d in docs:
        if not want[d["doc_id"]][1]:
            assert cut[d["doc_id"]] == (d["text"],)
        else:
            assert again[d["doc_id"]][0] == want[d["doc_id"]][0] - want[d["doc_id"]][1]
    assert decontam.find_hits(frame, table.limit(0)).where("n_hit > 0").count() == 0
    assert decontam.find_hits(frame.limit(0), table).count() == 0


def test_spotsigs_edits(frame, docs):
    rows = spotsigs.edit_report(frame).collect()
    want = brute.edited(docs)
    assert {r["doc_id"]: (r["n_chars"], r["edited_sha256"]) for r in rows} == want
    from xxhash import xxh3_64_intdigest

    drawn = lambda w: xxh3_64_intdigest(w.encode()) % spotsigs.SPARE == 0
    text = {d["doc_id"]: d["text"] or "" for d in docs}
    ids = sorted(text)
    prints = {}
    for i, after in zip(ids, [*ids[1:], ids[0]], strict=True):
        r = next(r for r in rows if r["doc_id"] == i)
        q = len(text[i]) // 4
        own, edited, following = (brute.spots(t, spotsigs.ANCHORS, drawn) for t in (text[i], text[i][: len(text[i]) - q] + text[after][:q], text[after]))
        assert r["near_edited"] == pytest.approx(brute.alike(own, edited)) and r["near_next"] == pytest.approx(brute.alike(own, following))
        assert len(base64.b64decode(r["fingerprint"])) == 4 * len(own) and len(base64.b64decode(r["edited_fingerprint"])) == 4 * len(edited)
        assert prints.setdefault(own, r["fingerprint"]) == r["fingerprint"] and prints.setdefault(edited, r["edited_fingerprint"]) == r["edited_fingerprint"]
    assert len(set(prints.values())) == len(prints)


def test_spotsigs_splices():
    """Cut at any two places, the words of two joined texts are hashed as those of the whole."""
    known = spotsigs.Words(frozenset(x.encode() for x in spotsigs.ANCHORS))
    of = lambda x: spotsigs._hashes(spotsigs._bytes(x), known)
    for text, after in (("the cat, sat on a mat ", " Of\u00e9 two  words\nand"), ("", "a b"), ("word", ""), ("word", "word"), ("...", "the end"), ("a b", "\t"), ("\u4f60\u597d x", "y\u4f60 \ud800z")):
        for i in range(len(text) + 1):
            for j in range(len(after) + 1):
                got = spotsigs.spliced(text[:i], after[:j], of(text), of(after), known)
                assert got.tolist() == of(text[:i] + after[:j]).tolist(), (text[:i], after[:j])


def test_spotsigs_signs_many_texts_at_once():
    """Signatures of texts worked out together are those of each alone: without words, without anchors, with anchors only, at ends, over several rounds."""
    known = spotsigs.Words(frozenset(x.encode() for x in spotsigs.ANCHORS))
    rng = random.Random(2)
    texts = ["", "the", "the of and", "zebra", "zebra quagga okapi", None, "a cat", "cat a", "the cat sat on the mat the cat sat on the mat", ""]
    texts += [" ".join(rng.choice(["the", "of", "x1", "x2", "x3", "x4", "\u4f60"]) for _ in range(rng.randrange(12))) for _ in range(200)]
    for some in (texts, texts[:1], ["", None], []):
        want = [spotsigs.signatures(x or "", known).tolist() for x in some]
        for most in (1, 50, 1 << 17):
            assert [s.tolist() for s in spotsigs.signatures_each(pa.array(some, pa.string()), known, most=most)] == want


def test_scratch_forgets_tables(spark):
    with Scratch(spark, "forgets") as scratch:
        kept = [scratch.keep(spark.range(n)) for n in (3, 4)]
        scratch.forget(kept[0])
        assert not exists(spark, f"{scratch.path}/1") and kept[1].count() == 4


def test_spotsigs_hot_ids(spark):
    """One id for most rows: its rows follow in the order of their texts' hashes, over many ranges."""
    rows = [(7 if i % 3 else (None if i % 2 else i), f"the cat{i} sat on a mat{i} of {i}") for i in range(300)]
    got = spotsigs.edit_report(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted((r["doc_id"] or -1, r["n_chars"]) for r in got) == sorted((i or -1, len(t)) for i, t in rows)
    hashes = {r["text"]: r["h"] for r in spark.createDataFrame(rows, "doc_id bigint, text string").select("text", F.xxhash64("text").alias("h")).collect()}
    order = sorted(rows, key=lambda r: (-(2**63) if r[0] is None else r[0], hashes[r[1]]))
    want = sorted(brute.sha(t[: len(t) - len(t) // 4] + n[: len(t) // 4]) for (_, t), (_, n) in zip(order, [*order[1:], order[0]], strict=True))
    assert sorted(r["edited_sha256"] for r in got) == want


def test_spotsigs_repeats_and_empty(spark, frame):
    assert spotsigs.edit_report(frame.limit(0)).count() == 0
    one = spark.createDataFrame([(5, "the cat sat of old"), (5, "the cat sat of old"), (5, "b"), (None, "c d e f")], "doc_id bigint, text string")
    assert spotsigs.edit_report(one).count() == 4


def classes_of(sets: dict, percent: int) -> dict:
    """The smallest id reachable from each, by comparing all with all."""
    low = {i: i for i in sets}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    while True:
        before = dict(low)
        for a, b in links:
            low[a] = low[b] = min(low[a], low[b])
        if low == before:
            return low


@pytest.mark.parametrize("percent", [60, 80])
def test_spotsigs_near_classes(frame, percent):
    sets = {r["doc_id"]: frozenset(r["sigs"]) for r in spotsigs.fingerprints(frame).collect()}
    want = classes_of(sets, percent)
    assert by_id(spotsigs.near_classes(frame, percent), "class_id") == {i: (c,) for i, c in want.items()}
    assert by_id(spotsigs.edit_report(frame, percent=percent), "class_id") == {i: (c,) for i, c in want.items()}
    assert len(set(want.values())) < len(want) - 10


def test_spotsigs_mass_of_near_copies(spark, monkeypatch):
    """Two groups of near copies, chains of edits and a mass on one template below the threshold: classes as by comparing all, without pairs of all with all."""
    seen, confirm = [], spotsigs.confirm
    monkeypatch.setattr(spotsigs, "confirm", lambda pairs, full, percent: seen.append(pairs.count()) or confirm(pairs, full, percent))
    rng = random.Random(11)
    word = lambda: f"r{rng.randrange(10**9)}"
    texts = []
    for g in range(2):
        base = [x for i in range(150) for x in ("the", f"g{g}w{i}")]
        texts += [" ".join(word() if rng.random() < 0.02 else w for w in base) for _ in range(150)]
    chain = [x for i in range(100) for x in ("of", f"c{i}")]
    for i in range(40):
        chain[2 * i + 1] = word()
        texts.append(" ".join(chain))
    template = [x for i in range(100) for x in ("in", f"t{i}")]
    for _ in range(200):
        t = template[:]
        for at in rng.sample(range(100), 7):
            t[2 * at + 1] = word()
        texts.append(" ".join(t))
    rng.shuffle(texts)
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(4)
    sets = {r["doc_id"]: frozenset(r["sigs"]) for r in spotsigs.fingerprints(frame).collect()}
    assert by_id(spotsigs.near_classes(frame), "class_id") == {i: (c,) for i, c in classes_of(sets, 80).items()}
    assert sum(seen) < 10_000  # of some 45,000 in groups


def test_spotsigs_short_lists_are_joined_once(spark, monkeypatch):
    """A group of near copies needs samples; lists of a few sets are read in the last one only, and two places after which too little is left make no list."""
    seen, across = {}, neardup.across
    sizes = lambda posted, grade: [r["count"] for r in posted.where(F.col("asks") >= grade).groupBy("shingle").count().collect()] if "asks" in posted.columns else [r["count"] for r in posted.groupBy("shingle").count().collect()]
    monkeypatch.setattr(neardup, "across", lambda ids, posted, roots, percent, grade, *rest: seen.update({grade: sizes(posted, grade)}) or across(ids, posted, roots, percent, grade, *rest))
    rng = random.Random(5)
    # Each set of the group is near some others only, so that its star leaves several components.
    base = [x for i in range(100) for x in ("the", f"g{i}")]
    texts = [" ".join(f"r{rng.randrange(10**9)}" if x != "the" and rng.random() < 0.07 else x for x in base) for _ in range(90)]
    texts += [" ".join(x for i in range(40) for x in ("of", f"p{g if i < 6 else (g, i, j)}q{i}".replace(" ", ""))) for g in range(60) for j in range(2)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(4)
    sets = {r["doc_id"]: frozenset(r["sigs"]) for r in spotsigs.fingerprints(frame).collect()}
    assert by_id(spotsigs.near_classes(frame), "class_id") == {i: (c,) for i, c in classes_of(sets, 80).items()}
    assert max(seen) > 0 and all(min(c) > neardup.SHORT for grade, c in seen.items() if grade and c)


def test_spotsigs_classes_of_odd_rows(spark):
    text = " ".join(f"the word{i} of thing{i} and other{i}" for i in range(30))
    rows = [(None, text + " the end", 1), (4, text, 1), (4, text, 1), (4, "a short one", 1), (9, None, 1), (8, "", 1), (-(2**62), "a short one", 1)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, Mark int")
    got = sorted((str(r["doc_id"]), str(r["class_id"])) for r in spotsigs.near_classes(df).collect())
    assert got == sorted([("None", "None"), ("4", "None"), ("4", "None"), ("4", str(-(2**62))), ("9", "8"), ("8", "8"), (str(-(2**62)), str(-(2**62)))])
    assert sorted((str(r["doc_id"]), str(r["class_id"])) for r in spotsigs.edit_report(df).collect()) == got
    assert spotsigs.near_classes(df.limit(0)).count() == 0


def test_warc_round_trip(spark):
    html = ["<p>a</p>", None, "", "<p>a</p>", "WARC/1.0\r\nContent-Length: 5\r\n\r\nfake\r\n\r\n", "é€😀", "x" * 300_000, "<p>a</p>", "\r\n\r\n"]
    pages = [{"page_id": 10 - i, "url": None if i == 2 else f"http://h/{i} b", "html": h} for i, h in enumerate(html)]
    df = spark.createDataFrame([(p["page_id"], p["url"], p["html"], "clash") for p in pages], "page_id bigint, url string, html string, digest string")
    got = warc.captures(df)
    assert by_id(got, "payload_bytes", "payload_digest", "record_type", "refers_to", key="page_id") == brute.warc(pages)
    assert got.where("request is null or metadata is null").count() == 0
    path = f"{shared_dir(spark)}/warc-test"
    warc.write_warc(df, path, least_bytes=5)
    full = warc.assemble(warc.read_warc(spark, path, payloads=True))
    text = {r["page_id"]: r["response"]["content"] for r in full.where("record_type = 'response'").collect()}
    assert text[4] == "x" * 300_000
    assert text[6] == html[4] and text[5] == html[5]
    assert full.where("record_type = 'revisit'").count() == 2
    assert warc.captures(df.limit(0)).count() == 0


def test_warc_members_and_urls(spark):
    import zlib

    pages = [(i, u, "p" * 100 * i) for i, u in enumerate(["http://h/a\nb c\x7f", "http://h/%20", "u\r\nX-Page-Id: 9", "", "http://h/é"])]
    path = f"{shared_dir(spark)}/warc-members"
    warc.write_warc(spark.createDataFrame(pages, "page_id bigint, url string, html string"), path)
    files = [r["content"] for r in spark.read.format("binaryFile").load(path).where("length > 0").collect()]
    n = 0
    for data in files:
        while data:
            member = zlib.decompressobj(31)
            record = member.decompress(data)
            assert record.startswith(b"WARC/1.0\r\n") and record.endswith(b"\r\n\r\n") and record.count(b"WARC-Type") == 1 and member.eof
            data, n = member.unused_data, n + 1
    assert n == 15
    uris = {r["page_id"]: r["uri"] for r in warc.assemble(warc.read_warc(spark, path)).collect()}
    assert uris == {0: "http://h/a%0Ab%20c%7F", 1: "http://h/%20", 2: "u%0D%0AX-Page-Id:%209", 3: "", 4: "http://h/é"}


def test_warc_reads_what_is_whole():
    import gzip

    record = lambda i, size=3: f"WARC/1.0\r\nWARC-Type: metadata\r\nX-Page-Id: {i}\r\nContent-Length: {size}\r\n\r\nabc\r\n\r\n".encode()
    bad = b"WARC/1.0\r\nWARC-Type: metadata\r\nContent-Length: many\r\n\r\nabc\r\n\r\n"
    kinds = lambda data: [(r[1], r[3]) for r in warc.parse_warc(data)]
    whole = [("metadata", 1), ("error", None), ("metadata", 2)]
    assert kinds(record(1) + bad + record(2)) == whole
    assert kinds(gzip.compress(record(1)) + gzip.compress(bad) + gzip.compress(record(2))) == whole
    assert kinds(gzip.compress(record(1) + bad + record(2))) == whole
    assert kinds(record(1) + record(2)[:-9]) == kinds(record(1) + record(2, 30)) == [("metadata", 1), ("error", None)]
    cut = gzip.compress(record(1)) + gzip.compress(record(2))[:-12]
    assert kinds(cut)[0] == ("metadata", 1) and kinds(cut)[-1] == ("error", None)
    assert kinds(gzip.compress(record(1)) + b"junk")[-1] == ("error", None) and kinds(b"junk") == [("error", None)]
    assert kinds(b"") == [] and kinds(b"WARC/1.0\r\n") == [("error", None)]
    response = b"WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    assert kinds(response + record(4)) == [("error", None), ("metadata", 4)]


def test_warc_repeated_rows(spark):
    df = spark.createDataFrame([(1, "u", "a"), (1, "u", "a"), (1, "v", "b"), (None, None, "a")], "page_id bigint, url string, html string")
    assert warc.captures(df).count() == 4


def test_near_duplicates(frame, docs):
    got = by_id(neardup.near_duplicates(frame), "n_shingles", "component_id")
    assert got == brute.near(docs)
    five = by_id(neardup.near_duplicates(frame, 80, 5), "n_shingles", "component_id")
    assert five == brute.near(docs, 80, 5)


def test_near_duplicates_in_large_groups(spark):
    """Drifting copies: nodes far larger than a leaf, with similarities on both sides of the threshold."""
    rng = random.Random(11)
    base = [f"w{rng.randrange(3000)}" for _ in range(150)]
    rows = []
    for i in range(400):
        edit = base[:]
        for _ in range(rng.randrange(0, 9)):
            edit[rng.randrange(150)] = f"e{i}_{rng.randrange(1000)}"
        rows.append((i, " ".join(edit)))
    got = by_id(neardup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")), "n_shingles", "component_id")
    assert got == brute.near([{"doc_id": i, "text": t} for i, t in rows])


def test_near_duplicates_in_a_mass_below_the_threshold(spark):
    """Pairs at 0.865 inside a mass at about 0.83: no node is ever a leaf, and no hub has a link."""
    rng = random.Random(5)
    base = [f"w{i}" for i in range(500)]
    edits = [{p: f"e{i}_{p}" for p in rng.sample(range(2, 498), 8)} for i in range(600)]
    for x in range(0, 60, 2):
        edits[x + 1] = dict(list(edits[x].items())[:2]) | dict(list(edits[x + 1].items())[2:])
    rows = [(i, " ".join(e.get(p, w) for p, w in enumerate(base))) for i, e in enumerate(edits)]
    got = by_id(neardup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")), "n_shingles", "component_id")
    want = brute.near([{"doc_id": i, "text": t} for i, t in rows])
    assert sum(c != i for i, (_, c) in want.items()) >= 25
    assert got == want


def test_near_duplicates_exact_way_finds_what_one_tree_loses(spark, frame, docs):
    got = by_id(neardup.near_duplicates(frame, trees=1, depth=2, leaf=2, exact=True), "n_shingles", "component_id")
    assert got == brute.near(docs)


def test_components_of_long_chains(spark):
    rng = random.Random(9)
    mixed = rng.sample(range(1000), 1000)
    chains = [(i, i + 1) for i in range(999)] + [(2000 + a, 2000 + b) for a, b in zip(mixed, mixed[1:], strict=False)]
    star = [(5000, 4000 + i) for i in range(300)] + [(5000, 4000)] * 3 + [(None, 1), (7, 7), (6000, 6000)]
    got = by_id(components(spark.createDataFrame(chains + star, "a bigint, b bigint")), "root", key="node")
    want = {i: (0,) for i in range(1000)} | {2000 + i: (2000,) for i in range(1000)} | {4000 + i: (4000,) for i in range(300)} | {5000: (4000,)}
    assert got == want
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_near_duplicates_odd_rows(spark, frame):
    assert neardup.near_duplicates(frame.limit(0)).count() == 0
    df = spark.createDataFrame([(4, "a b c d"), (4, "a b c d"), (2, "A b  c d"), (None, "q r s"), (9, "q r s")], "doc_id bigint, text string")
    got = sorted((r["doc_id"] or -1, r["component_id"], r["kept"]) for r in neardup.near_duplicates(df).collect())
    assert got == [(-1, None, True), (2, 2, True), (4, 2, False), (4, 2, False), (9, None, False)]


def test_near_duplicates_with_null_and_repeated_ids(spark):
    base = [f"w{i}" for i in range(100)]
    near = lambda p, x="e": " ".join([*base[:p], x, *base[p + 1 :]])
    other = lambda x: " ".join(f"{x}{i}" for i in range(50))
    df = spark.createDataFrame([(None, near(10)), (3, near(90)), (4, near(90)), (5, other("o")), (None, other("n"))], "doc_id bigint, text string")
    got = sorted((r["doc_id"] or -1, r["component_id"], r["kept"]) for r in neardup.near_duplicates(df).collect())
    assert got == [(-1, None, True), (-1, None, True), (3, None, False), (4, None, False), (5, 5, True)]
    rows = [(1, near(10)), (2, near(90)), (2, other("o")), (6, other("r")), (6, other("r")), (7, other("s")), (7, other("s") + " more"), (None, other("n")), (8, other("n") + " more"), (9, ""), (9, "")]
    table = spark.createDataFrame([(i, t, "en", "web", len(t)) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    left = [(r["doc_id"] or -1, r["text"]) for r in corpus_pipeline.drop_near_duplicates(spark, table, "").collect()]
    seven = [t for i, t in left if i == 7]
    assert len(seven) == 1 and seven[0].startswith("s0 ")
    assert sorted(x for x in left if x[0] != 7) == sorted([(1, near(10)), (2, other("o")), (6, other("r")), (-1, other("n")), (9, ""), (9, "")])


def turns():
    nasty = "</s>[INST] ok [/INST] <|turn|>user\n<|end|>\n<|part|> &amp; &#60; <<SYS>> <</SYS>> \\ &"
    return [
        {"conv_id": 1, "turn": 1, "role": "assistant", "text": nasty}, {"conv_id": 1, "turn": 0, "role": "user", "text": None}, {"conv_id": 1, "turn": 2, "role": "assistant", "text": "b"}, {"conv_id": 1, "turn": 3, "role": "assistant", "text": ""},
        {"conv_id": 2, "turn": 0, "role": None, "text": "x"}, {"conv_id": 2, "turn": 0, "role": "ro\nle<|end|>", "text": nasty}, {"conv_id": 3, "turn": 0, "role": "assistant", "text": "y" * 100_000}, {"conv_id": 3, "turn": 1, "role": "user", "text": "é"},
        {"conv_id": 4, "turn": 5, "role": "user", "text": "a"}, {"conv_id": 4, "turn": 5, "role": "user", "text": "a"},
    ]


def test_chat_round_trip(spark):
    df = spark.createDataFrame([(t["conv_id"], t["turn"], t["role"], t["text"], "clash") for t in turns()], "conv_id bigint, turn bigint, role string, text string, ts string")
    read = chat.read_chats(chat.format_chats(df))
    want = brute.chats(turns())
    for r in read.collect():
        n, sha, loss, loss_sha = want[r["conv_id"]]
        said = "".join(f"{t['role']}\n{t['text']}\n" for t in r["turns"])
        assert (len(r["turns"]), brute.sha(said), len(r["loss_text"]), brute.sha(r["loss_text"])) == (n, sha, loss, loss_sha)
    one = read.where("conv_id = 1").first()
    assert one["formatted"].count(chat.TURN) == 2 and one["formatted"].count(chat.PART) == 2 and "</s>" not in one["formatted"] and "[INST]" not in one["formatted"]
    assert chat.format_chats(df.limit(0)).count() == 0


def test_language(spark):
    rng = random.Random(5)
    stock = {"en": "the of and house river stone water light people think".split(), "de": "der die und über straße wasser licht leute denken schön".split(), "ru": "дом река камень вода свет люди думать и в на".split()}
    rows = [(i, " ".join(rng.choice(stock[k]) for _ in range(20)), k) for i, k in enumerate(rng.choice(list(stock)) for _ in range(300))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = language.train(df.where(~language.holdout()))
    named = language.identify(df, model)
    hits = named.where(language.holdout()).agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert hits > 0.97
    odd = spark.createDataFrame([(1, None, "k"), (2, "", "k"), (3, "12 !?", "k"), (4, "der die und straße wasser leute schön the people think of light and water river", "k"), (5, "x " * 50_000, "k")], "doc_id bigint, text string, score string")
    got = {r["doc_id"]: r for r in language.identify(odd, model).collect()}
    assert [got[i]["lang_pred"] for i in (1, 2, 3)] == ["und"] * 3 and got[3]["score"] == 0
    assert [s["lang"] for s in got[4]["lang_spans"]] == ["de", "en"]
    empty = language.train(df.limit(0))
    assert {r["lang_pred"] for r in language.identify(df, empty).collect()} == {"und"}
    assert language.identify(df.limit(0), model).count() == 0


def test_language_matches_plain(spark):
    rng = random.Random(6)
    stock = {"en": "the of and house river stone water light people think", "de": "der die und über straße wasser licht leute denken schön", "ru": "дом река камень вода свет люди думать", "hi": "नदी पत्थर पानी प्रकाश लोग सोचना"}
    stock = {k: v.split() for k, v in stock.items()}
    rows = [(i, " ".join(rng.choice(stock[k]) for _ in range(rng.randrange(1, 15))), k) for i, k in enumerate(rng.choice(list(stock)) for _ in range(200))]
    model = language.train(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    plain = brute.language_model([(t, k) for _, t, k in rows], language.SCRIPTS)
    mixed = [" ".join(rng.choice(stock[rng.choice(list(stock))]) for _ in range(12)) for _ in range(20)]
    texts = [None, "", "12 !", "中文文本在这里", "the 中文文本在这里", "xq zzk", "प्रकाश", "a", "Δοκιμή κειμένου", *[t for _, t, _ in rows[:60]], *mixed]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in language.identify(df, model).collect()}
    for i, t in enumerate(texts):
        lang, score = brute.language_of(t, plain, language.SCRIPTS)
        assert (got[i]["lang_pred"], got[i]["score"]) == (lang, pytest.approx(score, abs=1e-4)), t
    assert got[3]["score"] == got[8]["score"] == 0 and 0 < got[4]["score"] < 0.4 and got[6]["lang_pred"] == "hi" and len(got[6]["lang_spans"]) == 1
    one = language.train(spark.createDataFrame(rows, "doc_id bigint, text string, lang string").where("lang = 'en'"))
    assert {r["lang_pred"] for r in language.identify(df, one).where("doc_id > 5").collect()} == {"en"}
    two = language.train(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), most_langs=2)
    assert len(two["langs"]) == 2
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)] + [(1000 + i, t, k, "s", len(t)) for i, t, k in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    left = {r["doc_id"] for r in corpus_pipeline.identify_language(spark, docs, "").collect()}
    assert left >= {1000 + i for i, _, _ in rows} and not left & {0, 1, 2, 3, 8}


def test_viterbi_matches_plain(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    lengths = np.array([1, 7, 0 + 3, 1, 12])
    scores = rng.normal(size=(lengths.sum(), 3)).astype(np.float32)
    got = language.viterbi(scores, lengths, 0.8)
    at = 0
    for n in lengths:
        s = scores[at : at + n]
        import itertools

        cost = lambda p: sum(s[i][x] for i, x in enumerate(p)) - 0.8 * sum(a != b for a, b in zip(p, p[1:], strict=False))
        best = max(cost(p) for p in itertools.product(range(3), repeat=n)) if n <= 7 else None
        if best is not None:
            assert cost(got[at : at + n]) == pytest.approx(best, abs=1e-4)
        at += n


def test_line_dedup(frame, docs):
    got = line_dedup.dedup_lines(frame.select("doc_id", "text"))
    have = {r["doc_id"]: (r["_n_lines"], r["_n_dropped"], brute.sha(r["_kept"])) for r in got.collect()}
    assert have == brute.lines(docs)
    maps = by_id(line_dedup.keep_bitmaps(frame), "n_lines", "n_dropped", "keep")
    for i, (n, gone, keep) in maps.items():
        runs = [int(x) for x in keep.split(",")]
        assert sum(runs) == n and sum(runs[1::2]) == gone and (n, gone) == have[i][:2]


def test_line_dedup_odd_rows(spark, frame):
    long = "this line is long enough to count"
    df = spark.createDataFrame([(1, long), (1, long), (2, f"{long}\n{long}"), (3, f"a\n  {long.upper()} "), (3, None), (None, long)], "doc_id bigint, text string")
    got = sorted((r["doc_id"] or -1, r["_n_dropped"], r["_kept"]) for r in line_dedup.dedup_lines(df).collect())
    assert got == [(-1, 1, ""), (1, 1, ""), (1, 1, ""), (2, 2, ""), (3, 0, ""), (3, 0, f"a\n  {long.upper()} ")]
    assert line_dedup.dedup_lines(frame.limit(0)).count() == 0 and line_dedup.keep_bitmaps(frame.limit(0)).count() == 0


def luhn(digits: str) -> bool:
    return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def test_pii(spark):
    from weftgraph.llm import pii

    texts = [
        "card 4111 1111 1111 1111, again 4111 1111 1111 1111 and 4111111111111111.", "bad card 4111111111111112 and 1234", "mail Jo.Doe42@mail7.example.com, +1 (017) 555-7713!", "host 10.20.30.255 not 10.20.30.256 nor 1.2.3.4.5", "born 1985-02-28 not 2023-02-30",
        'token = "5f8a0b1c2d3e4f5061728394a5b6c7d8e9f00112" ok', "ssn 123-45-6789 not 000-12-3456", None, "", "no digits here", "4111111111111111", "CC BY 4.0. x@y", "word " * 50_000 + "4111111111111111",
    ]
    df = spark.createDataFrame([(i, t, "k") for i, t in enumerate(texts)], "doc_id bigint, text string, n_pii string")
    got = {r["doc_id"]: r for r in pii.pseudonymise(df, "key").collect()}
    a = re.match(r"card (\d{4} \d{4} \d{4} \d{4}), again (\d{4} \d{4} \d{4} \d{4}) and (\d{16})\.$", got[0]["text"])
    assert a[1] == a[2] and a[1].replace(" ", "") == a[3] == got[10]["text"] != "4111111111111111" and luhn(a[3]) and got[12]["text"].endswith(a[3])
    for i in (1, 7, 8, 9, 11):
        assert got[i]["text"] == texts[i] and got[i]["n_pii"] == 0
    m = re.match(r"mail ([A-Z][a-z]\.[A-Z][a-z]{2}\d{2})@mail7\.example\.com, \+1 \(\d{3}\) \d{3}-\d{4}!$", got[2]["text"])
    assert m and m[1] != "Jo.Doe42" and "(017) 555-7713" not in got[2]["text"]
    ip = re.match(r"host (\d+)\.(\d+)\.(\d+)\.(\d+) not 10\.20\.30\.256 nor 1\.2\.3\.4\.5$", got[3]["text"])
    assert all(int(x) < 256 for x in ip.groups())
    assert re.match(r"born (1[89]|2[01])\d\d-\d\d-\d\d not 2023-02-30$", got[4]["text"]) and "1985-02-28" not in got[4]["text"]
    assert re.match(r'token = "[0-9a-f]{40}" ok$', got[5]["text"]) and "5f8a0b" not in got[5]["text"]
    assert re.match(r"ssn \d{3}-\d{2}-\d{4} not 000-12-3456$", got[6]["text"]) and "123-45-6789" not in got[6]["text"]
    assert [x["kind"] for x in got[2]["pii_found"]] == ["email", "phone"]
    assert pii.pseudonymise(df, "other").where("doc_id = 10").first()["text"] != a[3]
    assert pii.pseudonymise(df.limit(0), "key").count() == 0


def test_pii_matches_plain(spark):
    from weftgraph.llm import pii

    values = [
        ("card", "4111 1111 1111 1111"), ("card", "4111111111111111"), ("card", "4111111111111112"), ("card", "378282246310005"), ("phone", "+49 30 1234567"), ("phone", "+49301234567"), ("phone", "+33 1 23 45 67 89"), ("phone", "+33123456789"),
        ("phone", "+1 (212) 555-0199"), ("phone", "(212) 555-0199"), ("phone", "+12125550199"), ("phone", "+353 87 123 4567"), ("phone", "+1 23 45"), ("ssn", "123-45-6789"), ("ssn", "666-12-3456"), ("ssn", "899-99-9999"), ("ip", "0.0.0.0"), ("ip", "192.168.255.1"),
        ("date", "1985-02-28"), ("date", "1750-01-01"), ("date", "1000-12-31"), ("date", "2999-06-15"), ("date", "2023-02-30"), ("date", "2000-02-29"), ("date", "1900-02-29"), ("email", "Jo@x.com"), ("email", "jo@x.com"), ("email", "A.b-C_9@mail7.example.com"), ("email", "z@q.org"), ("email", "UPPER.CASE@x.com"),
        ("secret", "5f8a0b1c2d3e4f5061728394a5b6c7d8e9f00112"), ("secret", "5F8A0B1C2D3E4F5061728394A5B6C7D8E9F00112"),
    ]
    lead = {"secret": "key = "}
    df = spark.createDataFrame([(i, f"see {lead.get(k, '')}{v} there") for i, (k, v) in enumerate(values)], "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in pii.pseudonymise(df, "k1").collect()}
    for i, (kind, v) in enumerate(values):
        new = brute.pseudonym("k1", kind, v)
        assert got[i]["text"] == f"see {lead.get(kind, '')}{new or v} there", (kind, v)
        assert [x["kind"] for x in got[i]["pii_found"]] == ([kind] if new else [])
    new = {v: re.sub("[^0-9a-z]", "", got[i]["text"].split("see ")[1][: len(v)].lower()) for i, (_, v) in enumerate(values)}
    assert new["+49 30 1234567"] == new["+49301234567"] and new["+33 1 23 45 67 89"] == new["+33123456789"] and new["Jo@x.com"] == new["jo@x.com"]
    assert new["+1 (212) 555-0199"] == new["+12125550199"] == "1" + new["(212) 555-0199"]


def test_pii_permutations(spark):
    from weftgraph.llm import pii

    ids = spark.range(2000)
    pairs = ids.where("id < 1000").select(pii.permute_pair("k", "t", F.floor(F.col("id") / 20), F.col("id") % 20, 50, 20).alias("p"))
    assert pairs.select("p.a", "p.b").distinct().count() == 1000
    days = F.date_add(F.lit("1999-01-01").cast("date"), F.col("id").cast("int"))
    dates = ids.select(pii._date("k", F.date_format(days, "yyyy-MM-dd")).alias("d"))
    assert dates.where("d is not null").distinct().count() == 2000
    texts = ids.select(pii.permute_text("k", "t", F.lpad(F.col("id").cast("string"), 4, "0")).alias("x"))
    assert texts.where("x rlike '^[0-9]{4}$'").distinct().count() == 2000


def test_pii_patterns_survive_long_texts(spark):
    """A megabyte of each pattern's own characters, and planning within seconds."""
    from weftgraph.llm import pii

    n = 250_000
    long = [
        "a@" + "b." * n + "c", "a." * n + "a@b.c", "a@b" * n, "1." * n, "1-" * n, "+1 " + "22 " * n, "1234 " * n, "(212) " * n, "9" * (4 * n), "key=" + "ab" * n, "@" * n, "2020-" * n,
        ".".join(["1.2.3.4"] * n), "+" * n, "token: " * n,
    ]
    df = spark.createDataFrame(list(enumerate(long)), "doc_id bigint, text string")
    began = time.time()
    made = pii.pseudonymise(df, "key")
    made._jdf.queryExecution().executedPlan()
    assert time.time() - began < 20  # a second or two on an idle machine
    got = {r["doc_id"]: r for r in made.collect()}
    assert got[0]["n_pii"] == 1 and got[0]["text"].endswith("@" + "b." * n + "c")
    assert got[1]["n_pii"] == 1 and len(got[1]["text"]) == len(long[1]) and got[1]["text"] != long[1]
    assert all(len(got[i]["text"]) == len(t) for i, t in enumerate(long) if i != 12)


def test_a_mass_below_the_threshold_makes_few_pairs(spark, monkeypatch):
    """600 documents on one template of 200 words, each with four words of its own: all pairs are 179,700, at a similarity of about 0.79."""
    seen, confirm = [], neardup.confirm

    def counted(pairs, full, percent):
        seen.append(pairs.count())
        return confirm(pairs, full, percent)

    monkeypatch.setattr(neardup, "confirm", counted)
    rng = random.Random(1)
    texts = []
    for _ in range(600):
        w = [f"w{i}" for i in range(200)]
        for at in rng.sample(range(200), 4):
            w[at] = f"r{rng.randrange(10**9)}"
        texts.append(" ".join(w))
    got = by_id(neardup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(4)), "component_id")
    want = brute.near([{"doc_id": i, "text": t} for i, t in enumerate(texts)])
    assert {i: c for i, (c,) in got.items()} == {i: c for i, (_, c) in want.items()}
    assert sum(seen) < 10_000


def test_spotsigs_tells_rows_of_one_id_apart(spark):
    text = " ".join(f"the word{i} of thing{i} and other{i}" for i in range(30))
    df = spark.createDataFrame([(1, "a short one"), (1, text), (2, text + " the end")], "doc_id bigint, text string")
    assert sorted((r["doc_id"], r["class_id"]) for r in spotsigs.near_classes(df).collect()) == [(1, 1), (1, 1), (2, 1)]


def test_warc_deals_out_rows_that_repeat(spark, monkeypatch, tmp_path):
    """Rows without an id and with one payload, of which a task gets a few: all come back, from several files."""
    monkeypatch.setattr(warc, "REPEATS", 50)
    pages = spark.range(600).select(F.lit(None).cast("bigint").alias("page_id"), F.lit("http://a.b/c").alias("url"), F.lit("<p>same</p>").alias("html")).unionByName(spark.createDataFrame([(5, None, "<p>other</p>")], "page_id bigint, url string, html string"))
    found = warc.captures(pages)
    assert found.count() == 601 and found.where("page_id = 5").count() == 1
    warc.write_warc(pages, str(tmp_path / "w"))
    assert len([p for p in (tmp_path / "w").glob("part-*") if p.stat().st_size > 500]) > 1


def test_language_null_ids_scripts_and_clashing_names(spark):
    rows = [(i, "the house and the tree are there " * 3 + f"word{i}", "en") for i in range(40)] + [(40 + i, "das haus und der baum sind dort " * 3 + f"wort{i}", "de") for i in range(40)]
    df = spark.createDataFrame([*rows, (None, "the house", "en")], "doc_id bigint, text string, lang string")
    assert df.where(language.holdout()).where("doc_id is null").count() == 1
    model = language.train(df.withColumn("doc_id", F.lit(None).cast("bigint")), sample=20)
    assert model["langs"] == ["de", "en"]
    mixed = spark.createDataFrame([(1, "the house and the tree \u043c\u0438\u0440 \u0434\u043e\u043c", 1.0)], "doc_id bigint, text string, Score double")
    row = language.identify(mixed, model).first()
    assert [x["lang"] for x in row["lang_spans"]] == ["en", None] and language.identify(mixed, model).columns == ["doc_id", "text", "lang_pred", "score", "lang_spans"]
