"""Simhash near-duplicates, periodic runs and the conversation trie against plain Python versions."""

from __future__ import annotations

import hashlib
import random
import re
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from tests.llm.brute import ASCII_LOWER, SPACE_WORD, sha
from weftgraph.llm import queries, runs, simhash, trie

EDGES = [None, "", " \t\n", "a", "A b\tc", "a b c d", "A B C D", "x \x1c y\xa0z w", "é Ü ß e f g", "w " * 3000, "na " * 7, "na " * 5, "a b " * 4, "a b " * 3 + "a"]
CLASH = "doc_id bigint, text string, fp bigint, words string, Text2 string"


def table(spark, texts, first=1):
    return spark.createDataFrame([(first + i, t, 7, "clash", "x") for i, t in enumerate(texts)], CLASH)


# ---- simhash


def plain_fingerprint(text):
    w = SPACE_WORD.findall((text or "").translate(ASCII_LOWER))
    h = [xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(prints, most=4):
    """key -> the set of keys reachable; prints: key -> fingerprint."""
    fps = np.unique(np.array(list(prints.values()), np.uint64))
    root = np.arange(len(fps))
    for i in range(len(fps)):
        joined = np.unique(root[np.bitwise_count(fps[i] ^ fps) <= most])
        root[np.isin(root, joined)] = joined.min()
    of = dict(zip(fps.tolist(), root.tolist(), strict=True))
    return {k: of[v] for k, v in prints.items()}


def near_texts():
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 7)))
    texts = list(EDGES)
    for _ in range(12):
        base = [word() for _ in range(rng.randrange(150, 400))]
        for _ in range(rng.randrange(1, 9)):
            copy = list(base)
            for _ in range(rng.randrange(0, 3)):
                copy[rng.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
    return texts


def test_simhash_equals_plain_version(spark):
    texts = near_texts()
    got = {r["doc_id"]: r for r in simhash.simhash_duplicates(table(spark, texts)).collect()}
    prints = {i + 1: plain_fingerprint(t) for i, t in enumerate(texts)}
    assert {i: int(r["fingerprint"], 16) for i, r in got.items()} == prints
    group = plain_components(prints)
    least = {}
    for i, g in group.items():
        least[g] = min(i, least.get(g, i))
    assert {i: r["component_id"] for i, r in got.items()} == {i: least[g] for i, g in group.items()}
    assert len(set(least.values())) < len(set(prints.values()))  # some links are between different fingerprints


@pytest.mark.parametrize("crowd", [1024, 6])
def test_simhash_links_in_crowded_cells(spark, monkeypatch, crowd):
    """Many fingerprints that agree in one half: crowded cells are refined, and no link is lost."""
    monkeypatch.setattr(simhash, "CROWD", crowd)
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**64, 30, dtype=np.uint64)
    odd = np.array([int(x) ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 8), replace=False)) for x in base for _ in range(10)], np.uint64)
    low = (base[0] & np.uint64(0xFFFFFFFF00000000)) | rng.integers(0, 2**12, 150, dtype=np.uint64)
    high = (base[0] & np.uint64(0xFFFFFFFF)) | (rng.integers(0, 2**12, 150, dtype=np.uint64) << np.uint64(32))
    fps = np.unique(np.concatenate((base, odd, low, high)))
    with simhash.Scratch(spark, "test") as scratch:
        found = simhash.links(spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp bigint"), scratch).collect()
    root = {int(x): int(x) for x in fps}
    find = lambda x: x if root[x] == x else find(root[x])
    for r in found:
        a, b = (int(np.int64(r[k]).view(np.uint64)) for k in ("a", "b"))
        root[find(a)] = find(b)
    want = plain_components({int(x): int(x) for x in fps})
    assert len({find(x) for x in root}) == len(set(want.values()))
    assert all(find(x) == find(y) for x in root for y in [next(z for z in want if want[z] == want[x])])


def test_simhash_exact_copies_make_no_pairs(spark):
    copies = spark.range(3000).select("id", F.lit("the same words in every row").alias("text"))
    got = simhash.simhash_duplicates(copies, id_col="id")
    assert got.agg(F.count("*"), F.min("component_id"), F.max("component_id")).first()[:] == (3000, 0, 0)


def test_simhash_null_and_repeated_ids_and_empty_table(spark):
    df = spark.createDataFrame([(None, "a b c d e"), (3, "a b c d e"), (3, "q w e r t y u"), (None, None)], "doc_id bigint, text string")
    got = sorted(((r["doc_id"] is None, r["doc_id"] or 0, r["component_id"]) for r in simhash.simhash_duplicates(df).collect()), key=str)
    assert [x[:2] for x in got] == [(False, 3), (False, 3), (True, 0), (True, 0)] and {got[0][2], got[1][2]} == {None, 3}
    assert all(x[2] is None for x in got[2:])
    assert simhash.simhash_duplicates(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        simhash.simhash_duplicates(df, most=6)


# ---- runs


def plain_lyndon(w):
    return [max(j - i for j in range(i + 1, len(w) + 1) if all(w[i:j] < w[k:j] for k in range(i + 1, j))) for i in range(len(w))]


def plain_runs(w, least=6, exponent=4):
    out = []
    for q in range(1, len(w) // exponent + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            n = j - i + q
            if j > i and n >= max(least, exponent * q) and not any(all(w[x] == w[x + r] for x in range(i, i + n - r)) for r in range(1, q)):
                out.append((i, n, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_repeats(doc_id, text):
    w, h = SPACE_WORD.findall(text or ""), crc32(str(doc_id).encode())
    g, n = h // 10, len(SPACE_WORD.findall(text or ""))
    if h % 10 or not n:
        return w
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def periodic_texts(n):
    rng = random.Random(8)
    texts = list(EDGES)
    while len(texts) < n:
        w = []
        for _ in range(rng.randrange(0, 6)):
            unit = [rng.choice(["a", "b", "c", "Ä"]) for _ in range(rng.randrange(1, 5))]
            w += (unit * 8)[: rng.randrange(1, 30)] + [rng.choice("abcdefgh") for _ in range(rng.randrange(0, 6))]
        texts.append(rng.choice([" ", "\n", " \t "]).join(w))
    return texts


def test_lyndon_arrays():
    rng = random.Random(2)
    for _ in range(1500):
        w = [rng.randrange(rng.randrange(1, 4)) for _ in range(rng.randrange(1, 20))]
        assert runs.lyndon(w) == plain_lyndon(w)


@pytest.mark.parametrize(("least", "exponent"), [(6, 4), (2, 2), (9, 3)])
def test_runs_of_texts(least, exponent):
    texts = [SPACE_WORD.findall(t or "") for t in periodic_texts(400)]
    assert runs.search([[w.encode() for w in t] for t in texts], least, exponent) == [plain_runs(t, least, exponent) for t in texts]


def test_runs_query_equals_plain_version(spark):
    texts = periodic_texts(300)
    made = queries.with_repeats(table(spark, texts))
    got = {r["doc_id"]: r for r in runs.find_runs(made).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts, 1):
        w = plain_repeats(i, t)
        want = plain_runs(w)
        gone = {x for s, n, p in want for x in range(s + p, s + n)}
        assert [tuple(r) for r in got[i]["runs"]] == want
        assert got[i]["collapsed"] == " ".join(x for k, x in enumerate(w) if k not in gone) and got[i]["n_words"] == len(w)
        best = min(want, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
        assert got[i]["strongest"] == best or tuple(got[i]["strongest"]) == best


def test_runs_null_ids_empty_table_and_long_texts(spark):
    df = spark.createDataFrame([(None, "ha " * 9), (1, "ha " * 9), (1, "ha " * 9), (2, "x y " * 100_000)], "doc_id bigint, text string")
    rows = runs.find_runs(df).collect()
    assert sorted(len(r["runs"]) for r in rows) == [1, 1, 1, 1] and {r["collapsed"] for r in rows} == {"ha", "x y"}
    assert runs.find_runs(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        runs.find_runs(df, exponent=1)


# ---- trie


def plain_trie(convs):
    """convs: (conv_id, list of (role, text))."""
    members, kids, leaves, saved = {}, {}, {}, {}
    for c, ts in convs:
        for d in range(len(ts) + 1):
            members.setdefault(tuple(ts[:d]), []).append((c, len(ts)))
    for node in members:
        if node:
            kids.setdefault(node[:-1], []).append(node)
    for node in sorted(members, key=len, reverse=True):
        own = kids.get(node, [])
        leaves[node] = sum(leaves[x] for x in own) or 1
        saved[node] = sum(saved[x] for x in own) + (len(members[node]) - 1) * (len(SPACE_WORD.findall(node[-1][1])) if node else 0)
    first = {k: min(c for c, _ in m) for k, m in members.items()}
    ends = {k: ",".join(map(str, sorted(c for c, n in m if n == len(k)))) for k, m in members.items()}
    rows = [(first[k], len(k), first[k[:-1]] if k else None, len(m), len(kids.get(k, [])), leaves[k], saved[k], sha(ends[k])) for k, m in members.items()]
    return sorted(rows, key=str)


def nodes(df):
    return sorted([tuple(r[c] for c in trie.NODE) for r in df.collect()], key=str)


def random_convs(seed):
    rng = random.Random(seed)
    out = []
    for c in rng.sample(range(600), 150):
        ts = [(rng.choice(["user", "assistant"]), rng.choice(["x", "y  z", "p\nq r", ""])) for _ in range(rng.choice([0, 1, 2, 3, 4, 25] if seed % 2 else [1, 2, 3]))]
        out.append((c, [("user", "hi there")] * rng.randrange(0, 4) if rng.random() < 0.3 else ts))
    return out if seed != 2 else [(c, [("user", "hi")] * 3) for c, _ in out]


@pytest.mark.parametrize(("seed", "cells"), [(0, 20), (1, 20), (1, 500_000), (2, 20), (3, 60)])
def test_trie_over_blocks_and_ranges(spark, monkeypatch, seed, cells):
    """Small blocks and ranges, so that nodes go on over many of them; at seed 2 all conversations are the same."""
    monkeypatch.setattr(trie, "PIECE", 10 if seed == 2 else 1 << 20)
    convs = random_convs(seed)
    df = spark.createDataFrame(convs, "conv_id bigint, ts array<struct<r:string,t:string>>")
    made = df.select("conv_id", F.transform("ts", lambda x: trie.turn_ids(x["r"], x["t"])).alias("turns"))
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert nodes(trie.prefix_trie(made, cells)) == plain_trie(convs)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_trie_of_rebuilt_conversations(spark):
    rng = random.Random(4)
    rows = []
    for c in rng.sample(range(120), 90):
        for t in range(rng.randrange(1, 6)):
            rows.append((c, t if t else None, rng.choice(["user", "assistant", None]), rng.choice(["a b", "c", None, "É a"]), "clash"))
    rng.shuffle(rows)
    rows += [(None, 0, "user", "left out", "clash")]
    convs = {}
    for c, t, r, x, _ in sorted((row for row in rows if row[0] is not None), key=lambda row: (row[0], row[1] is not None, row[1] or 0)):
        convs.setdefault(c, []).append((r or "", x or ""))
    made = []
    for c, ts in convs.items():
        h = crc32(str(c).encode()) % 4
        made.append((c, convs.get(c - c % 20, [])[:h] + ts[h:]))
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, turns string")
    assert nodes(trie.prefix_trie(queries.rebuilt(df))) == plain_trie(made)


def test_trie_ties_repeats_and_empty_table(spark):
    rows = [(1, 0, "user", "a"), (1, 0, "user", "b"), (2, 0, "user", "b"), (2, 0, "user", "a")]
    schema = "conv_id bigint, turn bigint, role string, text string"
    a = nodes(trie.prefix_trie(trie.ordered(spark.createDataFrame(rows, schema))))
    b = nodes(trie.prefix_trie(trie.ordered(spark.createDataFrame(rows[::-1], schema))))
    assert a == b and len(a) == 3 and a[-1][3] == 2  # equal turns are ordered by content: both conversations are the same
    assert trie.prefix_trie(trie.ordered(spark.createDataFrame([], schema))).count() == 0
    turnless = spark.createDataFrame([(5,), (4,)], "conv_id bigint").select("conv_id", F.array().cast(f"array<{trie.TURN}>").alias("turns"))
    assert nodes(trie.prefix_trie(turnless)) == [(4, 0, None, 2, 0, 1, 0, hashlib.sha256(b"4,5").hexdigest())]


def test_words_are_the_same_everywhere():
    text = "a\x0bb\x0cc\rd\te\nf g\x1ch\x85i j"
    assert text.encode().split() == [w.encode() for w in SPACE_WORD.findall(text)] and re.fullmatch(r"\S+", "g\x1ch") is None
