"""Near duplicates by a chosen-path set similarity join.

A document's set is its distinct shingles of words. Documents with equal sets are merged first. Each of ``trees``
independent trees branches the rest by minwise tokens: the documents of a node share the tokens of the path chosen so
far. A node of up to ``leaf`` documents is compared exhaustively; a larger one branches on by its next token, down to
``depth`` tokens. Candidates pass a sketch (2 bits of each of 128 minwise tokens) and are confirmed on full sets of
64-bit shingle hashes.

A node that is still large at the last level holds a group of many near copies, or documents that share most of a text.
Its documents are compared with one hub, the one that is in large nodes of most trees, so a group of thousands is
linked as a star. What the hubs leave apart is then joined exactly: a prefix-filter join with a positional filter
(``across``) over all documents of such nodes finds every similar pair in different components, by widening
samples first, so that few pairs are made of what one link joins. A pair is made only if the two sets' odd sketches allow it; these
tell sets of up to some 2,500 shingles apart that are a few hundredths below the threshold, so a mass of documents on one template makes pairs in
proportion to its documents, not to their square. It is compared in memory still, sketch by sketch.

Recall of a pair of similarity s: it shares a node of the last level in some tree with probability 1 - (1 - s^depth)^trees,
however large the groups are; if that node or one above it is small, the pair is compared there, else both documents take part in
the exact join. With 12 trees of depth 3: 0.99999 at 0.85 and 0.9998 at 0.8. The sketch loses one pair in millions.
``exact`` puts every document into the exact join, so that no pair is left to chance but for equal 64-bit hashes.

Spark hashes words and moves all rows; numpy turns a batch's word hashes into sets and minwise tokens.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, ascii_lower, small
from .components import components

TREES, DEPTH, LEAF = 12, 3, 16
TOKENS = 128
#: One document of so many is counted to tell frequent shingles from rare ones; the order of shingles needs no more.
COUNTED = 8
#: Of two unequal tokens' bits a quarter agree by chance. Candidates pass from so far below the threshold: five deviations.
SLACK = 0.2
#: Of the largest component about so many documents take part in the first exact join.
FEW = 64
#: Lists of up to so many places are joined once, without samples.
SHORT = 8
#: So many ids are sent to all tasks at most; more are joined by a shuffle.
MOST_SENT = 1_000_000
SKETCH = ("s0", "s1", "s2", "s3")
#: Bits of an odd sketch: bit b is 1 if an odd number of a set's shingles fall on it. Where two sets' sketches differ, an odd number of the
#: shingles that only one of them has falls.
ODD = 1024
ODDS = tuple(f"o{i}" for i in range(ODD // 64))
_A = (np.random.default_rng(20240101).integers(0, 2**31, TOKENS, dtype=np.uint32) * np.uint32(2)) | np.uint32(1)
_B = np.random.default_rng(20240102).integers(0, 2**32, TOKENS, dtype=np.uint64).astype(np.uint32)
_M = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB], np.uint64)


def word_hashes(text: Column | str) -> Column:
    """Hashes of the words ``[^\\x20\\x09-\\x0D]+``, A-Z lower-cased; null for null."""
    parts = F.split(F.btrim(ascii_lower(text), F.lit(" \t\n\x0b\x0c\r")), r"[\x20\x09-\x0D]+", -1)
    return F.when(F.btrim(F.col(text) if isinstance(text, str) else text, F.lit(" \t\n\x0b\x0c\r")) == "", F.array().cast("array<bigint>")).otherwise(F.transform(parts, lambda w: F.xxhash64(w)))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M[1]
    x = (x ^ (x >> np.uint64(27))) * _M[2]
    return x ^ (x >> np.uint64(31))


def shingles(hashes: np.ndarray, width: int = 3) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of ``width`` words; of fewer words, all as one."""
    h = hashes.view(np.uint64)
    if not len(h):
        return h
    w = min(width, len(h))
    out = np.full(len(h) - w + 1, w, np.uint64)
    for i in range(w):
        out = _mix(out * _M[0] + h[i : len(h) - w + 1 + i])
    return np.unique(out)


def minwise(sets: np.ndarray, block: int = 4096) -> np.ndarray:
    """The minwise tokens of one set, as 32-bit numbers."""
    x = (sets >> np.uint64(32)).astype(np.uint32)
    out = np.full(TOKENS, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), block):
        np.minimum(out, (x[i : i + block, None] * _A + _B).min(0), out=out)
    return out


def sketch(tokens: np.ndarray) -> np.ndarray:
    """2 bits of each token in four numbers."""
    bits = ((tokens * np.uint32(0x85EBCA6B)) >> np.uint32(30)).astype(np.uint64).reshape(4, 32)
    return (bits << (np.arange(32, dtype=np.uint64) * np.uint64(2))).sum(1, dtype=np.uint64).view(np.int64)


def _lists(column: pa.Array) -> Iterator[np.ndarray]:
    flat, ends = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    for a, b in zip(ends[:-1], ends[1:], strict=True):
        yield flat[a:b]


def _set_id(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def described(docs: DataFrame, width: int, tokens: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, mark, n, set_id, tokens, s0..s3): a hash of the text, set size, a 128-bit id of the set (null if empty),
    its first minwise tokens and its sketch."""

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, ids, first, marks = [], [], [], []
            for hashes in _lists(batch.column("hs")):
                s = shingles(hashes, width)
                t = minwise(s) if len(s) else np.zeros(TOKENS, np.uint32)
                n.append(len(s))
                ids.append(_set_id(s) if len(s) else None)
                first.append(t[:tokens].view(np.int32))
                marks.append(sketch(t))
            flat = pa.array(np.concatenate(first) if first else np.empty(0, np.int32))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * tokens), flat)
            four = np.stack(marks) if marks else np.zeros((0, 4), np.int64)
            columns = [batch.column("doc_id"), batch.column("mark"), pa.array(n, pa.int64()), pa.array(ids, pa.binary()), lists]
            columns += [pa.array(four[:, i].copy()) for i in range(4)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "mark", "n", "set_id", "tokens", *SKETCH])

    words = F.coalesce(word_hashes(text_col), F.array().cast("array<bigint>"))
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.xxhash64(text_col).alias("mark"), words.alias("hs"))
    kinds = "doc_id bigint, mark bigint, n bigint, set_id binary, tokens array<int>, s0 bigint, s1 bigint, s2 bigint, s3 bigint"
    return rows.mapInArrow(describe, kinds)


def _differences(x: Column, y: Column) -> Column:
    """In how many of the 128 places two sketches differ."""
    out = F.lit(0)
    for c in SKETCH:
        z = x[c].bitwiseXOR(y[c])
        out = out + F.bit_count(z.bitwiseOR(F.shiftright(z, 1)).bitwiseAND(F.lit(0x5555555555555555)))
    return out


def _likely(x: Column, y: Column, percent: int) -> Column:
    """Whether sizes and sketches allow a similarity of ``percent`` / 100."""
    sizes = F.least(x["n"], y["n"]) * 100 >= F.greatest(x["n"], y["n"]) * percent
    return sizes & (_differences(x, y) <= F.lit(int(TOKENS * 0.75 * (1 - percent / 100 + SLACK))))


def _paths(sets: DataFrame, trees: int, depth: int) -> DataFrame:
    """(id, k1, ..., one row per tree): the keys of the nodes on the document's path, one per level."""
    tree = lambda t: [F.xxhash64(F.lit(t), F.slice("tokens", t * depth + 1, level)).alias(f"k{level}") for level in range(1, depth + 1)]
    return sets.select("id", F.explode(F.array(*[F.struct(*tree(t)) for t in range(trees)])).alias("x")).select("id", "x.*")


def branch(sets: DataFrame, scratch: Scratch, trees: int, depth: int, leaf: int) -> tuple[DataFrame, DataFrame]:
    """(small, large), both (key, id): the documents of nodes of 2 to ``leaf`` documents, and those of
    nodes of the last level that have more. Counts are combined before the shuffle; most documents are alone in
    their first nodes and go no further."""
    rest, found = _paths(sets, trees, depth), []
    for level in range(1, depth + 1):
        key = F.col(f"k{level}").alias("key")
        sizes = rest.groupBy(key).agg(F.count(F.lit(1)).alias("size")).where("size > 1")
        met = scratch.keep(rest.withColumn("key", key).join(sizes, "key"))
        found.append(met.where(F.col("size") <= leaf).select("key", "id"))
        rest = met.where(F.col("size") > leaf).drop("key", "size")
    return reduce(DataFrame.unionByName, found), met.where(F.col("size") > leaf).select("key", "id")


def leaf_pairs(small: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Likely pairs (a, b) of the documents under each key; a key has a leaf's documents at most."""
    me = F.struct("id", "n", *SKETCH).alias("me")
    nodes = small.join(sets.select("id", me), "id").groupBy("key").agg(F.sort_array(F.collect_set("me")).alias("xs"))
    mate = lambda x, i: F.filter(F.slice("xs", i + 2, F.size("xs")), lambda y: _likely(x, y, percent))
    pairs = F.flatten(F.transform("xs", lambda x, i: F.transform(mate(x, i), lambda y: F.struct(x["id"].alias("a"), y["id"].alias("b")))))
    return nodes.select(F.explode(pairs).alias("p")).select("p.a", "p.b")


def star_pairs(large: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Likely pairs (a, b) of each document with the hub of its large node: of the node's documents the one that is in large
    nodes most often, as the original of a group is; of equals, the smallest id, so that a group's nodes agree."""
    times = large.groupBy("id").agg(F.count(F.lit(1)).alias("c"))
    known = sets.select("id", F.struct("id", "n", *SKETCH).alias("me")).join(times, "id")
    rows = large.join(known, "id").select("key", "c", "me")
    hubs = rows.groupBy("key").agg(F.min(F.struct((-F.col("c")).alias("c"), "me")).alias("x")).select("key", F.col("x.me").alias("hub"))
    one, hub = F.col("me"), F.col("hub")
    star = rows.join(hubs, "key").where((one["id"] != hub["id"]) & _likely(one, hub, percent))
    return star.select(F.least(one["id"], hub["id"]).alias("a"), F.greatest(one["id"], hub["id"]).alias("b"))


def full_sets(docs: DataFrame, wanted: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """(id, n, set) of the documents whose ids are in ``wanted`` (at); set holds the sorted shingle hashes as bytes. A document
    that shares its id with another text may bring a set that nobody asked for."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    texts = rows.join(small(wanted, wanted.count(), MOST_SENT), F.col("doc_id").eqNullSafe(F.col("at")), "left_semi")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [s for h in _lists(batch.column("hs")) if len(s := shingles(h, width))]
            columns = [pa.array([_set_id(s) for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int64())]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([s.tobytes() for s in sets], pa.binary())], ["id", "n", "set"])

    hashes = F.coalesce(word_hashes("text"), F.array().cast("array<bigint>")).alias("hs")
    return texts.select(hashes).mapInArrow(make, "id binary, n bigint, set binary").dropDuplicates(["id"])


def confirm(pairs: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """The distinct ``pairs`` (a, b) whose sets in ``full`` have 100 * intersection >= ``percent`` * union."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.concatenate((x, y))
                both.sort()
                same = int((both[1:] == both[:-1]).sum())
                keep.append(100 * same >= percent * (len(both) - same))
            links = pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"])
            yield links.filter(pa.array(keep, pa.bool_()))

    side = lambda k, v: full.select(F.col("id").alias(k), F.col("set").alias(v))
    return pairs.join(side("a", "x"), "a").join(side("b", "y"), "b").select("a", "b", "x", "y").mapInArrow(check, "a binary, b binary")


def of_pairs(pairs: DataFrame, full: DataFrame) -> DataFrame:
    """The rows of ``full`` (id, set) that the written ``pairs`` (a, b) name: most sets are in none, and then need no shuffle."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    return full.join(small(ends, ends.count(), MOST_SENT), "id", "left_semi")


def common_shingles(full: DataFrame, most: int = 400_000) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, count), by bucket: the most frequent 32-bit heads of shingle hashes, in about one of ``COUNTED`` sets. They
    only order the shingles in prefixes; which pairs the join finds does not depend on them."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heads = [(np.frombuffer(x.as_buffer(), np.uint64) >> np.uint64(32)).astype(np.int64) for x in batch.column("set")]
            bucket, n = np.unique(np.concatenate(heads) if heads else np.empty(0, np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(n.astype(np.int64))], ["bucket", "n"])

    some = full.where(F.pmod(F.xxhash64("id"), F.lit(COUNTED)) == 0).select("set").mapInArrow(count, "bucket bigint, n bigint")
    counts = some.groupBy("bucket").agg(F.sum("n").alias("n")).where("n > 1").orderBy(F.desc("n"), "bucket").limit(most).toArrow()
    bucket, n = counts.column("bucket").to_numpy(), counts.column("n").to_numpy()
    order = np.argsort(bucket)
    return bucket[order].astype(np.uint64), n[order]


def rare_first(s: np.ndarray, known: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """A set's shingles by a total order that is the same in all sets: count, then hash."""
    bucket, n = known
    if not len(bucket):
        return s
    head = s >> np.uint64(32)
    at = np.minimum(np.searchsorted(bucket, head), len(bucket) - 1)
    return s[np.lexsort((s, np.where(bucket[at] == head, n[at], 0)))]


def odd_sketch(s: np.ndarray) -> np.ndarray:
    counts = np.bincount(((s >> np.uint64(20)) & np.uint64(ODD - 1)).astype(np.int64), minlength=ODD)
    return np.packbits((counts & 1).astype(bool), bitorder="little").view(np.int64)


def _odd_enough(percent: int) -> str:
    """Whether the odd sketches of x and y allow a similarity of ``percent`` / 100. Such sets differ in d = x + y - 2 o shingles at most (see ``across``), and their
    sketches in d bits at most; in mean, in (1 - exp(-2 d / 1024)) / 2 of the bits, and five deviations more are let through."""
    d = f"(x.n + y.n - 2 * ceil({percent} * (x.n + y.n) / (100 + {percent})))"
    likely = f"{ODD / 2} * (1 - exp(-2 * {d} / {ODD})) + 5 * sqrt({ODD / 4} * (1 - exp(-4 * {d} / {ODD})))"
    return f"({' + '.join(f'bit_count(x.{o} ^ y.{o})' for o in ODDS)}) <= least({d}, {likely})"


def prefixes(full: DataFrame, percent: int) -> DataFrame:
    """(id, n, prefix, o0..o15): the rarest shingles of each set, so many that any set of similarity ``percent`` / 100 or more has one of
    them among its own, and its odd sketch."""
    known = full.sparkSession.sparkContext.broadcast(common_shingles(full))  # 400,000 shingles at most

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in batch.column("set")]
            rare = [rare_first(s, known.value)[: len(s) + (-percent * len(s) // 100) + 1].view(np.int64) for s in sets]
            ends = pa.array(np.cumsum([0, *map(len, rare)]).astype(np.int32))
            lists = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(rare) if rare else np.empty(0, np.int64)))
            odd = np.stack([odd_sketch(s) for s in sets]) if sets else np.zeros((0, len(ODDS)), np.int64)
            columns = [batch.column("id"), batch.column("n"), lists, *(pa.array(odd[:, i].copy()) for i in range(len(ODDS)))]
            yield pa.RecordBatch.from_arrays(columns, ["id", "n", "prefix", *ODDS])

    return full.select("id", "n", "set").mapInArrow(take, "id binary, n bigint, prefix array<bigint>, " + ", ".join(f"{o} bigint" for o in ODDS))


def asked(places: Column) -> Column:
    """The grade from which on a list of so many ``places`` takes part in ``across``: 0 for short ones, else that in which about ``FEW`` of them do."""
    return reduce(Column.__add__, [(places > most).cast("int") for most in (SHORT, *(FEW * 8**g for g in range(1, 12)))])


def postings(prefix: DataFrame, roots: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(ids, posted) of ``prefix`` (id, n, prefix, o0..o15): ids (id, k, o0..o15) number the sets, posted (k, n, i, shingle, asks) has the places of the
    shingles that more than one component of ``roots`` (id, root) has in its prefixes, and the grade that each list asks for. The others are left out by minima and
    maxima that are combined before the shuffle."""
    number = F.xxhash64("id").alias("k")
    own = scratch.keep(prefix.join(roots, "id").select("id", number, "n", F.xxhash64("root").alias("part"), "prefix", *ODDS))
    ends = own.select("part", F.explode("prefix").alias("shingle")).groupBy("shingle").agg(F.min("part").alias("p"), F.max("part").alias("q"), asked(F.count(F.lit(1))).alias("asks"))
    shared = ends.where("p <> q").select("shingle", "asks")
    posted = own.select("k", "n", F.posexplode("prefix").alias("i", "shingle")).join(shared, "shingle")
    return own.select("id", "k", *ODDS), scratch.keep(posted)


def across(ids: DataFrame, posted: DataFrame, roots: DataFrame, percent: int, grade: int, grades: int, scratch: Scratch) -> DataFrame:
    """Distinct pairs (a, b), a < b, of sets in different components of ``roots``: over all grades, from ``grades`` down to 0, every
    pair of similarity ``percent`` / 100 or more. A set's grade is drawn by its hash, each an eighth as often as the one below; a
    pair's is the larger of its sets', but in no list more than the list asks for. So a document that is like many of a large component is joined to it by few
    pairs, and makes none in the grades that follow; and a short list, as most are, is read and sent in the last grade only, however many there are.

    Two sets of sizes x >= y and such similarity share at least o = p (x + y) / (100 + p) shingles. By a total order, the first one
    they share is among the first x - p x / 100 + 1 of the larger and the first y - 2 p y / (100 + p) + 1 of the smaller, and from its
    places i and j on at least o are left in both. What passes must be near by its odd sketch too, so that documents that share
    most of a text, but less than is asked, meet in the join's condition without making pairs. Of a shingle's rows those of the component that has most of them meet
    only the others, not each other."""
    drawn = F.lit(0)
    for g in range(1, grades + 1):
        drawn = F.when(F.pmod("k", F.lit(8**g)) == 0, g).otherwise(drawn)
    parts = ids.join(roots, "id").select("k", F.xxhash64("root").alias("part"), drawn.alias("g"), *ODDS)
    rows = scratch.keep(posted.where(F.col("asks") >= grade).join(parts, "k"))
    each = rows.groupBy("shingle", "part").agg(F.count(F.lit(1)).alias("c"))
    tops = each.groupBy("shingle").agg(F.max_by("part", F.struct("c", "part")).alias("top"), F.count(F.lit(1)).alias("parts")).where("parts > 1").select("shingle", "top")
    rows = rows.join(tops, "shingle")
    short = lambda v: f"(100 + {percent}) * ({v}.n - {v}.i) >= 2 * {percent} * {v}.n"
    fits = f"""x.shingle = y.shingle and x.part <> y.part and least(x.asks, greatest(x.g, y.g)) = {grade} and (x.part = x.top or x.k < y.k)
        and 100 * least(x.n, y.n) >= {percent} * greatest(x.n, y.n) and if(x.n > y.n or x.n = y.n and {short("y")}, {short("y")}, {short("x")})
        and (100 + {percent}) * least(x.n - x.i, y.n - y.i) >= {percent} * (x.n + y.n) and {_odd_enough(percent)}"""
    met = rows.alias("x").join(rows.where("part <> top").alias("y"), F.expr(fits))
    met = met.select(F.least("x.k", "y.k").alias("j"), F.greatest("x.k", "y.k").alias("k")).distinct()
    pairs = met.join(ids.select(F.col("k").alias("j"), F.col("id").alias("x")), "j").join(ids.select("k", F.col("id").alias("y")), "k")
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def _under(scratch: Scratch, rows: DataFrame, found: DataFrame, at: str, node: str) -> DataFrame:
    """(id, root) of ``rows``, whose column ``at`` is looked up in ``found`` (node, root); what is not there keeps its own."""
    top = found.select(F.col(node).alias(at), F.col("root").alias("top"))
    return scratch.keep(rows.join(top, at, "left").select("id", F.coalesce("top", at).alias("root")))


def near_duplicates(
    docs: DataFrame, percent: int = 85, width: int = 3, id_col: str = "doc_id", text_col: str = "text",
    trees: int = TREES, depth: int = DEPTH, leaf: int = LEAF, exact: bool = False,
) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Documents are linked if 100 * intersection >= ``percent`` * union of their sets of distinct ``width``-word shingles
    (with fewer words, all of them as one). component_id is the smallest doc_id reachable; kept marks it. A null
    text or one without words has no set, links with nothing and is kept. Rows that share an id but not a text
    are judged one by one; a null id is smaller than all others. Texts of any length are taken whole, extra columns are
    ignored, repeated rows all come back, and an empty table gives no row. ``trees``, ``depth`` and ``leaf`` set
    recall (see above); ``exact`` leaves none of it to chance, at the price of posting a part of all shingles.
    """
    out = judged(docs, percent, width, id_col, text_col, trees, depth, leaf, exact)
    return out.select("doc_id", "n_shingles", "component_id", "kept")


def judged(
    docs: DataFrame, percent: int, width: int, id_col: str = "doc_id", text_col: str = "text",
    trees: int = TREES, depth: int = DEPTH, leaf: int = LEAF, exact: bool = False,
) -> DataFrame:
    """``near_duplicates`` with mark (xxhash64 of the text), and chosen: true for one (doc_id, mark) of each component, and for
    all without a set."""
    with Scratch(docs.sparkSession, "neardup") as scratch:
        return _judged(docs, percent, width, id_col, text_col, trees, depth, leaf, exact, scratch)


def _judged(docs: DataFrame, percent: int, width: int, id_col: str, text_col: str, trees: int, depth: int, leaf: int, exact: bool, scratch: Scratch) -> DataFrame:
    every = scratch.keep(described(docs, width, trees * depth, id_col, text_col))
    smallest = F.min(F.struct(F.coalesce("doc_id", F.lit(-(2**63))).alias("o"), "doc_id", "mark")).alias("f")
    alike = F.any_value(F.struct("n", "tokens", *SKETCH)).alias("x")  # the same in all rows of a set
    first = every.where("set_id is not null").groupBy(F.col("set_id").alias("id")).agg(smallest, F.min("doc_id").alias("at"), alike)
    sets = scratch.keep(first.select("id", "f", "at", "x.*"))
    leaves, large = branch(sets, scratch, trees, depth, leaf)
    likely = leaf_pairs(leaves, sets, percent).unionByName(star_pairs(large, sets, percent))
    pairs = scratch.keep(likely.distinct())
    crowded = sets.select("id") if exact else large.select("id").distinct()
    crowded = scratch.keep(crowded)
    ids = scratch.keep(pairs.select(F.explode(F.array("a", "b")).alias("id")).unionByName(crowded).distinct())
    wanted = scratch.keep(ids.join(sets.select("id", "at"), "id").select("at").distinct())
    full = scratch.keep(full_sets(docs, wanted, width, id_col, text_col))
    links = scratch.keep(confirm(pairs, full, percent))
    roots = _under(scratch, ids, components(links), "id", "node")
    if not crowded.isEmpty():
        numbers, posted = postings(prefixes(full.join(crowded, "id", "left_semi"), percent), roots, scratch)
        largest = roots.groupBy("root").count().agg(F.max("count")).first()[0]
        grades = max(0, math.ceil(math.log(largest / FEW, 8)))
        for grade in range(grades, -1, -1):
            likely = scratch.keep(across(numbers, posted, roots, percent, grade, grades, scratch))
            more = scratch.keep(confirm(likely, of_pairs(likely, full), percent))
            if not more.isEmpty():
                ends = more.join(roots.select(F.col("id").alias("a"), F.col("root").alias("x")), "a").join(roots.select(F.col("id").alias("b"), F.col("root").alias("y")), "b")
                roots = _under(scratch, roots, components(ends.select(F.col("x").alias("a"), F.col("y").alias("b"))), "root", "node")
    heads = sets.select("id", "f")
    lowest = roots.join(heads, "id").groupBy("root").agg(F.min("f").alias("f"))
    linked = roots.join(lowest, "root").select("id", F.col("f").alias("g"))
    named = heads.join(linked, "id", "left").select(F.col("id").alias("set_id"), F.coalesce("g", "f").alias("f"))
    out = every.select("doc_id", "mark", F.col("n").alias("n_shingles"), "set_id").join(named, "set_id", "left")
    component = F.when(F.col("f").isNotNull(), F.col("f.doc_id")).otherwise(F.col("doc_id"))
    kept = F.col("doc_id").eqNullSafe(component)
    chosen = kept & (F.col("f").isNull() | (F.col("mark") == F.col("f.mark")))
    return scratch.result(out.select("doc_id", "mark", "n_shingles", component.alias("component_id"), kept.alias("kept"), chosen.alias("chosen")))
