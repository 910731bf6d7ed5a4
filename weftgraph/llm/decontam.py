"""Benchmark decontamination against a broadcast hash set (DataFrame operations only).

A window of L words holds a whole block of k = (L + 1) // 2 words that starts at a multiple of k,
wherever the window lies. So a document hashes each word once, in blocks, and looks the
blocks up in a broadcast hash set of all k-grams of the benchmark's windows (a byte table with two
probes, its size bounded by ``MOST_SLOTS``). Only windows around a block that is found are spelled out
and then verified, word for word, by a join with the benchmark's windows. No window can be missed, and no
text is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, cut, small, unused

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same words before A-Z are lower-cased.
WORD_ANY_CASE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Bytes of the hash set at most. Beyond it more blocks pass the probe, and verification drops them.
MOST_SLOTS = 1 << 24
#: Benchmark windows, or items of lists of items, that are broadcast at most; more are joined by a shuffle.
BROADCAST_WINDOWS = 200_000


def words(text: Column | str) -> Column:
    return F.coalesce(F.regexp_extract_all(ascii_lower(text), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def item_windows(items: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """(n, w, items): each distinct window's length, words and the sorted ids of the items that have it."""
    w = items.select(F.col(id_col).cast("string").alias("item"), words(text_col).alias("ws")).where(F.size("ws") > 0)
    n = F.least(F.size("ws"), F.lit(width))
    wins = w.select("item", n.alias("n"), F.explode(F.transform(F.sequence(F.lit(1), F.size("ws") - n + 1), lambda i: F.array_join(F.slice("ws", i, n), " "))).alias("w"))
    return wins.groupBy("n", "w").agg(F.sort_array(F.collect_set("item")).alias("items"))


def _block(n: int) -> int:
    return (n + 1) // 2


def _hash_set(windows: DataFrame, lengths: list[int]) -> bytes:
    """A byte per slot, 1 where a gram of a window falls. Spark sets the slots as bits; the driver gets at most ``MOST_SLOTS`` / 32,768 bitmaps
    of 4 kB, however large the benchmark is."""

    def grams(n: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.lit(n - _block(n) + 1)), lambda i: F.xxhash64(F.slice(F.split("w", " "), i, _block(n))))

    blocks = F.array().cast("array<bigint>")
    for n in lengths:
        blocks = F.when(F.col("n") == n, grams(n)).otherwise(blocks)
    hashes = windows.select(F.explode(blocks).alias("h")).distinct()
    slots = 1 << 16
    count = hashes.count()
    while slots < min(16 * count, MOST_SLOTS):
        slots *= 2
    probes = hashes.select(F.explode(F.array(F.pmod("h", F.lit(slots)), F.pmod(F.shiftrightunsigned("h", 24), F.lit(slots)))).alias("at"))
    at = F.col("at") + 1
    bits = probes.groupBy(F.bitmap_bucket_number(at).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits"))
    table = bytearray(slots)
    for row in bits.collect():
        n = 8 * len(row["bits"])
        own = f"{int.from_bytes(row['bits'], 'little'):0{n}b}"[::-1].encode().translate(bytes.maketrans(b"01", b"\x00\x01"))
        begin = (row["part"] - 1) * n
        table[begin : begin + n] = own[: slots - begin]
    return bytes(table)


def find_hits(docs: DataFrame, benchmark: DataFrame, width: int = 13, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, items (sorted ids of the items with occurring windows),
    hits (array of (at, n): each occurring window's first word and length), contaminated.

    A null text has no words and is clean. Items without words are left out; an item
    shorter than ``width`` words is one window. Repeated documents are judged one by one.
    An empty benchmark leaves all documents clean.
    """
    every_window = cut(item_windows(benchmark, width, item_col, item_text_col))
    # Windows of the same items share a number; a document's numbers are looked up once it is known which it has.
    owners = cut(every_window.select(F.xxhash64("items").alias("owner"), "items").dropDuplicates(["owner"]))
    windows = every_window.select("n", "w", F.xxhash64("items").alias("owner"))
    sizes = {r["n"]: r["c"] for r in windows.groupBy("n").agg(F.count(F.lit(1)).alias("c")).collect()}  # at most ``width`` rows
    lengths = sorted(sizes)
    hash_set = _hash_set(windows, lengths)
    slots = F.lit(len(hash_set))
    n = F.size("ws")
    one = F.lit(b"\x01")

    def spelled(known: Column, length: int) -> Column:
        k = _block(length)
        blocks = F.transform(F.sequence(F.lit(0), n - k, F.lit(k)), lambda q: F.struct(q.alias("q"), F.xxhash64(F.slice("ws", q + 1, k)).alias("h")))
        found = F.filter(blocks, lambda b: (F.substring(known, F.pmod(b["h"], slots).cast("int") + 1, F.lit(1)) == one) & (F.substring(known, F.pmod(F.shiftrightunsigned(b["h"], 24), slots).cast("int") + 1, F.lit(1)) == one))
        starts = F.flatten(F.transform(found, lambda b: F.sequence(F.greatest(b["q"] - (length - k), F.lit(0)), F.least(b["q"], n - length))))
        wins = F.transform(F.array_distinct(starts), lambda p: F.struct(p.alias("at"), F.lit(length).alias("n"), F.array_join(F.slice("ws", p + 1, length), " ").alias("w")))
        return F.when(n >= length, wins)

    nothing = F.array().cast("array<struct<at:int,n:int,w:string>>")
    # The table is one literal of the plan, bound to a name.
    every = F.get(F.transform(F.array(F.lit(hash_set)), lambda known: F.concat(nothing, *[F.coalesce(spelled(known, x), nothing) for x in lengths])), F.lit(0))
    rows = docs.select(F.col(id_col).alias("doc_id"), words(text_col).alias("ws"), F.monotonically_increasing_id().alias("row"))
    near = rows.select("doc_id", "row", n.cast("bigint").alias("n_words"), F.explode_outer(every).alias("x")).select("doc_id", "row", "n_words", "x.*")
    hit = near.join(small(windows, sum(sizes.values()), BROADCAST_WINDOWS), ["n", "w"], "left")
    per_doc = cut(
        hit.groupBy("row", "doc_id", "n_words").agg(F.collect_list(F.when(F.col("owner").isNotNull(), F.struct("at", "n"))).alias("hits"), F.collect_set("owner").alias("owners"))
    )
    owned = per_doc.select("row", F.explode("owners").alias("owner")).join(small(owners, owners.agg(F.sum(F.size("items"))).first()[0] or 0, BROADCAST_WINDOWS), "owner")
    named = owned.groupBy("row").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    covered = F.size(F.array_distinct(F.flatten(F.transform("hits", lambda x: F.sequence(x["at"], x["at"] + x["n"] - 1)))))
    items = F.coalesce("items", F.array().cast("array<string>")).alias("items")
    rows = per_doc.join(named, "row", "left").select("doc_id", "n_words", covered.cast("bigint").alias("n_hit"), items, "hits")
    return rows.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def cut_spans(text: Column, hits: Column) -> Column:
    """``text`` without the words of the windows in ``hits``; what stands between words stays."""
    found = F.regexp_extract_all(text, F.lit(WORD_ANY_CASE), F.lit(0))
    between = F.split(text, WORD_ANY_CASE, -1)
    gone = F.array_distinct(F.flatten(F.transform(hits, lambda x: F.sequence(x["at"], x["at"] + x["n"] - 1))))
    drop = F.map_from_arrays(gone, F.transform(gone, lambda _: F.lit("")))
    return F.when(F.size(hits) == 0, text).otherwise(
        F.array_join(F.transform(between, lambda s, i: F.concat(s, F.coalesce(F.try_element_at(drop, i), F.get(found, i), F.lit("")))), "")
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "documents", width: int = 13, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without its contaminated documents (``remove="documents"``), or with the hit words cut
    out of every text (``remove="spans"``). All columns of ``docs`` are kept.

    Documents meet their hits by id; rows that share an id share its hits' fate: one contaminated row
    removes them all, and spans are cut only where the id is not repeated.
    """
    hits = find_hits(docs, benchmark, width, id_col, text_col)
    key, spans = unused(docs, "_key"), unused(docs, "_spans")
    same = F.col(id_col).eqNullSafe(F.col(key))
    if remove == "documents":
        return docs.join(hits.where("contaminated").select(F.col("doc_id").alias(key)).distinct(), same, "left_anti")
    cuts = hits.where("n_hit > 0").groupBy(F.col("doc_id").alias(key)).agg(F.first("hits").alias(spans), F.count(F.lit(1)).alias("n")).where("n = 1").drop("n")
    empty = F.array().cast("array<struct<at:int,n:int>>")
    return docs.join(cuts, same, "left").withColumn(text_col, cut_spans(F.col(text_col), F.coalesce(spans, empty))).drop(key, spans)
