"""The trie of conversation prefixes, with totals for every node.

A conversation is the row of its turns' ids. Rows are sorted by these and range-partitioned, so the members of a node, the conversations that
begin with its turns, stand together. A task reads its range in blocks. A block is a padded matrix of turn ids, sorted by ``numpy.lexsort``; where a
column differs from the row before is a mask, which OR-accumulated over the columns marks each row and depth at which a node
starts; ``reduceat`` over the starts of a depth gives its nodes' totals, and sums from the deepest column up those of subtrees.

Nodes on the path of a block's first or last row may go on in the next block. They stay open, in a stack as deep as the conversation, until a row
leaves them; those on the path of a range's first or last row are returned in part. These are few (two paths for each range), and are summed
by key and rolled up in one small task; other nodes whose parent is among the open ones look its smallest member up.

Texts stay where they are: a turn travels as two 64-bit hashes of its role and text and its number of words.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, partitions, small

#: Cells of a block's matrix at most; one longer conversation is a block of its own.
CELLS = 500_000
#: Characters of ids that an open node holds back at most before they are written out as a piece.
PIECE = 1 << 20
#: Parents that are sent to all tasks at most; more are joined by a shuffle.
MOST_SENT = 200_000
TURN = "struct<a:bigint,b:bigint,words:bigint>"
#: kind: 0 a node with its parent's id, 1 a node that has its parent's key instead, 2 a part of a node that other ranges may share, 3 ids that end at a node.
ROW = "kind int, conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, words bigint, ends_sha256 string, own binary, parent binary, piece string"
_NAMES = [x.split()[0] for x in ROW.split(", ")]
_KINDS = {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string(), "binary": pa.binary()}
_SCHEMA = pa.schema([(n, _KINDS[k]) for n, k in (x.split() for x in ROW.split(", "))])
NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
EMPTY = hashlib.sha256().hexdigest()
ROOT = b""
WORD = r"[^\x20\x09-\x0D]+"


def turn_ids(role: Column, text: Column) -> Column:
    """A turn as its two hashes and its text's words; null is empty."""
    r, t = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    n = F.size(F.regexp_extract_all(t, F.lit(WORD), F.lit(0))).cast("bigint")
    return F.struct(F.xxhash64(r, t).alias("a"), F.xxhash64(F.lit("turn"), t, r).alias("b"), n.alias("words"))


def ordered(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turns): the ids of each conversation's turns by turn, null first; of equal turns in the order of their ids, which their
    content fixes. Rows without a conversation are left out."""
    one = F.struct(F.col(turn_col).alias("at"), turn_ids(F.col(role_col), F.col(text_col)).alias("id"))
    rows = turns.where(F.col(conv_col).isNotNull()).select(F.col(conv_col).cast("bigint").alias("conv_id"), one.alias("t"))
    packed = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    return packed.select("conv_id", F.transform("ts", lambda t: t["id"]).alias("turns"))


def _key(parent: bytes, a: int, b: int) -> bytes:
    return hashlib.blake2b(parent + struct.pack("<qq", a, b), digest_size=16).digest()


def _joined(ids: np.ndarray) -> str:
    return ",".join(map(str, ids.tolist()))


class Open:
    """A node that rows to come may belong to: totals so far, without those of children that are still open."""

    def __init__(self, depth: int, a: int, b: int, words: int, parent: Open | None, first: bool):
        self.depth, self.a, self.b, self.words, self.first = depth, a, b, words, first
        self.key, self.parent = _key(parent.key, a, b) if parent else ROOT, parent.key if parent else None
        self.n = self.kids = self.leaves = self.saved = 0
        self.least: int | None = None
        self.sha, self.ended, self.pieces, self.held = hashlib.sha256(), False, [], 0

    def add(self, n: int, least: int, kids: int, leaves: int, saved: int) -> None:
        self.least = least if self.least is None else min(self.least, least)
        self.n, self.kids, self.leaves, self.saved = self.n + n, self.kids + kids, self.leaves + leaves, self.saved + saved

    def end(self, ids: np.ndarray) -> None:
        if len(ids):
            text = _joined(ids)
            self.sha.update(f"{',' if self.ended else ''}{text}".encode())
            self.ended = True
            self.pieces.append((int(ids[0]), text))
            self.held += len(text)


class Range:
    """One range of the sorted conversations, block by block; gives rows of ``ROW``."""

    def __init__(self) -> None:
        self.open: list[Open] = []
        self.out: list[dict] = []

    def close(self, to: int, at_end: bool = False) -> None:
        """Close the open nodes deeper than ``to``."""
        while len(self.open) > to + 1:
            node = self.open.pop()
            row = {"conv_id": node.least, "depth": node.depth, "n_convs": node.n, "n_children": node.kids, "words": node.words, "own": node.key, "parent": node.parent}
            if node.first or at_end:
                self.pieces(node)
                self.out.append(row | {"kind": 2, "n_leaves": node.leaves, "saved_tokens": node.saved})
                continue
            leaves, saved = node.leaves or 1, node.saved + (node.n - 1) * node.words
            self.out.append(row | {"kind": 1, "n_leaves": leaves, "saved_tokens": saved, "ends_sha256": node.sha.hexdigest()})
            up = self.open[-1]
            up.kids, up.leaves, up.saved = up.kids + 1, up.leaves + leaves, up.saved + saved

    def pieces(self, node: Open) -> None:
        self.out += [{"kind": 3, "conv_id": i, "own": node.key, "piece": text} for i, text in node.pieces]
        node.pieces, node.held = [], 0

    def block(self, conv: np.ndarray, size: np.ndarray, a: np.ndarray, b: np.ndarray, words: np.ndarray) -> Iterator[pa.RecordBatch]:
        """The next conversations: their ids and numbers of turns; the turns one after another."""
        rows, deep = len(conv), int(size.max())
        padded = []
        for values, pad in ((a, -(2**63)), (b, -(2**63)), (words, 0)):
            m = np.full((rows, deep), pad, np.int64)
            m[np.arange(deep) < size[:, None]] = values
            padded.append(m)
        columns = [m[:, c] for c in range(deep - 1, -1, -1) for m in (padded[1], padded[0])]
        order = np.lexsort((conv, *columns))
        conv, size = conv[order], size[order]
        a, b, words = (m[order] for m in padded)
        change = np.ones((rows, deep), bool)
        change[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        change = np.logical_or.accumulate(change, axis=1)

        # Nodes by depth: where they start, their members, smallest member and members that end there.
        depths = []
        for d in range(1, deep + 1):
            every = np.flatnonzero(change[:, d - 1])
            real = size[every] >= d
            start = every[real]
            n, least = np.diff(np.append(every, rows))[real], np.minimum.reduceat(conv, every)[real]
            ends = np.add.reduceat((size == d).astype(np.int64), every)[real]
            path = (start == 0) | (start + n == rows)
            depths.append({"start": start, "n": n, "least": least, "ends": ends, "path": path, "words": words[start, d - 1]})
        # Totals of children that are not on a path, from the deepest up.
        root = {"start": np.zeros(1, np.int64)}
        for x, below in zip([root, *depths], [*depths, None], strict=True):
            for name in ("kids", "leaves", "saved"):
                x[name] = np.zeros(len(x["start"]), np.int64)
            x["below"] = below
        for x in [*depths[::-1], root]:
            if (below := x["below"]) is not None:
                below["up"] = np.searchsorted(x["start"], below["start"], "right") - 1
                own = ~below["path"]
                for name, value in (("kids", 1), ("leaves", below["all_leaves"][own]), ("saved", below["all_saved"][own])):
                    np.add.at(x[name], below["up"][own], value)
            if x is not root:
                x["all_leaves"] = np.where(x["kids"] == 0, 1, x["leaves"])
                x["all_saved"] = x["saved"] + (x["n"] - 1) * x["words"]

        # Open nodes: leave those that the first row is not in, go down its path, then over to the last row's.
        fresh = not self.open
        if fresh:
            self.open.append(Open(0, 0, 0, 0, None, True))
        shared = 0
        while shared < min(len(self.open) - 1, int(size[0])) and (self.open[shared + 1].a, self.open[shared + 1].b) == (a[0, shared], b[0, shared]):
            shared += 1
        self.close(shared)
        ended = int(np.argmax(size > 0)) if size[-1] > 0 else rows  # conversations without a turn come first
        self.open[0].add(rows, int(conv.min()), int(root["kids"][0]), int(root["leaves"][0]), int(root["saved"][0]))
        self.open[0].end(conv[:ended])

        def step(d: int, k: int) -> None:
            x, parent = depths[d - 1], self.open[d - 1]
            s = int(x["start"][k])
            if d == len(self.open):
                self.open.append(Open(d, int(a[s, d - 1]), int(b[s, d - 1]), int(x["words"][k]), parent, parent.first and fresh and s == 0))
            self.open[d].add(int(x["n"][k]), int(x["least"][k]), int(x["kids"][k]), int(x["leaves"][k]), int(x["saved"][k]))
            self.open[d].end(conv[s : s + int(x["ends"][k])])

        for d in range(1, int(size[0]) + 1):
            step(d, 0)
        first_keys = [x.key for x in self.open[: int(size[0]) + 1]]
        both = 0
        while both < size[0] and depths[both]["n"][0] == rows:
            both += 1
        if both < size[0] or size[-1] > size[0]:
            self.close(both)
            for d in range(both + 1, int(size[-1]) + 1):
                step(d, len(depths[d - 1]["start"]) - 1)
        last_keys = [x.key for x in self.open]

        # Nodes off the paths are complete.
        up = None
        for d, x in enumerate(depths, 1):
            own = np.flatnonzero(~x["path"])
            if len(own):
                parent = x["up"][own]
                on_path = np.ones(len(own), bool) if up is None else up["path"][parent]
                keys = [None if not p else (first_keys[d - 1] if up is None or up["start"][k] == 0 else last_keys[d - 1]) for p, k in zip(on_path.tolist(), parent.tolist(), strict=True)]
                shas = [hashlib.sha256(_joined(conv[s : s + e]).encode()).hexdigest() if e else EMPTY for s, e in zip(x["start"][own].tolist(), x["ends"][own].tolist(), strict=True)]
                yield _batch(
                    len(own), kind=on_path.astype(np.int32), conv_id=x["least"][own], depth=np.full(len(own), d), parent_conv_id=pa.array(np.zeros(len(own), np.int64) if up is None else up["least"][parent], mask=on_path),
                    n_convs=x["n"][own], n_children=x["kids"][own], n_leaves=x["all_leaves"][own], saved_tokens=x["all_saved"][own], ends_sha256=shas, parent=keys,
                )
            up = x
        for node in self.open:
            if node.held > PIECE:
                self.pieces(node)
        yield from self.flush()

    def finish(self) -> Iterator[pa.RecordBatch]:
        self.close(-1, at_end=True)
        yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.out:
            yield pa.RecordBatch.from_pylist([dict.fromkeys(_NAMES) | row for row in self.out], _SCHEMA)
            self.out = []


def _batch(rows: int, **given: object) -> pa.RecordBatch:
    columns = [pa.array(given[f.name], f.type) if f.name in given else pa.nulls(rows, f.type) for f in _SCHEMA]
    return pa.RecordBatch.from_arrays(columns, schema=_SCHEMA)


def ranges(convs: DataFrame, cells: int = CELLS) -> DataFrame:
    """Rows of ``ROW`` of (conv_id, turns), range by range. Conversations of any number that are all the same lie in several ranges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = Range()
        for batch in batches:
            conv, lists = batch.column("conv_id").to_numpy(), batch.column("turns")
            at, turns = lists.offsets.to_numpy().astype(np.int64), lists.values
            a, b, words = (turns.field(i).to_numpy() for i in range(3))
            size, begin = np.diff(at), 0
            while begin < len(conv):
                wide = np.maximum.accumulate(size[begin:]) * np.arange(1, len(conv) - begin + 1)
                end = begin + max(1, int(np.searchsorted(wide, cells, "right")))
                part = slice(at[begin], at[end])
                yield from mine.block(conv[begin:end], size[begin:end], a[part], b[part], words[part])
                begin = end
        if mine.open:
            yield from mine.finish()

    n = partitions(convs.sparkSession)
    return convs.repartitionByRange(n, "turns", "conv_id").sortWithinPartitions("turns", "conv_id").mapInArrow(run, ROW)


def roll_up(parts: DataFrame) -> DataFrame:
    """Nodes on the edges of ranges, each summed over its parts, with their subtrees' totals and parents' ids (own, and NODE without ends).
    They are two paths for each range at most, and go through one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [row for batch in batches for row in batch.to_pylist()]
        known = {row["own"]: row for row in rows}
        for row in sorted(rows, key=lambda r: -r["depth"]):
            row["n_leaves"] = row["n_leaves"] if row["n_children"] else 1
            row["saved_tokens"] += (row["n_convs"] - 1) * row["words"]
            if (up := known.get(row["parent"])) is not None:
                row["parent_conv_id"] = up["conv_id"]
                up["n_children"] += 1
                up["n_leaves"] += row["n_leaves"]
                up["saved_tokens"] += row["saved_tokens"]
        if rows:
            yield pa.RecordBatch.from_pylist([{n: row.get(n) for n in out.names} for row in rows], out)

    out = pa.schema([("own", pa.binary()), *[(n, pa.int64()) for n in NODE[:-1]]])
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    merged = parts.groupBy("own").agg(F.min("conv_id").alias("conv_id"), F.any_value("depth").alias("depth"), F.any_value("parent").alias("parent"), F.any_value("words").alias("words"), *sums)
    return merged.coalesce(1).mapInArrow(run, "own binary, " + ", ".join(f"{n} bigint" for n in NODE[:-1]))


def digests(pieces: DataFrame) -> DataFrame:
    """(own, ends_sha256) of pieces (own, conv_id, piece) in the order of their first ids. SHA-256 can't be split, so a node's pieces pass one by one
    through one task, which holds none of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sha = None, hashlib.sha256()
        row = lambda: pa.RecordBatch.from_pydict({"own": pa.array([key], pa.binary()), "ends_sha256": [sha.hexdigest()]})
        for batch in batches:
            for own, piece in zip(batch.column("own").to_pylist(), batch.column("piece").to_pylist(), strict=True):
                if own != key:
                    if key is not None:
                        yield row()
                    key, sha = own, hashlib.sha256(piece.encode())
                else:
                    sha.update(f",{piece}".encode())
        if key is not None:
            yield row()

    return pieces.select("own", "conv_id", "piece").repartition("own").sortWithinPartitions("own", "conv_id").mapInArrow(run, "own binary, ends_sha256 string")


def prefix_trie(convs: DataFrame, cells: int = CELLS) -> DataFrame:
    """One row per node of the trie of ``convs`` (conv_id, turns as ``ordered`` gives them): conv_id (the smallest member), depth, parent_conv_id (the
    parent's smallest member; null for the root), n_convs (members), n_children, n_leaves (nodes without children in its subtree, itself
    included), saved_tokens (over its subtree, each node's members but one times the words of its last text) and ends_sha256 (hex digest of
    the ids of conversations that end at it, ascending, joined by commas).

    A node is a sequence of turns that conversations begin with; equal turns have equal roles and texts (two 64-bit hashes). The root, without turns, has
    all conversations as members, also those without turns. Ids that repeat are members as often as they come. Without conversations there is no
    node. A conversation's turns are one row of 24 bytes each; a block of a range is held in memory, ``cells`` turns or one conversation.
    """
    with Scratch(convs.sparkSession, "trie") as scratch:
        rows = scratch.keep(ranges(scratch.keep(convs.select("conv_id", "turns")), cells))
        edges = scratch.keep(roll_up(rows.where("kind = 2")))
        told = edges.join(digests(rows.where("kind = 3")), "own", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(EMPTY)))
        opened = scratch.keep(edges.select("own", "conv_id").unionByName(rows.where("kind = 1 and own is not null").select("own", "conv_id")))
        parents = small(opened.select(F.col("own").alias("parent"), F.col("conv_id").alias("up")), opened.count(), MOST_SENT)
        under = rows.where("kind = 1").join(parents, "parent").withColumn("parent_conv_id", F.col("up"))
        out = rows.where("kind = 0").select(*NODE).unionByName(under.select(*NODE)).unionByName(told.select(*NODE))
        return scratch.result(out)
