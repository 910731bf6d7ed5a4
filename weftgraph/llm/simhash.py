"""Near duplicates by simhash fingerprints under a segment-popcount embedding.

A fingerprint has 64 bits. Those of either half, in segments of ``SEGMENT`` bits, are mapped to the number of ones in each segment: a
point of a grid. A bit that differs moves the point by one step at most, so the Manhattan distance of two points never is more than the bits in
which the halves differ. Fingerprints that differ in four bits differ in two at most in one of the halves, and two points two steps apart
have a grid point between them, one step from each. So the range join under Manhattan distance is an equality join on grid points: each
fingerprint is put into the cell of its own point and those one step away, once for each half, and what meets in a cell is verified bit by bit.

A cell with more than ``CROWD`` fingerprints is not compared: its fingerprints go on to finer cells, made in the same way of the
quarters, then the eighths, of the other half, in segments of one bit. No cell is gathered before it is known to be small. Of a cell's links only
as many are returned as hold its linked fingerprints together.

Equal fingerprints are one row from the start. Spark counts, deals and joins; numpy makes fingerprints, cells and comparisons in batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import Scratch, small
from .components import components

SEED, WIDTH, MOST = 42, 4, 4
#: Bits of a segment: 1, 2, 4 or 8. Fewer give more cells (up to 33 of each half for a fingerprint, about 25 with two) that hold less.
SEGMENT = 2
#: A cell with more fingerprints is refined, not compared.
CROWD = 1024
#: Hot cells are sent to all tasks up to so many; more are joined by a shuffle.
MOST_SENT = 200_000
#: About so many rows are compared at once.
AT_ONCE = 200_000
_EVERY_OTHER = {1: 0x5555555555555555, 2: 0x3333333333333333, 4: 0x0F0F0F0F0F0F0F0F}
LOW = -(2**63)


def fingerprint(text: bytes, width: int = WIDTH, seed: int = SEED) -> int:
    """Bit b is set if more than half of the shingles' XXH64 have it; 0 without words."""
    words = text.lower().split()  # bytes: A-Z only, and split at the six white-space characters
    if not words:
        return 0
    joined = b" ".join(words)
    w = min(width, len(words))
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    begin = end - size
    spans = zip(begin[: len(words) - w + 1].tolist(), end[w - 1 :].tolist(), strict=True)
    hashes = np.fromiter((xxh64_intdigest(joined[a:b], seed) for a, b in spans), np.uint64, len(words) - w + 1)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        part = hashes[i : i + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp) for every row: the fingerprint's 64 bits as a signed number."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(x.as_buffer().to_pybytes(), width) if x.is_valid else 0 for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.array(found, np.uint64).view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(make, "doc_id bigint, fp bigint")


def counted(bits: np.ndarray, segment: int) -> np.ndarray:
    """Each segment's bits replaced by the number of ones in it."""
    out, w = bits, 1
    while w < segment:
        mask = np.uint64(_EVERY_OTHER[w])
        out = (out & mask) + ((out >> np.uint64(w)) & mask)
        w *= 2
    return out


def around(bits: np.ndarray, width: int, segment: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, point): for each row's ``width`` bits its point of the grid and all points one step away, packed as numbers."""
    own = counted(bits, segment)
    row = np.arange(len(bits))
    rows, points = [row], [own]
    for at in range(0, width, segment):
        value = (own >> np.uint64(at)) & np.uint64((1 << segment) - 1)
        one = np.uint64(1 << at)
        for ok, moved in ((value < segment, own + one), (value > 0, own - one)):
            rows.append(row[ok])
            points.append(moved[ok])
    return np.concatenate(rows), np.concatenate(points)


def _first(fps: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for half in (0, 1):
        row, point = around((fps >> np.uint64(32 * half)) & np.uint64(0xFFFFFFFF), 32, SEGMENT)
        yield row, np.uint64(half << 32) | point


def _finer(cells: np.ndarray, fps: np.ndarray, level: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Cells of the quarters of the half that a cell is not made of (level 1), then of the eighths of the other quarter (level 2)."""
    half = (cells >> np.uint64(32 if level == 1 else 49)) & np.uint64(1)
    left = (fps >> (np.uint64(32) * (np.uint64(1) - half))) & np.uint64(0xFFFFFFFF)
    width = 16
    if level == 2:
        left = (left >> (np.uint64(16) * (np.uint64(1) - ((cells >> np.uint64(16)) & np.uint64(1))))) & np.uint64(0xFFFF)
        width = 8
    for part in (0, 1):
        row, point = around((left >> np.uint64(width * part)) & np.uint64((1 << width) - 1), width, 1)
        yield row, (cells[row] << np.uint64(width + 1)) | np.uint64(part << width) | point


def celled(rows: DataFrame, level: int) -> DataFrame:
    """(cell, fp) of ``rows``: (fp) at level 0, (cell, fp) of crowded cells at the levels that refine them."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column("fp").to_numpy().view(np.uint64)
            for row, cell in _first(fps) if level == 0 else _finer(batch.column("cell").to_numpy().view(np.uint64), fps, level):
                yield pa.RecordBatch.from_arrays([pa.array(cell.view(np.int64)), pa.array(fps[row].view(np.int64))], ["cell", "fp"])

    return rows.mapInArrow(make, "cell bigint, fp bigint")


def held_together(cells: np.ndarray, fps: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(a, b): each row b of a cell that is linked, over others of its cell too, to an earlier row, with the first such row a; rows are sorted by
    cell, and two are linked by ``most`` differing bits or fewer. All pairs of a cell are compared, by their distance in the table."""
    a, b = [], []
    live, apart = np.flatnonzero(cells[1:] == cells[:-1]), 1
    while len(live):
        near = live[np.bitwise_count(fps[live] ^ fps[live + apart]) <= most]
        a.append(near)
        b.append(near + apart)
        apart += 1
        live = live[live + apart < len(cells)]
        live = live[cells[live] == cells[live + apart]]
    x, y = np.concatenate(a or [np.empty(0, np.int64)]), np.concatenate(b or [np.empty(0, np.int64)])
    root = np.arange(len(cells))
    while True:
        low = np.minimum(root[x], root[y])
        if (root[x] == low).all() and (root[y] == low).all():
            break
        np.minimum.at(root, x, low)
        np.minimum.at(root, y, low)
        root = root[root]
    linked = np.flatnonzero(root != np.arange(len(cells)))
    return fps[root[linked]], fps[linked]


def compared(cells: DataFrame, most: int) -> DataFrame:
    """(a, b): links inside the cells of (cell, fp), each of which is small. Cells meet in tasks whole, sorted, and pass in batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in _and_end(batches):
            if batch is not None:
                held.append((batch.column("cell").to_numpy(), batch.column("fp").to_numpy().view(np.uint64)))
                rows += batch.num_rows
                if rows < AT_ONCE:
                    continue
            if not rows:
                continue
            cell, fp = (np.concatenate(x) for x in zip(*held, strict=True))
            # The last cell may go on in the next batch.
            end = len(cell) if batch is None else int(np.searchsorted(cell, cell[-1]))
            a, b = held_together(cell[:end], fp[:end], most)
            held, rows = [(cell[end:], fp[end:])], len(cell) - end
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    dealt = cells.repartition("cell").sortWithinPartitions("cell")
    return dealt.mapInArrow(run, "a bigint, b bigint")


def _and_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def links(fps: DataFrame, scratch: Scratch, most: int = MOST) -> DataFrame:
    """Distinct links (a, b) that connect all distinct fingerprints (fp) of ``most`` differing bits or fewer."""
    found, rows = None, fps
    for level in (0, 1, 2):
        cells = celled(rows, level)
        hot = None
        if level < 2:  # the cells of the last level hold what agrees in all but a few bits and the last eighth
            hot = scratch.keep(cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > CROWD).select("cell"))
            crowds = hot.count()
            hot = small(hot, crowds, MOST_SENT) if crowds else None
        calm = cells if hot is None else cells.join(hot, "cell", "left_anti")
        new = scratch.keep(compared(calm, most).distinct())
        found = new if found is None else found.unionByName(new)
        if hot is None:
            break
        rows = scratch.keep(cells.join(hot, "cell", "left_semi"))
    return found.distinct()


def simhash_duplicates(docs: DataFrame, most: int = MOST, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, fp (the fingerprint as a signed number), fingerprint (16 lowercase hex digits) and component_id.

    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased, shingles ``width`` words joined by spaces, repeats included (with fewer words, all of
    them as one). Documents are linked if their fingerprints differ in ``most`` (5 or fewer) bits; component_id is the smallest doc_id
    reachable. A null text or one without words has fingerprint zero and is linked like any other. A null id is smaller than all others and
    stays null. Repeated rows and ids all come back, other columns are ignored, an empty table gives no row. Every link is found: there is no
    chance in it but for what the fingerprint itself does. A text is held whole, with about a hundred bytes a word.
    """
    if not 0 <= most <= 5:
        raise ValueError("cells are made for up to five differing bits")
    with Scratch(docs.sparkSession, "simhash") as scratch:
        every = scratch.keep(fingerprints(docs, width, id_col, text_col))
        first = scratch.keep(every.groupBy("fp").agg(F.min(F.coalesce("doc_id", F.lit(LOW))).alias("least")))
        roots = scratch.keep(components(links(first.select("fp"), scratch, most)))
        named = first.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
        lowest = named.groupBy("root").agg(F.min("least").alias("component_id"))
        heads = named.join(lowest, "root").select("fp", F.nullif("component_id", F.lit(LOW)).alias("component_id"))
        out = every.join(heads, "fp").select("doc_id", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
        return scratch.result(out)
