"""Periodic runs of words by Baier grouping.

A run is a stretch of words with smallest period q that no neighbouring word extends. Every run is found from a Lyndon root: the longest
Lyndon word that begins at some place of it, under the order of words or under its reverse. The first phase of Baier's suffix
sorter groups the suffixes of a text by exactly that word, so the grouping gives both Lyndon arrays without sorting suffixes (``lyndon``).
Each (place, length) is then extended to both sides through longest common extensions (``Blocks``) and kept if it is a run.

Words that can't be in a run of the wanted exponent are set aside before (``stretches``): in a run of exponent e all words but those
of the last period come again within a period, so they stand in a stretch of such words e - 1 times as long as any of the
distances. That holds for every run, so none is lost. A document is one row throughout, nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: About so many words are searched at once.
WORDS_AT_ONCE = 250_000
RUN = "struct<start:bigint,length:bigint,period:bigint>"
RESULT = f"doc_id bigint, n_words bigint, runs array<{RUN}>, strongest {RUN}, collapsed string"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def lyndon(letters: list[int]) -> list[int]:
    """At each place the length of the longest Lyndon word that begins there, by Baier's grouping.

    Suffixes are grouped by their first letter; a group is named by the number of suffixes in lower groups. From the highest
    group down, each suffix i points to the nearest suffix before it in a lower group. A suffix that c members of a group with
    the prefix u point to has its own prefix lengthened by c times u, and goes up, out of its group, next to it: the higher the larger c.
    """
    n = len(letters)
    sizes: dict[int, int] = {}
    for x in letters:
        sizes[x] = sizes.get(x, 0) + 1
    starts, below = {}, 0
    for x in sorted(sizes):
        starts[x] = below
        below += sizes[x]
    group = [starts[x] for x in letters]
    members: list[list[int]] = [[] for _ in range(n)]
    for i, g in enumerate(group):
        members[g].append(i)
    size = [len(m) for m in members]
    length, before = [1] * n, [-1] * n
    for g in range(n - 1, -1, -1):
        own = [i for i in members[g] if group[i] == g]
        if not own:
            continue
        # The pointers of a group's ascending members ascend, so equal ones follow each other.
        pointed: list[list[int]] = []
        for i in own:
            j = i - 1
            while j >= 0 and group[j] >= g:
                j = before[j]
            before[i] = j
            if j >= 0:
                if pointed and pointed[-1][0] == j:
                    pointed[-1][1] += 1
                else:
                    pointed.append([j, 1])
        unit = length[own[0]]
        by_count: dict[int, dict[int, list[int]]] = {}
        for j, c in pointed:
            by_count.setdefault(c, {}).setdefault(group[j], []).append(j)
        for c in sorted(by_count, reverse=True):
            for old, moved in by_count[c].items():
                size[old] -= len(moved)
                new = old + size[old]
                members[new], size[new] = moved, len(moved)
                for j in moved:
                    group[j] = new
                    length[j] += c * unit
    return length


class Blocks:
    """Longest common extensions in a text: equal blocks of 2^k letters have equal numbers, up to the k at which all differ."""

    def __init__(self, letters: np.ndarray):
        self.n, self.levels = len(letters), [letters]
        while (w := 1 << len(self.levels)) <= self.n:
            low = self.levels[-1]
            found, numbers = np.unique(low[: self.n - w + 1] * np.int64(self.n + 1) + low[w // 2 : self.n - w // 2 + 1], return_inverse=True)
            self.levels.append(numbers)
            if len(found) == self.n - w + 1:
                break

    def extend(self, i: np.ndarray, j: np.ndarray, ahead: bool) -> np.ndarray:
        """How many letters from i and j (i < j) on agree, or with ``ahead`` false how many right before them."""
        i, j, out = i.copy(), j.copy(), np.zeros(len(i), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            w, numbers = 1 << k, self.levels[k]
            x, y = (i, j) if ahead else (i - w, j - w)
            ok = (j + w <= self.n) if ahead else (i >= w)
            ok[ok] = numbers[x[ok]] == numbers[y[ok]]
            step = np.where(ok, w if ahead else -w, 0)
            i, j, out = i + step, j + step, out + np.abs(step)
        return out


def runs_of(letters: np.ndarray, least: int, exponent: int) -> list[tuple[int, int, int]]:
    """(start, length, period) of a text's runs of ``least`` letters and ``exponent`` periods or more, by start and period."""
    _, dense = np.unique(letters, return_inverse=True)
    up = dense.tolist()
    top = max(up)
    place = np.tile(np.arange(len(up), dtype=np.int64), 2)
    period = np.array(lyndon(up) + lyndon([top - x for x in up]), np.int64)
    blocks = Blocks(dense.astype(np.int64))
    start = place - blocks.extend(place, place + period, False)
    length = place + period + blocks.extend(place, place + period, True) - start
    good = (length >= least) & (length >= exponent * period)
    return sorted(set(zip(start[good].tolist(), length[good].tolist(), period[good].tolist(), strict=True)), key=lambda r: (r[0], r[2]))


def stretches(ids: np.ndarray, ends: np.ndarray, exponent: int) -> list[tuple[int, int]]:
    """(begin, end), apart and ascending, of the parts of several texts that may hold runs. ``ids``: the words of all texts, the same number only for
    equal words of one text; ``ends``: where each text ends."""
    n = len(ids)
    order = np.argsort(ids, kind="stable")
    again = ids[order[1:]] == ids[order[:-1]]
    far = np.zeros(n, np.int64)
    far[order[:-1][again]] = (order[1:] - order[:-1])[again]
    at = np.flatnonzero(far)  # a text's last word never comes again, so no stretch crosses a text's end
    while True:
        part = np.cumsum(np.concatenate(([0], np.diff(at) != 1)))[: len(at)]
        size = np.bincount(part)[part] if len(at) else at
        good = (exponent - 1) * far[at] <= size
        if good.all():
            break
        at = at[good]
    if not len(at):
        return []
    first = np.flatnonzero(np.concatenate(([True], np.diff(at) != 1)))
    begin, last = at[first], at[np.concatenate((first[1:], [len(at)])) - 1]
    end = np.minimum(last + 1 + (last + 1 - begin) // (exponent - 1), ends[np.searchsorted(ends, begin, "right")])
    out: list[tuple[int, int]] = []
    for a, b in zip(begin.tolist(), end.tolist(), strict=True):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def search(texts: list[list[bytes]], least: int, exponent: int) -> list[list[tuple[int, int, int]]]:
    """The runs of each text, given as words."""
    ends = np.cumsum([len(ws) for ws in texts])
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if not len(ends) or not ends[-1]:
        return found
    ids = np.concatenate([np.fromiter(map({}.setdefault, ws, range(end - len(ws), end)), np.int64, len(ws)) for ws, end in zip(texts, ends.tolist(), strict=True)])
    for a, b in stretches(ids, ends, exponent):
        k = int(np.searchsorted(ends, a, "right"))
        offset = a - int(ends[k]) + len(texts[k])
        found[k] += [(s + offset, n, p) for s, n, p in runs_of(ids[a:b], least, exponent)]
    return found


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words joined by spaces, without those that a run holds after its first period."""
    if runs:
        gone = np.zeros(len(words) + 1, np.int64)
        for s, n, p in runs:
            gone[s + p] += 1
            gone[s + n] -= 1
        words = [w for w, g in zip(words, np.cumsum(gone[:-1]).tolist(), strict=True) if not g]
    return b" ".join(words)


def _strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with the greatest exact exponent; of equals the first, then that of the smallest period."""
    best = None
    for r in runs:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    return best


def find_runs(docs: DataFrame, least: int = 6, exponent: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, runs (start, length and period of each, by start and period), strongest (the run with the greatest
    length / period; ties: smallest start, then period; null without a run) and collapsed (the text's words joined by one space, each run cut to
    its first period).

    Words are ``[^\\x20\\x09-\\x0D]+``, compared as they are, numbered from 0. A run has ``least`` words and ``exponent`` (2 or more) periods at
    least. A null text is empty: no words, no run, an empty collapsed text. Repeated rows and null ids come back row by row, other columns are
    ignored, an empty table gives no row. A text is held whole, some hundred bytes a word of it that may be in a run; time is in proportion
    to its words but for a logarithm.
    """
    if exponent < 2:
        raise ValueError("a run has two periods at least")

    def rows(ids: list, texts: list[list[bytes]]) -> pa.RecordBatch:
        found = search(texts, least, exponent)
        named = lambda r: r and dict(zip(("start", "length", "period"), r, strict=True))
        columns = [
            pa.array(ids, pa.int64()),
            pa.array([len(ws) for ws in texts], pa.int64()),
            pa.array([[named(r) for r in rs] for rs in found], pa.list_(_RUN)),
            pa.array([named(_strongest(rs)) for rs in found], _RUN),
            pa.array([collapse(ws, rs).decode() for ws, rs in zip(texts, found, strict=True)], pa.string()),
        ]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "runs", "strongest", "collapsed"])

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, n = [], [], 0
            for i, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids.append(i)
                texts.append(text.as_buffer().to_pybytes().split() if text.is_valid else [])  # bytes split at these six characters
                n += len(texts[-1])
                if n >= WORDS_AT_ONCE:
                    yield rows(ids, texts)
                    ids, texts, n = [], [], 0
            if ids:
                yield rows(ids, texts)

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(make, RESULT)
