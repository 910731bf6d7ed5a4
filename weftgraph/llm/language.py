"""Language identification: script ranges, per-word scores and a Viterbi pass with a switching penalty.

The model is naive Bayes over hashed character n-grams of words (1 to 3 letters, the word's edges among them).
The scripts that a language's training words use narrow a word's candidates. A document's words are labelled
together: the best path through the languages, where each change costs ``penalty``, gives spans of mixed-language text;
the language with most letters in its spans is the document's.

Training counts n-grams on a bounded sample of labelled rows (``SAMPLE`` per language) inside Spark tasks; the driver gets one
number per language and n-gram bucket. Prediction runs in Arrow batches: words are scored through a bounded
per-task cache, and the Viterbi recursion steps through all documents of a batch at once.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 15
#: Training rows per language, in expectation. All labelled rows are used where there are fewer.
SAMPLE = 2_000
PENALTY = 6.0
CACHE = 1 << 18
#: Languages that are learned at most, those with most labelled rows.
MOST_LANGS = 100
#: A mean margin of so much per word makes a score of 1 - 1/e.
TAU = 0.5


def _marks() -> str:
    """All combining marks, as ranges for a pattern: they belong to the word that they stand in."""
    codes = [c for c in range(0x300, 0x11FFF) if unicodedata.category(chr(c))[0] == "M"]
    known = set(codes)
    starts = [c for c in codes if c - 1 not in known]
    ends = [c for c in codes if c + 1 not in known]
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(starts, ends, strict=True))


MARK = re.compile(f"[{_marks()}]")
#: Words of a text without a combining mark, and of any.
PLAIN_WORDS, WORDS = re.compile(r"[^\W\d_]+"), re.compile(rf"[^\W\d_](?:[^\W\d_]|{MARK.pattern})*")
#: First code points of script ranges and their names (fixed values).
SCRIPTS = [(0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"), (0x0900, "indic"), (0x0E00, "thai"), (0x0E80, "other"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x3040, "kana"), (0x3100, "other"), (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "other")]
_STARTS = np.array([x for x, _ in SCRIPTS])
_NAMES = np.array([x for _, x in SCRIPTS])


def words_of(text: str) -> list[str]:
    text = unicodedata.normalize("NFC", text).lower()
    return (WORDS if not text.isascii() and _marked(text) else PLAIN_WORDS).findall(text)


def _marked(text: str) -> bool:
    """Whether a text has a combining mark; the first of them is U+0300."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    high = np.unique(codes[codes >= 0x300])
    return len(high) > 0 and MARK.search("".join(map(chr, high.tolist()))) is not None


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed 1- to 3-grams of ``<word>`` for many words at once: buckets (3 x characters, -1 where a gram would leave its
    word), the place where each word begins, and the script of each word's first letter."""
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    codes = np.frombuffer("".join([f"<{w}>" for w in words]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1])).astype(np.int64)
    left = np.repeat(starts + sizes, sizes) - np.arange(len(codes))  # characters up to the word's end
    out = np.full((3, len(codes)), -1, np.int64)
    h = np.zeros(len(codes), np.uint64)
    for n in (1, 2, 3):
        here = np.zeros(len(codes), np.uint64)
        here[: len(codes) - n + 1] = codes[n - 1 :]
        h = (h + here + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        out[n - 1] = np.where(left >= n, (h % np.uint64(BUCKETS)).astype(np.int64), -1)
    first = codes[starts + 1].astype(np.int64)
    return out, starts, np.searchsorted(_STARTS, first, "right") - 1


def holdout(id_col: str = "doc_id") -> Column:
    """Rows that nothing is learned from: a quarter by the CRC-32 of the id, and those without one."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(True))


def train(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", sample: int = SAMPLE, most_langs: int = MOST_LANGS) -> dict:
    """A model from rows with a text and a language, of ``sample`` rows per language, in expectation, and the ``most_langs`` languages that have
    most rows. The sample is drawn by the hash of id and text, so rows that share an id, or have none, are drawn one by one; ids and sources are no inputs of the model. Without any labelled row the model
    has no language and predicts ``und``."""
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    by_lang = rows.groupBy(F.col(lang_col).alias("lang")).agg(F.count(F.lit(1)).alias("n"))
    counts = {r["lang"]: r["n"] for r in by_lang.orderBy(F.desc("n"), "lang").limit(most_langs).collect()}
    langs = sorted(counts)
    if not langs:
        return {"langs": [], "weights": np.zeros((BUCKETS, 0), np.float32), "scripts": {}}
    limit = F.lit(float(sample)) / F.create_map(*[F.lit(x) for k, v in counts.items() for x in (k, float(v))])[F.col(lang_col)]
    draw = F.pmod(F.xxhash64(F.lit("sample"), F.col(id_col), F.col(text_col)), F.lit(1_000_000)) / 1e6
    drawn = rows.where(draw < limit).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for lang, part in pdf.groupby("lang"):
                for i in range(0, len(part), 256):
                    seen = Counter(w for text in part["text"].iloc[i : i + 256] for w in words_of(text))
                    if seen:
                        yield from tally(lang, list(seen), np.fromiter(seen.values(), np.int64, len(seen)))

    def tally(lang: str, words: list[str], n: np.ndarray) -> Iterator[pd.DataFrame]:
        buckets, starts, script = grams(words)
        sizes = np.diff(np.append(starts, buckets.shape[1]))
        names = _NAMES[script]
        for name in np.unique(names):
            times = np.repeat(np.where(names == name, n, 0), sizes)
            t = np.zeros(BUCKETS + 1, np.int64)
            for row in buckets:
                t[:BUCKETS] += np.bincount(row[row >= 0], times[row >= 0], BUCKETS).astype(np.int64)
            t[BUCKETS] = int(((sizes - 2) * n)[names == name].sum())
            at = np.flatnonzero(t)
            yield pd.DataFrame({"lang": lang, "script": str(name), "bucket": at, "n": t[at]})

    table = drawn.mapInPandas(count, "lang string, script string, bucket int, n bigint").groupBy("lang", "script", "bucket").agg(F.sum("n").alias("n")).toPandas()
    freq, letters = np.zeros((BUCKETS, len(langs))), {}
    for (lang, script), part in table.groupby(["lang", "script"]):
        inner = part[part["bucket"] < BUCKETS]
        np.add.at(freq[:, langs.index(lang)], inner["bucket"].to_numpy(), inner["n"].to_numpy(float))
        letters[lang, script] = float(part.loc[part["bucket"] == BUCKETS, "n"].sum())
    weights = np.log((freq + 0.5) / (freq.sum(0) + 0.5 * BUCKETS))
    weights -= weights.mean(1, keepdims=True)
    whole = {x: sum(v for (lang, _), v in letters.items() if lang == x) for x in langs}
    scripts: dict[str, np.ndarray] = {}
    for (lang, script), v in letters.items():
        if v >= 0.01 * max(whole[lang], 1):
            scripts.setdefault(script, np.zeros(len(langs), bool))[langs.index(lang)] = True
    return {"langs": langs, "weights": weights.astype(np.float32), "scripts": scripts}


def score_words(model: dict, words: list[str]) -> np.ndarray:
    """A score per word and language: the mean of its grams' log-weights, more for longer words. A language that doesn't use
    the word's script gets less than the worst; a word in a script that no language uses says nothing: all its scores are 0."""
    if not words:
        return np.zeros((0, len(model["langs"])), np.float32)
    buckets, starts, script = grams(words)
    padded = np.vstack((model["weights"], np.zeros((1, len(model["langs"])), np.float32)))  # bucket -1
    total = sum(np.add.reduceat(padded[row], starts, axis=0) for row in buckets)
    count = sum(np.add.reduceat((row >= 0).astype(np.float32), starts) for row in buckets)
    sizes = np.diff(np.append(starts, buckets.shape[1])) - 2
    scores = total / count[:, None] * np.minimum(4.0, 1 + sizes / 2)[:, None]
    fits = np.stack([model["scripts"].get(str(name), np.zeros(len(model["langs"]), bool)) for name in _NAMES])[script]
    scores = np.where(fits, scores, scores.min(1, keepdims=True) - 2.0)
    return np.where(fits.any(1)[:, None], scores, 0.0).astype(np.float32)


def viterbi(scores: np.ndarray, lengths: np.ndarray, penalty: float = PENALTY) -> np.ndarray:
    """Labels of the words of many documents, laid end to end in ``scores`` (words x languages).

    All documents advance together, longest first, so a step is one numpy operation over those not yet ended."""
    labels = np.zeros(len(scores), np.int32)
    if not len(scores):
        return labels
    begin = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    order = np.argsort(-lengths, kind="stable")
    begin, lengths = begin[order], lengths[order]
    active = np.searchsorted(-lengths, -np.arange(1, lengths[0] + 1), "right")  # documents with a word t
    v = scores[begin[: active[0]]].copy()
    switched = np.zeros(scores.shape, bool)
    best = np.zeros(len(scores), np.int32)
    for t in range(1, int(lengths[0])):
        k = active[t]
        at = begin[:k] + t
        v = v[:k] if len(v) > k else v
        top = v.argmax(1)
        jump = v[np.arange(k), top] - penalty
        sw = v < jump[:, None]
        switched[at], best[at] = sw, top
        v = np.where(sw, jump[:, None], v) + scores[at]
        ends = active[t + 1] if t + 1 < lengths[0] else 0
        if ends < k:
            labels[at[ends:]] = v[ends:].argmax(1)
    one = np.flatnonzero(lengths == 1)
    labels[begin[one]] = scores[begin[one]].argmax(1)
    for t in range(int(lengths[0]) - 1, 0, -1):
        at = begin[: active[t]] + t
        now = labels[at]
        labels[at - 1] = np.where(switched[at, now], best[at], now)
    return labels


SPANS = pa.list_(pa.struct([("at", pa.int32()), ("n", pa.int32()), ("lang", pa.string())]))


def identify(docs: DataFrame, model: dict, text_col: str = "text", penalty: float = PENALTY, spans: bool = True, group: int = 2048) -> DataFrame:
    """``docs`` with lang_pred, score and (if ``spans``) lang_spans: first word, number of words and language of each span.

    A span of words in scripts that no learned language uses has no language (null). lang_pred is ``und`` and score 0 if the text is null or has no letter. score is the share of all letters that is in spans
    of lang_pred and in a script that a learned language uses, times 1 - exp(-m / ``TAU``), where m is the mean per such word of what
    lang_pred scores above the next language. So it is 0 in a script that no language uses, and near 0 where words tell nothing. With
    one learned language m has no next and the score is the share. All rows and columns stay; columns of these names, in any letter case, are replaced. Very long
    texts are taken whole, in a batch's memory.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS numbers per language
    names = [c for c in docs.columns if c.lower() not in ("lang_pred", "score", "lang_spans")]
    extra = ", lang_spans array<struct<at:int,n:int,lang:string>>" if spans else ""
    rest = docs.select(*names)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema) + f", lang_pred string, score double{extra}"

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        langs = model["langs"]
        index: dict[str, int] = {}
        vectors = np.zeros((1 << 12, max(1, len(langs))), np.float32)
        sizes = np.zeros(1 << 12, np.int32)
        for batch in batches:
            for i in range(0, batch.num_rows, group):
                part = batch.slice(i, group)
                texts = [words_of(x) if x is not None and langs else [] for x in part.column(text_col).to_pylist()]
                if len(index) > CACHE:
                    index.clear()
                new = list({w for ws in texts for w in ws if w not in index})
                need = len(index) + len(new)
                if need > len(vectors):
                    vectors = np.concatenate((vectors, np.zeros((2 * need - len(vectors), vectors.shape[1]), np.float32)))
                    sizes = np.concatenate((sizes, np.zeros(2 * need - len(sizes), np.int32)))
                if new:
                    vectors[len(index) : need], sizes[len(index) : need] = score_words(model, new), list(map(len, new))
                index.update(zip(new, range(len(index), need), strict=True))
                at = np.fromiter((index[w] for ws in texts for w in ws), np.int64)
                lengths = np.fromiter((len(ws) for ws in texts), np.int64, len(texts))
                has = lengths > 0
                labels = viterbi(vectors[at], lengths[has], penalty)
                top, share = confidence(vectors[at], sizes[at], labels, lengths)
                columns = [*part.columns, pa.array([langs[x] if h else "und" for x, h in zip(top, has, strict=True)], pa.string()), pa.array(share, pa.float64())]
                if spans:
                    told = vectors[at].any(1)
                    columns.append(pa.array(list(_spans(np.where(told, labels, -1), lengths, langs)), SPANS))
                yield pa.RecordBatch.from_arrays(columns, [*names, "lang_pred", "score", *["lang_spans"] * spans])

    return rest.mapInArrow(predict, schema)


def confidence(scores: np.ndarray, sizes: np.ndarray, labels: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The language and score of each document, of its words' scores, letters and labels, laid end to end."""
    n, k = len(lengths), scores.shape[1]
    doc = np.repeat(np.arange(n), lengths)
    told = scores.any(1)  # a word of a script that no language uses has no score
    mass = np.bincount(doc[told] * k + labels[told], sizes[told], n * k).reshape(n, k).astype(float)
    top = mass.argmax(1)
    letters = np.bincount(doc, sizes, n)
    share = mass[np.arange(n), top] / np.maximum(letters, 1)
    own = told & (labels == top[doc])
    if k == 1:
        return top, share
    at, told_own = doc[own], scores[own]
    sums = np.stack([np.bincount(at, told_own[:, x], n) for x in range(k)], 1).astype(float)  # no word gives whole numbers
    best = sums[np.arange(n), top].copy()
    sums[np.arange(n), top] = -np.inf
    margin = (best - sums.max(1)) / np.maximum(np.bincount(at, minlength=n), 1)
    return top, share * (1 - np.exp(-np.maximum(margin, 0.0) / TAU))


def _spans(labels: np.ndarray, lengths: np.ndarray, langs: list[str]) -> Iterator[list[dict]]:
    end = 0
    for n in lengths:
        own, end = labels[end : end + n], end + n
        cuts = np.concatenate(([0], np.flatnonzero(own[1:] != own[:-1]) + 1, [n])) if n else np.zeros(1, int)
        yield [{"at": int(a), "n": int(b - a), "lang": langs[own[a]] if own[a] >= 0 else None} for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
