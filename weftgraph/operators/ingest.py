"""From documents to chunks, requests and entity records, and from records back to where their texts stand."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as fx
from ..functions.batches import pieces, record_batch
from ..plans.pack import ID_PATTERN, Pack
from ..sources.shared import cut
from .graph import ENTITY

# The patterns of natural boundaries, with their priorities.
SPEAKER = re.compile(r"(?m)^[ \t]*(?:[A-Z][A-Za-z0-9_.\-]{1,30}|P\d+)(?:[ \t]*\[[^\]]{1,40}\])?[ \t]*:[ \t]")
TIMESTAMP = re.compile(r"(?m)^[ \t]*[\[\(]\d{1,2}:\d{2}(?::\d{2})?[\]\)]")
HEADING = re.compile(r"(?m)^[ \t]*(?:#+|§)\s")
PARAGRAPH = re.compile(r"\n[ \t]*\n")
SENTENCE = re.compile(r"[\.!?][\"')\]]?\s+(?=[A-Z])")
KINDS = (("speaker_turn", SPEAKER, 5), ("timestamp", TIMESTAMP, 4), ("heading", HEADING, 3), ("paragraph", PARAGRAPH, 2), ("sentence", SENTENCE, 1))
MOST_CHUNKS = 1000
#: Needles, or pairs to be verified, are sent to all tasks up to so many; more are joined by a shuffle.
MOST_SENT = 200_000
#: A document's needles go along with its texts up to so many; where a document has more, they meet its texts by words.
MOST_ALONG = 256
BOUNDARY = T.ArrayType(T.StructType([T.StructField("pos", T.IntegerType()), T.StructField("kind", T.StringType()), T.StructField("priority", T.IntegerType())]))
CHUNK = T.StructType([T.StructField("doc_id", T.StringType()), T.StructField("n_chunks", T.IntegerType()), T.StructField("chunk_index", T.IntegerType()), T.StructField("text", T.StringType()), T.StructField("section_hint", T.StringType())])


def boundaries(text: str) -> list[tuple[int, str, int]]:
    """Where a chunk may begin, ascending; of several kinds at a place the one with the highest priority. The text's own begin is one
    if a pattern stands there."""
    best: dict[int, tuple[int, str]] = {}
    for kind, pattern, priority in KINDS:
        for m in pattern.finditer(text):
            if best.get(m.start(), (0, ""))[0] < priority:
                best[m.start()] = (priority, kind)
    return [(pos, kind, priority) for pos, (priority, kind) in sorted(best.items())]


def hint(text: str) -> str:
    """A chunk's label: its first speaker, time or heading line, else its first words."""
    head = text[:500]
    for pattern in (SPEAKER, TIMESTAMP):
        if m := pattern.search(head):
            return m.group(0).strip().rstrip(":").strip() if pattern is SPEAKER else m.group(0).strip()
    if m := HEADING.search(head):
        end = text.find("\n", m.start())
        return text[m.start() : end if end >= 0 else m.start() + 120].strip()
    first = " ".join(text.split()[:8])
    return first if len(first) <= 80 else first[:80] + "…"


def split_chunks(text: str | None, max_chars: int, whole: bool = True) -> list[tuple[int, str, str]]:
    """(index, text, hint) of each chunk: greedy, up to the last boundary within ``max_chars``, a hard cut where there is none.

    A chunk's end is stripped, and chunks of white space only are passed over, so nothing else is lost. Without ``whole`` such a chunk, or the
    thousandth, ends the document."""
    if max_chars <= 0:
        raise ValueError("a window takes one character at least")
    text = text or ""
    if len(text) <= max_chars:
        return [(0, text, hint(text))]
    stops = [p for p, _, _ in boundaries(text)] + [len(text)]
    out: list[tuple[int, str, str]] = []
    start = 0
    while start < len(text) and (whole or len(out) <= MOST_CHUNKS):
        k = bisect_right(stops, start + max_chars) - 1
        end = stops[k] if k >= 0 and stops[k] > start else start + max_chars
        body = text[start:end].rstrip()
        if body:
            out.append((len(out), body, hint(body)))
        elif not whole:
            break
        start = end
    return out


@F.pandas_udf(BOUNDARY)
def find_boundaries(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: [{"pos": p, "kind": k, "priority": n} for p, k, n in boundaries(t or "")])


def section_hint(text: Column | str) -> Column:
    """``hint`` as column functions: the first speaker, time or heading line of the first 500 characters, else the first words."""
    text = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    ends = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"
    bare = lambda c: F.regexp_replace(c, ends, "")
    head = F.substring(text, 1, 500)
    speaker, time = (F.regexp_extract(head, p.pattern, 0) for p in (SPEAKER, TIMESTAMP))
    begin = F.regexp_instr(head, F.lit(HEADING.pattern))
    rest = F.substring(text, begin, F.length(text))
    line = F.when(F.contains(rest, F.lit("\n")), F.substring_index(rest, "\n", 1)).otherwise(F.substring(rest, 1, 120))
    words = F.array_join(F.slice(F.split(bare(text), r"(?U)[\s\x1c-\x1f]+", 9), 1, 8), " ")
    first = F.when(F.length(words) <= 80, words).otherwise(F.concat(F.substring(words, 1, 80), F.lit("…")))
    named = bare(F.regexp_replace(bare(speaker), ":+$", ""))
    return F.when(speaker != "", named).when(time != "", bare(time)).when(begin > 0, bare(line)).otherwise(first)


def chunk_documents(docs: DataFrame, max_chars: int, id_col: str = "doc_id", text_col: str = "text", whole: bool = True) -> DataFrame:
    """(doc_id, chunk_index, n_chunks, chunk_doc_id, text, section_hint): each document cut in Arrow batches, no shuffle; few documents and their chunks
    are Python objects at a time. A table whose long texts stand together is dealt out first (``dealt_by_size``)."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            rows = []
            for doc, text in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist(), strict=True):
                chunks = split_chunks(text, max_chars, whole)
                rows += [(doc, len(chunks), *chunk) for chunk in chunks]
            yield record_batch({name: [r[k] for r in rows] for k, name in enumerate(CHUNK.names)}, CHUNK)

    rows = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(split, CHUNK)
    return rows.select("doc_id", "chunk_index", "n_chunks", fx.chunk_doc_id("doc_id", "chunk_index", "n_chunks").alias("chunk_doc_id"), "text", "section_hint")


def dealt_by_size(rows: DataFrame, tasks: int, text_col: str = "text") -> DataFrame:
    """``rows`` in ``tasks`` partitions of about equal total length of ``text_col``, for work that takes as long as its texts.

    Rows keep their order: partitions are ranges of the running total. Each task adds up its own texts from where the ones
    before end (one row per task meets on the driver), so rows are read twice and shuffled once. A partition has one text more than its share at
    most. The input must give the same rows in the same partitions when it is read again, as files do; what does not is to be written first. A null
    text counts as empty."""
    if tasks < 1:
        raise ValueError("work takes one task at least")
    size = F.coalesce(F.length(text_col), F.lit(0)).cast("bigint") + 1
    totals = rows.select(F.spark_partition_id().alias("p"), size.alias("n")).groupBy("p").agg(F.sum("n").alias("n")).orderBy("p").collect()
    starts, total = {}, 0
    for r in totals:
        starts[r["p"]], total = total, total + r["n"]
    names = rows.columns
    inner = [f"c{i}" for i in range(len(names))]
    fields = [T.StructField(n, f.dataType) for n, f in zip(inner, rows.schema, strict=True)]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = 0
        for batch in batches:
            n = np.array(batch.column("_n"), np.int64)
            begin = done + starts[batch.column("_p")[0].as_py()] + np.cumsum(n) - n if len(n) else n
            done += int(n.sum())
            task = pa.array((begin * tasks // total).astype(np.int32))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(inner)], task], [*inner, "_task"])

    sized = rows.toDF(*inner).withColumns({"_n": (F.coalesce(F.length(inner[names.index(text_col)]), F.lit(0)).cast("bigint") + 1), "_p": F.spark_partition_id()})
    placed = sized.mapInArrow(place, T.StructType([*fields, T.StructField("_task", T.IntegerType())]))
    return placed.repartitionById(tasks, "_task").drop("_task").toDF(*names)


def pack_turns(turns: DataFrame, max_chars: int, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, window, first_turn, last_turn, n_chars, text): turns in order, as ``role: text`` lines, packed greedily into windows of
    ``max_chars``; a longer turn is a window of its own. A conversation's turns meet in one row, folded inside the JVM."""
    line = F.concat(F.coalesce(role_col, F.lit("")), F.lit(": "), F.coalesce(text_col, F.lit("")))
    one = turns.select(F.col(conv_col).alias("conv_id"), F.struct(F.col(turn_col).cast("bigint").alias("turn"), line.alias("line")).alias("t"))
    packed = one.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    window = "array<struct<first:bigint,last:bigint,n:int,text:string>>"

    def step(acc: Column, t: Column) -> Column:
        last = F.element_at(acc, F.lit(-1))
        fits = (F.size(acc) > 0) & (F.when(F.size(acc) > 0, last["n"]).otherwise(0) + 1 + F.length(t["line"]) <= max_chars)
        grown = F.struct(last["first"].alias("first"), t["turn"].alias("last"), (last["n"] + 1 + F.length(t["line"])).alias("n"), F.concat(last["text"], F.lit("\n"), t["line"]).alias("text"))
        fresh = F.struct(t["turn"].alias("first"), t["turn"].alias("last"), F.length(t["line"]).alias("n"), t["line"].alias("text"))
        return F.when(fits, F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(grown))).otherwise(F.concat(acc, F.array(fresh))).cast(window)

    folded = packed.select("conv_id", F.aggregate("ts", F.array().cast(window), step).alias("ws"))
    return folded.select("conv_id", F.posexplode("ws").alias("window", "w")).select("conv_id", F.col("window").cast("bigint").alias("window"), F.col("w.first").alias("first_turn"), F.col("w.last").alias("last_turn"), F.col("w.n").cast("bigint").alias("n_chars"), F.col("w.text").alias("text"))


def render_requests(chunks: DataFrame, pack: Pack) -> DataFrame:
    """(chunk_doc_id, system, user): one request per chunk from the pack's templates; the text is cut to the pack's window."""

    def fill(template: str, parts: dict[str, Column]) -> Column:
        out = [parts[x[1:-1]] if x[:1] == "{" and x[1:-1] in parts else F.lit(x) for x in re.split(r"(\{\w+\})", template) if x]
        return F.concat(*out) if out else F.lit("")

    parts = {"doc_id": F.col("chunk_doc_id"), "prompt_version": F.lit(pack.prompt_version), "few_shot": F.lit(pack.few_shot), "text_window": F.substring("text", 1, pack.window_chars)}
    return chunks.select("chunk_doc_id", fill(pack.system_template, parts).alias("system"), fill(pack.user_template, parts).alias("user"))


def extraction_schema(pack: Pack) -> tuple[T.StructType, dict]:
    """What a response holds: the Spark type, and the constraints on it (classes, id pattern, property names but ``partOfStatute``)."""
    names = [p.name for p in pack.properties if p.name != "partOfStatute"]
    text = lambda n: T.StructField(n, T.StringType())
    entity = T.StructType([text("class"), text("id"), text("label"), text("source_section"), text("source_text"), T.StructField("properties", T.MapType(T.StringType(), T.StringType()))])
    rules = {"class": pack.class_names, "id": ID_PATTERN, "properties": names, "required": ["class", "id", "label", "source_section", "source_text"]}
    return T.StructType([T.StructField("entities", T.ArrayType(entity))]), rules


def parse_responses(responses: DataFrame, pack: Pack, json_col: str = "response") -> tuple[DataFrame, DataFrame]:
    """(entities, diagnostics) of ``responses`` (chunk_doc_id, response, finish_reason). Bad JSON gives no entity; a response
    without entities is a diagnostic: ``truncated`` where it ended for length, else ``empty``."""
    schema, _ = extraction_schema(pack)
    parsed = responses.withColumn("_e", F.coalesce(F.from_json(json_col, schema)["entities"], F.array().cast(schema["entities"].dataType)))
    rows = parsed.where(F.size("_e") > 0).select("chunk_doc_id", F.inline("_e"))
    why = F.when(F.col("finish_reason") == "length", F.lit("truncated")).otherwise(F.lit("empty"))
    return rows, parsed.where(F.size("_e") == 0).select("chunk_doc_id", why.alias("problem"))


def extract_entities(chunks: DataFrame, extractor: Callable[[pd.DataFrame], pd.DataFrame], schema: str = ENTITY) -> DataFrame:
    """A user's extractor (a frame of chunks in, a frame of entity records out) over all chunks, in frames of a few hundred."""
    made = T.StructType.fromDDL(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            yield record_batch(extractor(piece.to_pandas()), made)

    return chunks.mapInArrow(run, made)


_TURN = re.compile(r"(?m)^[ \t]*([A-Za-z][A-Za-z0-9_.\-]{1,30})[ \t]*:[ \t]+(.+)$")
_DEFINED = re.compile(r"[\"“]([^\"”\n]{2,80})[\"”]\s+means\s+([^.;\n]+)")


def rule_extractor(pdf: pd.DataFrame) -> pd.DataFrame:
    """Definitions (``"term" means ...``) and speakers' turns (``Name: text``) of chunks as entity records."""
    out = []
    for row in pdf.itertuples():
        found = [("Definition", m.group(1), m.group(0), {}) for m in _DEFINED.finditer(row.text)]
        found += [("Excerpt", " ".join(m.group(2).split()[:8]), m.group(2), {"spokenBy": [m.group(1)]}) for m in _TURN.finditer(row.text)]
        for i, (cls, label, source, props) in enumerate(found):
            eid = re.sub(r"[^a-z0-9_]", "_", f"{row.chunk_doc_id}_{cls}_e{i}".lower())
            out.append({"class": cls, "id": eid, "label": label, "uri": eid, "source_document": row.doc_id, "source_section": row.section_hint, "source_page": None, "source_text": source, "properties": props, "file": f"{eid}.md"})
    frame = pd.DataFrame(out, columns=[x.split()[0] for x in re.split(r", (?=\w+ (?:string|int|map))", ENTITY)])
    return frame.astype({"source_page": "Int32"})


def _runs(words: Column, width: int | Column) -> Column:
    """Hashes of the runs of ``width`` words, each by its place; an array with fewer words has none."""
    at = lambda i: F.xxhash64(F.slice(words, i, width))
    return F.when(F.size(words) >= width, F.transform(F.sequence(F.lit(1), F.size(words) - width + 1), at)).otherwise(F.array().cast("array<bigint>"))


#: Short needles are looked for together, in one pass over the texts, while there are at most so many.
MOST_LISTED = 2000


def _by_looking(short: DataFrame, texts: DataFrame) -> DataFrame:
    """(doc, place, needle_id): the texts that contain needles of one or two words (needle_id, norm), of which there are few. Texts are read once, each is
    looked through for every needle, and nothing is shuffled."""
    listed = short.select("needle_id", "norm").collect()
    norms = [(i, r["norm"]) for i, r in enumerate(listed)]
    schema = T.StructType([texts.schema["doc"], texts.schema["place"], T.StructField("_i", T.IntegerType())])

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            hits = [(row, i) for row, text in enumerate(piece.column("_t").to_pylist()) if text for i, norm in norms if norm in text]
            at = pa.array([row for row, _ in hits], pa.int32())
            yield pa.RecordBatch.from_arrays([piece.column("doc").take(at), piece.column("place").take(at), pa.array([i for _, i in hits], pa.int32())], names=schema.names)

    named = texts.sparkSession.createDataFrame([(i, r["needle_id"]) for i, r in enumerate(listed)], T.StructType([schema["_i"], short.schema["needle_id"]]))
    rows = texts.select("doc", "place", fx.normalize_for_match("text").alias("_t")).mapInArrow(look, schema)
    return rows.join(F.broadcast(named), "_i").select("doc", "place", "needle_id")


#: Short needles are looked for by runs of so many characters.
GRAM = 3


def _grams(norm: Column, width: int) -> Column:
    """The distinct runs of ``width`` characters of a text, in one pass."""
    return F.array_distinct(F.regexp_extract_all(norm, F.lit(f"(?s)(?=({'.' * width}))"), F.lit(1)))


def _by_grams(short: DataFrame, texts: DataFrame, widths: list[int], sent: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(doc, place, needle_id): the texts that hold the run of ``GRAM`` characters of a short needle (needle_id, norm) that the fewest texts hold; a needle with
    fewer characters is its own run. Texts give keys only for runs that are in some needle, so what is shuffled does not grow with their length."""
    n = F.length("norm")
    own = short.select("needle_id", F.explode(F.when(n >= GRAM, _grams(F.col("norm"), GRAM)).otherwise(F.array("norm"))).alias("gram"))
    norm = fx.normalize_for_match("text")
    every = F.flatten(F.transform(F.array(norm), lambda t: F.concat(*[_grams(t, w) for w in widths])))
    keyed = texts.select("doc", "place", F.explode(every).alias("gram"))
    held = keyed.join(sent(own.select("gram").distinct()), "gram").groupBy("gram").agg(F.count(F.lit(1)).alias("c"))
    # A run that no text holds is in no needle that one holds.
    rarest = own.join(sent(held), "gram", "left").groupBy("needle_id").agg(F.min(F.struct(F.coalesce("c", F.lit(0)).alias("c"), "gram")).alias("m")).where("m.c > 0")
    return keyed.join(sent(rarest.select("needle_id", F.col("m.gram").alias("gram"))), "gram").select("doc", "place", "needle_id")


def _in_own_texts(needles: DataFrame, texts: DataFrame, sent: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(doc, place, needle_id): the needles (needle_id, doc, norm), few for each document, that the texts of their document contain. A text is shuffled once at most, and
    looked through where it meets its needles."""
    own = needles.groupBy("doc").agg(F.collect_list(F.struct("needle_id", "norm")).alias("_ns"))
    # A lambda binds the text, so that it is normalised once and not for each needle.
    inside = F.transform(F.array(fx.normalize_for_match("text")), lambda t: F.filter("_ns", lambda n: F.contains(t, n["norm"])))
    return texts.join(sent(own), "doc").select("doc", "place", F.explode(F.element_at(inside, 1)).alias("_n")).select("doc", "place", F.col("_n.needle_id").alias("needle_id"))


def anchored(needles: DataFrame, texts: DataFrame, width: int = 4, along: int = MOST_ALONG) -> DataFrame:
    """(doc, needle_id, place): the texts (doc, place, text) that contain a needle (needle_id, doc or null for any, norm) after
    normalisation. ``needle_id`` names a row; a null text contains nothing and an empty needle is nowhere.

    Needles that name a document go along with its texts, if it has ``along`` of them at most (``_in_own_texts``). Up to ``MOST_LISTED`` needles of one or two words that
    name none are looked for in one pass (``_by_looking``). Others are joined by words (``_by_words``)."""
    needles = needles.where("norm <> ''").select("needle_id", "doc", "norm")
    found = []
    short = F.col("doc").isNull() & (F.size(F.split("norm", " ", -1)) <= 2)
    if 0 < needles.where(short).limit(MOST_LISTED + 1).count() <= MOST_LISTED:
        found.append(_by_looking(needles.where(short), texts))
        needles = needles.where(~short)
    per_doc = needles.where("doc is not null").groupBy("doc").agg(F.count(F.lit(1)).alias("c"))
    told = per_doc.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("all"), F.coalesce(F.max("c"), F.lit(0)).alias("most")).first()
    named, many = needles.where("doc is not null"), needles.where("doc is null")
    if told["most"] > along:
        crowded = cut(per_doc.where(F.col("c") > along).select("doc"))
        many = many.unionByName(named.join(crowded, "doc", "left_semi").select(*needles.columns))
        named = named.join(crowded, "doc", "left_anti").select(*needles.columns)
    if told["all"]:
        found.append(_in_own_texts(named, texts, F.broadcast if told["all"] <= MOST_SENT else lambda df: df))
    if not found or not many.isEmpty():
        found.append(_by_words(many, texts, width))
    return reduce(DataFrame.unionByName, [rows.select("doc", "needle_id", "place") for rows in found])


def _by_words(needles: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """``anchored`` by words: a needle's words but the first and last stand as whole words wherever it occurs. So up to ``width`` of them are a join key
    to as many words of a text, together with the document if the needle names one, and ``contains`` verifies the pairs that
    meet. A needle of one or two words has no inner word: it is looked for in its document's texts, or where it names none in the texts that
    hold its rarest run of three characters (``_by_grams``). Each text is normalised and split once, and gives at most ``width`` keys per word;
    for short needles without a document it is read twice more.
    """
    norm = fx.normalize_for_match("text")
    needles = needles.select("needle_id", "doc", "norm", F.split("norm", " ", -1).alias("_w"))
    needles = needles.withColumn("_n", F.least(F.lit(width), F.size("_w") - 2))
    free, short_chars = F.col("doc").isNull(), F.when(F.col("doc").isNull() & (F.col("_n") <= 0), F.least(F.length("norm"), F.lit(GRAM)))
    kinds = needles.groupBy("_n", free.alias("free"), short_chars.alias("chars")).agg(F.count(F.lit(1)).alias("c")).collect()  # few rows: widths and runs
    widths = sorted({r["_n"] for r in kinds if r["_n"] > 0})
    # A lambda binds the words, so that a text is split once and not for each of them.
    keys = F.transform(F.array(F.split(norm, " ", -1)), lambda ws: F.concat(F.array().cast("array<bigint>"), *[_runs(ws, n) for n in widths]))
    keyed = texts.select("doc", "place", F.explode(F.array_distinct(F.element_at(keys, 1))).alias("_k"))
    found = [texts.sparkSession.createDataFrame([], T.StructType([texts.schema["doc"], texts.schema["place"], needles.schema["needle_id"]]))]
    for anywhere in (False, True):
        mine = needles.where(free if anywhere else ~free)
        sent = F.broadcast if sum(r["c"] for r in kinds if r["free"] == anywhere) <= MOST_SENT else lambda df: df
        if any(r["_n"] > 0 for r in kinds if r["free"] == anywhere):
            inner = mine.where("_n > 0").select("needle_id", "doc", F.xxhash64(F.slice("_w", F.lit(2), F.col("_n"))).alias("_k"))
            found.append(keyed.join(sent(inner.drop("doc") if anywhere else inner), ["_k"] if anywhere else ["doc", "_k"]))
        if any(r["_n"] <= 0 for r in kinds if r["free"] == anywhere):
            short = mine.where("_n <= 0").select("needle_id", "doc", "norm")
            runs = sorted({r["chars"] for r in kinds if r["chars"]})
            found.append(_by_grams(short, texts, runs, sent) if anywhere else texts.join(short.select("needle_id", "doc"), "doc"))
    hit = cut(reduce(DataFrame.unionByName, [rows.select("doc", "place", "needle_id") for rows in found]).distinct())
    few = F.broadcast if hit.count() <= MOST_SENT else lambda df: df
    # A text that several needles may be in is normalised once.
    held = texts.join(few(hit.select("doc", "place").distinct()), ["doc", "place"], "left_semi").select("doc", "place", norm.alias("_t"))
    full = held.join(few(hit), ["doc", "place"]).join(needles.select("needle_id", F.col("norm").alias("_s")), "needle_id")
    return full.where(F.contains("_t", F.col("_s"))).select("doc", "needle_id", "place")


def locate_page(needles: DataFrame, pages: DataFrame, least: int = 40, head: int = 30) -> DataFrame:
    """(needle_id, page_no): the first page of a needle's document that contains it after normalisation; where none does and the
    needle has ``least`` characters or more, the first that contains its first ``head``, with any space they end in. Null where
    neither is found, and for a needle without a document.

    ``needles``: needle_id, doc, snippet; ``pages``: doc, page_no, page_text. Needles and heads are looked for in one pass."""
    norm = needles.select(F.col("needle_id").alias("_id"), "doc", fx.normalize_for_match("snippet").alias("norm")).where("doc is not null")
    tried = F.array(F.struct(F.lit(0).alias("_try"), "norm"), F.struct(F.lit(1).alias("_try"), F.substring("norm", 1, head).alias("norm")))
    both = norm.select("_id", "doc", F.inline(F.when(F.length("norm") >= least, tried).otherwise(F.slice(tried, 1, 1))))
    rows = both.select(F.struct("_id", "_try").alias("needle_id"), "doc", "norm")
    found = anchored(rows, pages.select("doc", F.col("page_no").alias("place"), F.col("page_text").alias("text")))
    best = found.groupBy(F.col("needle_id._id").alias("needle_id")).agg(F.min(F.struct("needle_id._try", "place")).alias("m"))
    return needles.select("needle_id").join(best.select("needle_id", F.col("m.place").alias("page_no")), "needle_id", "left")


def hooked_variants(hook: Callable[[str], list[str]]) -> Callable[[str], Column]:
    """A user's function from a source text to needles, as a column function in Arrow batches."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: list(hook(t or "")))

    return run


def locate_evidence(entities: DataFrame, pages: DataFrame, style: str = "default", hook: Callable[[str], list[str]] | None = None) -> DataFrame:
    """(id, variant, offset): each entity with a page and text, its first search variant that occurs on its page and where (from 0);
    both null where none does. ``pages``: doc, page_no, page_text. A pack's own ``hook`` gives the variants in place of a style."""
    wanted = entities.where("source_page is not null and source_text <> ''")
    on = wanted.join(pages, (F.col("source_document") == F.col("doc")) & (F.col("source_page") == F.col("page_no")), "left")
    tried = fx.search_variants("source_text", style) if hook is None else hooked_variants(hook)("source_text")
    rows = on.select("id", "page_text", tried.alias("tried")).select("id", "page_text", F.posexplode_outer("tried").alias("n", "variant"))
    at = F.expr("locate(variant, page_text)")
    hit = rows.select("id", F.when(at > 0, F.struct("n", "variant", (at - 1).alias("offset"))).alias("h"))
    return hit.groupBy("id").agg(F.min("h").alias("h")).select("id", "h.variant", "h.offset")


def evidence_counts(located: DataFrame) -> DataFrame:
    return located.agg(F.count_if(F.col("variant").isNotNull()).alias("matched"), F.count_if(F.col("variant").isNull()).alias("unmatched"))


def with_chunk_counts(chunks: DataFrame) -> DataFrame:
    """n_chunks and chunk_doc_id for a chunk table (doc_id, chunk_index) that lacks them."""
    n = F.count(F.lit(1)).over(Window.partitionBy("doc_id"))
    return chunks.withColumn("n_chunks", n).withColumn("chunk_doc_id", fx.chunk_doc_id("doc_id", "chunk_index", "n_chunks"))
