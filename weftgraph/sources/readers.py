"""Reading documents, entity records and proposals from files."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.batches import pieces, record_batch
from ..functions.text import derive_doc_id, estimate_chunks
from ..operators.graph import ENTITY

SUFFIXES = (".txt", ".md", ".markdown", ".vtt", ".srt")
FRONT = r"(?s)\A---[ \t]*\r?\n(.*?)\r?\n---[ \t]*(?:\r?\n(.*)\Z|\Z)"
RECORD = f"{ENTITY}, body string, corrupt boolean"
PROPOSAL = (
    "proposal_id string, operation string, status string, confidence string, created_at string, model_snapshot string, kept_id string, removed_id string, "
    "new_subtheme_label string, parent_theme_id string, member_code_ids array<string>, from_id string, property string, to_id string, entity_id string, new_label string, "
    "rationale string, evidence array<string>, reviewer_notes string, file string"
)


def stem(name: Column) -> Column:
    return F.regexp_replace(name, r"\.[^.]*$", "")


def file_name() -> Column:
    """The name of a row's file; the metadata column has it percent-encoded."""
    return F.url_decode(F.replace("_metadata.file_name", F.lit("+"), F.lit("%2B")))


def text_files(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """(path, file, size_bytes, text): one row per file right under ``path``."""
    reader = spark.read.format("text").option("recursiveFileLookup", "false").option("wholetext", "true")
    reader = reader.option("pathGlobFilter", pattern) if pattern else reader
    return reader.load(path).select(F.col("_metadata.file_path").alias("path"), file_name().alias("file"), F.col("_metadata.file_size").alias("size_bytes"), F.col("value").alias("text"))


def read_documents(spark: SparkSession, path: str, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """(doc_id, path, suffix, size_bytes, text) of the text files under ``path``; suffixes in any case."""
    suffix = F.lower(F.regexp_extract("file", r"(\.[^.]*)$", 1))
    return text_files(spark, path).withColumn("suffix", suffix).where(F.col("suffix").isin(*suffixes)).select(derive_doc_id(stem(F.col("file"))).alias("doc_id"), "path", "suffix", "size_bytes", "text")


def inbox_profile(docs: DataFrame, max_chars: int) -> DataFrame:
    """(doc_id, suffix, size_bytes, is_text, n_chars, estimated_chunks); chunks are given only for texts over the window."""
    n = F.length("text")
    return docs.select("doc_id", "suffix", "size_bytes", F.col("suffix").isin(*SUFFIXES).alias("is_text"), n.alias("n_chars"), F.when(n > max_chars, estimate_chunks(n, max_chars)).alias("estimated_chunks"))


def _scalar(raw: str):
    raw = raw.strip()
    if raw in ("", "~", "null", "Null", "NULL"):
        return None
    if raw[0] == "'" and raw[-1] == "'" and len(raw) > 1:
        return raw[1:-1].replace("''", "'")
    if raw[0] == '"' and raw[-1] == '"' and len(raw) > 1:
        try:
            return json.loads(raw)
        except ValueError:
            return raw[1:-1]
    return raw


def front_matter(block: str) -> dict:
    """The keys of a front-matter block: scalars, lists and one level of nested maps; plain scalars may run on over
    indented lines. What is not a map of keys gives an empty dict."""
    try:
        import yaml
    except ImportError:
        yaml = None
    if yaml is not None:
        try:
            found = yaml.safe_load(block)
        except yaml.YAMLError:
            return {}
        return found if isinstance(found, dict) else {}
    out: dict = {}
    key = sub = None
    for line in block.splitlines():
        body = line.strip()
        if not body or body.startswith("#"):
            continue
        indent = len(line) - len(line.lstrip())
        name, colon, rest = body.partition(":")
        keyed = colon and (not rest or rest[0] == " ") and not name.startswith(("-", "'", '"', "[")) and " " not in name
        if indent == 0 and keyed:
            key, sub = name, None
            out[key] = {} if rest.strip() == "{}" else [] if rest.strip() == "[]" else _scalar(rest)
        elif key is None:
            return {}
        elif body.startswith("- "):
            home = out if sub is None else out[key]
            at = key if sub is None else sub
            home[at] = [*(home[at] if isinstance(home[at], list) else []), _scalar(body[2:])]
        elif indent and keyed and (out[key] is None or isinstance(out[key], dict)):
            out[key], sub = out[key] or {}, name
            out[key][name] = _scalar(rest)
        elif isinstance(out[key], str):
            out[key] = _scalar(f"{out[key]} {body}")
    return out


def _text(x) -> str | None:
    return None if x is None else x if isinstance(x, str) else json.dumps(x) if isinstance(x, (dict, list)) else str(x)


def _texts(x) -> list[str]:
    return [t for t in map(_text, x if isinstance(x, list) else [x]) if t is not None]


def _typed(meta: dict, schema: str) -> dict:
    row = {}
    for part in (p.strip() for p in schema.replace("map<string, array<string>>", "map").split(", ")):
        name, kind = part.split(" ", 1)
        value = meta.get(name)
        if kind == "map":
            row[name] = {k: _texts(v) for k, v in value.items() if v is not None} if isinstance(value, dict) else {}
        elif kind.startswith("array"):
            row[name] = _texts(value) if value is not None else None
        elif kind == "int":
            row[name] = int(value) if str(value).isdigit() else None
        elif kind != "boolean":
            row[name] = _text(value)
    return row


def parse_records(files: DataFrame, schema: str = RECORD) -> DataFrame:
    """Front matter to rows, file by file in Arrow batches, few of which are Python objects at a time; a file without any is kept and marked, never fatal."""
    made = T.StructType.fromDDL(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            rows = []
            for file, block, body, ok in zip(*(piece.column(name).to_pylist() for name in ("file", "block", "body", "ok")), strict=True):
                rows.append(_typed(front_matter(block) if ok else {}, schema) | {"file": file, "body": body, "corrupt": not ok})
            yield record_batch({name: [r.get(name) for r in rows] for name in made.names}, made)

    has = F.regexp_like("text", F.lit(FRONT))
    block, body = F.regexp_extract("text", FRONT, 1), F.regexp_extract("text", FRONT, 2)
    return files.select("file", block.alias("block"), F.when(has, body).otherwise(F.col("text")).alias("body"), (has & (F.trim(block) != "")).alias("ok")).mapInArrow(run, made)


def read_vault(spark: SparkSession, path: str) -> DataFrame:
    """Entity records of the ``.md`` files right under ``path`` (sub-folders are not entities), with body and corrupt."""
    return parse_records(text_files(spark, path, "*.md"))


def read_proposals(spark: SparkSession, path: str) -> DataFrame:
    return parse_records(text_files(spark, path, "proposal_*.md"), PROPOSAL)
