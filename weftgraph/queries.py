"""The registered queries over the driver's tables, each with the SQL that must give the same rows.

Arrays are joined to strings and counts cast to bigint, so that both sides compare cell by cell.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as fx
from .operators import approval, browse, curate, graph, ingest, lint
from .operators import pattern as pt
from .plans import mapping, questions
from .plans.mapping import ref, table, texts
from .plans.pack import PACKS, THEMATIC, class_closure, props_table
from .sources import readers, writers
from .sources.shared import cut, remove, shared_dir

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def register(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        key = name or f.__name__
        REGISTRY[key] = f
        if sql:
            ORACLE[key] = sql
        return f

    return add


def joined(c, sep: str = "|"):
    return F.array_join(c, sep)


# ---- ingest ------------------------------------------------------------------------------------------------------


def inbox(spark: SparkSession, d: str) -> DataFrame:
    suffix = F.when(F.col("doc_id") % 3 == 0, ".pdf").when(F.col("doc_id") % 3 == 1, ".md").otherwise(".txt")
    return table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), suffix.alias("suffix"), F.octet_length("text").cast("bigint").alias("size_bytes"), "text")


@register("""SELECT CAST(doc_id AS VARCHAR) AS doc_id, CASE doc_id % 3 WHEN 0 THEN '.pdf' WHEN 1 THEN '.md' ELSE '.txt' END AS suffix,
  CAST(strlen(text) AS BIGINT) AS size_bytes, doc_id % 3 <> 0 AS is_text, length(text) AS n_chars,
  CASE WHEN length(text) > 2000 THEN CAST(ceil(length(text) / 2000.0) AS INTEGER) END AS estimated_chunks FROM documents""")
def inbox_profile(spark: SparkSession, d: str) -> DataFrame:
    return readers.inbox_profile(inbox(spark, d), 2000)


@register("SELECT CAST(doc_id AS VARCHAR) AS doc_id, '.txt' AS suffix, sha256(text) AS text_sha FROM documents")
def read_documents(spark: SparkSession, d: str) -> DataFrame:
    """Texts written as files of up to 500 lines each, read as documents, whole, and taken apart again."""
    path = f"{shared_dir(spark)}/documents-{uuid.uuid4().hex}"
    lines = texts(spark, d).select(F.to_json(F.struct(F.col("doc_id").cast("string").alias("doc_id"), "text")).alias("value"))
    lines.write.option("maxRecordsPerFile", 500).text(path)
    rows = readers.read_documents(spark, path).select("suffix", F.explode(F.split("text", "\n")).alias("line")).where("line <> ''")
    parsed = rows.select("suffix", F.from_json("line", "doc_id string, text string").alias("x"))
    out = cut(parsed.select("x.doc_id", "suffix", F.sha2("x.text", 256).alias("text_sha")))
    remove(spark, path)
    return out


@register("""WITH s AS (SELECT c_custkey, c_name, CASE c_custkey % 4 WHEN 0 THEN 'Interview' WHEN 1 THEN ' INTERVIEW - ' WHEN 2 THEN 'my interview_' ELSE c_mktsegment || '_' END || c_custkey || ' ' AS stem FROM customer)
  SELECT c_custkey, replace(replace(lower(c_name), '-', '_'), ' ', '_') AS doc_id,
  CASE WHEN c_custkey % 4 = 1 THEN 'interview' || c_custkey ELSE replace(replace(trim(lower(stem)), '-', '_'), ' ', '_') END AS thematic FROM s""")
def derive_doc_id(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey") % 4
    lead = F.when(k == 0, F.lit("Interview")).when(k == 1, F.lit(" INTERVIEW - ")).when(k == 2, F.lit("my interview_")).otherwise(F.concat("c_mktsegment", F.lit("_")))
    stem = F.concat(lead, F.col("c_custkey").cast("string"), F.lit(" "))
    return table(spark, d, "customer").select("c_custkey", fx.derive_doc_id("c_name").alias("doc_id"), fx.derive_doc_id(stem, True).alias("thematic"))


# Where a pattern's matches begin: after all parts before it and the matches between them. A sentence's end is matched with the capital letter after it.
_KINDS = (
    ("speaker_turn", 5, r"(?m)^[ \t]*(?:[A-Z][A-Za-z0-9_.\-]{1,30}|P\d+)(?:[ \t]*\[[^\]]{1,40}\])?[ \t]*:[ \t]"), ("timestamp", 4, r"(?m)^[ \t]*[\[\(]\d{1,2}:\d{2}(?::\d{2})?[\]\)]"),
    ("heading", 3, r"(?m)^[ \t]*(?:#+|§)[\s\p{Z}]"), ("paragraph", 2, r"\n[ \t]*\n"), ("sentence", 1, r"[\.!?][\x22\x27)\]]?[\s\p{Z}]+[A-Z]"),
)
BOUNDARIES = ("m AS (" + " UNION ALL ".join(f"SELECT doc_id, text, '{k}' AS kind, {n} AS priority, string_split_regex(text, '{p}') AS between, regexp_extract_all(text, '{p}') AS found FROM documents" for k, n, p in _KINDS) + "),"
  """ y AS (SELECT doc_id, text, kind, priority, unnest(range(1, len(found) + 1)) AS i, between, found FROM m),
  z AS (SELECT doc_id, kind, priority, CAST(coalesce(list_sum(list_transform(between[1:i], lambda s: length(s))), 0) + coalesce(list_sum(list_transform(found[1:i - 1], lambda s: length(s))), 0) AS BIGINT) AS pos FROM y),
  bd AS (SELECT doc_id, pos, arg_max(kind, priority) AS kind, max(priority) AS priority FROM z GROUP BY doc_id, pos)""")


@register(f"WITH {BOUNDARIES} SELECT * FROM bd")
def find_boundaries(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.inline(ingest.find_boundaries("text")))


def chunk_sql(width: int) -> str:
    """(doc_id, k, b, e): the chunks' begins and ends, from one to the next: the last boundary within the width, else the width."""
    return f"""{BOUNDARIES}, bs AS MATERIALIZED (SELECT doc_id, list(pos ORDER BY pos) AS stops FROM bd GROUP BY doc_id),
  dd AS MATERIALIZED (SELECT doc_id, coalesce(text, '') AS text, list_concat(coalesce(stops, []), [length(coalesce(text, ''))]) AS stops FROM documents LEFT JOIN bs USING (doc_id)),
  ch AS (SELECT doc_id, CAST(0 AS BIGINT) AS b, CAST(CASE WHEN length(text) <= {width} THEN length(text) ELSE coalesce(list_max(list_filter(stops, lambda p: p > 0 AND p <= {width})), {width}) END AS BIGINT) AS e FROM dd
    UNION ALL SELECT ch.doc_id, e, CAST(coalesce(list_max(list_filter(stops, lambda p: p > e AND p <= e + {width})), e + {width}) AS BIGINT) FROM ch JOIN dd ON dd.doc_id = ch.doc_id WHERE e < length(text)),
  cs AS (SELECT doc_id, b, CASE WHEN length(text) <= {width} THEN text ELSE regexp_replace(substring(text, CAST(b + 1 AS BIGINT), CAST(e - b AS BIGINT)), '[\\s\\p{{Z}}\\x1c-\\x1f\\x85]+$', '') END AS body, length(text) <= {width} AS one FROM ch JOIN dd USING (doc_id)),
  cn AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY b) - 1 AS INTEGER) AS chunk_index, CAST(count(*) OVER (PARTITION BY doc_id) AS INTEGER) AS n_chunks, body FROM cs WHERE one OR body <> '')"""


@register(f"WITH RECURSIVE {chunk_sql(2000)} SELECT CAST(doc_id AS VARCHAR) AS doc_id, chunk_index, n_chunks, doc_id || CASE WHEN n_chunks > 1 THEN '_c' || chunk_index ELSE '' END AS chunk_doc_id, body AS text FROM cn")
def chunk_documents(spark: SparkSession, d: str) -> DataFrame:
    return ingest.chunk_documents(texts(spark, d), 2000).drop("section_hint")


_W = r"[ \t\n\v\f\r]"


@register(rf"""WITH h AS (SELECT doc_id, coalesce(text, '') AS text, left(coalesce(text, ''), 500) AS head FROM documents),
  x AS (SELECT *, regexp_extract(head, '(?m)^[ \t]*(?:[A-Z][A-Za-z0-9_.\-]{{1,30}}|P\d+)(?:[ \t]*\[[^\]]{{1,40}}\])?[ \t]*:[ \t]') AS speaker, regexp_extract(head, '(?m)^[ \t]*[\[\(]\d{{1,2}}:\d{{2}}(?::\d{{2}})?[\]\)]') AS clock,
    regexp_extract(head, '(?m)^[ \t]*(?:#+|§)\s') AS heading, string_split_regex(regexp_replace(text, '^{_W}+|{_W}+$', '', 'g'), '{_W}+') AS ws FROM h),
  y AS (SELECT *, array_to_string(ws[1:8], ' ') AS first, substr(text, CAST(instr(head, heading) AS BIGINT)) AS rest FROM x)
  SELECT doc_id, CASE WHEN speaker <> '' THEN trim(rtrim(trim(speaker, ' ' || chr(9)), ':'), ' ' || chr(9)) WHEN clock <> '' THEN trim(clock, ' ' || chr(9))
    WHEN heading <> '' THEN trim(CASE WHEN contains(rest, chr(10)) THEN string_split(rest, chr(10))[1] ELSE left(rest, 120) END, ' ' || chr(9) || chr(13))
    WHEN length(first) <= 80 THEN first ELSE left(first, 80) || '…' END AS section_hint FROM y""")
def section_hint(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", ingest.section_hint("text").alias("section_hint"))


@register("SELECT doc_id, CASE WHEN length(text) <= 0 THEN 0 WHEN length(text) <= 2000 THEN 1 ELSE CAST(ceil(length(text) / 2000.0) AS INTEGER) END AS n FROM documents")
def estimate_chunks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", fx.estimate_chunks(F.length("text"), 2000).alias("n"))


@register("""WITH RECURSIVE l AS (SELECT conv_id, turn, length(coalesce(role, '') || ': ' || coalesce(text, '')) AS n,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn, coalesce(role, '') || ': ' || coalesce(text, '')) AS k FROM conversations),
  w AS (SELECT conv_id, k, turn, CAST(0 AS BIGINT) AS win, CAST(n AS BIGINT) AS used FROM l WHERE k = 1
    UNION ALL SELECT l.conv_id, l.k, l.turn, CASE WHEN w.used + 1 + l.n <= 1500 THEN w.win ELSE w.win + 1 END, CASE WHEN w.used + 1 + l.n <= 1500 THEN w.used + 1 + l.n ELSE l.n END
    FROM w JOIN l ON l.conv_id = w.conv_id AND l.k = w.k + 1)
  SELECT conv_id, win AS "window", min(turn) AS first_turn, max(turn) AS last_turn, max(used) AS n_chars FROM w GROUP BY conv_id, win""")
def pack_turns(spark: SparkSession, d: str) -> DataFrame:
    return ingest.pack_turns(table(spark, d, "conversations"), 1500).drop("text")


@register("""SELECT conv_id, turn, count(*) OVER (PARTITION BY conv_id) AS n_chunks,
  CASE WHEN count(*) OVER (PARTITION BY conv_id) > 1 THEN conv_id || '_c' || turn ELSE CAST(conv_id AS VARCHAR) END AS chunk_doc_id FROM conversations""")
def chunk_doc_id(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("doc_id"), F.col("turn").alias("chunk_index"))
    return ingest.with_chunk_counts(rows).select(F.col("doc_id").cast("bigint").alias("conv_id"), F.col("chunk_index").alias("turn"), "n_chunks", "chunk_doc_id")


@register("""SELECT conv_id, turn, CASE WHEN n <= 1 THEN section ELSE 'chunk ' || (turn + 1) || '/' || n || CASE WHEN role <> 'system' THEN ' (' || role || ')' ELSE '' END
  || CASE WHEN trim(section) <> '' THEN ' / ' || trim(section) ELSE '' END END AS section
  FROM (SELECT conv_id, turn, role, count(*) OVER (PARTITION BY conv_id) AS n, CASE WHEN turn % 2 = 0 THEN 'part ' || turn ELSE ' ' END AS section FROM conversations)""")
def enrich_source_section(spark: SparkSession, d: str) -> DataFrame:
    rows = ingest.with_chunk_counts(table(spark, d, "conversations").withColumnsRenamed({"conv_id": "doc_id", "turn": "chunk_index"}).withColumn("conv_id", F.col("doc_id")).withColumn("doc_id", F.col("doc_id").cast("string")))
    section = F.when(F.col("chunk_index") % 2 == 0, F.concat(F.lit("part "), F.col("chunk_index").cast("string"))).otherwise(F.lit(" "))
    return rows.select("conv_id", F.col("chunk_index").alias("turn"), fx.enrich_source_section(section, "chunk_index", "n_chunks", F.when(F.col("role") != "system", F.col("role"))).alias("section"))


def request_sql(width: int) -> str:
    return f"""WITH RECURSIVE {chunk_sql(width)}, rq AS (SELECT 'd' || doc_id || CASE WHEN n_chunks > 1 THEN '_c' || chunk_index ELSE '' END AS id, body FROM cn)
  SELECT id AS chunk_doc_id, 'Extract typed entities from document ' || id || '.' AS system, sha256(chr(10) || 'Document: ' || id || chr(10) || 'Version: v1' || chr(10) || 'Text:' || chr(10) || body) AS user_sha FROM rq"""


@register(request_sql(3000))
def render_requests(spark: SparkSession, d: str) -> DataFrame:
    """One request per chunk of 3,000 characters, so that no window cuts a text."""
    docs = texts(spark, d).select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("doc_id"), "text")
    return ingest.render_requests(ingest.chunk_documents(docs, 3000), THEMATIC).select("chunk_doc_id", "system", F.sha2("user", 256).alias("user_sha"))


@register(request_sql(12_000))
def render_chunk_requests(spark: SparkSession, d: str) -> DataFrame:
    """One request per chunk of each document, so that every part of a text is in a request."""
    docs = texts(spark, d).select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("doc_id"), "text")
    chunks = ingest.chunk_documents(docs, THEMATIC.window_chars)
    return ingest.render_requests(chunks, THEMATIC).select("chunk_doc_id", "system", F.sha2("user", 256).alias("user_sha"))


def responses(spark: SparkSession, d: str) -> DataFrame:
    """Model responses made from documents: most with an entity, some empty, some cut off, some not JSON."""
    i = F.col("doc_id")
    one = F.struct(F.lit("Excerpt").alias("class"), ref("doc", "doc_id").alias("id"), F.concat(F.lit("Document "), i.cast("string")).alias("label"), F.lit("").alias("source_section"), F.substring("text", 1, 40).alias("source_text"), F.create_map(F.lit("spokenBy"), F.col("source")).alias("properties"))
    body = F.to_json(F.struct(F.array(one).alias("entities")))
    text = F.when(i % 11 == 0, F.lit('{"entities": []}')).when(i % 13 == 0, F.substring(body, 1, 25)).otherwise(body)
    return table(spark, d, "documents").select(ref("doc", "doc_id").alias("chunk_doc_id"), text.alias("response"), F.when(i % 22 == 0, "length").otherwise("stop").alias("finish_reason"))


@register("""SELECT 'doc_' || doc_id AS chunk_doc_id, 'Excerpt' AS class, 'doc_' || doc_id AS id, 'Document ' || doc_id AS label, left(text, 40) AS source_text, source AS speaker
  FROM documents WHERE doc_id % 11 <> 0 AND doc_id % 13 <> 0""")
def parse_responses(spark: SparkSession, d: str) -> DataFrame:
    rows, _ = ingest.parse_responses(responses(spark, d), THEMATIC)
    return rows.select("chunk_doc_id", "class", "id", "label", "source_text", F.col("properties")["spokenBy"].alias("speaker"))


@register("SELECT 'doc_' || doc_id AS chunk_doc_id, CASE WHEN doc_id % 22 = 0 THEN 'truncated' ELSE 'empty' END AS problem FROM documents WHERE doc_id % 11 = 0 OR doc_id % 13 = 0")
def response_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    return ingest.parse_responses(responses(spark, d), THEMATIC)[1]


@register("SELECT role AS speaker, count(*) AS n FROM conversations WHERE regexp_matches(text, '^[^\\n]*[^\\s]') GROUP BY role")
def extract_entities(spark: SparkSession, d: str) -> DataFrame:
    turns = table(spark, d, "conversations").where(F.length(F.trim(F.substring_index("text", "\n", 1))) > 0)
    one = turns.select(F.concat_ws("_", F.lit("c"), F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("doc_id"), F.concat(F.col("role"), F.lit(": "), F.regexp_replace("text", "[:\n]", " ")).alias("text"))
    chunks = ingest.chunk_documents(one, 1_000_000)
    found = ingest.extract_entities(chunks, ingest.rule_extractor)
    return found.groupBy(F.get("properties.spokenBy", F.lit(0)).alias("speaker")).agg(F.count(F.lit(1)).alias("n"))


@register("""SELECT p_partkey, CASE WHEN p_partkey % 3 <> 2 THEN p_name END AS term FROM part""")
def definition_term(spark: SparkSession, d: str) -> DataFrame:
    k, name = F.col("p_partkey"), F.col("p_name")
    text = F.when(k % 3 == 0, F.concat(F.lit(" '"), name, F.lit("' means a part"))).when(k % 3 == 1, F.concat(F.lit("“"), name, F.lit("” , a part"))).otherwise(F.concat(name, F.lit(" means a part")))
    return table(spark, d, "part").select("p_partkey", fx.definition_term(text).alias("term"))


_BARE = "regexp_replace(trim(text), '[‘’“”`''\"]+', '', 'g')"


@register(f"""WITH v AS (SELECT doc_id, list_filter([trim(left({_BARE}, 80)), trim(left({_BARE}, 50)), trim(left({_BARE}, 30))], lambda x: length(x) >= 15) AS l FROM documents)
  SELECT doc_id, array_to_string(CASE WHEN len(l) > 1 AND l[1] = l[2] THEN CASE WHEN len(l) > 2 AND l[2] = l[3] THEN [l[1]] ELSE list_concat([l[1]], l[3:]) END WHEN len(l) > 2 AND l[2] = l[3] THEN [l[1], l[2]] ELSE l END, '|') AS variants FROM v""")
def search_variants(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", joined(fx.search_variants("text")).alias("variants"))


@register("SELECT p_partkey, '''' || p_name || '''|\"' || p_name || '\"|‘' || p_name || '’|“' || p_name || '”|' || p_name || '|' || trim(left(p_name || ' means a part that is used widely', 50)) || '|' || trim(left(p_name || ' means a part that is used widely', 30)) AS variants FROM part")
def search_variants_compliance(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.lit("'"), F.col("p_name"), F.lit("' means a part that is used widely"))
    return table(spark, d, "part").select("p_partkey", joined(fx.search_variants(text, "compliance")).alias("variants"))


@register("SELECT conv_id, turn, CASE turn % 3 WHEN 2 THEN 'Narrator: ' || trim_text ELSE trim_text END AS body FROM (SELECT conv_id, turn, ltrim(text, ' ' || chr(10) || chr(9) || chr(13)) AS trim_text FROM conversations)")
def strip_speaker_prefix(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("turn") % 3
    body = F.regexp_replace("text", r"^[ \n\t\r]+", "")
    lead = F.when(t == 0, F.concat(F.lit("P0"), F.col("turn").cast("string"), F.lit(" [00:14:22]: "))).when(t == 1, F.lit(" interviewer : ")).otherwise(F.lit("Narrator: "))
    return table(spark, d, "conversations").select("conv_id", "turn", fx.strip_speaker_prefix(F.concat(lead, body)).alias("body"))


NORM = "trim(regexp_replace(regexp_replace(lower({}), '[‘’“”`''\"]+', '', 'g'), '[\\s\\-–—.,;:()]+', ' ', 'g'))"


@register(f"SELECT doc_id, sha256({NORM.format('text')}) AS norm_sha FROM documents")
def normalize_for_match(spark: SparkSession, d: str) -> DataFrame:
    return texts(spark, d).select("doc_id", F.sha2(fx.normalize_for_match("text"), 256).alias("norm_sha"))


def page_table(spark: SparkSession, d: str, size: int = 1000) -> DataFrame:
    """Documents as pages of ``size`` characters."""
    n = F.greatest(F.lit(1), F.ceil(F.length("text") / size)).cast("int")
    docs = texts(spark, d).select(F.col("doc_id").cast("string").alias("doc"), F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(i.alias("page_no"), F.substring("text", (i - 1) * size + 1, F.lit(size)).alias("page_text"))).alias("ps"))
    return docs.select("doc", F.inline("ps"))


PAGE_SQL = "p AS (SELECT CAST(doc_id AS VARCHAR) AS doc, i AS page_no, substring(text, (i - 1) * 1000 + 1, 1000) AS page_text FROM (SELECT doc_id, text, unnest(range(1, greatest(1, CAST(ceil(length(text) / 1000.0) AS BIGINT)) + 1)) AS i FROM documents))"


@register(f"WITH {PAGE_SQL} SELECT doc, CAST(page_no AS INTEGER) AS page_no, length(page_text) AS n_chars FROM p")
def page_map(spark: SparkSession, d: str) -> DataFrame:
    return page_table(spark, d).select("doc", "page_no", F.length("page_text").cast("bigint").alias("n_chars"))


@register(f"""WITH {PAGE_SQL}, q AS (SELECT doc, page_no, {NORM.format('page_text')} AS t FROM p),
  s AS (SELECT CAST(doc_id AS VARCHAR) AS doc, {NORM.format('substring(text, 961, 70)')} AS n FROM documents),
  a AS (SELECT s.doc, min(page_no) AS page_no FROM s JOIN q ON q.doc = s.doc AND contains(q.t, s.n) WHERE s.n <> '' GROUP BY s.doc),
  b AS (SELECT s.doc, min(page_no) AS page_no FROM s JOIN q ON q.doc = s.doc AND contains(q.t, left(s.n, 30)) WHERE length(s.n) >= 40 AND s.doc NOT IN (SELECT doc FROM a) GROUP BY s.doc)
  SELECT s.doc AS needle_id, CAST(coalesce(a.page_no, b.page_no) AS INTEGER) AS page_no FROM s LEFT JOIN a USING (doc) LEFT JOIN b USING (doc)""")
def locate_page(spark: SparkSession, d: str) -> DataFrame:
    needles = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("needle_id"), F.col("doc_id").cast("string").alias("doc"), F.expr("substring(text, 961, 70)").alias("snippet"))
    return ingest.locate_page(needles, page_table(spark, d))


#: The first word, the first two, and the second's first letters of each benchmark item.
_SHORT = f"""nb AS (SELECT string_split({NORM.format('text')}, ' ') AS w FROM benchmark),
  nd AS (SELECT DISTINCT unnest([w[1], w[1] || ' ' || w[2], left(w[2], 2), left(w[2], 1)]) AS needle FROM nb WHERE len(w) >= 2)"""


@register(f"WITH {_SHORT}, t AS (SELECT {NORM.format('text')} AS t FROM documents) SELECT needle, count(*) AS n_texts FROM nd JOIN t ON contains(t.t, needle) WHERE needle <> '' GROUP BY needle")
def locate_short(spark: SparkSession, d: str) -> DataFrame:
    """In how many documents passages of one and two words, and of one and two letters, occur."""
    w = F.split(fx.normalize_for_match("text"), " ", -1)
    two = F.get(w, F.lit(1))
    heads = F.array(F.get(w, F.lit(0)), F.concat_ws(" ", F.get(w, F.lit(0)), two), F.substring(two, 1, 2), F.substring(two, 1, 1))
    needles = table(spark, d, "benchmark").where(F.size(w) >= 2).select(F.explode(heads).alias("norm")).distinct()
    docs = texts(spark, d).select(F.col("doc_id").cast("string").alias("doc"), F.lit(1).alias("place"), "text")
    found = ingest.anchored(needles.select(F.col("norm").alias("needle_id"), F.lit(None).cast("string").alias("doc"), "norm"), docs)
    return found.groupBy(F.col("needle_id").alias("needle")).agg(F.count(F.lit(1)).alias("n_texts"))


def evidence(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(ref("doc", "doc_id").alias("id"), F.col("doc_id").cast("string").alias("source_document"), F.lit(1).alias("source_page"), F.expr("substring(text, 941, 90)").alias("source_text"))
    return ingest.locate_evidence(docs, page_table(spark, d))


_EV = "regexp_replace(trim(substring(text, 941, 90)), '[‘’“”`''\"]+', '', 'g')"
_EV_SQL = f"""WITH t AS (SELECT doc_id, left(text, 1000) AS page, trim(left({_EV}, 80)) AS v1, trim(left({_EV}, 50)) AS v2, trim(left({_EV}, 30)) AS v3 FROM documents WHERE substring(text, 941, 90) <> ''),
  h AS (SELECT doc_id, page, CASE WHEN length(v1) >= 15 AND contains(page, v1) THEN v1 WHEN length(v2) >= 15 AND contains(page, v2) THEN v2 WHEN length(v3) >= 15 AND contains(page, v3) THEN v3 END AS variant FROM t)"""


@register(_EV_SQL + " SELECT 'doc_' || doc_id AS id, variant, CAST(instr(page, variant) - 1 AS INTEGER) AS \"offset\" FROM h")
def locate_evidence(spark: SparkSession, d: str) -> DataFrame:
    return evidence(spark, d)


@register(_EV_SQL + " SELECT count(variant) AS matched, count(*) - count(variant) AS unmatched FROM h")
def evidence_counts(spark: SparkSession, d: str) -> DataFrame:
    return ingest.evidence_counts(evidence(spark, d))


@register("SELECT o_orderkey, 'filedBy=[[iss_' || o_custkey || ']];filingDate=' || o_orderstatus || CASE WHEN o_orderkey % 2 = 0 THEN ';filedWith=[[a]]|[[b]]' ELSE '' END AS props FROM orders")
def wrap_links(spark: SparkSession, d: str) -> DataFrame:
    no = F.array().cast("array<string>")
    props = F.create_map(
        F.lit("filedBy"), F.array(F.lit(""), ref("iss", "o_custkey")), F.lit("filingDate"), F.array(F.col("o_orderstatus")), F.lit("filedWith"), F.when(F.col("o_orderkey") % 2 == 0, F.array(F.lit("[[a]]"), F.lit(None), F.lit("b"))).otherwise(no)
    )
    shown = F.array_join(F.transform(F.map_entries(fx.wrap_links(props, ["filingDate"])), lambda e: F.concat(e["key"], F.lit("="), joined(e["value"]))), ";")
    return table(spark, d, "orders").select("o_orderkey", shown.alias("props"))


@register("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'iss_' || o_custkey ELSE '[[' || o_custkey END AS target FROM orders")
def strip_links(spark: SparkSession, d: str) -> DataFrame:
    raw = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit(" [[iss_"), F.col("o_custkey").cast("string"), F.lit("]]"))).otherwise(F.concat(F.lit("[["), F.col("o_custkey").cast("string")))
    return table(spark, d, "orders").select("o_orderkey", fx.strip_link(raw).alias("target"))


_SAFE = "regexp_replace(lower('-' || p_type || ' ' || p_name || ' ' || p_type || ' of ' || p_brand), '[^a-z0-9_]', '_', 'g')"


@register(f"SELECT p_partkey, {_SAFE} AS safe, trim(left({_SAFE}, 40), '_') AS slug, left(trim({_SAFE}, '_'), 50) AS subtheme FROM part")
def sanitize_and_slug(spark: SparkSession, d: str) -> DataFrame:
    raw = F.concat(F.lit("-"), F.col("p_type"), F.lit(" "), F.col("p_name"), F.lit(" "), F.col("p_type"), F.lit(" of "), F.col("p_brand"))
    return table(spark, d, "part").select("p_partkey", fx.sanitize_id(raw).alias("safe"), fx.slugify(raw).alias("slug"), fx.subtheme_slug(raw).alias("subtheme"))


# ---- the graph ---------------------------------------------------------------------------------------------------

REG_EDGES = """e AS (SELECT 'fil_' || o_orderkey AS src, 'filedBy' AS prop, 'iss_' || o_custkey AS dst FROM orders
  UNION SELECT 'fil_' || o_orderkey, 'filedWith', 'nat_' || c_nationkey FROM orders JOIN customer ON o_custkey = c_custkey
  UNION SELECT 'fil_' || l_orderkey, 'containsDisclosure', 'dis_' || l_orderkey || '_' || l_linenumber FROM lineitem
  UNION SELECT 'dis_' || l_orderkey || '_' || l_linenumber, 'triggersObligation', 'obl_' || l_partkey FROM lineitem)"""
REG_ENTITIES = """n AS (SELECT 'iss_' || c_custkey AS id, 'Issuer' AS class, c_name AS label FROM customer UNION ALL SELECT 'fil_' || o_orderkey, 'Filing', 'Order_' || o_orderkey FROM orders
  UNION ALL SELECT 'nat_' || n_nationkey, 'Regulator', n_name FROM nation UNION ALL SELECT 'obl_' || p_partkey, 'Obligation', p_name FROM part
  UNION ALL SELECT DISTINCT 'dis_' || l_orderkey || '_' || l_linenumber, 'Disclosure', 'Line ' || l_linenumber || ' of ' || l_orderkey FROM lineitem)"""
REG_LITERALS = "l AS (SELECT 'fil_' || o_orderkey AS id, 'filingDate' AS prop, strftime(o_orderdate, '%Y-%m-%d') AS value FROM orders UNION ALL SELECT 'iss_' || c_custkey, 'tickerSymbol', c_mktsegment FROM customer)"
REG_TRIPLES = f"""{REG_EDGES}, {REG_ENTITIES}, {REG_LITERALS}, t AS (SELECT 'rege:' || id AS s, 'rdf:type' AS p, 'reg:' || class AS o, 'iri' AS o_kind, NULL AS o_lang FROM n UNION ALL SELECT 'rege:' || id, 'rdfs:label', label, 'lit', 'en' FROM n
  UNION ALL SELECT 'rege:' || src, 'reg:' || prop, 'rege:' || dst, 'iri', NULL FROM e UNION ALL SELECT 'rege:' || id, 'reg:' || prop, value, 'lit', NULL FROM l)"""


def reg(spark: SparkSession, d: str) -> DataFrame:
    return mapping.regulatory(spark, d).triples()


@register(f"WITH {REG_EDGES} SELECT * FROM e")
def graph_edges_table(spark: SparkSession, d: str) -> DataFrame:
    return mapping.regulatory(spark, d).edges


@register(f"WITH {REG_LITERALS} SELECT * FROM l")
def graph_literals_table(spark: SparkSession, d: str) -> DataFrame:
    return mapping.regulatory(spark, d).literals


@register(f"WITH {REG_TRIPLES} SELECT * FROM t")
def graph_triples(spark: SparkSession, d: str) -> DataFrame:
    return reg(spark, d)


@register(f"WITH {REG_TRIPLES} SELECT s, p, o, o_kind, o_lang FROM t UNION SELECT 'reg:' || x, 'rdf:type', 'owl:Class', 'iri', NULL FROM (VALUES ('Filing'), ('Issuer'), ('Disclosure'), ('Regulator'), ('Obligation')) v(x)")
def load_graph(spark: SparkSession, d: str) -> DataFrame:
    schema = graph.schema_triples(spark, PACKS["regulatory"]).where("o = 'owl:Class'")
    # Triples that a row of each table gives; counts are in the files' footers.
    rows = sum(n * table(spark, d, name).count() for name, n in (("lineitem", 4), ("orders", 5), ("customer", 3), ("part", 2)))
    return graph.load_graph(schema, reg(spark, d), None, rows=rows)


@register("""WITH t(name, parent) AS (SELECT r_name, NULL FROM region UNION ALL SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT s_name, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey)
  SELECT name AS child, name AS ancestor FROM t UNION SELECT name, parent FROM t WHERE parent IS NOT NULL UNION SELECT a.name, b.parent FROM t a JOIN t b ON a.parent = b.name WHERE b.parent IS NOT NULL""")
def class_closure_query(spark: SparkSession, d: str) -> DataFrame:
    region, nation, supplier = table(spark, d, "region"), table(spark, d, "nation"), table(spark, d, "supplier")
    rows = region.selectExpr("r_name as name", "cast(null as string) as parent").unionByName(nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).selectExpr("n_name as name", "r_name as parent"))
    return class_closure(rows.unionByName(supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).selectExpr("s_name as name", "n_name as parent")))


@register("SELECT 'https://ontology.example.org/regulatory/entity/iss_' || c_custkey AS uri, 'iss_' || c_custkey AS local FROM customer")
def entity_uri(spark: SparkSession, d: str) -> DataFrame:
    uri = graph.entity_uri(PACKS["regulatory"], ref("iss", "c_custkey"))
    return table(spark, d, "customer").select(uri.alias("uri"), pt.local_name(uri).alias("local"))


@register(f"WITH {REG_EDGES} SELECT CASE prop WHEN 'filedBy' THEN 'Filing' WHEN 'filedWith' THEN 'Filing' WHEN 'containsDisclosure' THEN 'Filing' ELSE 'Disclosure' END AS domain, 'reg:' || prop AS predicate, count(*) AS n FROM e GROUP BY 1, 2")
def predicate_map(spark: SparkSession, d: str) -> DataFrame:
    g = mapping.regulatory(spark, d)
    dims = props_table(spark, g.pack).select(F.col("name").alias("prop"), "domain")
    counts = g.edges.groupBy("prop").agg(F.count(F.lit(1)).alias("n"))
    # The pack's properties: a row for each.
    return counts.join(F.broadcast(dims), "prop").select("domain", graph.predicate(g.pack, "prop").alias("predicate"), "n")


# ---- patterns ----------------------------------------------------------------------------------------------------


@register(f"WITH {REG_TRIPLES} SELECT s AS filing, o AS issuer FROM t WHERE p = 'reg:filedBy'")
def triple_pattern(spark: SparkSession, d: str) -> DataFrame:
    return pt.triple_pattern(reg(spark, d), "?filing", "reg:filedBy", "?issuer")


@register("SELECT 'rege:iss_' || c_custkey AS issuer FROM customer WHERE c_mktsegment = 'BUILDING'")
def constant_literal(spark: SparkSession, d: str) -> DataFrame:
    return pt.triple_pattern(reg(spark, d), "?issuer", "reg:tickerSymbol", pt.Lit("BUILDING"))


@register("SELECT 'rege:fil_' || o_orderkey AS filing, 'rege:iss_' || o_custkey AS issuer, 'rege:nat_' || c_nationkey AS regulator FROM orders JOIN customer ON o_custkey = c_custkey")
def bgp_join(spark: SparkSession, d: str) -> DataFrame:
    t = reg(spark, d)
    return pt.bgp(pt.triple_pattern(t, "?filing", "reg:filedBy", "?issuer"), pt.triple_pattern(t, "?filing", "reg:filedWith", "?regulator"))


@register("SELECT 'rege:fil_' || o_orderkey AS filing FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'")
def filter_in(spark: SparkSession, d: str) -> DataFrame:
    t = reg(spark, d)
    ids = pt.triple_pattern(t, "?issuer", "reg:tickerSymbol", pt.Lit("BUILDING"))
    return pt.filter_in(pt.triple_pattern(t, "?filing", "reg:filedBy", "?issuer"), "issuer", ids).select("filing")


@register("SELECT 'rege:nat_' || n_nationkey AS regulator, count(DISTINCT o_custkey) AS issuers FROM nation LEFT JOIN (customer JOIN orders ON o_custkey = c_custkey) ON n_nationkey = c_nationkey GROUP BY n_nationkey")
def count_distinct_group(spark: SparkSession, d: str) -> DataFrame:
    t = reg(spark, d)
    group = pt.bgp(pt.triple_pattern(t, "?filing", "reg:filedWith", "?regulator"), pt.triple_pattern(t, "?filing", "reg:filedBy", "?issuer"))
    return pt.group_count(pt.optional(pt.triple_pattern(t, "?regulator", "rdf:type", "reg:Regulator"), group), ["regulator"], "issuer", "issuers", distinct=True)


@register("SELECT 'rege:iss_' || c_custkey AS issuer, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey ORDER BY n DESC, issuer LIMIT 10")
def top_k_issuers(spark: SparkSession, d: str) -> DataFrame:
    t = reg(spark, d)
    counts = pt.group_count(pt.triple_pattern(t, "?filing", "reg:filedBy", "?issuer"), ["issuer"], "filing", "n")
    rows = pt.triple_pattern(t, "?issuer", "rdf:type", "reg:Issuer").join(counts, "issuer", "left").select("issuer", F.coalesce("n", F.lit(0)).alias("n"))
    return pt.top_k(rows, 10, "-n", "issuer")


@register("SELECT count(*) > 0 AS answer FROM customer WHERE c_mktsegment = 'BUILDING'")
def ask(spark: SparkSession, d: str) -> DataFrame:
    return pt.ask(pt.triple_pattern(reg(spark, d), "?issuer", "reg:tickerSymbol", pt.Lit("BUILDING")))


@register("SELECT DISTINCT 'rege:iss_' || o_custkey AS s, 'reg:regulatedBy' AS p, 'rege:nat_' || c_nationkey AS o, 'iri' AS o_kind FROM orders JOIN customer ON o_custkey = c_custkey")
def construct(spark: SparkSession, d: str) -> DataFrame:
    return pt.construct(bgp_join(spark, d), (F.col("issuer"), F.lit("reg:regulatedBy"), F.col("regulator"), "iri"))


@register(f"WITH {REG_ENTITIES} SELECT id, class, label FROM n")
def entity_catalog(spark: SparkSession, d: str) -> DataFrame:
    return pt.entity_catalog(reg(spark, d), "rege:")


@register("SELECT 'rege:nat_' || n_nationkey AS regulator, CAST(count(o_orderkey) AS VARCHAR) AS n FROM nation LEFT JOIN (customer JOIN orders ON o_custkey = c_custkey) ON n_nationkey = c_nationkey GROUP BY n_nationkey")
def rows_as_strings(spark: SparkSession, d: str) -> DataFrame:
    t = reg(spark, d)
    rows = pt.optional(pt.triple_pattern(t, "?regulator", "rdf:type", "reg:Regulator"), pt.triple_pattern(t, "?filing", "reg:filedWith", "?regulator"))
    return pt.rows_as_strings(pt.group_count(rows, ["regulator"], "filing", "n"))


@register("SELECT 'rege:iss_' || c_custkey AS issuer, coalesce(min(strftime(o_orderdate, '%Y-%m-%d')), c_mktsegment) AS shown FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey, c_mktsegment")
def bind_if_bound(spark: SparkSession, d: str) -> DataFrame:
    t = reg(spark, d)
    dated = pt.bgp(pt.triple_pattern(t, "?filing", "reg:filedBy", "?issuer"), pt.triple_pattern(t, "?filing", "reg:filingDate", "?date"))
    first = dated.groupBy("issuer").agg(F.min("date").alias("date"))
    return pt.optional(pt.triple_pattern(t, "?issuer", "reg:tickerSymbol", "?ticker"), first).select("issuer", pt.if_bound("date", "ticker").alias("shown"))


@register("SELECT 'rege:iss_' || c_custkey AS issuer FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 3 = 0)")
def minus_not_exists(spark: SparkSession, d: str) -> DataFrame:
    t = reg(spark, d)
    filed = pt.triple_pattern(t, "?filing", "reg:filedBy", "?issuer").where(F.regexp_extract("filing", r"(\d+)$", 1).cast("bigint") % 3 == 0)
    return pt.minus(pt.triple_pattern(t, "?issuer", "rdf:type", "reg:Issuer"), filed.select("issuer"))


@register("SELECT 'sup_' || s_suppkey AS src, 'nat_' || s_nationkey AS dst FROM supplier UNION SELECT 'nat_' || n_nationkey, 'reg_' || n_regionkey FROM nation UNION SELECT 'sup_' || s_suppkey, 'reg_' || n_regionkey FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def path_plus(spark: SparkSession, d: str) -> DataFrame:
    return pt.path_plus(mapping.compliance(spark, d).edges.where("prop in ('imposesObligationOn', 'enforcedBy')"))


# ---- competency questions ----------------------------------------------------------------------------------------


def _cq(pack: str, cq: str, *constants: str) -> Query:
    return lambda spark, d: questions.resolve(pack, cq)(getattr(mapping, pack)(spark, d).triples(classes=True), *constants)


CQS: dict[str, tuple[Query, str]] = {
    "cq_compliance_1": (_cq("compliance", "cq1", "ccoe:nat_7"), "SELECT 'ccoe:sup_' || s_suppkey AS obligation, s_name AS \"obligationLabel\", CASE WHEN s_suppkey % 2 = 0 THEN 'ccoe:nat_' || s_nationkey END AS statute, CASE WHEN s_suppkey % 2 = 0 THEN n_name END AS \"statuteLabel\" FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_nationkey = 7"),
    "cq_compliance_2": (_cq("compliance", "cq2"), "SELECT 'ccoe:reg_' || r_regionkey AS regulator, r_name AS \"regulatorLabel\", 'ccoe:nat_' || n_nationkey AS statute, n_name AS \"statuteLabel\" FROM nation JOIN region ON n_regionkey = r_regionkey"),
    "cq_compliance_3": (_cq("compliance", "cq3", "ccoe:brand_Brand#12"), "SELECT 'ccoe:part_' || p_partkey AS definition, 'Part ' || p_partkey AS label, CASE WHEN p_size % 2 = 0 THEN p_type END AS section, p_name AS \"definitionText\" FROM part WHERE p_brand = 'Brand#12'"),
    "cq_thematic_1": (_cq("thematic", "cq1"), "SELECT 'thae:code_' || s AS code, 'Code ' || s AS label, count(x) AS \"nExcerpts\" FROM (SELECT source AS s, doc_id AS x FROM documents UNION ALL SELECT 'unused', NULL UNION ALL SELECT 'even', conv_id FROM conversations WHERE conv_id % 2 = 0) WHERE s IS NOT NULL GROUP BY s"),
    "cq_thematic_2": (_cq("thematic", "cq2"), "SELECT 'thae:theme_' || lang AS theme, 'Theme ' || lang AS \"themeLabel\", 'thae:doc_' || d.doc_id AS excerpt, 'Document ' || d.doc_id AS \"excerptLabel\", 'Q_' || quality AS speaker FROM documents d LEFT JOIN (SELECT DISTINCT doc_id, quality FROM labels) l ON d.doc_id = l.doc_id WHERE lang IS NOT NULL"),
    "cq_thematic_3": (_cq("thematic", "cq3", "user"), "SELECT 'thae:turn_' || conv_id || '_' || turn AS excerpt, 'Turn ' || conv_id || '.' || turn AS \"excerptLabel\", 'turn ' || turn AS section, CASE WHEN text <> '' THEN text END AS text, CASE WHEN conv_id % 2 = 0 THEN 'thae:code_even' END AS code, CASE WHEN conv_id % 2 = 0 THEN 'Code even' END AS \"codeLabel\" FROM conversations WHERE role = 'user'"),
    "cq_literature_1": (_cq("literature", "cq1"), "SELECT 'lite:lang_' || lang AS entity, lang AS \"entityLabel\", 'lite:doc_' || d.doc_id AS paper, 'Document ' || d.doc_id AS \"paperLabel\", CAST(quality AS VARCHAR) AS year FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE lang IS NOT NULL"),
    "cq_literature_2": (_cq("literature", "cq2"), "SELECT 'lite:method_' || quality AS methodology, 'Quality ' || quality AS \"methodLabel\", 'lite:claim_' || doc_id AS claim, 'Claim on ' || doc_id AS \"claimLabel\" FROM labels WHERE quality IS NOT NULL"),
    "cq_literature_3": (_cq("literature", "cq3"), f"WITH d AS (SELECT doc_id, {NORM.format('text')} AS t FROM documents), b AS (SELECT item_id, {NORM.format('text')} AS n FROM benchmark) SELECT 'lite:doc_' || doc_id AS \"claimOrPaper\", 'Paper' AS \"typeLabel\", 'lite:item_' || item_id AS \"citedPaper\", 'Item ' || item_id AS \"citedPaperLabel\" FROM d JOIN b ON contains(t, n)"),
    "cq_regulatory_1": (_cq("regulatory", "cq1"), "SELECT 'rege:iss_' || c_custkey AS issuer, c_mktsegment AS ticker, 'rege:fil_' || o_orderkey AS filing, 'Order_' || o_orderkey AS \"filingLabel\", strftime(o_orderdate, '%Y-%m-%d') AS date FROM orders JOIN customer ON o_custkey = c_custkey"),
    "cq_regulatory_2": (_cq("regulatory", "cq2"), "SELECT 'rege:obl_' || l_partkey AS obligation, p_name AS \"obligationLabel\", 'rege:dis_' || l_orderkey || '_' || l_linenumber AS disclosure, 'Line ' || l_linenumber || ' of ' || l_orderkey AS \"disclosureLabel\", 'rege:fil_' || o_orderkey AS filing, 'Order_' || o_orderkey AS \"filingLabel\" FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey FROM lineitem) JOIN part ON l_partkey = p_partkey LEFT JOIN orders ON l_orderkey = o_orderkey"),
    "cq_regulatory_3": (_cq("regulatory", "cq3"), "SELECT DISTINCT 'rege:nat_' || n_nationkey AS regulator, n_name AS \"regulatorLabel\", 'rege:obl_' || p_partkey AS obligation, p_name AS \"obligationLabel\" FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN part ON l_partkey = p_partkey"),
}
for _name, (_query, _sql) in CQS.items():
    register(_sql, _name)(_query)

# ---- records and lint --------------------------------------------------------------------------------------------

VAULT = """d AS (SELECT documents.*, quality FROM documents LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) l USING (doc_id)),
  x0 AS (SELECT doc_id AS i, CASE WHEN doc_id % 61 = 9 THEN 'Quote' ELSE 'Excerpt' END AS class, CASE WHEN doc_id % 83 = 1 THEN '' WHEN doc_id % 89 = 2 THEN 'Doc_' || doc_id ELSE 'doc_' || doc_id END AS id,
    CASE WHEN doc_id % 67 = 10 THEN '' ELSE 'Document ' || doc_id END AS label, coalesce(source, '') AS source_document, CASE WHEN doc_id % 59 = 11 THEN '' ELSE 'chars ' || n_chars END AS source_section, quality, lang, source,
    CASE WHEN doc_id % 73 = 12 THEN 'file_' || doc_id || '.md' ELSE 'doc_' || doc_id || '.md' END AS file, doc_id % 103 = 13 AS corrupt FROM d),
  x1 AS (SELECT * FROM x0 UNION ALL SELECT * REPLACE ('z_' || file AS file) FROM x0 WHERE i % 107 = 14),
  x AS (SELECT *, CASE WHEN i % 79 = 8 THEN 'https://ontology.example.org/elsewhere' ELSE 'https://ontology.example.org/thematic/entity/' || id END AS uri FROM x1),
  o AS (SELECT 'Theme' AS class, 'theme_' || lang AS id, 'Theme ' || lang AS label FROM (SELECT DISTINCT lang FROM documents WHERE lang IS NOT NULL)
    UNION ALL SELECT 'Code', 'code_' || s, 'Code ' || s FROM (SELECT DISTINCT source AS s FROM documents WHERE source IS NOT NULL UNION ALL SELECT 'unused')
    UNION ALL SELECT 'Subtheme', 'sub_' || q, 'Subtheme ' || q FROM (SELECT DISTINCT quality AS q FROM (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) WHERE quality IS NOT NULL)),
  r AS (SELECT i, class, id, label, uri, source_document, source_section, file, corrupt FROM x
    UNION ALL SELECT NULL, class, id, label, 'https://ontology.example.org/thematic/entity/' || id, 'tables', '', id || '.md', false FROM o),
  props AS (SELECT file, 'codedAs' AS prop, CASE WHEN i % 53 = 4 THEN 'code_nowhere' ELSE 'code_' || source END AS value FROM x
    UNION ALL SELECT file, 'supportsTheme', CASE WHEN i % 71 = 5 THEN 'doc_' || i ELSE 'theme_' || lang END FROM x
    UNION ALL SELECT file, 'spokenBy', 'Q_' || quality FROM x WHERE quality IS NOT NULL
    UNION ALL SELECT file, 'mood', 'calm' FROM x WHERE i % 97 = 6
    UNION ALL SELECT file, 'hasSubtheme', 'sub_0' FROM x WHERE i % 101 = 7
    UNION ALL SELECT 'theme_en.md', 'hasSubtheme', 'sub_1' FROM o WHERE id = 'theme_en'),
  u AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY file) AS n, first_value(file) OVER (PARTITION BY id ORDER BY file) AS first FROM r WHERE NOT corrupt AND id <> ''),
  g AS (SELECT * FROM u WHERE n = 1),
  gp AS (SELECT g.id, g.class, g.file, prop, value FROM g JOIN props USING (file) WHERE value IS NOT NULL)"""
LINT = f"""WITH {VAULT}, f AS (
  SELECT 'error' AS severity, 'no_frontmatter' AS rule, '' AS entity_id, file FROM r WHERE corrupt
  UNION ALL SELECT 'error', 'missing_id', '', file FROM r WHERE NOT corrupt AND id = ''
  UNION ALL SELECT 'error', 'duplicate_id', id, file FROM u WHERE n > 1
  UNION ALL SELECT 'error', 'missing_required_field', id, file FROM g WHERE label = ''
  UNION ALL SELECT 'error', 'missing_required_field', id, file FROM g WHERE source_document = ''
  UNION ALL SELECT 'error', 'unknown_class', id, file FROM g WHERE class NOT IN ('Theme', 'Subtheme', 'Code', 'Excerpt')
  UNION ALL SELECT 'warn', 'filename_mismatch', id, file FROM g WHERE regexp_replace(lower(id), '[^a-z0-9_]', '_', 'g') || '.md' <> file
  UNION ALL SELECT 'warn', 'uri_id_mismatch', id, file FROM g WHERE NOT ends_with(uri, id)
  UNION ALL SELECT 'warn', 'excerpt_missing_property', id, file FROM g WHERE class = 'Excerpt' AND file NOT IN (SELECT file FROM props WHERE prop = 'spokenBy')
  UNION ALL SELECT 'warn', 'excerpt_missing_source_section', id, file FROM g WHERE class = 'Excerpt' AND source_section = ''
  UNION ALL SELECT 'error', 'unknown_property', id, file FROM gp WHERE prop = 'mood'
  UNION ALL SELECT 'error', 'domain_violation', id, file FROM gp WHERE (prop IN ('codedAs', 'supportsTheme', 'spokenBy') AND class <> 'Excerpt') OR (prop = 'hasSubtheme' AND class NOT IN ('Theme', 'Subtheme'))
  UNION ALL SELECT 'warn', 'dangling_wikilink', id, file FROM gp WHERE prop IN ('codedAs', 'supportsTheme', 'hasSubtheme') AND value NOT IN (SELECT id FROM g)
  UNION ALL SELECT 'warn', 'self_reference', id, file FROM gp WHERE prop IN ('codedAs', 'supportsTheme', 'hasSubtheme') AND value = id
  UNION ALL SELECT 'warn', 'orphan_code', id, file FROM g WHERE class = 'Code' AND id NOT IN (SELECT value FROM gp WHERE class = 'Excerpt' AND prop <> 'spokenBy')
  UNION ALL SELECT 'warn', 'orphan_subtheme', id, file FROM g WHERE class = 'Subtheme' AND id NOT IN (SELECT value FROM gp WHERE class = 'Theme' AND prop = 'hasSubtheme')
  UNION ALL SELECT 'info', 'theme_without_subthemes', id, file FROM g WHERE class = 'Theme' AND file NOT IN (SELECT file FROM props WHERE prop = 'hasSubtheme'))"""
RULES = (
    "no_frontmatter", "missing_id", "duplicate_id", "missing_required_field", "unknown_class", "filename_mismatch", "uri_id_mismatch", "excerpt_missing_property", "excerpt_missing_source_section",
    "unknown_property", "domain_violation", "dangling_wikilink", "self_reference", "orphan_code", "orphan_subtheme", "theme_without_subthemes",
)


def findings(spark: SparkSession, d: str) -> DataFrame:
    return lint.lint(mapping.vault(spark, d), THEMATIC)


def _rule(rule: str) -> Query:
    return lambda spark, d: findings(spark, d).where(F.col("rule") == rule).select("severity", "rule", "entity_id", "file")


for _name in RULES:
    register(f"{LINT} SELECT * FROM f WHERE rule = '{_name}'", f"lint_{_name}")(_rule(_name))


@register(f"{LINT} SELECT * FROM f")
def lint_all(spark: SparkSession, d: str) -> DataFrame:
    return lint.in_order(findings(spark, d)).select("severity", "rule", "entity_id", "file")


@register(f"{LINT} SELECT s AS severity, count(rule) AS n FROM (VALUES ('error'), ('warn'), ('info')) v(s) LEFT JOIN f ON f.severity = s GROUP BY s")
def lint_summary(spark: SparkSession, d: str) -> DataFrame:
    return lint.lint_summary(findings(spark, d))


@register(f"{LINT} SELECT count(*) = 0 AS passed FROM f WHERE severity IN ('error', 'warn')")
def lint_strict_gate(spark: SparkSession, d: str) -> DataFrame:
    return lint.strict_gate(findings(spark, d), strict=True)


def clean(spark: SparkSession, d: str) -> DataFrame:
    return lint.gate(mapping.vault(spark, d))


@register(f"WITH {VAULT} SELECT DISTINCT id AS src, prop, value AS dst FROM gp WHERE prop IN ('codedAs', 'supportsTheme', 'hasSubtheme') AND value <> id")
def entities_to_edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.entities_to_edges(clean(spark, d), THEMATIC)


@register(f"WITH {VAULT} SELECT DISTINCT id, prop, value FROM gp WHERE prop = 'spokenBy'")
def entities_to_literals(spark: SparkSession, d: str) -> DataFrame:
    return graph.entities_to_literals(clean(spark, d), THEMATIC)


@register(f"""WITH {VAULT}, t AS (SELECT id AS s, 'rdf:type' AS p, 'tha:' || CASE WHEN class IN ('Theme', 'Subtheme', 'Code', 'Excerpt') THEN class ELSE 'Theme' END AS o, 'iri' AS o_kind FROM g
  UNION ALL SELECT id, 'rdfs:label', label, 'lit' FROM g UNION ALL SELECT id, 'dcterms:source', source_section, 'lit' FROM g WHERE source_section <> ''
  UNION ALL SELECT id, 'skos:definition', rtrim('text of ' || label), 'lit' FROM g
  UNION ALL SELECT DISTINCT id, 'tha:' || prop, CASE WHEN prop = 'spokenBy' THEN value ELSE 'thae:' || value END, CASE WHEN prop = 'spokenBy' THEN 'lit' ELSE 'iri' END FROM gp WHERE prop <> 'mood' AND (value <> id OR prop = 'spokenBy'))
  SELECT 'thae:' || s AS s, p, o, o_kind FROM t""")
def entities_to_triples(spark: SparkSession, d: str) -> DataFrame:
    told = clean(spark, d).withColumn("source_text", F.concat(F.lit("  text\nof "), "label", F.lit(" ")))
    return graph.graph_of(told, THEMATIC).triples().select("s", "p", "o", "o_kind")


# ---- browse ------------------------------------------------------------------------------------------------------


@register(f"WITH {VAULT} SELECT CASE WHEN trim(source_document) <> '' THEN trim(source_document) ELSE regexp_replace(regexp_replace(file, '\\.md$', ''), '_e\\d+$', '') END AS doc_id, count(*) AS entity_count, array_to_string(list_sort(list(DISTINCT class)), '|') AS classes FROM g GROUP BY 1")
def document_rollup(spark: SparkSession, d: str) -> DataFrame:
    return browse.document_rollup(clean(spark, d)).withColumn("classes", joined("classes"))


@register(f"""WITH {VAULT}, w AS (SELECT DISTINCT 'doc_' || (i // 10) AS doc FROM x UNION SELECT DISTINCT source_document FROM x WHERE source_document <> ''),
  a AS (SELECT doc, file FROM w JOIN g ON starts_with(regexp_replace(file, '\\.md$', ''), doc))
  SELECT * FROM a UNION ALL SELECT doc, file FROM w JOIN g ON source_document = doc WHERE doc NOT IN (SELECT doc FROM a)""")
def entities_for_document(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    wanted = docs.select(ref("doc", F.expr("doc_id div 10")).alias("doc")).unionByName(docs.where("source is not null").select(F.col("source").alias("doc"))).distinct()
    return browse.entities_for_document(clean(spark, d), wanted)


@register(f"WITH {VAULT} SELECT file, class, label, source_section, (SELECT count(DISTINCT prop) FROM gp WHERE gp.file = g.file) AS n_props FROM g")
def entity_card(spark: SparkSession, d: str) -> DataFrame:
    return browse.entity_card(clean(spark, d)).select("file", "class", "label", "source_section", F.size("properties").cast("bigint").alias("n_props"))


@register(f"WITH {VAULT}, b AS (SELECT CASE WHEN source_document <> '' THEN source_document ELSE regexp_replace(file, '\\.md$', '') END AS doc_id, list(DISTINCT class) AS cs FROM g GROUP BY 1) SELECT doc_id FROM b WHERE contains(lower(doc_id), 'quot') OR len(list_filter(cs, lambda c: contains(lower(c), 'quot'))) > 0")
def vault_search(spark: SparkSession, d: str) -> DataFrame:
    return browse.vault_search(browse.document_rollup(clean(spark, d)), "QUOT").select("doc_id")


@register(f"WITH {VAULT} SELECT file, class, id, label FROM g WHERE file = 'doc_3.md'")
def read_entity(spark: SparkSession, d: str) -> DataFrame:
    return browse.read_entity(clean(spark, d), "doc_3.md").select("file", "class", "id", "label")


REG_CQ1 = "q AS (SELECT 'rege:iss_' || c_custkey AS a, 'rege:fil_' || o_orderkey AS b FROM orders JOIN customer ON o_custkey = c_custkey)"


@register(f"WITH {REG_CQ1} SELECT DISTINCT a AS entity FROM q UNION SELECT b FROM q")
def result_entities(spark: SparkSession, d: str) -> DataFrame:
    return browse.result_entities(questions.filings_by_issuer(reg(spark, d)), "rege:")


@register("""WITH q AS (SELECT 'rege:iss_' || c_custkey AS a, 'rege:fil_' || o_orderkey AS b FROM orders JOIN customer ON o_custkey = c_custkey),
  r AS (SELECT a, b, row_number() OVER (ORDER BY a DESC, b) AS n FROM q), e AS (SELECT a AS entity, n * 10 AS pl FROM r UNION ALL SELECT b, n * 10 + 2 FROM r)
  SELECT entity, row_number() OVER (ORDER BY min(pl)) - 1 AS position FROM e GROUP BY entity""")
def entities_in_order(spark: SparkSession, d: str) -> DataFrame:
    return browse.entities_in_order(questions.filings_by_issuer(reg(spark, d)).orderBy(F.desc("issuer"), "filing"), "rege:")


@register("SELECT DISTINCT 'rege:nat_' || c_nationkey AS regulator, 'rege:obl_' || l_partkey AS obligation FROM orders JOIN customer ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE c_nationkey < 5")
def stored_graph_question(spark: SparkSession, d: str) -> DataFrame:
    """Three hops over the graph as a stored table, from five regulators' filings to what their disclosures trigger."""
    base, name = f"{shared_dir(spark)}/graph-{uuid.uuid4().hex}", f"graph_{uuid.uuid4().hex}"
    try:
        t = graph.store_graph(reg(spark, d), name, base)
        mine = pt.triple_pattern(t, "?filing", "reg:filedWith", "?regulator").where(F.col("regulator").isin(*[f"rege:nat_{i}" for i in range(5)]))
        return cut(pt.bgp(mine, pt.triple_pattern(t, "?filing", "reg:containsDisclosure", "?disclosure"), pt.triple_pattern(t, "?disclosure", "reg:triggersObligation", "?obligation")).select("regulator", "obligation").distinct())
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        remove(spark, base)


@register("SELECT 'sup_' || s_suppkey AS src, 'nat_' || s_nationkey AS dst FROM supplier WHERE s_suppkey % 7 = 0 UNION SELECT 'sup_' || s_suppkey, 'reg_' || n_regionkey FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey % 7 = 0")
def path_from(spark: SparkSession, d: str) -> DataFrame:
    starts = table(spark, d, "supplier").where("s_suppkey % 7 = 0").select(ref("sup", "s_suppkey").alias("src"))
    return pt.path_from(mapping.compliance(spark, d).edges.where("prop in ('imposesObligationOn', 'enforcedBy')"), starts)


@register("SELECT 'sup_' || s_suppkey AS src, 'reg_' || n_regionkey AS dst FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey = 2 UNION SELECT 'nat_' || n_nationkey, 'reg_' || n_regionkey FROM nation WHERE n_regionkey = 2")
def path_to(spark: SparkSession, d: str) -> DataFrame:
    ends = table(spark, d, "region").where("r_regionkey = 2").select(ref("reg", "r_regionkey").alias("dst"))
    return pt.path_to(mapping.compliance(spark, d).edges.where("prop in ('imposesObligationOn', 'enforcedBy')"), ends)


@register(f"WITH {REG_TRIPLES}, {REG_CQ1} SELECT s, p, o FROM t WHERE s IN (SELECT a FROM q UNION SELECT b FROM q)")
def cq_subgraph(spark: SparkSession, d: str) -> DataFrame:
    asked = questions.filings_by_issuer(mapping.regulatory(spark, d).triples(classes=True))
    return browse.cq_subgraph(reg(spark, d), asked, "rege:").select("s", "p", "o")


@register(f"WITH {REG_EDGES} SELECT 'rege:' || src AS src, prop AS label, 'rege:' || dst AS dst FROM e")
def graph_edges(spark: SparkSession, d: str) -> DataFrame:
    return browse.graph_edges(reg(spark, d))


@register(f"""WITH {REG_EDGES}, {REG_ENTITIES} SELECT 'rege:' || k AS node, coalesce(label, k) AS label, coalesce(class, '') AS class, CASE class WHEN 'Filing' THEN 0 WHEN 'Issuer' THEN 1 WHEN 'Disclosure' THEN 2 WHEN 'Regulator' THEN 3 WHEN 'Obligation' THEN 4 END AS color
  FROM (SELECT id AS k FROM n UNION SELECT src FROM e UNION SELECT dst FROM e) LEFT JOIN n ON id = k""")
def graph_nodes(spark: SparkSession, d: str) -> DataFrame:
    return browse.graph_nodes(reg(spark, d), PACKS["regulatory"])


@register(f"""WITH {VAULT}, k AS (SELECT lower(regexp_replace(regexp_replace(regexp_replace(file, '\\.md$', ''), '_e\\d+$', ''), '[\\s\\-_]', '', 'g')) AS key, file FROM g UNION ALL SELECT lower(regexp_replace(trim(label), '[\\s\\-_]', '', 'g')), file FROM g),
  m AS (SELECT key, max(file) AS file FROM k WHERE key <> '' GROUP BY key) SELECT name, coalesce(file, name || '.md') AS file FROM (SELECT 'Document-' || doc_id AS name FROM documents) LEFT JOIN m ON key = lower(regexp_replace(name, '[\\s\\-_]', '', 'g'))""")
def resolve_file(spark: SparkSession, d: str) -> DataFrame:
    names = table(spark, d, "documents").select(F.concat(F.lit("Document-"), F.col("doc_id").cast("string")).alias("name"))
    return browse.resolve_file(names, clean(spark, d))


def outcomes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("name"), (F.col("n_chars") >= 60).alias("ok"), F.lit("too short").alias("error"))


@register("SELECT count(*) AS processed, count(*) FILTER (n_chars >= 60) AS succeeded, count(*) FILTER (n_chars < 60) AS failed FROM documents")
def batch_result(spark: SparkSession, d: str) -> DataFrame:
    return browse.batch_result(outcomes(spark, d))


@register("SELECT CAST(doc_id AS VARCHAR) AS name, 'too short' AS error FROM documents WHERE n_chars < 60")
def batch_errors(spark: SparkSession, d: str) -> DataFrame:
    return browse.batch_errors(outcomes(spark, d))


# ---- curation ----------------------------------------------------------------------------------------------------


def part_entities(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    label = F.when(k % 10 == 0, F.upper("p_name")).otherwise(F.lower("p_name"))
    return table(spark, d, "part").select(ref("part", "p_partkey").alias("id"), F.col("p_type").alias("class"), label.alias("label"), ref("part", "p_partkey").alias("uri"), F.lower(F.regexp_replace("p_brand", "#", "")).alias("source_document"), F.lit("").alias("source_section"), F.lit("").alias("source_text"))


PART = "pe AS (SELECT 'part_' || p_partkey AS id, p_type AS class, CASE WHEN p_partkey % 10 = 0 THEN upper(p_name) ELSE lower(p_name) END AS label, lower(replace(p_brand, '#', '')) AS doc FROM part)"


@register(f"""WITH {PART}, s AS (SELECT class, id, list_sort(list_distinct(list_filter(string_split_regex(lower(label), '[^a-z0-9]+'), lambda w: w <> ''))) AS ws FROM pe),
  h AS (SELECT class, ws, min(id) AS head FROM s WHERE len(ws) > 0 GROUP BY class, ws)
  SELECT head AS kept_id, id AS removed_id FROM s JOIN h USING (class, ws) WHERE id <> head
  UNION ALL SELECT a.head, b.head FROM h a JOIN h b ON a.class = b.class AND a.head < b.head WHERE len(list_intersect(a.ws, b.ws)) >= 0.5 * len(list_distinct(list_concat(a.ws, b.ws)))""")
def propose_merges(spark: SparkSession, d: str) -> DataFrame:
    return curate.propose_merges(part_entities(spark, d)).select("kept_id", "removed_id")


TYPOS = "rl AS (SELECT 'part_' || p_partkey AS id, p_type AS class, CASE p_partkey % 10 WHEN 1 THEN left(p_name, 2) || substr(p_name, 4) WHEN 2 THEN left(p_name, 4) || substr(p_name, 4) WHEN 3 THEN left(p_name, 1) || substr(p_name, 3, 1) || substr(p_name, 2, 1) || substr(p_name, 4) WHEN 4 THEN 'x' || substr(p_name, 2) WHEN 5 THEN upper(p_name) || ' ' ELSE p_name END AS label FROM part)"


def respelled_parts(spark: SparkSession, d: str) -> DataFrame:
    """Parts whose names have typos: a letter left out, doubled, swapped or changed, and other letter cases."""
    k, name = F.col("p_partkey") % 10, F.col("p_name")
    cut_ = lambda a, n=99: F.substring(name, a, n)
    label = F.when(k == 1, F.concat(cut_(1, 2), cut_(4))).when(k == 2, F.concat(cut_(1, 4), cut_(4))).when(k == 3, F.concat(cut_(1, 1), cut_(3, 1), cut_(2, 1), cut_(4))).when(k == 4, F.concat(F.lit("x"), cut_(2))).when(k == 5, F.concat(F.upper(name), F.lit(" "))).otherwise(name)
    return table(spark, d, "part").select(ref("part", "p_partkey").alias("id"), F.col("p_type").alias("class"), label.alias("label"))


@register(f"""WITH {TYPOS}, h AS (SELECT class, trim(regexp_replace(lower(label), '\\s+', ' ', 'g')) AS t, min(id) AS head FROM rl GROUP BY 1, 2)
  SELECT a.head AS kept_id, b.head AS removed_id FROM h a JOIN h b ON a.class = b.class AND a.head < b.head AND damerau_levenshtein(a.t, b.t) <= 1""")
def propose_respelled(spark: SparkSession, d: str) -> DataFrame:
    return curate.propose_respelled(respelled_parts(spark, d)).select("kept_id", "removed_id")


CODED = """cx AS (SELECT DISTINCT o_orderpriority AS theme, l_orderkey AS src, unnest(['flag_' || l_returnflag, 'status_' || l_linestatus, 'quantity_' || CAST(floor(l_quantity / 10) AS INTEGER), 'supplier_' || l_suppkey]) AS code FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def order_codes(spark: SparkSession, d: str) -> DataFrame:
    """Orders as excerpts: their priority is the theme, what their lines show the codes."""
    src = ref("ord", "l_orderkey")
    shown = F.array(ref("flag", "l_returnflag"), ref("status", "l_linestatus"), ref("quantity", F.floor(F.col("l_quantity") / 10)), ref("supplier", "l_suppkey"))
    codes = table(spark, d, "lineitem").select(src.alias("src"), F.lit("codedAs").alias("prop"), F.explode(shown).alias("dst")).distinct()
    return codes.unionByName(table(spark, d, "orders").select(ref("ord", "o_orderkey").alias("src"), F.lit("supportsTheme").alias("prop"), F.col("o_orderpriority").alias("dst")))


@register(f"""WITH RECURSIVE {CODED}, n AS (SELECT theme, code, count(*) AS n FROM cx GROUP BY 1, 2), t AS (SELECT theme, count(DISTINCT src) AS total FROM cx GROUP BY 1),
  p AS (SELECT a.theme, a.code AS a, b.code AS b, count(*) AS m FROM cx a JOIN cx b ON a.theme = b.theme AND a.src = b.src AND a.code < b.code GROUP BY 1, 2, 3),
  e AS MATERIALIZED (SELECT p.theme, a, b FROM p JOIN n x ON x.theme = p.theme AND x.code = a JOIN n y ON y.theme = p.theme AND y.code = b JOIN t ON t.theme = p.theme WHERE m >= 3 AND m * total >= 2.0 * x.n * y.n),
  g AS MATERIALIZED (SELECT theme, a, b FROM e UNION ALL SELECT theme, b, a FROM e),
  r AS (SELECT DISTINCT theme, a AS code, a AS low FROM g UNION SELECT g.theme, g.b, r.low FROM r JOIN g ON g.theme = r.theme AND g.a = r.code)
  SELECT theme, min(low) AS group_id, code FROM r GROUP BY theme, code""")
def cohering_codes(spark: SparkSession, d: str) -> DataFrame:
    return curate.cohering_codes(order_codes(spark, d), 3, 2.0, wide=12)


@register("""WITH c AS (SELECT lang, source, count(*) AS n FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL GROUP BY lang, source HAVING count(*) >= 3)
  SELECT 'theme_' || lang AS parent_theme_id, array_to_string(list_sort(list('code_' || source)), '|') AS members FROM c GROUP BY lang HAVING count(*) >= 2""")
def propose_groups(spark: SparkSession, d: str) -> DataFrame:
    return curate.propose_groups(mapping.thematic(spark, d).edges, 3).select("parent_theme_id", joined("member_code_ids").alias("members"))


@register(f"WITH {VAULT} SELECT DISTINCT value AS from_id, id AS to_id FROM gp a WHERE prop = 'supportsTheme' AND value <> id AND NOT EXISTS (SELECT 1 FROM gp b WHERE b.prop = 'hasSubtheme' AND b.id = a.value AND b.value = a.id)")
def propose_links(spark: SparkSession, d: str) -> DataFrame:
    return curate.propose_links(graph.entities_to_edges(clean(spark, d), THEMATIC)).select("from_id", "to_id")


@register(f"WITH {PART} SELECT id AS entity_id, lower(label) AS new_label FROM pe WHERE label = upper(label)")
def propose_renames(spark: SparkSession, d: str) -> DataFrame:
    return curate.propose_renames(part_entities(spark, d)).select("entity_id", "new_label")


def raw_proposals(spark: SparkSession, d: str) -> DataFrame:
    """Responses with one proposal each, made from orders over parts: of all four kinds and one unknown."""
    k = F.col("o_orderkey")
    op = F.element_at(F.array(*[F.lit(x) for x in (*curate.OPERATIONS, "split_entity")]), (k % 5 + 1).cast("int"))
    a, b = ref("part", k % 199 + 1), ref("part", k % 199 + 1 + k % 7)
    p = F.struct(
        op.alias("operation"), F.lit("because").alias("rationale"), F.when(k % 3 == 0, F.lit("high")).alias("confidence"), a.alias("kept_id"), b.alias("removed_id"), F.concat(F.lit("Group "), (k % 11).cast("string")).alias("new_subtheme_label"), a.alias("parent_theme_id"),
        F.when(k % 2 == 0, F.array(b)).otherwise(F.array(b, a)).alias("member_code_ids"), a.alias("from_id"), F.lit("relatedTo").alias("property"), b.alias("to_id"), a.alias("entity_id"), F.concat(F.lit("Name "), (k % 13).cast("string")).alias("new_label"),
    )
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("seq"), F.to_json(F.struct(F.array(p).alias("proposals"))).alias("response"))


RAW = """rp AS (SELECT o_orderkey AS k, ['merge_entities', 'group_codes', 'link_hierarchy', 'rename_label', 'split_entity'][o_orderkey % 5 + 1] AS operation, 'part_' || (o_orderkey % 199 + 1) AS a,
    'part_' || (o_orderkey % 199 + 1 + o_orderkey % 7) AS b, 'Group ' || (o_orderkey % 11) AS g, 'Name ' || (o_orderkey % 13) AS m, CASE WHEN o_orderkey % 3 = 0 THEN 'high' ELSE 'medium' END AS confidence FROM orders),
  np AS (SELECT k, operation, confidence, CASE WHEN operation = 'merge_entities' THEN a END AS kept_id, CASE WHEN operation = 'merge_entities' THEN b END AS removed_id, CASE WHEN operation = 'group_codes' THEN g END AS new_subtheme_label,
    CASE WHEN operation = 'group_codes' THEN a END AS parent_theme_id, CASE WHEN operation = 'group_codes' THEN CASE WHEN k % 2 = 0 THEN [b] ELSE [b, a] END END AS members, CASE WHEN operation = 'link_hierarchy' THEN a END AS from_id,
    CASE WHEN operation = 'link_hierarchy' THEN 'relatedTo' END AS property, CASE WHEN operation = 'link_hierarchy' THEN b END AS to_id, CASE WHEN operation = 'rename_label' THEN a END AS entity_id, CASE WHEN operation = 'rename_label' THEN m END AS new_label FROM rp),
  fp AS (SELECT *, 'proposal_' || left(sha1(operation || '|(' || CASE operation WHEN 'merge_entities' THEN '''' || kept_id || ''', ''' || removed_id || ''''
      WHEN 'group_codes' THEN '''' || parent_theme_id || ''', (' || array_to_string(list_transform(list_sort(members), lambda x: '''' || x || ''''), ', ') || CASE WHEN len(members) = 1 THEN ',' ELSE '' END || ')'
      WHEN 'link_hierarchy' THEN '''' || from_id || ''', ''' || property || ''', ''' || to_id || '''' WHEN 'rename_label' THEN '''' || entity_id || ''',' ELSE '''{}'',' END || ')'), 8) AS proposal_id FROM np),
  pp AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY proposal_id ORDER BY k) AS n FROM fp) WHERE n = 1),
  sp AS (SELECT *, CASE WHEN ord % 2 = 0 THEN 'approved' WHEN ord % 3 = 0 THEN 'rejected' ELSE 'pending' END AS status FROM (SELECT *, CAST(('0x' || substring(proposal_id, 13, 4)) AS BIGINT) AS ord FROM pp))"""


def proposals(spark: SparkSession, d: str) -> DataFrame:
    """Normalised proposals with ids, one per fingerprint (the first by order), and a status drawn from the id."""
    raw = curate.normalize_proposals(raw_proposals(spark, d))
    named = raw.withColumn("proposal_id", F.concat(F.lit("proposal_"), curate.fingerprint()))
    columns = [c for c in named.columns if c != "proposal_id"]
    first = named.groupBy("proposal_id").agg(F.min(F.struct(*columns)).alias("p")).select("proposal_id", "p.*")
    order = F.conv(F.substring("proposal_id", 13, 4), 16, 10).cast("bigint")
    status = F.when(order % 2 == 0, "approved").when(order % 3 == 0, "rejected").otherwise("pending")
    return first.withColumn("status", status).withColumn("reviewer_notes", F.lit(None).cast("string"))


@register(f"WITH {RAW} SELECT operation, confidence, kept_id, removed_id, new_subtheme_label, parent_theme_id, array_to_string(members, '|') AS members, from_id, property, to_id, entity_id, new_label FROM np")
def normalize_proposals(spark: SparkSession, d: str) -> DataFrame:
    return curate.normalize_proposals(raw_proposals(spark, d)).select("operation", "confidence", "kept_id", "removed_id", "new_subtheme_label", "parent_theme_id", joined("member_code_ids").alias("members"), "from_id", "property", "to_id", "entity_id", "new_label")


@register(f"WITH {RAW} SELECT proposal_id, operation, count(*) AS n FROM fp GROUP BY 1, 2")
def proposal_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    named = curate.normalize_proposals(raw_proposals(spark, d)).withColumn("proposal_id", F.concat(F.lit("proposal_"), curate.fingerprint()))
    return named.groupBy("proposal_id", "operation").agg(F.count(F.lit(1)).alias("n"))


@register(f"WITH {RAW} SELECT proposal_id, operation, CASE WHEN ord % 5 = 0 THEN 'pending' ELSE status END AS status, CASE WHEN ord % 7 = 0 THEN 'old' ELSE 'because' END AS rationale FROM sp")
def upsert_proposals(spark: SparkSession, d: str) -> DataFrame:
    p = proposals(spark, d)
    order = F.conv(F.substring("proposal_id", 13, 4), 16, 10).cast("bigint")
    existing = p.where(order % 5 != 0).withColumn("rationale", F.lit("old")).unionByName(p.where((order % 5 == 0) & (order % 7 == 0)).withColumn("rationale", F.lit("old")).withColumn("status", F.lit("pending")))
    return curate.upsert_proposals(existing, p.where(order % 7 != 0).drop("status", "reviewer_notes")).select("proposal_id", "operation", "status", "rationale")


@register(f"WITH {RAW} SELECT proposal_id, CASE WHEN ord % 10 = 0 THEN 'deferred' ELSE status END AS status, CASE WHEN ord % 10 = 0 THEN 'later' END AS reviewer_notes FROM sp")
def set_status(spark: SparkSession, d: str) -> DataFrame:
    p = proposals(spark, d)
    order = F.conv(F.substring("proposal_id", 13, 4), 16, 10).cast("bigint")
    made = p.where(order % 10 == 0).select("proposal_id", F.inline(F.array(*[F.struct(F.lit(s).alias("status"), F.lit(n).cast("string").alias("notes"), F.lit(i).cast("bigint").alias("seq")) for i, (s, n) in enumerate((("rejected", None), ("deferred", "later"), ("bogus", "no")))])))
    return curate.set_status(p, made)[0].select("proposal_id", "status", "reviewer_notes")


@register(f"WITH {RAW} SELECT s AS status, count(proposal_id) AS n FROM (VALUES ('pending'), ('approved'), ('rejected'), ('deferred'), ('applied')) v(s) LEFT JOIN sp ON status = s GROUP BY s")
def proposal_counts(spark: SparkSession, d: str) -> DataFrame:
    return curate.proposal_counts(proposals(spark, d))


# Of the proposals of one fingerprint the least labels count.
LABELS = "lb AS (SELECT proposal_id, min(new_subtheme_label) AS gl, min(new_label) AS ml FROM fp GROUP BY proposal_id), sl AS (SELECT * FROM sp JOIN lb USING (proposal_id))"
_SUMMARY = """CASE operation WHEN 'merge_entities' THEN 'Keep `' || kept_id || '`, remove `' || removed_id || '`.' WHEN 'group_codes' THEN 'New Subtheme ''' || gl || ''' under `' || parent_theme_id || '` (' || len(members) || ' member code(s)).'
  WHEN 'link_hierarchy' THEN '`' || from_id || '` —' || property || '→ `' || to_id || '`.' WHEN 'rename_label' THEN '`' || entity_id || '` → label ''' || ml || '''.' ELSE operation END"""


@register(f"WITH {RAW}, {LABELS} SELECT proposal_id, {_SUMMARY} AS summary FROM sl")
def payload_summary(spark: SparkSession, d: str) -> DataFrame:
    return proposals(spark, d).select("proposal_id", curate.payload_summary().alias("summary"))


@register(f"WITH {RAW}, {LABELS} SELECT proposal_id, operation, {_SUMMARY} AS summary FROM sl WHERE status = 'approved'")
def apply_dry_run(spark: SparkSession, d: str) -> DataFrame:
    return curate.dry_run(proposals(spark, d))


@register(f"""WITH {RAW}, {LABELS} SELECT proposal_id, removed_id AS src, kept_id AS dst, 'merge into' AS label, 'remove' AS change FROM sl WHERE operation = 'merge_entities'
  UNION ALL SELECT proposal_id, parent_theme_id, 'NEW:' || gl, 'hasSubtheme', 'add' FROM sl WHERE operation = 'group_codes' UNION ALL SELECT proposal_id, 'NEW:' || gl, unnest(members), '(implied)', 'imply' FROM sl WHERE operation = 'group_codes'
  UNION ALL SELECT proposal_id, from_id, to_id, property, 'add' FROM sl WHERE operation = 'link_hierarchy' UNION ALL SELECT proposal_id, entity_id, entity_id, ml, 'relabel' FROM sl WHERE operation = 'rename_label'""")
def proposal_preview_edges(spark: SparkSession, d: str) -> DataFrame:
    return curate.preview_edges(proposals(spark, d))


def part_edges(spark: SparkSession, d: str) -> DataFrame:
    parts = table(spark, d, "part").select("p_partkey")
    return parts.select(ref("part", "p_partkey").alias("src"), F.lit("relatedTo").alias("prop"), ref("part", F.col("p_partkey") % 97 + 1).alias("dst")).where("src <> dst")


PART_EDGES = "ed AS (SELECT * FROM (SELECT 'part_' || p_partkey AS src, 'relatedTo' AS prop, 'part_' || (p_partkey % 97 + 1) AS dst FROM part) WHERE src <> dst)"
MERGES = """mg AS (SELECT 'part_' || (o_orderkey % 199 + 1) AS kept_id, 'part_' || (o_orderkey % 199 + 1 + o_orderkey % 7) AS removed_id, o_orderkey AS seq FROM orders),
  m1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY removed_id ORDER BY seq, kept_id) AS n FROM mg WHERE kept_id <> removed_id) WHERE n = 1),
  m2 AS (SELECT a.removed_id AS removed, a.kept_id AS kept FROM m1 a LEFT JOIN m1 b ON a.kept_id = b.removed_id WHERE b.seq IS NULL OR b.seq > a.seq),
  mr AS (SELECT removed, kept FROM m2 UNION ALL SELECT mr.removed, m2.kept FROM mr JOIN m2 ON mr.kept = m2.removed),
  root AS (SELECT removed, kept FROM mr WHERE kept NOT IN (SELECT removed FROM m2))"""


def merges(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select(ref("part", k % 199 + 1).alias("kept_id"), ref("part", k % 199 + 1 + k % 7).alias("removed_id"), k.alias("seq"))


@register(f"WITH RECURSIVE {PART_EDGES}, {MERGES} SELECT DISTINCT src, prop, coalesce(kept, dst) AS dst FROM ed LEFT JOIN root ON dst = removed WHERE src NOT IN (SELECT removed FROM root)")
def apply_merges(spark: SparkSession, d: str) -> DataFrame:
    return curate.apply_merges(part_entities(spark, d), part_edges(spark, d), merges(spark, d))[1]


@register(f"WITH RECURSIVE {PART}, {MERGES} SELECT id, label FROM pe WHERE id NOT IN (SELECT removed FROM root)")
def apply_merges_entities(spark: SparkSession, d: str) -> DataFrame:
    return curate.apply_merges(part_entities(spark, d), part_edges(spark, d), merges(spark, d))[0].select("id", "label")


@register(f"WITH {PART}, r AS (SELECT 'part_' || (o_orderkey % 199 + 1) AS id, arg_max('Name ' || o_orderkey, o_orderkey) AS l FROM orders GROUP BY 1) SELECT pe.id, coalesce(l, label) AS label FROM pe LEFT JOIN r ON r.id = pe.id")
def apply_renames(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    renames = table(spark, d, "orders").select(ref("part", k % 199 + 1).alias("entity_id"), ref("Name", k).alias("new_label"), k.alias("seq")).withColumn("new_label", F.replace("new_label", F.lit("_"), F.lit(" ")))
    return curate.apply_renames(part_entities(spark, d), renames).select("id", "label")


@register(f"WITH {PART_EDGES} SELECT * FROM ed UNION SELECT 'part_' || (o_orderkey % 199 + 1), 'relatedTo', 'part_' || (o_orderkey % 50 + 1) FROM orders")
def apply_links(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    return curate.apply_links(part_edges(spark, d), table(spark, d, "orders").select(ref("part", k % 199 + 1).alias("src"), F.lit("relatedTo").alias("prop"), ref("part", k % 50 + 1).alias("dst")))


GROUPS = f"""gr AS (SELECT * FROM (SELECT doc || '_subtheme_group_' || regexp_extract(new_subtheme_label, '[0-9]+') AS id, parent_theme_id AS parent, 'Group ' || regexp_extract(new_subtheme_label, '[0-9]+') AS label,
    row_number() OVER (PARTITION BY doc || '_subtheme_group_' || regexp_extract(new_subtheme_label, '[0-9]+') ORDER BY parent_theme_id) AS n2 FROM (SELECT DISTINCT new_subtheme_label, parent_theme_id FROM np WHERE operation = 'group_codes') JOIN pe ON pe.id = parent_theme_id) WHERE n2 = 1)"""


@register(f"WITH {RAW}, {PART}, {GROUPS} SELECT 'hasSubtheme' AS prop, parent AS src, id AS dst, label FROM gr")
def apply_groups(spark: SparkSession, d: str) -> DataFrame:
    p = curate.normalize_proposals(raw_proposals(spark, d)).where("operation = 'group_codes'").select("new_subtheme_label", "parent_theme_id").distinct()
    groups = p.withColumn("proposal_id", F.col("parent_theme_id")).withColumn("member_code_ids", F.array().cast("array<string>"))
    entities, edges = curate.apply_groups(part_entities(spark, d), part_edges(spark, d), groups, THEMATIC)
    new = entities.where("class = 'Subtheme'").select(F.col("id").alias("dst"), "label")
    return edges.where("prop = 'hasSubtheme'").join(new, "dst").select("prop", "src", "dst", "label")


# Of the proposals of one fingerprint the least label counts. Approved ones are numbered by their ids and judged one after another: what is dead, and what is made, is carried on.
APPLIED = f"""ap AS (SELECT * FROM (SELECT proposal_id, any_value(operation) AS operation, any_value(kept_id) AS kept_id, any_value(removed_id) AS removed_id, min(new_subtheme_label) AS label, any_value(parent_theme_id) AS parent,
    any_value(from_id) AS from_id, any_value(property) AS property, any_value(to_id) AS to_id, any_value(entity_id) AS entity_id, min(new_label) AS new_label FROM fp GROUP BY proposal_id) WHERE CAST(('0x' || substring(proposal_id, 13, 4)) AS BIGINT) % 2 = 0),
  nd AS (SELECT *, CASE operation WHEN 'rename_label' THEN entity_id WHEN 'link_hierarchy' THEN from_id WHEN 'merge_entities' THEN kept_id ELSE parent END AS need FROM ap),
  od AS MATERIALIZED (SELECT row_number() OVER (ORDER BY proposal_id) AS k, nd.*, pe.id IS NOT NULL AS known, CASE WHEN operation = 'group_codes' THEN doc || '_subtheme_group_' || regexp_extract(nd.label, '[0-9]+') END AS makes FROM nd LEFT JOIN pe ON pe.id = need),
  sq AS (SELECT CAST(0 AS BIGINT) AS k, CAST([] AS VARCHAR[]) AS dead, CAST([] AS VARCHAR[]) AS made, CAST(NULL AS VARCHAR) AS message
    UNION ALL SELECT k, CASE WHEN message IS NULL AND operation = 'merge_entities' THEN list_append(dead, removed_id) ELSE dead END, CASE WHEN message IS NULL AND operation = 'group_codes' THEN list_append(made, makes) ELSE made END, message
    FROM (SELECT od.*, dead, made, CASE WHEN operation = 'split_entity' THEN 'operation not implemented' WHEN kept_id = removed_id THEN 'kept_id equals removed_id' WHEN NOT known OR list_contains(dead, need) THEN 'not found: ' || need
      WHEN list_contains(made, makes) THEN 'target subtheme exists' END AS message FROM sq JOIN od ON od.k = sq.k + 1)),
  rs AS MATERIALIZED (SELECT od.*, sq.message FROM od JOIN sq USING (k)),
  vm AS MATERIALIZED (SELECT k, removed_id AS removed, kept_id AS kept, coalesce(lag(k) OVER (PARTITION BY removed_id ORDER BY k), -1) AS since FROM rs WHERE message IS NULL AND operation = 'merge_entities')"""


@register(f"""WITH RECURSIVE {RAW}, {PART}, {PART_EDGES}, {APPLIED},
  al AS (SELECT src, prop, dst, CAST(0 AS BIGINT) AS born FROM ed UNION ALL SELECT need, 'hasSubtheme', makes, k FROM rs WHERE message IS NULL AND operation = 'group_codes' UNION ALL SELECT from_id, property, to_id, k FROM rs WHERE message IS NULL AND operation = 'link_hierarchy'),
  lv AS (SELECT * FROM al WHERE NOT EXISTS (SELECT 1 FROM vm WHERE vm.removed = al.src AND vm.k > al.born)),
  mv AS (SELECT src, prop, dst, born AS t FROM lv UNION ALL SELECT src, prop, vm.kept, vm.k FROM mv JOIN vm ON vm.removed = mv.dst AND mv.t < vm.k AND mv.t >= vm.since),
  en AS (SELECT * FROM mv WHERE NOT EXISTS (SELECT 1 FROM vm WHERE vm.removed = mv.dst AND mv.t < vm.k AND mv.t >= vm.since))
  SELECT DISTINCT src, prop, dst FROM en""")
def apply_approved(spark: SparkSession, d: str) -> DataFrame:
    _, _, edges, _ = curate.apply_approved(proposals(spark, d), part_entities(spark, d), part_edges(spark, d), THEMATIC)
    return edges


@register(f"""WITH RECURSIVE {RAW}, {PART}, {APPLIED}, rn AS (SELECT entity_id AS id, arg_max(new_label, k) AS l FROM rs WHERE message IS NULL AND operation = 'rename_label' GROUP BY 1)
  SELECT pe.id, coalesce(l, label) AS label FROM pe LEFT JOIN rn USING (id) WHERE pe.id NOT IN (SELECT removed FROM vm) UNION ALL SELECT makes, label FROM rs WHERE message IS NULL AND operation = 'group_codes'""")
def apply_approved_entities(spark: SparkSession, d: str) -> DataFrame:
    return curate.apply_approved(proposals(spark, d), part_entities(spark, d), part_edges(spark, d), THEMATIC)[1].select("id", "label")


@register(f"WITH RECURSIVE {RAW}, {PART}, {APPLIED} SELECT proposal_id, operation, message IS NULL AS ok, coalesce(message, 'applied') AS message FROM rs")
def apply_results(spark: SparkSession, d: str) -> DataFrame:
    return curate.apply_results(proposals(spark, d), part_entities(spark, d), THEMATIC)


# ---- approval ----------------------------------------------------------------------------------------------------


def source_entities(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("source is not null").select(F.concat(ref("doc", "doc_id"), F.lit(".md")).alias("file"), F.col("source").alias("source_document"), F.lit("Excerpt").alias("class"), ref("Document", "doc_id").alias("label"), F.lit("").alias("source_section"))


def events(spark: SparkSession, d: str) -> DataFrame:
    """Every source submitted; every third approved twice, every fourth (by submission) then rejected."""
    sent = approval.submit(source_entities(spark, d))
    made = sent.select("submission_id", F.inline(F.array(*[F.struct(F.lit(e).alias("event"), F.lit(m).alias("mod"), F.lit(s).cast("bigint").alias("seq")) for e, m, s in (("APPROVED", 3, 1), ("APPROVED", 3, 2), ("REJECTED", 4, 3))]))).where("submission_id % mod = 0")
    decisions = made.select("submission_id", "event", F.lit("ann").alias("reviewer"), F.lit("seen").alias("notes"), F.lit("2024-02-01T00:00:00Z").alias("timestamp"), "seq")
    first, last = decisions.where("seq < 3"), decisions.where("seq = 3")
    return approval.decide(approval.decide(sent, first), last)


SUB = "sb AS (SELECT row_number() OVER (ORDER BY source) AS submission_id, source AS doc_id, count(DISTINCT doc_id) AS n_files FROM documents WHERE source IS NOT NULL GROUP BY source), st AS (SELECT *, CASE WHEN submission_id % 4 = 0 THEN 'REJECTED' WHEN submission_id % 3 = 0 THEN 'APPROVED' ELSE 'PENDING' END AS status FROM sb)"


@register(f"WITH {SUB} SELECT submission_id, doc_id, n_files FROM sb")
def submit(spark: SparkSession, d: str) -> DataFrame:
    return approval.submit(source_entities(spark, d)).select("submission_id", "doc_id", F.size("files").cast("bigint").alias("n_files"))


@register(f"WITH {SUB} SELECT submission_id, doc_id, status FROM st")
def submission_states(spark: SparkSession, d: str) -> DataFrame:
    return approval.current(events(spark, d)).select("submission_id", "doc_id", "status")


@register(f"WITH {SUB} SELECT submission_id, doc_id, n_files FROM st WHERE status = 'PENDING'")
def list_pending(spark: SparkSession, d: str) -> DataFrame:
    return approval.list_pending(events(spark, d)).select("submission_id", "doc_id", F.size("files").cast("bigint").alias("n_files"))


@register(f"WITH {SUB} SELECT 'doc_' || d.doc_id || '.md' AS file FROM documents d WHERE source IN (SELECT doc_id FROM st WHERE status <> 'REJECTED')")
def live_entities(spark: SparkSession, d: str) -> DataFrame:
    return approval.live(source_entities(spark, d), events(spark, d)).select("file")


@register(f"WITH {SUB} SELECT 'doc_' || d.doc_id || '.md' AS file, source || '_20240201000000' AS quarantine_dir FROM documents d WHERE source IN (SELECT doc_id FROM st WHERE status = 'REJECTED')")
def quarantine_entities(spark: SparkSession, d: str) -> DataFrame:
    return approval.quarantine(source_entities(spark, d), events(spark, d)).select("file", "quarantine_dir")


@register(f"WITH {SUB} SELECT submission_id, doc_id, n_files AS n_cards FROM st WHERE status = 'PENDING'")
def hydrate_pending(spark: SparkSession, d: str) -> DataFrame:
    return approval.hydrate_pending(events(spark, d), source_entities(spark, d)).select("submission_id", "doc_id", "n_cards")


# ---- sinks and streams -------------------------------------------------------------------------------------------


@register("""SELECT 'doc_' || source || '_' || lang AS id, arg_max('new ' || doc_id, doc_id) AS label FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL GROUP BY source, lang
  UNION ALL SELECT 'old_' || r_regionkey, r_name FROM region""")
def upsert_entities(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("source is not null and lang is not null")
    new = docs.select(F.concat_ws("_", F.lit("Doc"), "source", "lang").alias("id"), F.concat(F.lit("new "), F.col("doc_id").cast("string")).alias("label"), F.col("doc_id").alias("seq"))
    region = table(spark, d, "region")
    existing = docs.select(F.concat_ws("_", F.lit("doc"), "source", "lang").alias("id"), F.lit("old").alias("label")).distinct().unionByName(region.select(ref("old", "r_regionkey").alias("id"), F.col("r_name").alias("label")))
    return writers.upsert_entities(existing, new).select(F.lower("id").alias("id"), "label")


_REG_IRI = "https://ontology.example.org/regulatory/"


@register(f"""WITH {REG_TRIPLES}, z AS (SELECT *, replace(replace(replace(s, 'rege:', '{_REG_IRI}entity/'), 'reg:', '{_REG_IRI}'), 'rdf:', 'x') AS s1, replace(replace(replace(replace(p, 'reg:', '{_REG_IRI}'), 'rdf:', 'http://www.w3.org/1999/02/22-rdf-syntax-ns#'), 'rdfs:', 'http://www.w3.org/2000/01/rdf-schema#'), '_', '_') AS p1 FROM t)
  SELECT '<' || s1 || '> <' || p1 || '> ' || CASE WHEN o_kind = 'iri' THEN '<' || replace(replace(o, 'rege:', '{_REG_IRI}entity/'), 'reg:', '{_REG_IRI}') || '>' ELSE '"' || replace(o, '"', '\\"') || '"' || coalesce('@' || o_lang, '') END || ' .' AS line FROM z""")
def triple_lines(spark: SparkSession, d: str) -> DataFrame:
    return writers.triple_lines(reg(spark, d), PACKS["regulatory"])


@register(f"""WITH {VAULT}, pr AS (SELECT file, string_agg(chr(10) || '  ' || prop || ': "' || CASE WHEN prop = 'spokenBy' THEN value ELSE '[[' || value || ']]' END || '"', ''
      ORDER BY list_position(['codedAs', 'supportsTheme', 'spokenBy', 'mood', 'hasSubtheme'], prop)) AS listed FROM gp GROUP BY file),
  w AS (SELECT g.*, coalesce(text, '') AS body, listed, regexp_replace(lower(id), '[^a-z0-9_]', '_', 'g') AS slug FROM g LEFT JOIN documents ON i = doc_id LEFT JOIN pr USING (file)),
  j AS (SELECT *, CAST(to_json(class) AS VARCHAR) AS jc, CAST(to_json(id) AS VARCHAR) AS ji, CAST(to_json(label) AS VARCHAR) AS jl, CAST(to_json(source_document) AS VARCHAR) AS jd, CAST(to_json(source_section) AS VARCHAR) AS js, CAST(to_json(body) AS VARCHAR) AS jt FROM w)
  SELECT slug || '.md' AS file, replace('---~class: ' || jc || '~id: ' || ji || '~label: ' || jl || '~uri: "https://ontology.example.org/thematic/entity/' || id || '"~source_document: ' || jd || '~source_section: ' || js
    || CASE WHEN i IS NULL THEN '' ELSE '~source_page: 1' END || '~source_text: ', '~', chr(10)) || jt || chr(10) || CASE WHEN listed IS NULL THEN 'properties: {{}}' ELSE 'properties:' || listed END
    || replace('~validation: PENDING~---~~## ' || label || '~~**Class:** `tha:' || class || '`~**Source:** ' || CASE WHEN i IS NULL THEN source_section || ' — ' || source_document ELSE '[' || source_section || ' — page 1](evidence/' || id || '.pdf#page=1)' END || '~~> ', '~', chr(10))
    || body || replace('~~*Extracted automatically. Review before merging.*~', '~', chr(10)) AS markdown FROM j""")
def entity_markdown(spark: SparkSession, d: str) -> DataFrame:
    return writers.entity_markdown(clean(spark, d), THEMATIC)


@register(f"{LINT} SELECT '{{\"severity\":\"' || severity || '\",\"rule\":\"' || rule || '\",\"entity_id\":\"' || entity_id || '\",\"file\":\"' || file || '\"}}' AS json FROM f")
def findings_json(spark: SparkSession, d: str) -> DataFrame:
    return writers.as_json(findings(spark, d).select("severity", "rule", "entity_id", "file"))


@register(f"WITH {VAULT} SELECT regexp_replace(lower(id), '[^a-z0-9_]', '_', 'g') || '.md' AS file, class, id, label FROM g")
def read_vault(spark: SparkSession, d: str) -> DataFrame:
    """Records rendered as Markdown and parsed again."""
    made = writers.entity_markdown(clean(spark, d), THEMATIC).select("file", F.col("markdown").alias("text"))
    return readers.parse_records(made).select("file", "class", "id", "label")


@register("SELECT role AS speaker, count(*) AS n FROM conversations WHERE regexp_matches(text, '\\S') GROUP BY role")
def stream_ingest(spark: SparkSession, d: str) -> DataFrame:
    """Transcripts written as files, streamed through the ingest once, and read back."""
    from .streaming import inbox as stream

    base = f"{shared_dir(spark)}/ingest-{uuid.uuid4().hex}"
    lines = table(spark, d, "conversations").where(F.regexp_like("text", F.lit(r"\S"))).select(F.concat(F.col("role"), F.lit(": "), F.trim(F.regexp_replace("text", r"[:\s]+", " "))))
    lines.write.text(f"{base}/inbox")
    stream.start(spark, f"{base}/inbox", f"{base}/out", f"{base}/state", ingest.rule_extractor, THEMATIC, once=True).awaitTermination()
    out = cut(stream.current_entities(spark, f"{base}/out").groupBy(F.get("properties.spokenBy", F.lit(0)).alias("speaker")).agg(F.count(F.lit(1)).alias("n")))
    remove(spark, base)
    return out


@register(r"""WITH t AS (SELECT * FROM conversations WHERE regexp_matches(text, '[^\s:]') AND conv_id % 5 <> 0 AND (conv_id % 3 <> 0 OR role = 'user')) SELECT role AS speaker, count(*) AS n FROM t GROUP BY role""")
def redelivered_entities(spark: SparkSession, d: str) -> DataFrame:
    """Transcripts delivered in two batches, the second one twice: it brings the users' turns of every third conversation, together with an older file of the
    same id that has all turns, and an empty text for every fifth."""
    from .streaming import inbox as stream

    line = F.concat(F.col("role"), F.lit(": "), F.trim(F.regexp_replace("text", r"[:\s]+", " ")))
    turns = table(spark, d, "conversations").where(F.regexp_like("text", F.lit(r"[^\s:]"))).select("conv_id", "role", F.struct("turn", line.alias("line")).alias("t"))
    told = lambda rows: rows.groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list("t")), lambda t: t["line"]), "\n").alias("text"))
    name = lambda sep: F.concat(F.lit(f"c{sep}"), F.col("conv_id").cast("string"), F.lit(".txt"))
    file = lambda rows, sep, text, day: rows.select(fx.derive_doc_id(readers.stem(name(sep))).alias("doc_id"), name(sep).alias("file"), text.alias("text"), F.lit(f"2024-01-0{day}").cast("timestamp").alias("modified"))
    every, users = told(turns), told(turns.where("role = 'user'")).where("conv_id % 3 = 0 and conv_id % 5 <> 0")
    again = file(users, " ", F.col("text"), 3).unionByName(file(every.where("conv_id % 3 = 0 and conv_id % 5 <> 0"), "_", F.col("text"), 2)).unionByName(file(every.where("conv_id % 5 = 0"), "-", F.lit("nothing was said"), 3))
    out = f"{shared_dir(spark)}/redelivered-{uuid.uuid4().hex}"
    try:
        for batch, docs in ((0, file(every, "-", F.col("text"), 1)), (1, again), (1, again)):
            stream.ingest_batch(docs, batch, out, ingest.rule_extractor, THEMATIC)
        return cut(stream.current_entities(spark, out).groupBy(F.get("properties.spokenBy", F.lit(0)).alias("speaker")).agg(F.count(F.lit(1)).alias("n")))
    finally:
        remove(spark, out)


def flagship(spark: SparkSession, d: str) -> DataFrame:
    return REGISTRY["cq_regulatory_3"](spark, d)
