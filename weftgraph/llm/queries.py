"""The registered queries: thin, each over its whole tables through its operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontam, language, line_dedup, mixing, neardup, pii, runs, simhash, spotsigs, trie, url_filter, warc
from .common import table


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), url_filter.rules_table(spark))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = decontam.find_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return hits.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op4_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.edit_report(table(spark, sf_dir, "documents"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.captures(table(spark, sf_dir, "pages"))
    n = 1 + F.col("request").isNotNull().cast("int") + F.col("metadata").isNotNull().cast("int")
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", n.alias("n_records"))


def op6_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


EXTRA_TEXT = "</s>[INST] ok [/INST]"


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-7, 0, "user", EXTRA_TEXT), (-7, 1, "assistant", EXTRA_TEXT)], turns.schema)
    read = chat.read_chats(chat.format_chats(turns.unionByName(extra)))
    said = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss_text").cast("bigint").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )


#: The key of the pseudonyms. A run that is not a check takes its own.
PII_KEY = "weftgraph"


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = pii.pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), PII_KEY)
    return made.select("doc_id", "text", "n_pii", F.array_join(F.array_sort(F.array_distinct(F.transform("pii_found", lambda x: x["kind"]))), ",").alias("kinds"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language.train(docs.where(~language.holdout()))
    named = language.identify(docs.select("doc_id", "text"), model, spans=False)
    return named.select("doc_id", language.holdout().alias("held_out"), "lang_pred", "score")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"), F.sha2("_kept", 256).alias("kept_sha256"))


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def with_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, text): every tenth document, by the CRC-32 of its id, repeats a stretch of its words to its end."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g = (h / 10).cast("bigint")

    def repeated(ws: Column) -> Column:
        n = F.size(ws)
        a = (g % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        return F.array_join(F.transform(ws, lambda w, i: F.when(i < a, w).otherwise(F.get(ws, a + (i - a) % p))), " ")

    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    bound = F.get(F.transform(F.array(words), lambda ws: F.when(F.size(ws) > 0, repeated(ws))), F.lit(0))
    return docs.select("doc_id", F.when(h % 10 == 0, F.coalesce(bound, "text")).otherwise(F.col("text")).alias("text"))


def op12_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.find_runs(with_repeats(table(spark, sf_dir, "documents")))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")))
    listed = F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\n"))), "")
    best = F.col("strongest")
    return found.select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        best["start"].alias("start"),
        best["length"].alias("length"),
        best["period"].alias("period"),
        F.expr("strongest.length * 1000 div strongest.period").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def rebuilt(turns: DataFrame) -> DataFrame:
    """(conv_id, turns): each conversation with its first 0 to 3 turns, by the CRC-32 of its id, taken from the conversation with the
    last id up to its own that 20 divides, where there is one."""
    own = trie.ordered(turns)
    h = F.crc32(F.col("conv_id").cast("string")) % 4
    heads = own.where(F.pmod("conv_id", F.lit(20)) == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, 3).alias("head"))
    met = own.withColumn("base", F.col("conv_id") - F.pmod("conv_id", F.lit(20))).join(heads, "base", "left")
    head = F.coalesce(F.slice("head", F.lit(1), h.cast("int")), F.slice("turns", 1, 0))
    return met.select("conv_id", F.concat(head, F.slice("turns", h.cast("int") + 1, F.size("turns"))).alias("turns"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(rebuilt(table(spark, sf_dir, "conversations"))).select(*trie.NODE)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = (op1_mix_sources, op2_url_filter, op3_decontamination, op4_spotsigs, op5_warc, op6_neardup, op7_chat_format, op8_pii, op9_language, op10_line_dedup, op11_simhash, op12_runs, op13_prefix_trie, pipeline)
    return {f.__name__: f for f in named}


LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP2_SQL = r"""WITH u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
  p AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
  r(h, q, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
  m AS (SELECT page_id, arg_max(h || q, length(h || q)) AS rule, arg_max(v, length(h || q)) AS verdict FROM p JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, q) GROUP BY page_id)
  SELECT p.page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM p LEFT JOIN m USING (page_id)"""

OP3_SQL = rf"""WITH d AS (SELECT doc_id, regexp_extract_all({LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
  b AS (SELECT item_id, ws, least(13, len(ws)) AS n FROM (SELECT item_id, regexp_extract_all({LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark) WHERE len(ws) > 0),
  w AS (SELECT DISTINCT item_id, n, array_to_string(ws[i:i + n - 1], ' ') AS w FROM (SELECT *, unnest(range(1, len(ws) - n + 2)) AS i FROM b)),
  dw AS (SELECT doc_id, n, i, array_to_string(ws[i:i + n - 1], ' ') AS w FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM w))),
  m AS (SELECT DISTINCT doc_id, dw.n, i, item_id FROM dw JOIN w ON dw.n = w.n AND dw.w = w.w),
  h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM m) GROUP BY doc_id),
  t AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS sha FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM m) GROUP BY doc_id)
  SELECT doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(sha, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
  FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)"""

OP5_SQL = """WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hx, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages),
  f AS (SELECT *, list_transform(range(0, 8), lambda i: CAST('0x' || substr(hx, CAST(5 * i + 1 AS BIGINT), 5) AS BIGINT)) AS vs FROM p)
  SELECT page_id, strlen(html) AS payload_bytes, array_to_string(list_transform(vs, lambda v: array_to_string(list_transform([15, 10, 5, 0], lambda b: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((v >> b) & 31) + 1 AS BIGINT), 1)), '')), '') AS payload_digest,
  CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN first <> page_id THEN first END AS refers_to, 3 AS n_records FROM f"""

OP6_SQL = rf"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({LOWERED}, '[^\x20\x09-\x0D]+') AS ws FROM documents),
  s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 2], ' ') AS sh FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 2, 1) + 1)) AS i FROM d WHERE len(ws) > 0)),
  n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
  p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
  e AS (SELECT a, b FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * k >= 85 * (x.n + y.n - k)),
  g AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
  r AS (SELECT doc_id AS doc, doc_id AS low FROM documents UNION SELECT g.b, r.low FROM r JOIN g ON r.doc = g.a)
  SELECT doc AS doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(low) AS component_id, doc = min(low) AS kept FROM r LEFT JOIN n ON n.doc_id = doc GROUP BY doc"""

OP7_SQL = r"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
  e AS (SELECT *, length(regexp_replace(regexp_replace(replace(text, '&', '&amp;'), '<(\|(?:turn|part|end|im_start|im_end|system|user|assistant)\|>|/?s>|<(?:/?SYS)>>)', '&#60;\1', 'g'), '\[(/?INST\])', '&#91;\1', 'g')) AS n,
    lag(role) OVER w AS before, lead(role) OVER w AS after FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text))
  SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256, CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
  CAST(sum(n + CASE WHEN before = role THEN 8 ELSE 9 + length(role) END + CASE WHEN after = role THEN 0 ELSE 8 END) AS BIGINT) AS formatted_chars FROM e GROUP BY conv_id"""

OP10_SQL = r"""WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
  l AS (SELECT doc_id, i, ls[i] AS line, translate(trim(ls[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM d)),
  k AS (SELECT key, max(doc_id) AS last FROM l WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
  j AS (SELECT l.*, k.key IS NULL OR last = doc_id AS keep FROM l LEFT JOIN k USING (key))
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (NOT keep) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (keep), '')) AS kept_sha256 FROM j GROUP BY doc_id"""

#: CRC-32 of a string of ASCII characters, bit by bit.
CRC32 = """xor(list_reduce(list_concat([4294967295], list_transform(string_split({}, ''), lambda x: CAST(ascii(x) AS BIGINT))),
    lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, _: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295)"""

OP12_SQL = rf"""WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws, {CRC32.format("CAST(doc_id AS VARCHAR)")} AS h FROM documents),
  v AS (SELECT *, len(ws) AS n, (h // 10) % len(ws) AS a, 1 + (len(ws) - (h // 10) % len(ws)) // (3 + (h // 10) % 8) AS q FROM d),
  w AS MATERIALIZED (SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(0, n), lambda i: ws[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % q END]) ELSE ws END AS ws FROM v),
  x AS MATERIALIZED (SELECT doc_id, n, unnest(range(0, n)) AS i, unnest(ws) AS w FROM w),
  e AS (SELECT x.doc_id, y.i - x.i AS p, x.i FROM x JOIN x y ON x.doc_id = y.doc_id AND x.w = y.w AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
  s AS MATERIALIZED (SELECT doc_id, p AS period, min(i) AS start, count(*) + p AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, p ORDER BY i) AS k FROM e) GROUP BY doc_id, p, k HAVING count(*) + p >= greatest(6, 4 * p)),
  r AS MATERIALIZED (SELECT * FROM s WHERE NOT EXISTS (SELECT 1 FROM s z WHERE z.doc_id = s.doc_id AND z.period < s.period AND z.start <= s.start AND z.start + z.length >= s.start + s.length)),
  g AS (SELECT doc_id, count(*) AS n_runs, sha256(string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period)) AS runs_sha256 FROM r GROUP BY doc_id),
  b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY CAST(length AS DOUBLE) / period DESC, start, period) AS k FROM r) WHERE k = 1),
  o AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM r),
  c AS (SELECT doc_id, sha256(string_agg(w, ' ' ORDER BY i)) AS sha FROM x ANTI JOIN o USING (doc_id, i) GROUP BY doc_id)
  SELECT w.doc_id, coalesce(n_runs, 0) AS n_runs, b.start, b.length, b.period, 1000 * b.length // b.period AS exponent_milli, coalesce(runs_sha256, sha256('')) AS runs_sha256, coalesce(c.sha, sha256('')) AS collapsed_sha256
  FROM w LEFT JOIN g USING (doc_id) LEFT JOIN b USING (doc_id) LEFT JOIN c USING (doc_id)"""

OP13_SQL = rf"""WITH t AS (SELECT conv_id, list(struct_pack(r := coalesce(role, ''), t := coalesce(text, '')) ORDER BY turn NULLS FIRST, role, text) AS ts FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
  c AS (SELECT *, {CRC32.format("CAST(conv_id AS VARCHAR)")} % 4 AS h FROM t),
  r AS (SELECT c.conv_id, list_concat(coalesce(b.ts[1:h], []), c.ts[h + 1:]) AS ts FROM c LEFT JOIN t b ON b.conv_id = c.conv_id - c.conv_id % 20),
  m AS (SELECT conv_id, len(ts) AS n, d, ts[1:d] AS p FROM (SELECT *, unnest(range(0, len(ts) + 1)) AS d FROM r)),
  g AS MATERIALIZED (SELECT p, d, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(CASE WHEN n = d THEN CAST(conv_id AS VARCHAR) END, ',' ORDER BY conv_id), '')) AS ends_sha256,
    CASE WHEN d = 0 THEN 0 ELSE (count(*) - 1) * len(regexp_extract_all(p[d].t, '[^\x20\x09-\x0D]+')) END AS saved FROM m GROUP BY p, d),
  k AS (SELECT p[1:d - 1] AS p, count(*) AS n_children FROM g WHERE d > 0 GROUP BY 1),
  l AS MATERIALIZED (SELECT g.*, coalesce(n_children, 0) AS n_children FROM g LEFT JOIN k USING (p)),
  u AS (SELECT p[1:e] AS p, sum(saved) AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves FROM (SELECT *, unnest(range(0, d + 1)) AS e FROM l) GROUP BY 1)
  SELECT l.conv_id, l.d AS depth, o.conv_id AS parent_conv_id, l.n_convs, l.n_children, u.n_leaves, CAST(u.saved_tokens AS BIGINT) AS saved_tokens, l.ends_sha256 FROM l JOIN u USING (p) LEFT JOIN l o ON l.d > 0 AND o.d = l.d - 1 AND o.p = l.p[1:l.d - 1]"""


def oracle_sql() -> dict[str, str]:
    """SQL for the operators that it can express; the others are tested against plain Python, round trips or held-out rows."""
    return {"op2_url_filter": OP2_SQL, "op3_decontamination": OP3_SQL, "op5_warc": OP5_SQL, "op6_neardup": OP6_SQL, "op7_chat_format": OP7_SQL, "op10_line_dedup": OP10_SQL, "op12_runs": OP12_SQL, "op13_prefix_trie": OP13_SQL}
