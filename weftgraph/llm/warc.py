"""WARC archives: writing captures, reading them back and assembling transactions.

Each record is a gzip member of its own, so other readers can go to any record. Records are built by column expressions,
compressed in Arrow batches and written by Spark's text writer, whose output is any bytes: every member
ends in a zero byte, the high byte of its size, and that byte is the writer's line separator. So archives go to any file system
that Spark knows, a task's file appears only when the task commits, and a retried task leaves no half file.
Pages are dealt to files by their bytes. Reading decompresses a file member by member, parses by Content-Length and gives a
row with an error for what it can't read. A capture's request, response (or revisit) and metadata
records are joined through their WARC-Concurrent-To identifiers.

Payloads are hashed in one pass of their own, of which ids, digests and sizes are kept; equal payloads are found by
digest, with counts combined before the shuffle. One join then brings each page its digest and role.
"""

from __future__ import annotations

import base64
import hashlib
import math
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, partitions, small

CRLF = "\r\n"
DATE = "2024-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
RECORD = "record_id string, type string, concurrent_to string, page_id bigint, uri string, digest string, payload_bytes bigint, refers_to bigint, content string, error string"
#: Payload bytes of an archive file, about; a record that is larger is not split.
FILE_BYTES = 64 << 20
#: The gzip member of nothing. It ends in a zero byte, as the member of a record of 16 MB or more may not.
NOTHING = zlib.compress(b"", wbits=31)


def base32_sha1(payload: Column) -> Column:
    """The payload's SHA-1 in upper-case base32: 20 bits, five hex digits, are four base32 digits."""
    hexed = F.sha1(payload)
    fours = [F.lpad(F.conv(F.substring(hexed, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*fours), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _record_id(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("|", *parts).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-"), F.substring(h, 13, 4), F.lit("-"), F.substring(h, 17, 4), F.lit("-"), F.substring(h, 21, 12), F.lit(">"))


def _record(headers: list[tuple[str, Column | None]], block: Column) -> Column:
    """One record without its closing CR LF CR LF; headers that are null are left out."""
    lines = [F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(CRLF)), F.lit("")) for name, value in headers]
    return F.concat(F.lit(f"WARC/1.0{CRLF}"), *lines, F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit(CRLF * 2), block)


def payload_roles(pages: DataFrame, least_bytes: int = 0, id_col: str = "page_id", payload_col: str = "html") -> DataFrame:
    """(page_id, x, digest, n, first): a 64-bit hash of each page's payload, its digest and bytes, and the smallest page id with an
    equal payload, for payloads of at least ``least_bytes`` bytes; smaller payloads stand for themselves."""
    return _roles(_hashed(pages, id_col, payload_col), least_bytes)


#: Rows with one id and payload that a task gets at most; more are dealt to several.
REPEATS = 1000
#: Such ids and payloads that are sent to all tasks at most.
MOST_SENT = 200_000


def _hashed(pages: DataFrame, id_col: str, payload_col: str) -> DataFrame:
    payload = F.coalesce(F.col(payload_col), F.lit(""))
    return pages.select(F.col(id_col).alias("page_id"), F.xxhash64(payload).alias("x"), base32_sha1(payload).alias("digest"), F.octet_length(payload).cast("bigint").alias("n"))


def _roles(hashed: DataFrame, least_bytes: int) -> DataFrame:
    rows = hashed.distinct()
    firsts = rows.where(F.col("n") >= least_bytes).groupBy("digest").agg(F.min("page_id").alias("first"))
    return rows.join(firsts, "digest", "left").select("page_id", "x", "digest", "n", F.coalesce("first", "page_id").alias("first"))


def percent_encoded(url: Column) -> Column:
    """``url`` with control characters and spaces as % and two hex digits."""
    out = url
    for c in (*range(33), 127):
        out = F.replace(out, F.lit(chr(c)), F.lit(f"%{c:02X}"))
    return F.when(url.rlike(r"[\x00-\x20\x7F]"), out).otherwise(url)


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each record (with its closing CR LF CR LF) as a gzip member, less the zero byte it ends in."""
    for batch in batches:
        out = []
        for record in batch.column("value"):
            member = zlib.compress(record.as_py().encode("utf-8", "surrogatepass") + b"\r\n\r\n", 6, wbits=31)
            out.append((member if member[-1] == 0 else member + NOTHING)[:-1])
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])


def write_warc(
    pages: DataFrame, path: str, least_bytes: int = 0, file_bytes: int = FILE_BYTES, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html"
) -> None:
    """Archives of ``pages`` under ``path``: per page a request, a response or revisit, and a metadata record.

    A null payload is empty, a null url or id leaves its header out, and control characters and spaces in a url are
    percent-encoded. Rows repeated in full repeat their records. A page id may come with several payloads. Very long payloads
    are written whole; other columns are ignored; no page gives no record.
    """
    with Scratch(pages.sparkSession, "warc-roles") as scratch:
        _write(pages, path, least_bytes, file_bytes, id_col, url_col, payload_col, scratch)


def _write(pages: DataFrame, path: str, least_bytes: int, file_bytes: int, id_col: str, url_col: str, payload_col: str, scratch: Scratch) -> None:
    hashed = scratch.keep(_hashed(pages, id_col, payload_col))
    roles = _roles(hashed, least_bytes)
    files = max(partitions(pages.sparkSession), math.ceil((hashed.agg(F.sum("n")).first()[0] or 0) / file_bytes))
    payload = F.coalesce(F.col(payload_col), F.lit(""))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload"), F.xxhash64(payload).alias("x"))
    # A null id is no key of a join: it counts as 0, told apart by a flag.
    key = ["_id", "_null", "x"]
    keyed = lambda df: df.withColumns({"_id": F.coalesce("page_id", F.lit(0)), "_null": F.col("page_id").isNull()})
    # Rows that repeat an id and a payload very often are dealt to several files, and their role with them.
    hot = scratch.keep(keyed(hashed).groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / REPEATS).cast("int").alias("_parts")).where("_parts > 1"))
    hot, one = small(hot, hot.count(), MOST_SENT), F.coalesce("_parts", F.lit(1))
    dealt = keyed(rows).join(hot, key, "left").withColumn("_part", F.pmod(F.monotonically_increasing_id(), one)).repartition(files, *key, "_part")
    told = keyed(roles).drop("page_id").join(hot, key, "left").withColumn("_part", F.explode(F.sequence(F.lit(0).cast("bigint"), one.cast("bigint") - 1))).repartition(files, *key, "_part")
    r = dealt.join(told, [*key, "_part"]).select("page_id", "url", "payload", "digest", "first")
    uri = percent_encoded(F.col("url"))
    page = F.col("page_id").cast("string")
    main_id, about = _record_id(F.lit("main"), page, F.col("url"), F.col("digest")), [("WARC-Date", F.lit(DATE)), ("WARC-Target-URI", uri), ("X-Page-Id", page)]
    revisit = F.col("first") != F.col("page_id")
    status = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.octet_length("payload").cast("string"), F.lit(CRLF * 2))
    http = ("Content-Type", F.lit("application/http; msgtype=response"))
    sha = ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest")))
    response = _record([("WARC-Type", F.lit("response")), ("WARC-Record-ID", main_id), *about, sha, http], F.concat(status, F.col("payload")))
    again = _record([("WARC-Type", F.lit("revisit")), ("WARC-Record-ID", main_id), *about, ("WARC-Profile", F.lit(REVISIT_PROFILE)), ("X-Refers-To-Page-Id", F.col("first").cast("string")), sha, http], status)
    path_of = F.coalesce(F.nullif(F.regexp_extract(uri, r"^[^:]*://[^/?#]*([^#]*)", 1), F.lit("")), F.lit("/"))
    asked = F.concat(F.lit("GET "), F.coalesce(path_of, F.lit("/")), F.lit(f" HTTP/1.1{CRLF * 2}"))
    request = _record([("WARC-Type", F.lit("request")), ("WARC-Record-ID", _record_id(F.lit("request"), main_id)), ("WARC-Concurrent-To", main_id), *about, ("Content-Type", F.lit("application/http; msgtype=request"))], asked)
    fields = F.concat(F.lit("page-id: "), F.coalesce(page, F.lit("")), F.lit(CRLF))
    metadata = _record([("WARC-Type", F.lit("metadata")), ("WARC-Record-ID", _record_id(F.lit("metadata"), main_id)), ("WARC-Concurrent-To", main_id), *about, ("Content-Type", F.lit("application/warc-fields"))], fields)
    records = r.select(F.explode(F.array(request, F.when(revisit, again).otherwise(response), metadata)).alias("value"))
    members = records.mapInArrow(_members, "value binary").select(F.col("value").cast("string"))
    members.write.option("lineSep", "\x00").mode("overwrite").text(path)


def _pieces(data: bytes, block: int = 1 << 16) -> Iterator[tuple[bytes, str | None]]:
    """(bytes, error): the gzip members of an archive, or a plain archive as it is. A member that can't be decompressed gives what it had and
    an error, and ends the file, as nothing tells where the next one begins."""
    if data[:2] != b"\x1f\x8b":
        yield data, None
        return
    at, held, member, parts = 0, b"", None, []
    view = memoryview(data)
    while held or at < len(data):
        if not held:
            held, at = bytes(view[at : at + block]), at + block
        member = member or zlib.decompressobj(31)
        try:
            parts.append(member.decompress(held))
        except zlib.error as e:
            yield b"".join(parts), f"gzip: {e}"
            return
        held = member.unused_data
        if member.eof:
            yield b"".join(parts), None
            member, parts = None, []
    if member is not None:
        yield b"".join(parts), "gzip: the file ends within a member"


def _record_at(data: bytes, at: int, payloads: bool) -> tuple[tuple, int]:
    """The record that begins at ``at`` as a ``RECORD`` row, and where it ends."""
    end = data.find(b"\r\n\r\n", at)
    if end < 0:
        raise ValueError("the header does not end")
    head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in data[at:end].decode("utf-8", "replace").split(CRLF)[1:])}
    size = int(head["content-length"])
    if size < 0 or end + 4 + size > len(data):
        raise ValueError(f"the block has less than {size} bytes")
    block = memoryview(data)[end + 4 : end + 4 + size]
    kind, digest, n, content = head.get("warc-type"), head.get("warc-payload-digest"), None, None
    if kind in ("response", "revisit"):
        http = data.find(b"\r\n\r\n", end + 4, end + 4 + size)
        if http < 0:
            raise ValueError("the HTTP header does not end")
        stated = [x.split(b":", 1)[1] for x in data[end + 4 : http].split(b"\r\n") if x.lower().startswith(b"content-length:")]
        payload = block[http - end :]
        if kind == "response":
            n, digest = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
            content = bytes(payload).decode("utf-8", "replace") if payloads else None
        else:
            n, digest = int(stated[0]) if stated else None, (digest or "").removeprefix("sha1:")
    elif payloads:
        content = bytes(block).decode("utf-8", "replace")
    number = lambda k: int(head[k]) if head.get(k) else None
    ids = head.get("warc-record-id"), kind, head.get("warc-concurrent-to"), number("x-page-id"), head.get("warc-target-uri")
    return (*ids, digest, n, number("x-refers-to-page-id"), content, None), end + 4 + size


def parse_warc(data: bytes, payloads: bool = False) -> Iterator[tuple]:
    """The records of one archive's bytes, plain or gzip (one member or many), as ``RECORD`` rows. What can't be read (a malformed
    header, a record or file cut short) gives a row of type ``error`` with the reason; reading goes on at the next line that begins a
    record, or the next member."""
    wrong = lambda why: (None, "error", *[None] * 7, why)
    for piece, error in _pieces(data):
        at = piece.find(b"WARC/")
        if at < 0 and piece.strip():
            yield wrong("no record")
        while at >= 0:
            try:
                row, at = _record_at(piece, at, payloads)
                yield row
                at = piece.find(b"WARC/", at)
            except (ValueError, KeyError) as e:
                yield wrong(f"{type(e).__name__}: {e}")
                at = piece.find(b"\nWARC/", at)
                at += at >= 0
        if error:
            yield wrong(error)


def read_warc(spark: SparkSession, path: str, payloads: bool = False, batch: int = 2_000) -> DataFrame:
    """The records of the archives under ``path``, as ``RECORD`` rows; ``payloads`` adds each record's content. What can't be read
    is a row of type ``error``."""
    names = [x.split()[0] for x in RECORD.split(", ")]
    ints = ("page_id", "payload_bytes", "refers_to")

    def frame(rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=names)
        return out.astype({c: "Int64" for c in ints})

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for files in batches:
            for data in files["content"]:
                rows = []
                for record in parse_warc(data, payloads):
                    rows.append(record)
                    if len(rows) == batch:
                        yield frame(rows)
                        rows = []
                if rows:
                    yield frame(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInPandas(parse, RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: page_id, payload_bytes, payload_digest, record_type, refers_to, uri, and the structs
    response, request, metadata (null where a capture has none).

    Responses and revisits are captures; a request or metadata record joins the capture that its concurrent-to names.
    Of several requests (or metadata records) for one capture the smallest record id counts; those that
    name no known capture are left out. Captures that repeat a record id all come back.
    """
    main = records.where("type in ('response', 'revisit')")
    about = F.struct("record_id", "uri", "content")
    least = lambda kind: F.min(F.when(F.col("type") == kind, about)).alias(kind)
    sides = records.where("type in ('request', 'metadata') and concurrent_to is not null")
    sides = sides.groupBy(F.col("concurrent_to").alias("record_id")).agg(least("request"), least("metadata"))
    refers = F.when(F.col("type") == "revisit", F.col("refers_to")).alias("refers_to")
    named = ["page_id", "payload_bytes", F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"), refers, "uri"]
    return main.join(sides, "record_id", "left").select(*named, about.alias("response"), "request", "metadata")


def captures(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """``pages`` written as archives in the shared folder, read back and assembled (no payloads); the archives are removed."""
    with Scratch(pages.sparkSession, "warc") as scratch:
        write_warc(pages, f"{scratch.path}/archives", least_bytes)
        records = scratch.result(read_warc(pages.sparkSession, f"{scratch.path}/archives"))
    return assemble(records)
