"""WARC derivatives: linked metadata and conversion records from response records.

Every response yields two records that refer to it: a `metadata` record (source
headers, title, links, digests, as warc-fields) and a `conversion` record (plain text).
Each keeps WARC-Refers-To with the response's record id, WARC-Target-URI, WARC-Date and
the source's payload digest, and carries a digest of its own block. Record ids are
name-based: a UUID cut from a SHA-256 of the response id and the record type, so a
rebuilt record has the same id.

Responses come from a table of pages or from WARC files (`read_responses`), and records
can be written as WARC files (`write_records`). Files are read as bytes by Content-Length,
one file by one task, which must hold it. Pages are taken apart in one pass, in time
linear in their length; character references, named and numeric, become their characters
in text, title and links. A page is never looked at outside its row.

Defined cases: a null payload is an empty one; a null URL leaves WARC-Target-URI out, and
line ends in a URL are percent-encoded; a null header block has no source headers; repeated
responses give repeated records; pages without a body give a conversion record with an
empty block; an empty table gives no records. Columns of the responses named as one of
the records' own give way to them.
"""

from __future__ import annotations

import gzip
import hashlib
import html as references
import io
import re
from collections.abc import Iterator
from typing import BinaryIO

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

DATE = "1970-01-01T00:00:00Z"
VERSION, NEXT = re.compile(rb"WARC/1\.[01]\s*"), re.compile(rb"\r?\n(WARC/1\.[01]\r?\n)")
CHARSET = re.compile(rb"charset\s*=\s*[\"']?([A-Za-z0-9_.:-]+)", re.I)
BATCH_BYTES = 8 << 20  # of blocks handed on together
RECORD = pa.schema([("headers", pa.string()), ("block", pa.string()), ("complete", pa.bool_()), ("raw", pa.binary())])

_HIDDEN = re.compile(r"<!--|<(script|style)\b", re.I)
_CLOSE = {"<!--": re.compile("-->"), "script": re.compile(r"</script\s*>", re.I), "style": re.compile(r"</style\s*>", re.I)}
#: Tags at which a line ends.
_BREAK = re.compile(r"<(?:br|/p|/div|/h[1-6]|/li|/tr|/title)\b[^>]*>", re.I)
_TAG = re.compile(r"<[^>]*>")
_ANCHOR, _HREF = re.compile(r"<a\s", re.I), re.compile(r"href\s*=\s*\"", re.I)
_TITLE, _TITLE_END = re.compile(r"<title[^>]*>", re.I), re.compile(r"</title\s*>", re.I)
_BLANKS, _LINES = re.compile(r"[ \t\r]+"), re.compile(r" ?\n[ \n]*")


def plain_text(page: str) -> str:
    """Text of a page: scripts, styles and comments go, tags become spaces or line ends, blank runs become one."""
    out, at, seek = [], 0, 0
    unclosed: set[str] = set()
    while found := _HIDDEN.search(page, seek):
        kind = (found.group(1) or "<!--").lower()
        end = None if kind in unclosed else _CLOSE[kind].search(page, found.end())
        if end:
            out += [page[at : found.start()], " "]
            at = seek = end.end()
        else:
            unclosed.add(kind)
            seek = found.end()
    text = "".join([*out, page[at:]])
    # up to the last end of a tag every beginning of one finds an end, so each search is short
    last = text.rfind(">") + 1
    text = _TAG.sub(" ", _BREAK.sub("\n", text[:last])) + text[last:]
    text = references.unescape(text).replace("\xa0", " ")
    return _LINES.sub("\n", _BLANKS.sub(" ", text)).strip(" \n")


def page_title(page: str) -> str:
    begin = _TITLE.search(page)
    end = begin and _TITLE_END.search(page, begin.end())
    return re.sub(r"[\r\n\t ]+", " ", references.unescape(page[begin.end() : end.start()])) if end else ""


def page_links(page: str) -> list[str]:
    """The double-quoted href of each anchor, in order."""
    out, at = [], 0
    while found := _ANCHOR.search(page, at):
        end = page.find(">", found.end())
        href = _HREF.search(page, found.end() - 1, len(page) if end < 0 else end + 1)
        close = page.find('"', href.end()) if href else -1
        if close >= 0:
            out.append(re.sub(r"[\r\n]+", " ", references.unescape(page[href.end() : close])))
            at = close + 1
        elif end < 0 or href:
            break
        else:
            at = end + 1
    return out


PARTS = T.StructType().add("text", "string").add("title", "string").add("links", T.ArrayType(T.StringType()))


@F.pandas_udf(PARTS)
def page_parts(pages: pd.Series) -> pd.DataFrame:
    return pd.DataFrame({"text": pages.map(plain_text), "title": pages.map(page_title), "links": pages.map(page_links)})


def uuid_urn(name: Column) -> Column:
    h = F.sha2(name.cast("binary"), 256)
    part = lambda a, n: F.substring(h, a, n)
    return F.concat(F.lit("urn:uuid:"), part(1, 8), F.lit("-"), part(9, 4), F.lit("-8"), part(14, 3), F.lit("-8"), part(18, 3), F.lit("-"), part(21, 12))


def digest(block: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(block.cast("binary"), 256))


def responses_from_pages(pages: DataFrame) -> DataFrame:
    """Response records of (page_id, url, html) rows: record_id, target_uri, date, http_headers, payload, payload_digest."""
    html = F.coalesce("html", F.lit(""))
    headers = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(html).cast("string"), F.lit("\r\n"))
    return pages.select(
        "page_id",
        uuid_urn(F.concat_ws("|", F.lit("response"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.coalesce("url", F.lit("")))).alias("record_id"),
        F.col("url").alias("target_uri"),
        F.lit(DATE).alias("date"),
        headers.alias("http_headers"),
        html.alias("payload"),
        digest(html).alias("payload_digest"),
    )


def derive(responses: DataFrame) -> DataFrame:
    """Two records for each response, with the response's columns that identify it.

    record_type, record_id, refers_to, target_uri, date, payload_digest (the source's),
    block_digest, content_length, headers (the WARC header block) and block.
    """
    own = {"record_type", "content_type", "block", "refers_to", "block_digest", "content_length", "headers"}
    keep = [c for c in responses.columns if c not in own | {"payload", "http_headers"}]
    payload = F.coalesce("payload", F.lit(""))
    parted = responses.select(*keep, "http_headers", F.octet_length(payload).alias("__length"), page_parts(payload).alias("__page"))
    source = F.filter(F.split(F.coalesce("http_headers", F.lit("")), "\r\n"), lambda x: x != "")
    fields = F.concat(
        F.transform(source, lambda x: F.concat(F.lit("source-header: "), x)),
        F.array(F.concat(F.lit("title: "), "__page.title"), F.concat(F.lit("payload-digest: "), F.col("payload_digest")), F.concat(F.lit("payload-length: "), F.col("__length").cast("string"))),
        F.transform("__page.links", lambda x: F.concat(F.lit("outlink: "), x)),
    )
    meta = F.concat(F.array_join(fields, "\r\n"), F.lit("\r\n"))
    kinds = F.array(
        F.struct(F.lit("metadata").alias("record_type"), F.lit("application/warc-fields").alias("content_type"), meta.alias("block")),
        F.struct(F.lit("conversion").alias("record_type"), F.lit("text/plain").alias("content_type"), F.col("__page.text").alias("block")),
    )
    out = parted.select(*keep, F.explode(kinds).alias("__k")).select(*[F.col(c) for c in keep if c != "record_id"], F.col("record_id").alias("refers_to"), "__k.*")
    out = out.withColumn("record_id", uuid_urn(F.concat_ws("|", "record_type", "refers_to")))
    out = out.withColumn("block_digest", digest(F.col("block"))).withColumn("content_length", F.octet_length("block").cast("long"))
    line = lambda name, value: F.concat(F.lit(name + ": "), value, F.lit("\r\n"))
    uri = F.coalesce(line("WARC-Target-URI", F.replace(F.replace("target_uri", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))), F.lit(""))
    headers = F.concat(
        F.lit("WARC/1.1\r\n"), line("WARC-Type", F.col("record_type")), line("WARC-Record-ID", F.concat(F.lit("<"), "record_id", F.lit(">"))),
        line("WARC-Refers-To", F.concat(F.lit("<"), "refers_to", F.lit(">"))), uri, line("WARC-Date", F.col("date")), line("WARC-Payload-Digest", F.col("payload_digest")),
        line("WARC-Block-Digest", F.col("block_digest")), line("Content-Type", F.col("content_type")), line("Content-Length", F.col("content_length").cast("string")),
    )
    return out.withColumn("headers", headers)


def write_records(records: DataFrame, path: str) -> None:
    """Records as WARC text files: header block, blank line, block, two line ends."""
    records.select(F.concat("headers", F.lit("\r\n"), "block").alias("value")).write.option("lineSep", "\r\n\r\n").text(path)


def records_in(stream: BinaryIO) -> Iterator[tuple[bytes, bytes, bool]]:
    """(header block, block, complete) of the records of a WARC stream of version 1.0 or 1.1, which is read by Content-Length.

    A record without a usable length, or one that is longer than the file, is not complete and ends before the next
    version line; what lies between records is passed over.
    """
    line = stream.readline()
    while line:
        if not VERSION.fullmatch(line):
            line = stream.readline()
            continue
        head = [line]
        while (line := stream.readline()) and line.strip():
            head.append(line)
        found = [h.split(b":", 1)[1].strip() for h in head if h.lower().startswith(b"content-length:")]
        size = int(found[0]) if found and found[0].isdigit() else None
        start = stream.tell()
        block = stream.read() if size is None else stream.read(size)
        whole = size is not None and len(block) == size
        if not whole and (cut := NEXT.search(block)):
            block = block[: cut.start()]
            stream.seek(start + cut.end() - len(cut[1]))
        yield b"".join(head), block, whole
        line = stream.readline()


def read_records(spark: SparkSession, path: str, version: str | None = None) -> DataFrame:
    """headers, block (as UTF-8 text), complete and raw (the block's bytes) of each record of WARC files, plain or gzip, of one version or both.

    Files are the unit of work: one is read as bytes and walked record by record, so a block may hold anything, version lines
    as well. complete is false where the file ends before the block does, or its length is no number.
    """
    files = spark.read.format("binaryFile").load(path).select("content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch["content"]:
                raw = content.as_py()
                rows, size = [], 0
                for head, block, whole in records_in(gzip.open(io.BytesIO(raw)) if raw[:2] == b"\x1f\x8b" else io.BytesIO(raw)):
                    if version is None or head.startswith(version.encode()):
                        rows.append((head.decode("utf-8", "replace"), block.decode("utf-8", "replace"), whole, block))
                        size += len(block)
                    if len(rows) == 256 or size > BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist([dict(zip(RECORD.names, r, strict=True)) for r in rows], RECORD)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist([dict(zip(RECORD.names, r, strict=True)) for r in rows], RECORD)

    return files.mapInArrow(run, "headers string, block string, complete boolean, raw binary")


def header(name: str) -> Column:
    """The value of a header line in headers, empty where there is none."""
    return F.trim(F.regexp_extract("headers", rf"(?im)^{re.escape(name)}:[ \t]*([^\r\n]*)", 1))


def page_text(http_headers: bytes, payload: bytes) -> str:
    """The payload in the charset that the HTTP headers or the page's first bytes name, else UTF-8, else Latin-1."""
    named = CHARSET.search(http_headers) or CHARSET.search(payload[:2048])
    for charset in (named[1].decode("ascii") if named else "utf-8", "utf-8"):
        try:
            return payload.decode(charset)
        except (LookupError, UnicodeDecodeError):
            pass
    return payload.decode("latin-1")


def read_responses(spark: SparkSession, path: str, version: str | None = None) -> DataFrame:
    """Response records of WARC files, as `derive` takes them: record_id, target_uri, date, http_headers, payload, payload_digest.

    The payload is text in the page's own charset. A response without a payload digest gets the SHA-256 of its payload's
    bytes; records cut short are left out.
    """
    found = read_records(spark, path, version).where((F.lower(header("WARC-Type")) == "response") & F.col("complete"))
    strip = lambda c: F.regexp_replace(c, "^<|>$", "")
    named = found.select(strip(header("WARC-Record-ID")).alias("record_id"), F.nullif(strip(header("WARC-Target-URI")), F.lit("")).alias("target_uri"), header("WARC-Date").alias("date"), F.nullif(header("WARC-Payload-Digest"), F.lit("")).alias("payload_digest"), "raw")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [r.as_py().partition(b"\r\n\r\n") for r in batch["raw"]]
            heads = [h + (b"\r\n" if sep else b"") for h, sep, _ in parts]
            digests = [d or "sha256:" + hashlib.sha256(p).hexdigest() for d, (_, _, p) in zip(batch["payload_digest"].to_pylist(), parts, strict=True)]
            texts = [page_text(h, p) for h, _, p in parts]
            yield pa.RecordBatch.from_arrays([batch["record_id"], batch["target_uri"], batch["date"], pa.array([h.decode("latin-1") for h in heads], pa.string()), pa.array(texts, pa.string()), pa.array(digests, pa.string())], names=["record_id", "target_uri", "date", "http_headers", "payload", "payload_digest"])

    return named.mapInArrow(run, "record_id string, target_uri string, date string, http_headers string, payload string, payload_digest string")
