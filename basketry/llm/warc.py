"""WARC archives: a writer and a salvage reader.

Writer: one record per page, written with Spark's text writer, so files appear
through Spark's commit protocol in any store Spark writes to.  Plain archives
take the record's closing blank lines as line separator.  Gzip archives hold
one member per record, so that damage costs one record: the members are
written as raw bytes, and the line separator is their last byte, a zero
(the high byte of a length under 16 MB).  Pages with equal
payloads: the one with the smallest id is a ``response``, the others are
``revisit`` records that refer to it and carry the HTTP head only.  Payloads
are compared by SHA-1 and length; the smallest id is found by a
pre-aggregated group, so a payload that a third of all pages share is one
row before the shuffle.

Reader: takes (path, content) rows as ``binaryFile`` gives them; plain or
gzip, one member per record or many records per member.  Every record's
version line, head, length, closing blank lines and payload digest are
checked; a digest in a form that is not known counts as unchecked.  After a failed check the reader looks for the next gzip member or
version line that starts a valid record, goes on there and logs the bytes in
between as a quarantined gap.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.llm.text import whole

VERSION = "WARC/1.1"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
CLOSE = b"\r\n\r\n"
_VERSION_LINE = re.compile(rb"WARC/1\.[01]\r\n")
_HTTP_END = re.compile(rb"\r?\n\r?\n")
_MEMBER = b"\x1f\x8b\x08"


def base32_of_hex(digest: Column) -> Column:
    """Base32 of a hexadecimal SHA-1: 5 hex digits are 4 base32 digits."""
    parts = []
    for i in range(8):
        n = F.conv(F.substring(digest, 5 * i + 1, 5), 16, 10).cast("int")
        for shift in (15, 10, 5, 0):
            parts.append(F.lit(BASE32).substr(F.shiftright(n, shift).bitwiseAND(31) + 1, F.lit(1)))
    return F.concat(*parts)


def records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", text_col: str = "html",
            min_bytes: int = 0, date: str = "2000-01-01T00:00:00Z") -> DataFrame:
    """(record string): one WARC record per row, without its closing lines.

    Null payload: empty.  Null url: an empty target.  Rows without an id are
    always responses and nothing refers to them; rows that share the smallest
    id of a payload are responses all.  Payloads under ``min_bytes`` are
    never revisited.
    """
    payload = whole(F.col(text_col))
    rows = pages.select(F.col(id_col).cast("long").alias("id"), whole(F.col(url_col)).alias("url"),
                        payload.alias("payload"), F.sha1(payload.cast("binary")).alias("sha"),
                        F.octet_length(payload).cast("long").alias("n"))
    first = (rows.filter(F.col("n") >= min_bytes).groupBy("sha", "n").agg(F.min("id").alias("first"), F.count("*").alias("c"))
             .filter("c > 1").select("sha", "n", "first"))
    rows = rows.join(first, ["sha", "n"], "left").withColumn("again", F.coalesce(F.col("id") > F.col("first"), F.lit(False)))
    crlf = F.lit("\r\n")
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
                    F.col("n").cast("string"), F.lit("\r\n\r\n"))
    block = F.when(F.col("again"), head).otherwise(F.concat(head, F.col("payload")))
    name = F.coalesce(F.col("id").cast("string"), F.lit("none"))
    lines = [
        F.lit(VERSION),
        F.concat(F.lit("WARC-Type: "), F.when(F.col("again"), "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: <urn:page:"), name, F.lit(">")),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace("url", r"[\x00-\x20\x7F]", "%20")),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), base32_of_hex(F.col("sha"))),
        F.when(F.col("again"), F.concat(
            F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: <urn:page:"),
            F.col("first").cast("string"), F.lit(">"))),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
    ]
    return rows.select(F.concat(F.concat_ws("\r\n", *lines), crlf, crlf, block).alias("record"))


def write_archives(pages: DataFrame, path: str, compression: str = "gzip", per_file: int = 1000, **how) -> None:
    """Write ``pages`` as archives of at most ``per_file`` records each;
    ``gzip``: one member per record, other codecs are Spark's, over whole files."""
    rows = records(pages, **how)
    if compression == "gzip":
        rows = rows.select(F.col("record").cast("binary").alias("record")).mapInArrow(_members, "record binary")
        rows, sep, compression = rows.select(F.col("record").cast("string").alias("record")), "\0", "none"
    else:
        sep = CLOSE.decode()
    rows.write.option("lineSep", sep).option("compression", compression).option("maxRecordsPerFile", per_file).text(path)


def _packed(record: bytes) -> bytes:
    """The record and its closing lines as a gzip member, without its last
    byte, which is zero.  A record of 16 MB or more is followed by an empty
    member, whose last byte is."""
    out = gzip.compress(record + CLOSE, 6, mtime=0)
    if out[-1]:
        out += gzip.compress(b"", 6, mtime=0)
    return out[:-1]


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, 500):
            part = [_packed(r.as_py()) for r in b.column(0).slice(at, 500)]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.binary())], ["record"])


def _heads(lines: list[bytes]) -> dict[str, str] | None:
    """Names and values; a line that starts with white space goes on with the
    value before it."""
    out, joined = {}, []
    for line in lines:
        if joined and line[:1] in (b" ", b"\t"):
            joined[-1] += b" " + line.strip()
        else:
            joined.append(line)
    for line in joined:
        key, colon, value = line.partition(b":")
        if not colon:
            return None
        out[key.strip().decode("utf-8", "replace").lower()] = value.strip().decode("utf-8", "replace")
    return out


def _agrees(told: str, payload: bytes) -> bool:
    """False if ``told`` (algorithm:value, hexadecimal or base32 in any case)
    is known to be another payload's digest."""
    name, _, value = told.partition(":")
    name, value = name.strip().lower().replace("-", ""), value.strip().rstrip("=").upper()
    if name not in ("md5", "sha1", "sha256", "sha512"):
        return True
    digest = hashlib.new(name, payload).digest()
    forms = (digest.hex().upper(), base64.b32encode(digest).decode().rstrip("="))
    return value in forms or len(value) not in map(len, forms)


def _record(data: bytes, at: int) -> tuple[dict | None, int, str]:
    """The record at ``at`` and its end, or None and what is wrong."""
    version = _VERSION_LINE.match(data, at)
    if not version:
        return None, at, "no version line"
    end = data.find(CLOSE, version.end() - 2)
    if end < 0:
        return None, at, "unfinished head"
    head = _heads(data[version.end():end].split(b"\r\n"))
    if head is None or not head.get("content-length", "").isdigit():
        return None, at, "bad head"
    start, size = end + 4, int(head["content-length"])
    stop = start + size
    if data[stop:stop + 4] != CLOSE:
        return None, at, "bad length"
    block, kind, told = data[start:stop], head.get("warc-type", ""), head.get("warc-payload-digest", "")
    http, payload, n = None, block, size
    if head.get("content-type", "").startswith("application/http"):
        cut = _HTTP_END.search(block)
        if not cut:
            return None, at, "bad HTTP head"
        http = _heads(re.split(rb"\r?\n", block[:cut.start()])[1:]) or {}
        payload = block[cut.end():]
        n = len(payload)
    if kind == "revisit":
        digest = told.partition(":")[2]
        n = int(http["content-length"]) if http and http.get("content-length", "").isdigit() else None
        payload = None
    else:
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        if not _agrees(told, payload):
            return None, at, "bad digest"
    return {"kind": kind, "record_id": head.get("warc-record-id"), "url": head.get("warc-target-uri"),
            "payload_bytes": n, "payload_digest": digest, "refers_to": head.get("warc-refers-to"),
            "payload": payload}, stop + 4, ""


def _plain(data: bytes, base: int = 0) -> Iterator[dict]:
    """Records and gaps of uncompressed bytes; offsets count from ``base``."""
    at = 0
    while at < len(data):
        got, end, wrong = _record(data, at)
        if got is None:
            end = len(data)
            for m in _VERSION_LINE.finditer(data, at + 1):
                if _record(data, m.start())[0] is not None:
                    end = m.start()
                    break
            got = {"kind": "gap", "problem": wrong}
        yield got | {"offset": base + at, "length": end - at}
        at = end


def _member(data: bytes, at: int) -> tuple[bytes, int]:
    """What the gzip member at ``at`` holds, and its end; end 0: damaged, the
    bytes before the damage are given."""
    d, out, pos = zlib.decompressobj(31), [], at
    try:
        while not d.eof and pos < len(data):
            out.append(d.decompress(data[pos:pos + 65536]))
            pos += 65536
    except zlib.error:
        # the failing call gave nothing: go over its bytes one by one
        d = zlib.decompressobj(31)
        out = [d.decompress(data[at:pos])]
        try:
            for k in range(pos, min(pos + 65536, len(data))):
                out.append(d.decompress(data[k:k + 1]))
        except zlib.error:
            pass
        return b"".join(out), 0
    if not d.eof:
        return b"".join(out), 0
    return b"".join(out), min(pos, len(data)) - len(d.unused_data)


def _starts_record(data: bytes, at: int) -> bool:
    try:
        return zlib.decompressobj(31).decompress(data[at:at + 4096], 16).startswith(b"WARC/1.")
    except zlib.error:
        return False


def salvage(data: bytes) -> Iterator[dict]:
    """All valid records of an archive's bytes in order, and the gaps.  In a
    gzip archive offset and length are those of the member; ``inner`` is the
    place inside it."""
    if not data.startswith(_MEMBER) and not (_MEMBER in data and not _VERSION_LINE.search(data)):
        yield from _plain(data)
        return
    at = 0
    while at < len(data):
        held, end = _member(data, at) if data.startswith(_MEMBER, at) else (b"", 0)
        if end:
            for r in _plain(held):
                yield r | {"inner": r["offset"], "offset": at, "length": end - at}
            at = end
            continue
        # whole records before the damage are still good
        saved = [r for r in _plain(held) if r["kind"] != "gap"]
        nxt = data.find(_MEMBER, at + 1)
        while nxt >= 0 and not _starts_record(data, nxt):
            nxt = data.find(_MEMBER, nxt + 1)
        end = nxt if nxt >= 0 else len(data)
        for r in saved:
            yield r | {"inner": r["offset"], "offset": at, "length": end - at}
        yield {"kind": "gap", "problem": "damaged member", "offset": at, "length": end - at}
        at = end


_READ = ("path string, offset long, inner long, length long, kind string, record_id string, url string, "
         "payload_bytes long, payload_digest string, refers_to string, problem string, payload binary")


def read_archives(files: DataFrame, payloads: bool = True) -> DataFrame:
    """Records (kind: their WARC type) and quarantined gaps (kind ``gap``,
    with ``problem``) of archive files ``files(path, content)``.  An empty or
    null content gives no rows."""
    names = [c.split()[0] for c in _READ.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, content in zip(b["path"], b["content"]):
                part: list[dict] = []
                for r in salvage(content or b""):
                    part.append({"path": path} | r | ({} if payloads else {"payload": None}))
                    if len(part) >= 500:
                        yield _frame(part, names)
                        part = []
                if part:
                    yield _frame(part, names)

    return files.select("path", "content").mapInPandas(run, _READ)


def _frame(rows: list[dict], names: list[str]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=names)
    return frame.astype({c: "Int64" for c in ("offset", "inner", "length", "payload_bytes")}).astype(object).where(frame.notna(), None)


def load_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """``read_archives`` over the files of a folder.  Each file is one row, so
    keep archives to a size that a task can hold, as ``write_archives`` does."""
    return read_archives(spark.read.format("binaryFile").load(path), payloads)


def page_of(name: Column) -> Column:
    """The page id in a record id; null if it had none."""
    return F.regexp_extract(name, "<urn:page:(-?[0-9]+)>", 1).try_cast("long")
