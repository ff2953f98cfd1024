"""WARC archives: one gzip member a record, written and read by Spark's own file sources.

Writing. Equal payloads of at least ``min_bytes`` are stored once: the row with the
largest id is a response, the others are revisits that refer to it. Members go
through the text sink, so archives land wherever Spark can write. The sink ends
each value with a separator byte; a gzip member ends with the high byte of its
length, which is zero below 16 MiB, so that byte *is* the separator (a longer
record is followed by an empty member, whose last byte is zero too). The files
are plain concatenations of gzip members.

Reading. The text source deals byte ranges of the files to tasks and cuts them at
the gzip magic. A task owns the candidates that start in its range and follows
the last one beyond its end. A candidate counts as a member only if its header
decodes to a WARC record; a magic inside compressed data does not, so that piece
is appended to the member before it. Where such a piece starts in the next range
the two tasks hand out fragments, which are put together afterwards, file by file.
Files must not carry a compression suffix, or Spark would unpack them as a whole.

Archives of others can be read too: records of any type, several records in a
member, ids of any form (page_id is null where an id is not one of ours) and digests
in hex or base 32. Nothing damaged stops a job: a member that is cut off or can't be
unpacked, a record without a usable header and a payload that disagrees with its
digest are rows of their own, with ``error`` set (record_type is "damaged" where
there is no record to speak of).

Null payloads are empty, null urls are written without one, a null id is read as
null. Rows with the same id and payload stay separate records of the same kind. Of
equal payloads with equal largest ids, all rows of that id are responses. An empty
table gives no records. A payload of any length is one record; memory follows the
longest. Columns other than the named ones are not read, so they may have any name.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .textio import arrow_schema, bounded, small_batches, stored

MAGIC = b"\x1f\x8b\x08"
MIN_BYTES = 1000
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"


def member(record: bytes, level: int = 6) -> bytes:
    """A gzip member that ends in a zero byte (with an empty member behind, where needed)."""
    pack = zlib.compressobj(level, zlib.DEFLATED, 31)
    out = pack.compress(record) + pack.flush()
    if out[-1]:
        pack = zlib.compressobj(level, zlib.DEFLATED, 31)
        out += pack.compress(b"") + pack.flush()
    return out


def record(page_id, url, payload: bytes, digest: str, refers_to, date: str) -> bytes:
    """One WARC record: a response with its payload, or a revisit without."""
    revisit = refers_to is not None
    http = HTTP % len(payload)
    block = http if revisit else http + payload
    name = "" if page_id is None else str(page_id)
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:x-page:{name}>", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(c if c.isprintable() and c != " " else "".join(f"%{b:02X}" for b in c.encode()) for c in url))
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:x-page:{refers_to}>"]
    head += [f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def planned(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", text_col: str = "html", min_bytes: int = MIN_BYTES) -> DataFrame:
    """id, url, payload, digest and refers_to (null for responses) of each row.

    The copies are found by an aggregate over digests and ids alone, which Spark
    combines before the shuffle. Payloads are shuffled only if more digests have
    copies than may be broadcast; Spark can split that join where it is skewed.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("payload"))
    rows = rows.withColumns({"digest": F.sha1("payload"), "size": F.octet_length("payload")})
    copies = rows.where(F.col("size") >= min_bytes).groupBy("digest").agg(F.max("page_id").alias("keeper"), F.count("*").alias("n")).where("n > 1").drop("n")
    copies = bounded(copies, "copies")
    return rows.join(copies, "digest", "left").select(
        "page_id", "url", "payload", "digest", F.when(F.col("keeper") != F.coalesce("page_id", F.col("keeper") - 1), F.col("keeper")).alias("refers_to")
    )


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", text_col: str = "html", min_bytes: int = MIN_BYTES, date: str = "1970-01-01T00:00:00Z") -> None:
    """Write the rows as WARC files below ``path``, one file a task."""

    def run(batches):
        for batch in batches:
            rows = zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True)
            out = [member(record(i, u, p.encode(), d, r, date))[:-1] for i, u, p, d, r in rows]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])

    small_batches(pages.sparkSession)
    members = planned(pages, id_col, url_col, text_col, min_bytes).mapInArrow(run, "value binary")
    members.select(F.col("value").cast("string").alias("value")).write.option("encoding", "ISO-8859-1").option("lineSep", "\0").text(path)


def header_of(candidate: bytes) -> bool:
    """Whether a candidate starts with a member whose content starts like a WARC record."""
    try:
        return zlib.decompressobj(31).decompress(candidate, 16).startswith(b"WARC/1.")
    except zlib.error:
        return False


def whole(candidate: bytes) -> bytes | None:
    """The content of a member, or None if it is not complete."""
    unpack = zlib.decompressobj(31)
    try:
        data = unpack.decompress(candidate)
    except zlib.error:
        return None
    return data if unpack.eof else None


def hex_digest(text: str | None) -> str | None:
    """A sha1 digest of a header, in hex or base 32, as lower-case hex; None for others."""
    kind, _, value = (text or "").partition(":")
    if kind.lower() != "sha1":
        return None
    try:
        return base64.b32decode(value.strip().upper()).hex() if len(value.strip()) == 32 else value.strip().lower()
    except binascii.Error:
        return value.strip().lower()


def page_of(record_id: str | None) -> int | None:
    """The page id in a record id of our own."""
    name = (record_id or "").strip("<> ").removeprefix("urn:x-page:")
    return int(name) if name.lstrip("-").isascii() and name.lstrip("-").isdigit() else None


def damaged(error: str) -> dict:
    return {"record_type": "damaged", "error": error}


def parse(data: bytes) -> tuple[dict, int]:
    """Fields of the record at the start of ``data``, and where it ends."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    field = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    size = field.get("content-length", "")
    if not gap or not size.isascii() or not size.isdigit() or "warc-type" not in field:
        return damaged("no usable header"), len(data)
    block, kind = rest[: int(size)], field["warc-type"].lower()
    out = {"record_id": field.get("warc-record-id"), "page_id": page_of(field.get("warc-record-id")), "url": field.get("warc-target-uri"), "record_type": kind, "refers_to": page_of(field.get("warc-refers-to"))}
    digest = hex_digest(field.get("warc-payload-digest"))
    if kind == "revisit":
        told = field.get("x-payload-length", "")
        out |= {"payload_bytes": int(told) if told.isascii() and told.isdigit() else None, "payload_digest": digest}
    else:
        http = kind in ("response", "request") and field.get("content-type", "").startswith("application/http")
        out["payload"] = block.partition(b"\r\n\r\n")[2] if http else block
        seen = hashlib.sha1(out["payload"]).hexdigest()
        out |= {"payload_bytes": len(out["payload"]), "payload_digest": seen, "error": f"payload digest {seen}, header says {digest}" if digest and digest != seen else None}
    if len(block) < int(size):
        out["error"] = "the block is cut off"
    return out, len(head) + 4 + int(size)


def records(data: bytes) -> Iterator[dict]:
    """The records of a member's content."""
    while data:
        got, end = parse(data)
        yield got
        data = data[end:].lstrip(b"\r\n")


FIELDS = "record_id string, page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary, error string"
FRAGMENT = "part string, file string, block long, nth int, raw binary"


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """One row a record. ``payloads`` off leaves the payload null (it is decoded and checked all the same)."""
    small_batches(spark)
    schema = T._parse_datatype_string(f"{FIELDS}, {FRAGMENT}")
    names = [f.name for f in T._parse_datatype_string(FIELDS)]

    def rows_of(data: bytes) -> list[dict]:
        return [{**got, "part": "record", "payload": got.get("payload") if payloads else None} for got in records(data)]

    def lost(file: str) -> dict:
        return {**damaged(f"a member of {file} is not complete"), "part": "record"}

    def scan(batches):
        out, where, open_, seen, nth = arrow_schema(schema), None, None, False, 0

        def fragment(part, raw):
            return {"part": part, "file": where[0], "block": where[1], "nth": nth, "raw": raw}

        def table(rows):
            return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], out.field(n).type) for n in out.names], schema=out)

        for batch in batches:
            rows: list[dict] = []
            for file, block, piece in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if (file, block) != where:
                    if open_ is not None:
                        rows.append(fragment("tail", open_))
                    where, open_, seen, nth = (file, block), None, False, 0
                    if block == 0:
                        continue  # what stands before a file's first magic: nothing, in a sound file
                candidate = MAGIC + piece
                if header_of(candidate):
                    if open_ is not None:
                        rows.append(lost(file))
                    open_, seen = candidate, True
                elif open_ is not None:
                    open_ += candidate
                elif not seen:
                    rows.append(fragment("head", candidate))
                    nth += 1
                if open_ is not None and (data := whole(open_)) is not None:
                    rows += rows_of(data)
                    open_ = None
            yield table(rows)
        if open_ is not None:
            yield table([fragment("tail", open_)])

    def stitch(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["block", "part", "nth"])  # the heads of a range come before its tail
        rows, open_, file = [], None, group["file"].iloc[0]
        for part, raw in zip(group["part"], group["raw"], strict=True):
            if part == "tail":
                rows += [] if open_ is None else [lost(file)]
                open_ = bytes(raw)
            elif open_ is not None:
                open_ += bytes(raw)
            else:
                rows.append(lost(file))
            if open_ is not None and (data := whole(open_)) is not None:
                rows += rows_of(data)
                open_ = None
        rows += [] if open_ is None else [lost(file)]
        out = pd.DataFrame(rows, columns=names, dtype=object)
        return out.astype({"page_id": "Int64", "refers_to": "Int64", "payload_bytes": "Int64"})

    pieces = spark.read.option("encoding", "ISO-8859-1").option("lineSep", MAGIC.decode("latin-1")).text(path)
    pieces = pieces.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("piece"))
    parts = pieces.mapInArrow(scan, schema)
    parts = parts if payloads else stored(parts, "records")  # without payloads far less to write than to scan again
    joined = parts.where("part <> 'record'").select("part", "file", "block", "nth", "raw").groupBy("file").applyInPandas(stitch, FIELDS)
    return parts.where("part = 'record'").select(*names).unionByName(joined)
