"""WARC archives, index first.

Writing gives each page one gzip member (a WARC/1.1 record) and one row of an
index: archive, offset, length, URL, digest. Of pages with equal payloads, the
one with the largest id is a ``response``; the others are ``revisit`` records
that refer to it and carry no payload. Reading starts from the index: the
selected rows are sorted by archive and offset, neighbours are joined into one
byte range, and a range is one request, cut into its records again.

Archives are written by the tasks, through the file system of the shared
folder. A task that is repeated writes another file; only the files named by the
index (a written table, so of committed tasks alone) count.

The payload digests of all rows are taken once; hot payloads are not dealt out:
the row of their response goes to them. The payloads are shuffled once, to meet
their response.

Defined cases: a null payload is empty, and equal to other empty ones; a null URL
gives a record without target; characters that no header may hold are
percent-encoded there; null ids rank below all others; rows that share the
largest id and the payload have one response and revisits of it; payloads under
``least`` bytes are all responses; extra columns are ignored; an empty table
gives an empty index.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import join_unique, materialise, new_folder, ship

ship(__name__)

INDEX = "archive string, offset long, length long, url string, digest string, record_id string, record_type string, page_id long"
RECORDS = "record_id string, page_id long, record_type string, url string, payload_digest string, payload_bytes long, refers_id string"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_name(row: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'record {row}')}>"


def header_value(text: str) -> str:
    """``text`` with control characters and outer blanks percent-encoded."""
    return re.sub(r"[\x00-\x1f\x7f]|^ | $", lambda m: quote(m[0]), text)


def pack_record(record_id: str, date: str, url: str | None, page_id: int | None, digest: str, payload: bytes | None, refers_id: str | None, length: int) -> bytes:
    """One record as a gzip member of its own; without a payload it is a revisit of ``refers_id``."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    block = http + (payload or b"")
    head = [("WARC-Type", "response" if refers_id is None else "revisit"), ("WARC-Record-ID", record_id), ("WARC-Date", date)]
    if url is not None:
        head.append(("WARC-Target-URI", header_value(url)))
    if page_id is not None:
        head.append(("X-Page-Id", str(page_id)))
    if refers_id is not None:
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", refers_id)]
    head += [("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Block-Digest", f"sha1:{digest32(block)}"), ("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    lines = "".join(f"{k}: {v}\r\n" for k, v in head)
    return gzip.compress(b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n", 6, mtime=0)


def unpack_record(member: bytes) -> tuple[dict[str, str], bytes]:
    """(headers by lower-case name, payload) of one gzip member; raises where its lengths or block digest do not agree."""
    data = zlib.decompress(member, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines)}
    block = rest[: int(fields["content-length"])]
    if version != "WARC/1.1" or rest[len(block) :] != b"\r\n\r\n" or fields["warc-block-digest"] != f"sha1:{digest32(block)}":
        raise ValueError(f"damaged record {fields.get('warc-record-id')}")
    return fields, block.partition(b"\r\n\r\n")[2]


def file_system(address: str):
    """(file system, path) of a full address, as tasks reach it."""
    from pyarrow import fs

    return (fs.LocalFileSystem(), urlsplit(address).path) if address.startswith("file:") else fs.FileSystem.from_uri(address)


def _write(folder: str, date: str, archive_bytes: int):
    names = [x.split(" ")[0] for x in INDEX.split(", ")]

    def run(batches):
        fs, top = file_system(folder)
        out, name, at = None, None, 0
        for batch in batches:
            rows = []
            for rid, page_id, url, html, ref in zip(*(c.to_pylist() for c in batch.columns)):
                payload = html.encode()
                record_id, refers_id, digest = record_name(rid), None if ref is None or ref == rid else record_name(ref), digest32(payload)
                member = pack_record(record_id, date, url, page_id, digest, payload if refers_id is None else None, refers_id, len(payload))
                if out is None or at + len(member) > archive_bytes and at:
                    if out:
                        out.close()
                    name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = fs.open_output_stream(f"{top}/{name}", compression=None)
                out.write(member)
                rows.append((f"{folder}/{name}", at, len(member), url, digest, record_id, "response" if refers_id is None else "revisit", page_id))
                at += len(member)
            if rows:
                kinds = [pa.int64() if x in ("offset", "length", "page_id") else pa.string() for x in names]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
        if out:
            out.close()

    return run


def write_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 0, date: str = "2024-01-01T00:00:00Z", archive_bytes: int = 1 << 30) -> DataFrame:
    """The index of the archives that hold ``pages``: one row, and one record, for each page."""
    html = F.coalesce(F.col(f"`{payload_col}`").cast("string"), F.lit(""))
    rows = materialise(
        pages.select(F.monotonically_increasing_id().alias("rid"), F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"), html.alias("html"), F.sha1(html.cast("binary")).alias("sha")),
        "warc-pages",
        "zstd",
    )
    firsts = rows.filter(F.octet_length("html") >= least).groupBy("sha").agg(F.max(F.struct("page_id", "rid"))["rid"].alias("ref"))
    met = join_unique(rows, firsts, "sha", "left").select("rid", "page_id", "url", "html", F.when(F.octet_length("html") >= least, F.col("ref")).alias("ref"))
    folder = new_folder(pages.sparkSession, "warc")
    return materialise(met.mapInArrow(_write(folder, date, archive_bytes), INDEX), "warc-index")


def byte_ranges(index: DataFrame, gap: int, span: int) -> DataFrame:
    """(archive, start, stop, records) of the requests that fetch the rows of ``index``; records are (offset, length, record_id).

    Rows of an archive at most ``gap`` bytes apart share a request, up to where one would cross a multiple of ``span`` bytes.
    """
    by = Window.partitionBy("archive").orderBy("offset")
    last = F.lag(F.col("offset") + F.col("length")).over(by)
    cut = last.isNull() | (F.col("offset") - last > gap) | (F.floor(F.col("offset") / span) != F.floor(F.lag("offset").over(by) / span))
    runs = index.select("archive", "offset", "length", "record_id", cut.cast("int").alias("cut")).withColumn("run", F.sum("cut").over(by))
    records = F.sort_array(F.collect_list(F.struct("offset", "length", "record_id")))
    return runs.groupBy("archive", "run").agg(F.min("offset").alias("start"), F.max(F.col("offset") + F.col("length")).alias("stop"), records.alias("records")).drop("run")


def _read(payloads: bool):
    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                archive, start, stop, records = (c[i].as_py() for c in batch.columns)
                fs, path = file_system(archive)
                with fs.open_input_file(path) as f:
                    data = f.read_at(stop - start, start)
                cols = [[] for _ in range(7 + payloads)]
                for r in records:
                    at = r["offset"] - start
                    fields, payload = unpack_record(data[at : at + r["length"]])
                    if fields["warc-record-id"] != r["record_id"]:
                        raise ValueError(f"{archive} at {r['offset']} holds {fields['warc-record-id']}, not {r['record_id']}")
                    said, kind = fields["warc-payload-digest"].removeprefix("sha1:"), fields["warc-type"]
                    if kind == "response" and said != digest32(payload):
                        raise ValueError(f"payload digest of {r['record_id']}")
                    page, size = fields.get("x-page-id"), len(payload) if kind == "response" else None
                    row = [r["record_id"], None if page is None else int(page), kind, fields.get("warc-target-uri"), said, size, fields.get("warc-refers-to")] + ([payload.decode()] if payloads else [])
                    for c, v in zip(cols, row):
                        c.append(v)
                names = [x.split(" ")[0] for x in RECORDS.split(", ")] + ["payload"] * payloads
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if n in ("page_id", "payload_bytes") else pa.string()) for n, c in zip(names, cols)], names=names)

    return run


def read_records(index: DataFrame, wanted: Column | None = None, payloads: bool = True, gap: int = 65536, span: int = 8 << 20) -> DataFrame:
    """The records of the index rows for which ``wanted`` holds (all, if not given), checked against their digests.

    Revisits have the digest of the payload that they refer to, no size and an empty payload.
    """
    chosen = index if wanted is None else index.filter(wanted)
    ranges = byte_ranges(chosen, gap, span)
    parts = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return ranges.repartition(parts, "archive", "start").mapInArrow(_read(payloads), RECORDS + ", payload string" * payloads)


def resolve(records: DataFrame) -> DataFrame:
    """``records`` (a written table) with ``refers_to``: revisits take size and digest from the response they name, and its page id."""
    plain = records.filter("record_type = 'response'")
    named = plain.select(F.col("record_id").alias("refers_id"), F.col("page_id").alias("refers_to"), F.col("payload_bytes").alias("size_"), F.col("payload_digest").alias("digest_"))
    again = join_unique(records.filter("record_type = 'revisit'"), named, "refers_id", "left")
    same = F.when(F.col("digest_") == F.col("payload_digest"), F.col("size_"))
    return plain.withColumn("refers_to", F.lit(None).cast("long")).unionByName(again.withColumn("payload_bytes", same).drop("size_", "digest_"))


def round_trip(pages: DataFrame, **options) -> DataFrame:
    """Write all pages, read all archives back, and tell what they hold: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    records = materialise(read_records(write_archives(pages, **options), payloads=False), "warc-records")
    return resolve(records).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha1(h) AS x, max(page_id) OVER (PARTITION BY h) AS top FROM p)
SELECT page_id, payload_bytes, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + CAST((CAST('0x' || substr(x, CAST(5 * (i // 4) + 1 AS BIGINT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31 AS BIGINT), 1)), '') AS payload_digest,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to
FROM d
"""
