"""WARC archives: one record per page, an index written first, and coalesced byte-range reads.

Each task writes one archive of gzip members (a member per record) and hands back the index rows of its records: file,
offset, length, URL and payload digest. The index is a written table; every later read starts from it. A read sorts the
chosen records by file and offset, joins ranges with a gap of at most GAP bytes, and fetches a range at once; only the
chosen bytes are read. A task that is run again writes an archive of another name, and only the attempt that ended has
its rows in the index.

Duplicates: of records with equal payloads of `least` bytes or more, that with the largest page_id is the response, and
the others are revisit records without a payload that refer to it. Digests are counted with a partial aggregate; rows
without their payloads are joined with one row a digest, a join that adaptive execution splits where a payload is shared
by a large part of the pages.

Cases: a null html is an empty payload; a target holds no blanks and control characters, but
the url comes back as it was, null too; equal rows that repeat (page_id and payload) have one type and one record id; a null page_id sorts below all others and refers like any other page; further
columns are ignored; no rows give an empty index.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import shared_dir, written

GAP = 64 << 10
#: Most bytes fetched at once.
RANGE = 4 << 20
INDEX = "file string, offset long, length long, url string, page_id long, payload_digest string, record_type string, refers_to long"
_URN = "urn:page:"


def _opened(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def record(page_id, url: str | None, payload: bytes, digest: str, refers_to) -> bytes:
    """One WARC/1.1 record. refers_to: the response's page_id; None for a response."""
    target = "".join(c for c in url or "" if c.isprintable() and c != " ")
    revisit = refers_to is not None
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <{_URN}{page_id}>",
        f"WARC-Target-URI: {target}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{digest}",
    ]
    if revisit:
        lines += [f"WARC-Refers-To: <{_URN}{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    body = b"" if revisit else payload
    if target != url:  # null, or with characters that a header can't hold: the url itself comes along
        lines.append(f"X-Page-URL: {json.dumps(url)}")
    lines += [f"X-Payload-Length: {len(payload)}", "Content-Type: text/html", f"Content-Length: {len(body)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parsed(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    size = int(headers["Content-Length"])
    if len(rest) < size + 4 or rest[size : size + 4] != b"\r\n\r\n":
        raise ValueError("a cut WARC record")
    return headers, rest[:size]


def _packed(data: bytes) -> bytes:
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def _write(base: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _opened(base)
        name, out, offset = f"{uuid.uuid4().hex}.warc.gz", None, 0
        for batch in batches:
            rows = []
            for x in batch.to_pylist():
                if out is None:
                    store.create_dir(root, recursive=True)
                    out = store.open_output_stream(f"{root}/{name}", compression=None)
                payload = (x["html"] or "").encode()
                data = _packed(record(x["page_id"], x["url"], payload, x["payload_digest"], x["refers_to"]))
                out.write(data)
                rows.append([f"{base}/{name}", offset, len(data), x["url"], x["page_id"], x["payload_digest"], x["record_type"], x["refers_to"]])
                offset += len(data)
            if rows:
                kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in INDEX.split(", ")])
        if out is not None:
            out.close()

    return run


def sha1_base32(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1 of binary data: five bytes at a time, ten hex digits to eight symbols."""
    hexed = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(hexed, 10 * k + 1, 10), 16, 32), 8, "0") for k in range(4)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def write_archives(pages: DataFrame, least: int = 0) -> DataFrame:
    """Writes pages (page_id, url, html) and returns the index table: see INDEX."""
    payload = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8")
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.col("html").cast("string").alias("html"),
        sha1_base32(payload).alias("payload_digest"),
        F.octet_length(payload).cast("long").alias("payload_bytes"),
    )
    slim = rows.groupBy("page_id", "payload_digest", "payload_bytes").agg(F.lit(1).alias("one")).drop("one")
    tops = slim.groupBy("payload_digest").agg(F.max("page_id").alias("top"))
    again = (F.col("payload_bytes") >= least) & ~F.col("page_id").eqNullSafe(F.col("top"))
    typed = slim.join(tops, "payload_digest").select(
        F.coalesce("page_id", F.lit(0)).alias("_at"),
        F.col("page_id").isNull().alias("_none"),
        "payload_digest",
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        F.when(again, F.col("top")).alias("refers_to"),
    )
    mine = rows.withColumn("_at", F.coalesce("page_id", F.lit(0))).withColumn("_none", F.col("page_id").isNull())
    joined = mine.join(typed, ["_at", "_none", "payload_digest"])
    due = joined.select("page_id", "url", "html", "payload_digest", "record_type", "refers_to")
    return written(due.mapInArrow(_write(shared_dir(pages.sparkSession)), INDEX))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    handles: dict[str, pa.NativeFile] = {}
    for batch in batches:
        rows = batch.to_pylist()
        out, k = [], 0
        while k < len(rows):
            first, end, m = rows[k], rows[k]["offset"] + rows[k]["length"], k + 1
            while m < len(rows) and rows[m]["file"] == first["file"] and rows[m]["offset"] - end <= GAP and rows[m]["offset"] + rows[m]["length"] - first["offset"] <= RANGE:
                end = max(end, rows[m]["offset"] + rows[m]["length"])
                m += 1
            if first["file"] not in handles:
                for old in handles.values():
                    old.close()
                store, path = _opened(first["file"])
                handles = {first["file"]: store.open_input_file(path)}
            data = handles[first["file"]].read_at(end - first["offset"], first["offset"])
            for x in rows[k:m]:
                begin = x["offset"] - first["offset"]
                headers, payload = parsed(zlib.decompress(data[begin : begin + x["length"]], 31))
                if headers["WARC-Type"] == "response" and base64.b32encode(hashlib.sha1(payload).digest()).decode() != headers["WARC-Payload-Digest"][5:]:
                    raise ValueError(f"the digest of a record in {x['file']} at {x['offset']} differs")
                out.append((x, headers, payload))
            k = m
        if out:
            number = lambda s: None if s == "None" else int(s)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([number(h["WARC-Record-ID"][len(_URN) + 1 : -1]) for _, h, _ in out], pa.int64()),
                    pa.array([json.loads(h["X-Page-URL"]) if "X-Page-URL" in h else h["WARC-Target-URI"] for _, h, _ in out], pa.string()),
                    pa.array([h["WARC-Type"] for _, h, _ in out]),
                    pa.array([number(h["WARC-Refers-To"][len(_URN) + 1 : -1]) if "WARC-Refers-To" in h else None for _, h, _ in out], pa.int64()),
                    pa.array([h["WARC-Payload-Digest"][5:] for _, h, _ in out]),
                    pa.array([int(h["X-Payload-Length"]) for _, h, _ in out], pa.int64()),
                    pa.array([p for _, _, p in out], pa.binary()),
                ],
                names=["page_id", "url", "record_type", "refers_to", "payload_digest", "payload_bytes", "payload"],
            )


RECORD = "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary"


def read_archives(index: DataFrame) -> DataFrame:
    """The records that the rows of an index (or a filtered one) name: page_id, url, record_type, refers_to, payload_digest, payload_bytes, payload.

    Files are dealt out by name and position, so that a large archive is read by several tasks.
    """
    piece = F.floor(F.col("offset") / (64 << 20))
    dealt = index.select("file", "offset", "length").repartition("file", piece).sortWithinPartitions("file", "offset")
    return dealt.mapInArrow(_read, RECORD)


def op1(spark, sf_dir: str) -> DataFrame:
    """Every page written and read back by its index row."""
    index = write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return read_archives(index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
