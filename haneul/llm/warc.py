"""WARC archives: written with an index of every record, read back by coalesced byte ranges.

The writer puts each task's records into a file of its own (`<uuid>.warc.gz`, one gzip member
a record) and returns an index row per record: file, offset, length, URL, digest. The index
is committed by Spark's Parquet writer, so it names only the files of tasks that succeeded; a
lost executor's half-written file is never read. The reader starts from the index alone: it
takes the selected records, sorts them by file and offset, joins neighbours into one read of
up to `max_read` bytes, and parses the members.

Nulls: a null html is an empty payload; a null URL leaves out WARC-Target-URI; a null id is
kept (it sorts after all ids when the original of equal payloads is chosen). Rows that repeat
an id and its payload: the one with the least URL is the response, the others revisit it. Very
long payloads are one record each, which a task holds at a time. An empty table gives an empty
index. Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Fixed values of the WARC 1.1 format.
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "file string, offset long, length long, page_id long, url string, payload_digest string, payload_bytes long, record_type string, refers_to long"
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload string"

#: Keys that the rows of one digest are dealt over.
SALTS = 32


def _open(uri: str):
    """(file system, path) of a URI; a bare path or file: is the shared mount that all executors see."""
    from pyarrow import fs

    uri = re.sub(r"^file:/+", "/", uri)
    return (fs.LocalFileSystem(), uri) if uri.startswith("/") else fs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", uri))


def _name(page_id: int | None) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def _record(page_id, url, payload: bytes, digest: str, kind: str, refers_to, date: str) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    head = [VERSION, f"WARC-Type: {kind}", f"WARC-Record-ID: {_name(page_id)}", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\r\n]+", " ", url))
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if kind == "revisit":
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {_name(refers_to)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return ("\r\n".join(head) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def _parse(raw: bytes) -> tuple:
    """(id, url, payload bytes, digest, type, refers_to, payload) of a record; its digest is computed anew."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    http, _, payload = rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    number = lambda name: None if (x := fields[name][10:-1]) == "null" else int(x)
    digest = fields["WARC-Payload-Digest"][5:]
    if fields["WARC-Type"] == "revisit":
        return number("WARC-Record-ID"), fields.get("WARC-Target-URI"), size, digest, "revisit", number("WARC-Refers-To"), None
    found = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    if found != digest or len(payload) != size:
        raise ValueError(f"record {fields['WARC-Record-ID']} is damaged: {found}, {len(payload)} bytes")
    return number("WARC-Record-ID"), fields.get("WARC-Target-URI"), size, digest, "response", None, payload


def originals(pages: DataFrame, min_bytes: int) -> DataFrame:
    """pages (page_id, url, payload, digest) with record_type and refers_to. Equal payloads of
    at least min_bytes meet by digest in a count that is combined before the shuffle, so a group
    of any size costs one row. Digests seen more than once are joined back on SALTS keys each, so
    a payload that a third of all pages share is dealt over as many tasks."""
    sized = pages.where(F.octet_length("payload") >= min_bytes)
    each = sized.groupBy("digest", "page_id").agg(F.count("*").alias("c"))
    order = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "c")
    firsts = each.groupBy("digest").agg(F.sum("c").alias("n"), F.min(order).alias("first")).where("n > 1")
    firsts = firsts.select("digest", F.col("first.page_id").alias("first_id"), F.col("first.c").alias("first_c"))
    salted = firsts.withColumn("_hn_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = pages.withColumn("_hn_salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
    joined = dealt.join(salted.hint("merge"), ["digest", "_hn_salt"], "left").drop("_hn_salt")
    is_first = F.col("page_id").eqNullSafe(F.col("first_id"))
    alone = F.col("first_c").isNull()
    plain = joined.withColumn("record_type", F.when(alone | is_first, "response").otherwise("revisit"))
    if firsts.where("first_c > 1").limit(1).count():  # rows that repeat the id of an original: one stays the response
        tied = (F.col("first_c") > 1) & is_first
        again = joined.where(tied).withColumn("_hn_k", F.row_number().over(W.partitionBy("digest").orderBy("url")))
        again = again.withColumn("record_type", F.when(F.col("_hn_k") == 1, "response").otherwise("revisit")).drop("_hn_k")
        plain = plain.where(~F.coalesce(tied, F.lit(False))).unionByName(again)
    return plain.withColumn("refers_to", F.when(F.col("record_type") == "revisit", F.col("first_id")))


def write_warc(pages: DataFrame, root: str, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", min_bytes: int = 0, date: str = "2024-01-01T00:00:00Z", max_file_bytes: int = 1 << 30) -> DataFrame:
    """Write a record per row below `root` and return the index of all of them."""
    payload = F.encode(F.coalesce(F.col(body_col), F.lit("")), "UTF-8")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload"))
    rows = originals(rows.withColumn("digest", F.sha1("payload")), min_bytes)
    rows = rows.select("page_id", "url", "payload", "digest", "record_type", "refers_to")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = _open(f"{root}/archives")
        out, at, name = None, 0, ""
        for batch in batches:
            index = []
            for r in batch.to_pylist():
                if out is None or at >= max_file_bytes:
                    if out is not None:
                        out.close()
                    fs.create_dir(path, recursive=True)
                    name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = fs.open_output_stream(f"{path}/{name}", compression=None)
                digest = base64.b32encode(bytes.fromhex(r["digest"])).decode()
                body = r["payload"]
                packer = zlib.compressobj(6, zlib.DEFLATED, 31)
                member = packer.compress(_record(r["page_id"], r["url"], body, digest, r["record_type"], r["refers_to"], date)) + packer.flush()
                out.write(member)
                index.append((name, at, len(member), r["page_id"], r["url"], digest, len(body), r["record_type"], r["refers_to"]))
                at += len(member)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*index), types)], names) if index else empty
        if out is not None:
            out.close()

    names = [x.split()[0] for x in INDEX.split(", ")]
    types = [pa.string() if x.endswith("string") else pa.int64() for x in INDEX.split(", ")]
    empty = pa.RecordBatch.from_arrays([pa.array([], t) for t in types], names)
    rows.mapInArrow(write, INDEX).write.parquet(f"{root}/index")
    return read_index(pages.sparkSession, root)


def read_index(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(INDEX).parquet(f"{root}/index")


def read_warc(index: DataFrame, root: str, payload: bool = True, block_bytes: int = 64 << 20, max_read: int = 4 << 20, max_gap: int = 64 << 10) -> DataFrame:
    """Read the records that the index rows name. Rows are dealt by (file, block of
    block_bytes), so a task's share is bounded however large a file is; within a block reads
    that lie max_gap or less apart become one, up to max_read bytes."""

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = _open(f"{root}/archives")
        held, held_name = None, None

        def read(run: list[tuple]) -> Iterator[tuple]:
            nonlocal held, held_name
            if run[0][0] != held_name:
                if held is not None:
                    held.close()
                held, held_name = fs.open_input_file(f"{path}/{run[0][0]}"), run[0][0]
            start = run[0][1]
            data = held.read_at(run[-1][1] + run[-1][2] - start, start)
            for _, offset, length in run:
                yield _parse(zlib.decompress(data[offset - start : offset - start + length], 31))

        def runs() -> Iterator[list[tuple]]:
            run: list[tuple] = []
            for batch in batches:
                for row in zip(*(c.to_pylist() for c in batch.columns)):
                    if run and (row[0] != run[0][0] or row[1] - (run[-1][1] + run[-1][2]) > max_gap or row[1] + row[2] - run[0][1] > max_read):
                        yield run
                        run = []
                    run.append(row)
            if run:
                yield run

        for run in runs():
            found = [(*r[:6], r[6].decode("utf-8") if payload and r[6] is not None else None) for r in read(run)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), types)], names)
        if held is not None:
            held.close()

    names = [x.split()[0] for x in RECORD.split(", ")]
    types = [pa.string() if x.endswith("string") else pa.int64() for x in RECORD.split(", ")]
    dealt = index.select("file", "offset", "length", F.floor(F.col("offset") / block_bytes).alias("block")).repartition("file", "block")
    return dealt.sortWithinPartitions("file", "offset").select("file", "offset", "length").mapInArrow(fetch, RECORD)
