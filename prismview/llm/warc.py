"""WARC: write records to gzip archives, normalise them to one member per record with an offset index, read them back.

The writer makes monolithic archives: one gzip stream over many records, as simple tools do. The normaliser inflates
each stream once, front to back and in bounded memory, rewrites every record as a gzip member of its own, turns
records whose payload an earlier page has into revisits, and writes a sidecar index of offsets beside each archive.
The reader takes members by the offsets of the sidecars. All files lie in the shared folder; names come from the task's
number, and a file is moved to its name when it is complete, so a repeated task replaces its file by an equal one. Archives
are dealt to as many tasks as there are archives (``spark.sql.shuffle.partitions`` at most), since the rows that name
them say nothing about their size.

Edge cases: ids may be of any type that Spark casts to and from strings; a null payload is empty; null ids are written
without an id and stay null, and where all ids of a payload are null, all its records are responses; of rows with the
smallest id and equal payloads the first written is the response, the others revisit it (their own id); without any page
there are no archives and no rows; further columns aren't read.
"""

from __future__ import annotations

import base64
import hashlib
import json
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prismview.llm.common import discard, forget, scratch, settled, table

HEAD = b"WARC/1.1\r\n"
DATE = "2024-01-01T00:00:00Z"
ROLL_BYTES = 64 << 20
#: Payload bytes after which the reader passes its rows on.
BATCH_BYTES = 4 << 20
GZIP = 16 + zlib.MAX_WBITS


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: str | None, url: str | None, payload: bytes, sha1: str, size: int, refers_to: str | None = None) -> bytes:
    """One WARC record; with refers_to a revisit, whose block is empty."""
    fields = {"WARC-Type": "response" if refers_to is None else "revisit", "WARC-Date": DATE}
    if page_id is not None:
        fields["WARC-Record-ID"] = f"<urn:page:{quote(str(page_id), safe='')}>"
    if url:
        fields["WARC-Target-URI"] = "".join(url.split())
    fields |= {"WARC-Payload-Digest": f"sha1:{sha1}", "X-Payload-Length": str(size)}
    if refers_to is not None:
        fields |= {"WARC-Refers-To": f"<urn:page:{quote(str(refers_to), safe='')}>", "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"}
        payload = b""
    fields |= {"Content-Type": "text/html", "Content-Length": str(len(payload))}
    return HEAD + "".join(f"{k}: {v}\r\n" for k, v in fields.items()).encode() + b"\r\n" + payload + b"\r\n\r\n"


def parsed(head: bytes) -> dict[str, str]:
    return dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:] if ": " in x)


def records(chunks: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields, block) of each record of an inflated stream; holds one record at a time."""
    buffer = bytearray()
    need, fields = 0, None
    for chunk in chunks:
        buffer += chunk
        while True:
            if fields is None:
                end = buffer.find(b"\r\n\r\n")
                if end < 0:
                    break
                fields, at = parsed(bytes(buffer[:end])), end + 4
                need = at + int(fields["Content-Length"]) + 4
            if len(buffer) < need:
                break
            yield fields, bytes(buffer[at:need - 4])
            del buffer[:need]
            fields = None


def inflated(stream, size: int = 1 << 18) -> Iterator[bytes]:
    """The contents of a gzip stream of one or more members, read once."""
    z = zlib.decompressobj(GZIP)
    while data := stream.read(size):
        while data:
            yield z.decompress(data)
            data = z.unused_data if z.eof else b""
            if z.eof:
                z = zlib.decompressobj(GZIP)


def place(uri: str):
    """File system and path of a URI; a plain path is a local one."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


class Whole:
    """A file that gets its name when it is closed."""

    def __init__(self, uri: str):
        self.fs, self.path = place(uri)
        self.temporary = f"{self.path}.{TaskContext.get().taskAttemptId() if TaskContext.get() else 0}.tmp"
        self.fs.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.out, self.at = self.fs.open_output_stream(self.temporary), 0

    def write(self, data: bytes) -> int:
        self.out.write(data)
        self.at += len(data)
        return len(data)

    def close(self) -> None:
        self.out.close()
        self.fs.move(self.temporary, self.path)


def id_of(fields: dict[str, str], name: str) -> str | None:
    return unquote(fields[name].removeprefix("<urn:page:").removesuffix(">")) if name in fields else None


def write_archives(pages: DataFrame, to: str, payload: str = "html", roll: int = ROLL_BYTES) -> DataFrame:
    """Monolithic archives of all pages in the folder to; returns row, path, ordinal, page_id, digest, bytes of every record.

    The pages are written where they are read, without a shuffle.
    """
    def run(batches):
        part, n, out, z, size, ordinal, path, row = TaskContext.get().partitionId(), 0, None, None, 0, 0, "", 0
        for b in batches:
            rows = [[], [], [], [], []]
            for page_id, url, html in zip(*(b.column(i).to_pylist() for i in range(1, 4)), strict=True):
                if out is None:
                    path = f"{to}/part-{part:05d}-{n:04d}.warc.gz"
                    out, z, size, ordinal, n = Whole(path), zlib.compressobj(2, zlib.DEFLATED, GZIP), 0, 0, n + 1
                body = (html or "").encode()
                sha1 = digest(body)
                data = record(page_id, url, body, sha1, len(body))
                out.write(z.compress(data))
                size += len(data)
                for to_list, v in zip(rows, ((part << 33) + row, path, ordinal, sha1, len(body)), strict=True):
                    to_list.append(v)
                ordinal, row = ordinal + 1, row + 1
                if size >= roll:
                    out.write(z.flush())
                    out.close()
                    out = None
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([*[pa.array(r, k) for r, k in zip(rows, kinds, strict=True)], b.column(0)], ["row", "path", "ordinal", "digest", "bytes", "page_id"])
        if out is not None:
            out.write(z.flush())
            out.close()

    few = pages.select("page_id", F.col("page_id").cast("string").alias("_id"), "url", F.col(payload))
    kind = pages.schema["page_id"].dataType.simpleString()
    return settled(few.mapInArrow(run, f"row long, path string, ordinal long, digest string, bytes long, page_id {kind}"), "warc-records", rows=256)


def revisits(found: DataFrame, least: int = 0) -> DataFrame:
    """path, todo: for each archive the (ordinal, refers_to) of the records that become revisits.

    Of the records with equal payloads of at least ``least`` bytes the first with the smallest page_id stays. Only digests
    that occur twice are joined back; the list of an archive is bounded by the archive.
    """
    some = found.where(F.col("bytes") >= least)
    twice = some.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null")
    twice = settled(twice.select(F.col("digest").alias("_digest"), "first"), "warc-twice")
    held = some.join(twice, (some["digest"] == twice["_digest"]) & (some["page_id"] == twice["first"])).groupBy("_digest").agg(F.min("row").alias("_row"), F.first("first").alias("first"))
    held = settled(held, "warc-held", twice)
    later = some.join(held, some["digest"] == held["_digest"]).where("row <> _row")
    lists = later.groupBy("path").agg(F.collect_list(F.struct("ordinal", F.col("first").cast("string").alias("first"))).alias("todo"))
    return settled(found.groupBy("path").agg(F.count("*").alias("records")).join(lists, "path", "left"), "warc-todo", held)


def spread(df: DataFrame, archives: int) -> DataFrame:
    """df range-partitioned by path into as many tasks as there are archives, within the session's number of partitions."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return df.repartitionByRange(max(1, min(n, archives)), "path")


def normalise(archives: DataFrame, to: str, level: int = 6) -> DataFrame:
    """Archives (path, todo) rewritten in the folder to, a member per record; returns the number of members of each new path.

    Beside each archive lies its index, a line of JSON per record with file, page, url, offset and length.
    """
    def run(batches):
        for b in batches:
            for path, todo in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                refers = {x["ordinal"]: x["first"] for x in todo or ()}
                file, members = path.rpartition("/")[2], 0
                out, index = Whole(f"{to}/{file}"), Whole(f"{to}/{file.removesuffix('.warc.gz')}.cdxj")
                source, at = place(path)
                with source.open_input_stream(at, compression=None) as stream:
                    for i, (fields, block) in enumerate(records(inflated(stream))):
                        page, members = id_of(fields, "WARC-Record-ID"), members + 1
                        data = record(page, fields.get("WARC-Target-URI"), block, fields["WARC-Payload-Digest"][5:], int(fields["X-Payload-Length"]), refers.get(i))
                        z = zlib.compressobj(level, zlib.DEFLATED, GZIP)
                        offset, length = out.at, out.write(z.compress(data) + z.flush())
                        index.write((json.dumps({"file": file, "page": page, "url": fields.get("WARC-Target-URI"), "offset": offset, "length": length}) + "\n").encode())
                out.close()
                index.close()
                yield pa.RecordBatch.from_arrays([pa.array([f"{to}/{file}"]), pa.array([members], pa.int64())], ["path", "members"])

    return settled(archives.mapInArrow(run, "path string, members long"), "warc-normalised")


def sidecars(spark: SparkSession, folder: str) -> DataFrame:
    """path, page, url, offset, length from the indexes of all archives in a folder."""
    lines = spark.read.schema("file string, page string, url string, offset long, length long").json(f"{folder}/*.cdxj")
    return lines.select(F.concat(F.lit(f"{folder}/"), "file").alias("path"), "page", "url", "offset", "length")


def read_members(index: DataFrame, kind: str = "string") -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, url, payload of each member that the index (path, offset,
    length) names. kind: the type of the ids.

    A response's size and digest are taken from its payload anew; a revisit's from its header.
    """
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "payload"]
    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string()]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    def run(batches):
        source, path, stream, rows, size = None, None, None, [], 0
        for b in batches:
            for name, offset, length in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if name != path:
                    source, at = place(name)
                    path, stream = name, source.open_input_file(at)
                fields, block = next(records(iter([zlib.decompress(stream.read_at(length, offset), GZIP)])))
                own = fields["WARC-Type"] == "response"
                if own and fields["WARC-Payload-Digest"] != f"sha1:{digest(block)}":
                    raise ValueError(f"{name}, offset {offset}: the payload doesn't have its digest")
                rows.append((id_of(fields, "WARC-Record-ID"), len(block) if own else int(fields["X-Payload-Length"]), fields["WARC-Payload-Digest"][5:], fields["WARC-Type"], id_of(fields, "WARC-Refers-To"), fields.get("WARC-Target-URI"), block.decode() if own else None))
                size += len(block) + 256
                if size >= BATCH_BYTES:
                    yield batch(rows)
                    rows, size = [], 0
        if rows:
            yield batch(rows)

    got = index.select("path", "offset", "length").mapInArrow(run, "page_id string, payload_bytes long, payload_digest string, record_type string, refers_to string, url string, payload string")
    return got.withColumns({c: F.col(c).cast(kind) for c in ("page_id", "refers_to")})


def warc_round_trip(pages: DataFrame, payload: str = "html", least: int = 0) -> DataFrame:
    """Pages written, normalised and read back by the sidecars; the monolithic archives go once they have been rewritten."""
    spark = pages.sparkSession
    raw, to = scratch(spark, "warc-raw"), scratch(spark, "warc")
    found = write_archives(pages, raw, payload)
    todo = revisits(found, least)
    archives = todo.count()
    kind = pages.schema["page_id"].dataType.simpleString()
    if not archives:
        return read_members(spark.createDataFrame([], "path string, offset long, length long"), kind)
    forget(normalise(spread(todo.select("path", "todo"), archives), to), todo, found)
    discard(raw)
    return read_members(spread(sidecars(spark, to), archives).sortWithinPartitions("path", "offset"), kind)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


_CHARS = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (x >> {s}) % 32 + 1, 1)" for s in (15, 10, 5, 0))
SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes,
  array_to_string(list_transform(list_transform(range(8), lambda i: ('0x' || substr(h, i * 5 + 1, 5))::BIGINT), lambda x: {_CHARS}), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM f
"""
