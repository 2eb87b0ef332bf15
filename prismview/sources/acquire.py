"""Resumable acquisition: the chunks of a plan, fetched by a stream that can be stopped and started again at any time.

A plan is a list of (name, address); the address answers with CSV and a header. The stream's offsets are places in the plan, a batch is
a few chunks (``in_flight``, a task each), and the stream's log says how far it came. A chunk becomes a file of its name,
compressed and written under another name first; it is renamed when the batch is committed, so a file that is there is whole. What is there
is never fetched again, also in a batch that is repeated. A chunk whose address fails is left out, and comes once more at the end of
this run and of later ones. After the deadline no new batch begins.
"""

from __future__ import annotations

import csv
import gzip
import io
import json
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, DataSourceStreamWriter, InputPartition, WriterCommitMessage

from prismview.sources.connectors import fetched

Plan = list[tuple[str, str]]


def file_system(uri: str):
    """(file system, path) of a URI or a local path."""
    from pyarrow.fs import FileSystem, LocalFileSystem

    return FileSystem.from_uri(uri) if "://" in uri else (LocalFileSystem(), uri)


def present(folder: str) -> set[str]:
    """Names of the files in a folder; none if it isn't there."""
    from pyarrow.fs import FileSelector, FileType

    fs, path = file_system(folder)
    return {f.base_name for f in fs.get_file_info(FileSelector(path, allow_not_found=True)) if f.type == FileType.File}


class _Chunk(InputPartition):
    def __init__(self, name: str, address: str):
        self.name, self.address = name, address


class ChunkReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str], columns: list[str]):
        self.plan: Plan = [tuple(x) for x in json.loads(options["plan"])]
        self.folder, self.columns = options["path"], columns
        self.several, self.deadline = int(options.get("in_flight", 3)), float(options.get("deadline", "inf"))
        self.tries, self.delay = int(options.get("tries", 6)), float(options.get("delay", 15))
        self.handed, self.again = 0, None

    def missing(self) -> Plan:
        there = present(self.folder)
        return [c for c in self.plan if c[0] not in there]

    def initialOffset(self) -> dict:
        return {"chunk": 0}

    def latestOffset(self) -> dict:
        missing = self.missing()
        first = self.plan.index(missing[0]) if missing else len(self.plan)
        self.handed = max(self.handed, first)
        if time.time() < self.deadline and missing:
            if self.handed < len(self.plan):
                self.handed = min(self.handed + self.several, len(self.plan))
            else:  # what failed comes once more
                self.again = len(missing) if self.again is None else self.again
                more = min(self.several, self.again)
                self.handed, self.again = self.handed + more, self.again - more
        return {"chunk": self.handed}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        missing, n = self.missing(), len(self.plan)
        some = [c for c in self.plan[start["chunk"]:end["chunk"]] if c in missing]
        if missing:
            some += [missing[i % len(missing)] for i in range(max(start["chunk"], n) - n, end["chunk"] - n)]
        return [_Chunk(*c) for c in dict.fromkeys(some)] or [_Chunk("", "")]

    def read(self, partition: _Chunk) -> Iterator[tuple]:
        if not partition.name:
            return
        try:
            body = fetched(partition.address, self.tries, self.delay)
        except OSError:
            return  # it stays missing
        rows = [r for r in csv.reader(io.StringIO(body)) if r and not r[0].startswith("#")]
        if not rows or rows[0] != self.columns:
            raise ValueError(f"{partition.name}: expected the columns {self.columns}, got {rows[:1]}")
        yield (partition.name, -1, *self.columns)  # so that a chunk without rows is a file as well
        for i, r in enumerate(rows[1:]):
            yield (partition.name, i, *r)


class RemoteChunks(DataSource):
    """readStream.format("remote_chunks"): options plan (JSON), path (the chunks' folder), columns ("a,b"), in_flight, deadline (epoch seconds), tries, delay."""

    @classmethod
    def name(cls) -> str:
        return "remote_chunks"

    def _columns(self) -> list[str]:
        return [c.strip() for c in self.options["columns"].split(",")]

    def schema(self) -> str:
        return ", ".join(["_chunk string", "_n long", *[f"`{c}` string" for c in self._columns()]])

    def streamReader(self, schema) -> ChunkReader:
        return ChunkReader(self.options, self._columns())


@dataclass
class _Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class ChunkWriter(DataSourceStreamWriter):
    def __init__(self, folder: str):
        self.folder = folder

    def write(self, iterator: Iterator[Row]) -> _Written:
        fs, path = file_system(self.folder)
        fs.create_dir(path, recursive=True)
        files, out, name = [], None, None
        try:
            for r in iterator:
                if r[0] != name:
                    if out:
                        out.close()
                    name, other = r[0], f"{path}/.{r[0]}.{uuid.uuid4().hex}.tmp"
                    out = io.TextIOWrapper(gzip.GzipFile(fileobj=fs.open_output_stream(other), mode="wb", mtime=0), newline="")
                    files.append((other, f"{path}/{name}"))
                csv.writer(out, lineterminator="\n").writerow(r[2:])
        finally:
            if out:
                raw = out.buffer.fileobj
                out.close()
                raw.close()
        return _Written(files)

    def commit(self, messages: list[_Written | None], batchId: int) -> None:
        fs, _ = file_system(self.folder)
        for other, name in (f for m in messages if m for f in m.files):
            fs.move(other, name)

    def abort(self, messages: list[_Written | None], batchId: int) -> None:
        fs, _ = file_system(self.folder)
        for other, _ in (f for m in messages if m for f in m.files):
            fs.delete_file(other)


class ChunkFiles(DataSource):
    """writeStream.format("chunk_files"): option path."""

    @classmethod
    def name(cls) -> str:
        return "chunk_files"

    def streamWriter(self, schema, overwrite: bool) -> ChunkWriter:
        return ChunkWriter(self.options["path"])


def sql_plan(url: str, query: str, key: str, ranges: list[tuple[float, float]], stem: str) -> Plan:
    """A chunk for each closed range of a key, from a service that takes SQL."""
    from urllib.parse import urlencode

    joined = "AND" if " where " in query.lower() else "WHERE"
    one = lambda a, b: urlencode({"cmd": " ".join(f"{query} {joined} {key} BETWEEN {a:g} AND {b:g}".split()), "format": "csv"})
    return [(f"{stem}_{a:g}_{b:g}.csv.gz", f"{url}?{one(a, b)}") for a, b in ranges]


def acquire(spark: SparkSession, plan: Plan, folder: str, columns: list[str], seconds: float = float("inf"), in_flight: int = 3, tries: int = 6, delay: float = 15.0) -> list[str]:
    """Names of the plan's chunks that are still missing in folder after this run."""
    from prismview.functions.shared import importable

    importable(spark)
    for source in (RemoteChunks, ChunkFiles):
        spark.dataSource.register(source)
    options = {"plan": json.dumps(plan), "path": folder, "columns": ",".join(columns), "in_flight": in_flight, "deadline": time.time() + seconds, "tries": tries, "delay": delay}
    stream = (spark.readStream.format("remote_chunks").options(**options).load().writeStream.format("chunk_files").option("path", folder)
              .option("checkpointLocation", f"{folder.rstrip('/')}/_log").start())
    try:
        stream.processAllAvailable()
    finally:
        stream.stop()
    there = present(folder)
    return [name for name, _ in plan if name not in there]
