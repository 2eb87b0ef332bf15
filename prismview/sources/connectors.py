"""Python data sources: FITS binary tables, and a remote SQL service that answers in CSV. Register them once per session."""

from __future__ import annotations

import struct
import time
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Fixed values of the FITS standard: type letter -> (struct code, bytes, SQL type).
FITS_TYPES = {"L": ("c", 1, "boolean"), "B": ("B", 1, "short"), "I": ("h", 2, "short"), "J": ("i", 4, "int"), "K": ("q", 8, "long"), "E": ("f", 4, "float"), "D": ("d", 8, "double"), "A": ("s", 1, "string")}
BLOCK = 2880


def _open(uri: str):
    from pyarrow import fs

    files, path = fs.FileSystem.from_uri(uri)
    return files.open_input_file(path)


def fits_header(data: bytes, at: int) -> tuple[dict[str, object], int]:
    """(cards, place after the header)."""
    cards: dict[str, object] = {}
    while True:
        card = data[at:at + 80].decode("ascii", "replace")
        at += 80
        if card.startswith("END") and card.strip() == "END":
            return cards, -(-at // BLOCK) * BLOCK
        if not card:
            raise ValueError("header without an end")
        if card[8:10] == "= ":
            v = card[10:]
            v = v.split("'")[1].rstrip() if v.lstrip().startswith("'") else v.split("/")[0].strip()
            cards[card[:8].strip()] = v


class FitsTable:
    """Layout of the first binary table of a file."""

    def __init__(self, uri: str):
        with _open(uri) as f:
            head = f.read(1 << 20)
            at = 0
            while True:
                cards, body = fits_header(head, at)
                size = abs(int(cards.get("BITPIX", 8))) // 8
                for i in range(int(cards.get("NAXIS", 0))):
                    size *= int(cards[f"NAXIS{i + 1}"])
                if cards.get("XTENSION") == "BINTABLE":
                    break
                at = body + (-(-size // BLOCK) * BLOCK if int(cards.get("NAXIS", 0)) else 0)
                f.seek(0)
                head = f.read(at + (1 << 20))
        self.start, self.width, self.rows = body, int(cards["NAXIS1"]), int(cards["NAXIS2"])
        self.columns, offset = [], 0
        for i in range(1, int(cards["TFIELDS"]) + 1):
            form = str(cards[f"TFORM{i}"])
            repeat, letter = int(form.rstrip("LBIJKEDAXCMPQ") or 1), form.lstrip("0123456789")[0]
            code, n, sql = FITS_TYPES[letter]
            self.columns.append((str(cards[f"TTYPE{i}"]), letter, repeat, code, offset, sql))
            offset += repeat * n

    def ddl(self, wanted: list[str]) -> str:
        return ", ".join(f"`{n}` {t if k == 1 or a == 'A' else f'array<{t}>'}" for n, a, k, _, _, t in self.columns if not wanted or n in wanted)

    def read(self, uri: str, first: int, count: int, wanted: list[str]) -> Iterator[tuple]:
        own = [c for c in self.columns if not wanted or c[0] in wanted]
        with _open(uri) as f:
            data = f.read_at(count * self.width, self.start + first * self.width)
        for r in range(count):
            row = []
            for _, letter, repeat, code, offset, _ in own:
                at = r * self.width + offset
                if letter == "A":
                    row.append(data[at:at + repeat].decode("ascii", "replace").rstrip(" \0"))
                else:
                    v = struct.unpack_from(f">{repeat}{code}", data, at)
                    v = tuple(x == b"T" for x in v) if letter == "L" else v
                    row.append(v[0] if repeat == 1 else list(v))
            yield tuple(row)


class _Rows(InputPartition):
    def __init__(self, first: int, count: int):
        self.first, self.count = first, count


class FitsReader(DataSourceReader):
    def __init__(self, uri: str, wanted: list[str], per: int):
        self.uri, self.wanted, self.per, self.table = uri, wanted, per, FitsTable(uri)

    def partitions(self):
        return [_Rows(i, min(self.per, self.table.rows - i)) for i in range(0, self.table.rows, self.per)] or [_Rows(0, 0)]

    def read(self, partition):
        yield from self.table.read(self.uri, partition.first, partition.count, self.wanted)


class FitsSource(DataSource):
    """format("fits"): options path (a URI), columns (comma-separated, default all), rows_per_partition."""

    @classmethod
    def name(cls):
        return "fits"

    def _wanted(self) -> list[str]:
        return [c for c in self.options.get("columns", "").split(",") if c]

    def schema(self):
        return FitsTable(self.options["path"]).ddl(self._wanted())

    def reader(self, schema):
        return FitsReader(self.options["path"], self._wanted(), int(self.options.get("rows_per_partition", 100_000)))


def fetched(address: str, tries: int = 6, delay: float = 15.0) -> str:
    """The text at an address. A failed try is repeated after a doubling delay; an error of the request itself isn't."""
    import urllib.error
    import urllib.request

    for k in range(tries):
        try:
            with urllib.request.urlopen(address, timeout=300) as answer:
                return answer.read().decode()
        except urllib.error.HTTPError as e:
            if 400 <= e.code < 500 and e.code != 429 or k == tries - 1:
                raise
        except OSError:
            if k == tries - 1:
                raise
        time.sleep(delay)
        delay = min(300.0, 2 * delay)
    raise ValueError("tries has to be 1 or more")


class _Query(InputPartition):
    def __init__(self, sql: str):
        self.sql = sql


class SqlReader(DataSourceReader):
    def __init__(self, options, names: list[str], types: list[str]):
        self.url, self.sql, self.names, self.types = options["url"], options["query"], names, types
        self.key, self.tries, self.delay = options.get("partition_column"), int(options.get("tries", 6)), float(options.get("delay", 15))
        self.ranges = [r.split(":") for r in options.get("ranges", "").split(",") if r]

    def partitions(self):
        if not self.ranges:
            return [_Query(self.sql)]
        joined = " AND " if " where " in self.sql.lower() else " WHERE "
        return [_Query(f"{self.sql}{joined}{self.key} BETWEEN {float(a):g} AND {float(b):g}") for a, b in self.ranges]

    def read(self, partition):
        import csv
        import io
        import urllib.parse

        address = f"{self.url}?{urllib.parse.urlencode({'cmd': ' '.join(partition.sql.split()), 'format': 'csv'})}"
        rows = list(csv.reader(io.StringIO(fetched(address, self.tries, self.delay))))
        rows = [r for r in rows if r and not r[0].startswith("#")]
        if not rows or rows[0] != self.names:
            raise ValueError(f"expected the columns {self.names}, got {rows[:1]}")
        cast = {"string": str, "long": int, "bigint": int, "int": int, "double": float, "float": float}
        for r in rows[1:]:
            yield tuple(None if v in ("", "null") else cast[t](v) for v, t in zip(r, self.types, strict=True))


class RemoteSql(DataSource):
    """format("remote_sql"): options url, query, columns ("a long, b double"), and for parallel reads partition_column and
    ranges ("1:30,31:60"). A failed try is repeated after a doubling delay; an error of the request itself isn't."""

    @classmethod
    def name(cls):
        return "remote_sql"

    def schema(self):
        return self.options["columns"]

    def reader(self, schema):
        fields = [c.split() for c in self.options["columns"].split(",")]
        return SqlReader(self.options, [f[0] for f in fields], [f[1].lower() for f in fields])


def register(spark: SparkSession) -> None:
    from prismview.functions.shared import importable

    importable(spark)
    spark.dataSource.register(FitsSource)
    spark.dataSource.register(RemoteSql)
