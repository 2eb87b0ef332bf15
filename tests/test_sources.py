import gzip
import struct
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer
from urllib.parse import parse_qs, urlparse

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prismview.sources import columns, connectors, readers


def test_spaced_and_irregular_text(spark, tmp_path):
    p = tmp_path / "a.txt"
    p.write_text("# id x\n 0123456789012345678 1.5\n2 oops\n\n")
    schema = T.StructType([T.StructField("id", T.StringType()), T.StructField("x", T.DoubleType())])
    assert [tuple(r) for r in readers.spaced_text(spark, str(p), schema).collect()] == [("0123456789012345678", 1.5), ("2", None)]
    p.write_text("1 2 3\n")
    with pytest.raises(Exception, match="expected 2 fields"):
        readers.spaced_text(spark, str(p), schema).collect()
    p.write_text("a 1.5 some free text\nb x y\nc 2\n")
    good, bad = readers.irregular_text(spark, str(p), schema)
    assert [tuple(r) for r in good.orderBy("id").collect()] == [("a", 1.5, "some free text"), ("c", 2.0, "")] and bad.first()["n_bad"] == 1


def test_chunks(spark, tmp_path):
    for name, body in (("c1", "id,v\n001,5\n002,6\n"), ("c2", "id,v\n001,7\n003,8\n")):
        (tmp_path / f"{name}.csv.gz").write_bytes(gzip.compress(body.encode()))
    schema = T.StructType([T.StructField("id", T.StringType()), T.StructField("v", T.IntegerType())])
    got = readers.compiled_chunks(spark, str(tmp_path), schema, ["id"]).orderBy("id").collect()
    assert [tuple(r) for r in got] == [("001", 5, "c1"), ("002", 6, "c1"), ("003", 8, "c2")]
    assert {r["name"] for r in readers.listing(spark, str(tmp_path)).collect()} == {"c1.csv.gz", "c2.csv.gz"}
    bad = T.StructType([T.StructField("key", T.StringType()), T.StructField("v", T.IntegerType())])
    with pytest.raises(Exception):
        readers.csv_chunks(spark, str(tmp_path), bad).collect()


def test_small_helpers(spark, tmp_path):
    assert readers.key_ranges([5, 1, 3, 3, 9], 2) == [(1, 3), (5, 9)] and readers.degree_ranges(0, 25)[-1] == (20.0, None)
    assert readers.safe_base("../x") == "data" and readers.safe_base("a/b") == "a/b" and readers.json_or(str(tmp_path / "no"), 3) == 3
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    assert readers.tolerant_columns(df, {"a": "int", "z": "double"}).first()["z"] is None
    with pytest.raises(ValueError):
        readers.tolerant_columns(df, {"x": "int", "z": "double", "a": "int"})
    (tmp_path / "t.tex").write_text("x & y \\\\\n$8.5$ & ${-0.2}$ \\\\\n")
    assert [tuple(r) for r in readers.latex_rows(spark, str(tmp_path / "t.tex"), r"\d", ["a", "b"]).collect()] == [(8.5, -0.2)]
    s = readers.synthetic(spark, 2000)
    r = s.agg(F.corr("mass", "size").alias("c"), F.count_if(F.col("rate").isNull()).alias("n")).first()
    assert r["c"] > 0.5 and 50 < r["n"] < 150


def fits(path, rows):
    card = lambda k, v: f"{k:<8}= {v:>20}".ljust(80)
    pad = lambda b, c=b" ": b + c * (-len(b) % 2880)
    first = pad("".join([card("SIMPLE", "T"), card("BITPIX", 8), card("NAXIS", 0), "END".ljust(80)]).encode())
    body = b"".join(struct.pack(">id4s2h", a, b, c.encode().ljust(4), *d) for a, b, c, d in rows)
    head = [card("XTENSION", "'BINTABLE'"), card("BITPIX", 8), card("NAXIS", 2), card("NAXIS1", 20), card("NAXIS2", len(rows)), card("PCOUNT", 0), card("GCOUNT", 1), card("TFIELDS", 4)]
    for i, (n, f) in enumerate((("a", "J"), ("b", "D"), ("c", "4A"), ("d", "2I"))):
        head += [card(f"TTYPE{i + 1}", f"'{n}'"), card(f"TFORM{i + 1}", f"'{f}'")]
    path.write_bytes(first + pad("".join([*head, "END".ljust(80)]).encode()) + pad(body, b"\0"))


def test_fits(spark, tmp_path):
    rows = [(i, i / 4, f"n{i}", (i, -i)) for i in range(7)]
    fits(tmp_path / "t.fits", rows)
    connectors.register(spark)
    df = spark.read.format("fits").option("path", f"file://{tmp_path}/t.fits").option("rows_per_partition", 3).load()
    assert sorted((r["a"], r["b"], r["c"], tuple(r["d"])) for r in df.collect()) == rows and df.rdd.getNumPartitions() == 3
    assert spark.read.format("fits").option("path", f"file://{tmp_path}/t.fits").option("columns", "a,c").load().columns == ["a", "c"]


def test_remote_sql_retries_and_checks(spark):
    seen = []

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            sql = parse_qs(urlparse(self.path).query)["cmd"][0]
            seen.append(sql)
            if seen.count(sql) == 1:
                self.send_response(503), self.end_headers()
                return
            lo = sql.rsplit("BETWEEN ", 1)[1].split(" ")[0]
            self.send_response(200), self.end_headers()
            self.wfile.write(f"#Table1\nid,x\n{lo},2.5\n00,\n".encode())

        def log_message(self, *a):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    connectors.register(spark)
    o = {"url": f"http://127.0.0.1:{server.server_port}/sql", "query": "SELECT id,  x\nFROM t", "columns": "id string, x double", "partition_column": "plate", "ranges": "1:30,31:60", "delay": "0.05"}
    df = spark.read.format("remote_sql").options(**o).load()
    assert sorted((r["id"], r["x"]) for r in df.collect()) == [("00", None), ("00", None), ("1", 2.5), ("31", 2.5)]
    assert "SELECT id, x FROM t WHERE plate BETWEEN 1 AND 30" in seen
    with pytest.raises(Exception, match="expected the columns"):
        spark.read.format("remote_sql").options(**o | {"columns": "id string, y double"}).load().collect()
    server.shutdown()


def test_column_files(spark, tmp_path):
    v = np.arange(1000, dtype=np.uint16) * 65
    assert columns.unshuffled(columns.shuffled(v), 1000).tolist() == v.tolist() and columns.unpacked(b"ab") == b"ab"
    with pytest.raises(ValueError):
        columns.unshuffled(b"abc", 2)
    df = spark.range(1000).select(F.col("id").alias("rank"), F.when(F.col("id") % 10 > 0, F.col("id") / 7).alias("x"))
    made = columns.write_columns(df, "rank", {"x": (0.0, 200.0)}, f"file://{tmp_path}/out", 300)
    assert sum(r["rows"] for r in made.collect()) == 1000
    back = columns.read_column(spark, f"file://{tmp_path}/out", "x", 0.0, 200.0, 300).join(df, "rank")
    half = 200 / 65534 / 2
    assert back.count() == 1000 and back.where((F.col("x").isNull() != F.col("value").isNull()) | (F.abs(F.col("x") - F.col("value")) > half * 1.0001)).count() == 0


def test_cached_tables(spark, tmp_path):
    src = tmp_path / "src"
    src.write_text("x")
    built = []

    def build():
        built.append(1)
        return spark.range(3)

    for _ in range(2):
        assert readers.cached(spark, f"file://{tmp_path}/table", [str(src)], build).count() == 3
    assert len(built) == 1
