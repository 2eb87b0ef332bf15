"""Acquisition that is stopped, fails in places, and goes on where it was."""

import threading
from http.server import BaseHTTPRequestHandler, HTTPServer
from urllib.parse import parse_qs, urlparse

import pytest

from prismview.sources.acquire import acquire, present, sql_plan
from prismview.sources.readers import key_ranges


@pytest.fixture()
def service():
    asked, broken = [], set()

    class Service(BaseHTTPRequestHandler):
        def do_GET(self):
            sql = parse_qs(urlparse(self.path).query)["cmd"][0]
            a, b = (int(x) for x in sql.split("BETWEEN ")[1].split(" AND "))
            asked.append(a)
            self.send_response(404 if a in broken else 200)
            self.end_headers()
            if a not in broken:
                rows = [f'0{k},"name, {k}"' for k in range(a, b + 1) if k % 7]  # some chunks have no rows
                self.wfile.write("\n".join(["# a note", "id,name", *rows, ""]).encode())

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/sql", asked, broken
    server.shutdown()


def rows_in(spark, folder):
    df = spark.read.option("header", True).schema("id string, name string").csv(f"{folder}/*.csv.gz")
    return sorted((r["id"], r["name"]) for r in df.collect())


def test_goes_on_where_it_was_stopped(spark, service, tmp_path):
    url, asked, broken = service
    keys = [k for k in range(1, 41) if k % 7] + [7, 14]
    plan = sql_plan(url, "SELECT id,\n name FROM t", "k", key_ranges(keys, 4), "t")
    folder = f"file://{tmp_path}/chunks"
    wanted = [name for name, _ in plan]
    assert acquire(spark, plan, folder, ["id", "name"], seconds=0) == wanted and not asked
    few = plan[:4]  # a run that ended after four chunks
    assert acquire(spark, few, folder, ["id", "name"]) == [] and len(asked) == 4
    broken |= {int(wanted[6].split("_")[1])}
    assert acquire(spark, plan, folder, ["id", "name"], delay=0.01) == [wanted[6]]
    assert len(asked) == len(plan) + 1 and set(asked) >= {int(n.split("_")[1]) for n in wanted}  # the broken one twice, what was there never again
    broken.clear()
    asked.clear()
    assert acquire(spark, plan, folder, ["id", "name"]) == [] and asked == [int(wanted[6].split("_")[1])]
    asked.clear()
    assert acquire(spark, plan, folder, ["id", "name"]) == [] and not asked
    assert {n for n in present(folder) if not n.startswith(".")} == set(wanted) and not [n for n in present(folder) if n.endswith(".tmp")]
    lows = [tuple(int(float(x)) for x in n.removesuffix(".csv.gz").split("_")[1:]) for n in wanted]
    assert rows_in(spark, folder) == sorted((f"0{k}", f"name, {k}") for a, b in lows for k in range(a, b + 1) if k % 7)


def test_another_header_is_an_error(spark, service, tmp_path):
    url, _, _ = service
    plan = sql_plan(url, "SELECT id, name FROM t", "k", [(1, 3)], "t")
    with pytest.raises(Exception, match="expected the columns"):
        acquire(spark, plan, f"file://{tmp_path}/chunks", ["id", "other"])
    assert not [n for n in present(f"file://{tmp_path}/chunks") if n.endswith(".gz")]
