from prismview.llm import url_filters as u


def domains(spark, hosts, suffixes=None):
    table = suffixes and spark.createDataFrame([(s,) for s in suffixes], "suffix string")
    got = u.registered_domains(spark.createDataFrame([(h, 1, 0) for h in hosts], "host string, n long, bad long"), table)
    return {r["host"]: (r["domain"], r["suffix"]) for r in got.collect()}


def test_suffixes(spark):
    got = domains(spark, ["www.a.co.uk", "co.uk", "b.com", "x.y.b.com", "com", "", "10.0.0.1", "[::1]", "1.2.3.4.5"])
    assert got == {"www.a.co.uk": ("a.co.uk", "co.uk"), "co.uk": ("co.uk", "co.uk"), "b.com": ("b.com", "com"), "x.y.b.com": ("b.com", "com"), "com": ("com", "com"),
                   "": ("", ""), "10.0.0.1": ("10.0.0.1", "ip"), "[::1]": ("[::1]", "ip"), "1.2.3.4.5": ("4.5", "5")}
    own = domains(spark, ["p.q.a.b.c", "x.b.c", "b.c", "x.co.uk"], ["a.b.C", "b.c", None, "b.c"])
    assert own == {"p.q.a.b.c": ("q.a.b.c", "a.b.c"), "x.b.c": ("x.b.c", "b.c"), "b.c": ("b.c", "b.c"), "x.co.uk": ("co.uk", "uk")}
    assert u.registered_domains(spark.createDataFrame([("x.b.c",)], "host string"), spark.createDataFrame([], "suffix string")).first()["domain"] == "b.c"


def test_ports_share_a_reputation(spark):
    pages = [(i, f"http://bad.org{':8080' if i % 2 else ''}/p") for i in range(40)] + [(100 + i, f"http://good{i % 4}.org/p") for i in range(80)]
    pages = spark.createDataFrame([*pages, (500, "http://bad.org:99/new"), (501, None)], "page_id long, url string")
    outcomes = spark.createDataFrame([(i, True) for i in range(40)] + [(100 + i, False) for i in range(80)], "page_id long, bad boolean")
    got = {r["page_id"]: (r["host"], r["verdict"]) for r in u.url_filters(pages, outcomes).collect()}
    assert got[500] == ("bad.org:99", "block") and got[0] == ("bad.org", "block") and got[1] == ("bad.org:8080", "block") and got[100] == ("good0.org", "allow") and got[501][0] == ""
