from pyspark.sql import functions as F

from pactlake.llm import url_filter as uf
from pactlake.llm.common import settle
from tests.conftest import SF, canonical


def test_query_equals_sql(spark, duck):
    got = uf.op5_url_filter(spark, SF)
    assert uf.op5_url_filter(spark, SF.replace("0.001", "0.01")).where("rule IS NULL AND verdict = 'block'").count() > 0
    want = duck.execute(uf.SQL["op5_url_filter"])
    assert canonical(got.columns, [tuple(r) for r in got.collect()]) == canonical([c[0] for c in want.description], want.fetchall())


def test_cascade_is_exact_over_its_universe(spark):
    universe = settle(spark.range(20_000).select(F.format_string("key%d", "id").alias("key")))
    for share, most in ((2, uf.MAX_BITS), (50, uf.MAX_BITS), (100_000, uf.MAX_BITS), (2, 100)):
        listed = settle(universe.where(F.crc32("key") % share == 0))
        cascade = uf.Cascade(listed, universe, most)
        inside = {r.key for r in listed.collect()}
        assert {r.key for r in cascade.marked(universe, "is").where("is").collect()} == inside
        assert (cascade.joined is None) == (most > 100)
    assert len(uf.Cascade(settle(universe.where("key LIKE '%7'")), universe).levels) > 1


def judge(spark, urls, rules, blocked=()):
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("key", F.lit("clash")).withColumn("host", F.lit("clash"))
    rows = uf.decisions(pages, spark.createDataFrame(rules, "host string, path string, verdict string"), spark.createDataFrame([(b,) for b in blocked], "host string"))
    return [tuple(r)[1:] for r in sorted(rows.collect())]


def test_rules(spark):
    rules = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("com", "/de/", "block")]
    got = judge(
        spark,
        ["http://A.Example.NET/en/x?y", "http://example.net/fr", "x://badexample.net/en/1", None, "", "no scheme", "http://z.com/de", "http://z.com/de/#", "http://spam.org", "http://net?/", "a://b://c.net/"],
        rules,
        ["Spam.org", None, ""],
    )
    assert got == [
        ("a.example.net", "/en/x", "example.net/en/", "allow"),
        ("example.net", "/fr", "net/", "block"),
        ("badexample.net", "/en/1", "net/", "block"),
        ("", "", None, "allow"),
        ("", "", None, "allow"),
        ("", "", None, "allow"),
        ("z.com", "/de", None, "allow"),
        ("z.com", "/de/", "com/de/", "block"),
        ("spam.org", "", None, "block"),
        ("net", "", None, "allow"),
        ("b:", "//c.net/", None, "allow"),
    ]


def test_large_lists_are_joined(spark):
    pages = spark.createDataFrame([(1, "http://a.net/x"), (2, "http://b.c.org/"), (3, "http://d.org")], "page_id long, url string")
    rules = spark.createDataFrame([("net", "/", "block")], "host string, path string, verdict string")
    rows = uf.decisions(pages, rules, spark.createDataFrame([("c.org",)], "host string"), most=1).collect()
    assert sorted((r.page_id, r.rule, r.verdict) for r in rows) == [(1, "net/", "block"), (2, None, "block"), (3, None, "allow")]


def test_long_urls(spark):
    """A host of very many labels, and a very long path: as many keys as the lists have label counts."""
    many, path = "a." * 100_000, "/en/" + "p" * 1_000_000
    got = judge(spark, [f"http://{many}example.net{path}", f"http://{many}spam.org", "http://" + "." * 100_000], [("example.net", "/en/", "allow"), ("net", "/", "block")], ["spam.org", "org.x.y.z"])
    assert [(r[2], r[3]) for r in got] == [("example.net/en/", "allow"), (None, "block"), (None, "allow")]
    assert len(got[0][1]) == len(path)


def test_empty(spark):
    assert judge(spark, [], [("net", "/", "block")]) == []
    assert judge(spark, ["http://a.net/"] * 2, []) == [("a.net", "/", None, "allow")] * 2


def test_levels_in_slices(spark, monkeypatch):
    """Whether a level is one array or many, membership is exact; no join stands in the plan of the rows."""
    keys = [f"k{i}" for i in range(4000)]
    listed = set(keys[::3])
    universe = uf.settle(spark.createDataFrame([(k,) for k in keys], "key string"))
    own = uf.settle(spark.createDataFrame([(k,) for k in sorted(listed)] + [("never",)], "key string"))
    for words in (1 << 21, 7):
        monkeypatch.setattr(uf, "SLICE", words)
        cascade = uf.Cascade(own, universe)
        assert max(len(s) for s, _ in cascade.levels) == (1 if words > 7 else -(-max(n for _, n in cascade.levels) // 64 // 7))
        got = cascade.marked(universe, "hit")
        assert {r.key for r in got.collect() if r.hit} == listed
        assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString().split("Subquery")[0]
