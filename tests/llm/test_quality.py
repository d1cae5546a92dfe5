import pytest
from pyspark.sql import functions as F

from pactlake.llm import quality as ql
from tests.conftest import SF

SF_LARGER = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs = {r.doc_id: r for r in ql.op6_quality(spark, SF_LARGER).collect()}
    labels = spark.read.parquet(f"{SF_LARGER}/labels.parquet").collect()
    held = [(docs[r.doc_id].predicted, r.quality) for r in labels if docs[r.doc_id].held_out]
    assert len(docs) == 1000 and len(held) > 50
    assert sum(p == q for p, q in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in docs.values())


def test_held_out_rows_follow_crc(spark):
    import zlib

    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in ql.op6_quality(spark, SF).collect())


def test_scores_follow_compiled_rules(spark):
    rules = ql.Rules((((0, False, 1.0),), ((0, True, 1.0), (6, False, 0.1))), (2.0, -3.0), 0.5)
    df = spark.createDataFrame([(1, "a b c"), (2, "####"), (3, None), (4, "")], "doc_id long, text string")
    got = {r.doc_id: r.score for r in ql.decisions(df, rules).collect()}
    import math

    sig = lambda x: 1 / (1 + math.exp(-x))
    assert got == {1: pytest.approx(sig(2.5)), 2: pytest.approx(sig(-2.5)), 3: pytest.approx(sig(0.5)), 4: pytest.approx(sig(0.5))}


def test_odd_rows_and_columns(spark):
    rules = ql.Rules((((6, False, 0.2),),), (-9.0,), 3.0)
    df = spark.createDataFrame([(1, "fine words here"), (None, "### $$$"), (1, "fine words here"), (2, "w " * 200_000), (3, None)], "doc_id long, text string").selectExpr("*", "'x' AS q_stats", "1 AS `a.b`", "2 AS words")
    out = ql.keep(df, rules)
    assert out.columns == df.columns and sorted(r.doc_id for r in out.collect()) == [1, 1, 2, 3]
    assert [r.held_out for r in ql.decisions(df.where("doc_id IS NULL"), rules).collect()] == [False]
    assert ql.keep(df.limit(0), rules).count() == 0


def test_without_labels_all_score_alike(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, label int")
    assert ql.fit(df, none).score([]) is not None and ql.fit(df, none).bias == 0
    one = spark.createDataFrame([(1, 1), (None, 0), (2, None)], "doc_id long, label int")
    assert {r.predicted for r in ql.decisions(df, ql.fit(df, one)).collect()} == {1}


def test_rules_are_few_and_conjunctive(spark):
    docs, labels = (spark.read.parquet(f"{SF_LARGER}/{t}.parquet") for t in ("documents", "labels"))
    rules = ql.learned(docs, labels)
    assert 0 < len(rules.rules) < 60 and all(1 <= len(r) <= ql.DEPTH for r in rules.rules) and all(rules.weights)
    assert ql.statistics(docs, F.col("text"), "q")[0].columns == [*docs.columns, "q_stats"]


def plain_statistics(text):
    """The ten statistics of a text, in Python."""
    import math
    import unicodedata

    words = [w for w in text.replace("\n", " ").replace("\t", " ").split(" ") if w]
    lines, n, chars = text.split("\n"), max(1, len(words)), max(1, len(text))
    share = lambda ok: sum(map(ok, text)) / chars
    return [
        math.log1p(len(words)),
        len(text) / n,
        len(set(words)) / n,
        sum(len(w) <= 3 for w in words) / n,
        sum(a == b for a, b in zip(words, words[1:])) / n,
        1 - len(set(lines)) / len(lines),
        share(lambda c: c in "#$%&*|{}<>=_~^@\\/+"),
        share(lambda c: c in "!?"),
        share(lambda c: c in "0123456789"),
        share(lambda c: unicodedata.category(c) == "Lu"),
    ]


def test_query_equals_brute_force(spark):
    """Every score from statistics and rules in plain Python, whole texts and odd ones included."""
    import math

    documents, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rules = ql.learned(documents, labels)
    odd = [(-1, ""), (-2, None), (-3, "a" * 400_000), (-4, "Ä é ß\t\n\n x x x"), (-5, "word " * 60_000 + "\nword"), (-6, "!?!? 123 #$%")]
    rows = documents.select("doc_id", "text").unionByName(spark.createDataFrame(odd, "doc_id long, text string"))
    got = {r.doc_id: r.score for r in ql.decisions(rows, rules).collect()}
    for r in rows.collect():
        stats = plain_statistics(r.text or "")
        fires = [all(stats[i] <= at if below else stats[i] > at for i, below, at in rule) for rule in rules.rules]
        want = 1 / (1 + math.exp(-(rules.bias + sum(w for w, f in zip(rules.weights, fires) if f))))
        assert abs(got[r.doc_id] - want) < 1e-9
