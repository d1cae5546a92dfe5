import hashlib

import pytest
from pyspark.sql import functions as F

from pactlake.llm import sketch as sk
from tests.conftest import SF


def shingles(text):
    words = text.lower().split()
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    """(doc_id, text) in order of descending id -> {doc_id: (n_chars, sha256 of the edited text, true containments)}."""
    out = {}
    for k, (i, text) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        third = len(text) // 3
        edited = text[: len(text) - third] + after[:third]
        a = shingles(text)
        near = [len(a & shingles(b)) / len(a) if a else 0.0 for b in (edited, after)]
        out[i] = (len(text), hashlib.sha256(edited.encode()).hexdigest(), *near, len(a))
    return out


@pytest.mark.parametrize("bucket,fanout", [(4096, 256), (7, 256), (3, 4)])
def test_equals_brute_force(spark, bucket, fanout, monkeypatch):
    """Also over many buckets, where heads are lent, and with more cuts than are compared at once."""
    monkeypatch.setattr(sk, "FANOUT", fanout)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = brute(sorted(((r.doc_id, r.text or "") for r in docs.collect()), reverse=True))
    got = {r.doc_id: r for r in sk.decisions(docs, bucket=bucket).collect()}
    assert {i: (r.n_chars, r.edited_sha256) for i, r in got.items()} == {i: w[:2] for i, w in want.items()}
    large = [i for i, w in want.items() if w[4] > 200]
    for i in large:
        assert abs(got[i].near_edited - want[i][2]) < 0.25 and abs(got[i].near_next - want[i][3]) < 0.25
    assert sum(abs(got[i].near_edited - want[i][2]) for i in large) / len(large) < 0.06


def test_ids_of_any_spread(spark):
    ids = [0, 1, 2, -5, 10**15, 10**15 + 1, -(10**17), 77, 78, 79, 2**62]
    df = spark.createDataFrame([(i, f"text of {i} " * 5) for i in ids], "doc_id long, text string")
    want = brute(sorted(((r.doc_id, r.text) for r in df.collect()), reverse=True))
    got = {r.doc_id: (r.n_chars, r.edited_sha256) for r in sk.decisions(df, bucket=2).collect()}
    assert got == {i: w[:2] for i, w in want.items()}


@pytest.mark.parametrize("kind", ["outlier", "null", "repeated"])
def test_no_bucket_is_crowded(spark, kind):
    """An outlying id, null ids and one repeated id don't gather rows in one bucket."""
    id_col = {"outlier": "CASE WHEN id = 5 THEN 1L << 60 ELSE id END", "null": "CASE WHEN id % 3 > 0 THEN id END", "repeated": "CASE WHEN id % 3 > 0 THEN id ELSE 7 END"}[kind]
    df = spark.range(60_000).selectExpr(f"{id_col} AS doc_id", "concat('text ', id) AS text")
    keys = sk.settle(sk._keyed(df).select("k", "h"))
    largest = sk.with_bucket(keys, sk.bucket_cuts(keys)).groupBy("bucket").count().agg(F.max("count"), F.count("*")).first()
    assert largest[0] <= 2 * sk.BUCKET and largest[1] >= 40


def test_odd_rows(spark):
    rows = [(3, "a b c d e f"), (3, "a b c d e f"), (2, None), (1, ""), (None, "x"), (4, "W " * 200_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS k", "2 AS bucket", "'x' AS sketch")
    got = sk.decisions(df).collect()
    assert len(got) == len(rows)
    three = [r for r in got if r.doc_id == 3]
    assert three[0].fingerprint == three[1].fingerprint
    empty = [r for r in got if r.doc_id in (1, 2)]
    assert all(r.fingerprint == "" and r.n_chars == 0 and r.near_edited == 1.0 for r in empty)
    assert [r.near_next for r in got if r.doc_id == 2] == [1.0] and [r.near_next for r in got if r.doc_id == 1] == [0.0]
    one = sk.decisions(df.where("doc_id = 4")).first()
    assert one.near_next == 1.0
    assert sk.decisions(df.limit(0)).count() == 0


def test_sketches_merge(spark):
    a, b = "one two three four five six seven " * 30, "eight nine ten eleven twelve thirteen " * 30
    df = spark.createDataFrame([(a,), (b,)], "t string")
    held = [set(r.s) for r in sk.with_sketch(df, F.col("t"), "s").collect()]
    every = [set(r.s) for r in sk.with_sketch(df, F.col("t"), "s", scale=1).collect()]
    limit = -(2**63) + 2**64 // sk.SCALE
    assert held == [{h for h in e if h < limit} for e in every]


def test_no_python_in_the_plan(spark):
    plan = sk.op9_scaled_sketch(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
