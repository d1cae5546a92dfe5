import numpy as np
import pytest
from pyspark.sql import functions as F

from pactlake.llm import mixing as mx
from tests.conftest import SF


def table(spark):
    rows = [(i, "good plain words " * (5 + i % 7), "a") for i in range(60)] + [(100 + i, "awful nasty words " * (5 + i % 3), "b") for i in range(30)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    return docs, spark.createDataFrame([(r[0], r[2]) for r in rows if r[0] % 2], "doc_id long, domain string")


def test_targets_are_met(spark):
    docs, labelled = table(spark)
    got = mx.rates(docs, labelled, {"a": 0.9, "b": 0.1}, "a").collect()
    total = {d: sum(r.rate * r.tokens * r[f"p_{d}"] for r in got) for d in "ab"}
    assert total["b"] / (total["a"] + total["b"]) == pytest.approx(0.1, abs=1e-3)
    assert total["a"] == pytest.approx(sum(r.tokens * r.p_a for r in got), rel=1e-3)
    assert all(r.rate >= 0 and abs(r.copies - r.rate) < 1 and r.p_a + r.p_b == pytest.approx(1) for r in got)


def test_projection_holds_rates_at_zero(spark):
    rows = spark.createDataFrame([(10, [0.5, 0.5]), (10, [1.0, 0.0]), (10, [0.9, 0.1])], "tokens long, p array<double>")
    moves, reached = mx.fit_moves(rows, ["a", "b"], {"a": 0.999, "b": 0.001}, "a")
    rates = [r[0] for r in rows.select(mx.rate_of(moves, "p")).collect()]
    assert min(rates) == 0.0
    assert reached["a"][1] == pytest.approx(reached["a"][0], rel=0.05)
    with pytest.warns(UserWarning, match="can't be met"):
        mx.fit_moves(rows.where("p[0] < 0.95"), ["a", "b"], {"a": 0.999, "b": 0.001}, "a")


@pytest.mark.parametrize("targets", [(0.6, 0.3, 0.1), (0.98, 0.01, 0.01), (0.3, 0.69, 0.01)])
def test_least_squares_equal_brute_force(spark, targets):
    """The squared errors are as small as those of many plain projected gradient steps over all rates, with targets in and out of reach."""
    rng = np.random.default_rng(12)
    p = rng.dirichlet([0.7, 0.5, 0.4], 80)
    tokens = rng.integers(1, 50, 80)
    rows = spark.createDataFrame([(int(n), x.tolist()) for n, x in zip(tokens, p)], "tokens long, p array<double>")
    import warnings

    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        _, got = mx.fit_moves(rows, ["a", "b", "c"], dict(zip("abc", targets)), "a")
    start = tokens @ p
    goal = start[0] / targets[0] * np.array(targets)
    a = (p * tokens[:, None]).T / start[:, None]
    rate = np.ones(80)
    for _ in range(50_000):
        rate = np.maximum(0, rate - (a.T @ (a @ rate - goal / start)) / np.linalg.norm(a, 2) ** 2)
    best = ((a @ rate - goal / start) ** 2).sum()
    mine = sum(((got[d][1] - got[d][0]) / s) ** 2 for d, s in zip("abc", start))
    assert mine <= best + 1e-3


def test_query_keeps_clean_documents(spark):
    got = {r.doc_id: r for r in mx.op10_mixing(spark, SF).collect()}
    assert len(got) == 200
    labels = spark.read.parquet(f"{SF}/labels.parquet").collect()
    clean = [got[r.doc_id] for r in labels if r.quality == 1 and r.toxic == 0]
    toxic = [got[r.doc_id] for r in labels if r.toxic == 1]
    assert sum(r.copies > 0 for r in clean) / len(clean) > 0.9
    assert sum(r.copies for r in toxic) / len(toxic) < 0.5


def test_odd_rows(spark):
    docs, labelled = table(spark)
    odd = spark.createDataFrame([(None, "good plain words"), (500, None), (501, ""), (502, "nasty " * 200_000), (1, "good plain words " * 6), (1, "good plain words " * 6)], "doc_id long, text string")
    every = docs.unionByName(odd).selectExpr("*", "1 AS _words", "2 AS `a.b`", "'x' AS _tokens")
    out = mx.mixed(every, labelled, {"a": 0.9, "b": 0.1}, "a")
    assert out.columns == every.columns and out.where("doc_id < 60").count() > 50
    assert mx.rates(docs.limit(0), labelled).count() == 0
    assert [r.rate for r in mx.rates(docs, labelled.limit(0)).limit(3).collect()] == [1.0] * 3


def test_copies_average_to_the_rate(spark):
    got = spark.range(20_000).select(mx.copies(F.lit(1.3), "id").alias("c")).agg(F.avg("c"), F.min("c"), F.max("c")).first()
    assert got[0] == pytest.approx(1.3, abs=0.02) and (got[1], got[2]) == (1, 2)


def test_no_python_in_the_plan(spark):
    plan = mx.op10_mixing(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_without_its_anchor_the_largest_domain_keeps_its_tokens(spark):
    rows = mx.settle(spark.createDataFrame([(10, [1.0, 0.0]), (30, [0.0, 1.0]), (20, [0.0, 1.0])], "tokens long, p array<double>"))
    with pytest.warns(UserWarning, match="'clean'"):
        moves, outcome = mx.fit_moves(rows, ["junk", "toxic"], {"clean": 0.96, "junk": 0.02, "toxic": 0.02}, "clean")
    assert outcome["toxic"][0] == pytest.approx(50) and outcome["junk"][0] == pytest.approx(50) and moves
    assert mx.fit_moves(rows, ["clean"], {"clean": 1.0}, "clean") == ({}, {})
    assert mx.fit_moves(rows.limit(0), ["junk", "toxic"], {"junk": 0.5, "toxic": 0.5}, "clean") == ({}, {})
