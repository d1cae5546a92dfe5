import random
from fractions import Fraction

import numpy as np
import pytest

from pactlake.llm import whitening
from tests.conftest import SF


def exact(rows):
    """x, S and n²·covariance of some vectors, in Python integers."""
    x = [[int(np.floor(np.float64(c) * 64)) + 1_000_000 for c in r] for r in rows]
    n, d = len(x), len(x[0])
    s = [sum(r[j] for r in x) for j in range(d)]
    return x, s, [[n * sum(r[j] * r[k] for r in x) - s[j] * s[k] for k in range(d)] for j in range(d)]


def check(rows, table, components=32):
    """table: vec_id -> vector of the rows that remain."""
    ids = list(table)
    x, s, c = exact([table[i] for i in ids])
    n, d = len(x), len(x[0])
    v = np.array([[float(Fraction(e, n * n)) for e in r] for r in c])
    e = np.sort(np.linalg.eigvalsh(v))[::-1][:components]
    m = min(components, d)
    got = {(r.vec_id, r.component): r for r in rows}
    assert set(got) == {(i, k) for i in ids for k in range(1, m + 1)} and len(rows) == len(got)
    z = np.array([[got[i, k].whitened for k in range(1, m + 1)] for i in ids])
    assert all(r.n == n for r in rows) and len({r.identity_error for r in rows}) == 1
    for i, own in zip(ids, x):
        assert {int(got[i, k].deviation) for k in range(1, m + 1)} == {sum((n * own[j] - s[j]) ** 2 for j in range(d))}
    assert np.allclose([got[ids[0], k].explained for k in range(1, m + 1)], e / np.trace(v), rtol=1e-6)
    error = np.abs(np.cov(z.T, bias=True).reshape(m, m) - np.eye(m)).max()
    assert error < 1e-6 and abs(error - rows[0].identity_error) < 1e-9
    centred = np.array([[float(Fraction(n * a - b, n)) for a, b in zip(own, s)] for own in x])
    for k in range(m):  # each component is the projection on a unit eigenvector
        a = np.linalg.lstsq(centred, z[:, k] * np.sqrt(e[k]), rcond=None)[0]
        assert np.allclose(v @ a, e[k] * a, atol=1e-6 * e[0]) and abs(np.linalg.norm(a) - 1) < 1e-6


def test_query_equals_rational_arithmetic(spark):
    table = {r.vec_id: r.embedding for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    df = whitening.op13_whitening(spark, SF)
    assert dict(df.dtypes) == {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double", "explained": "double", "identity_error": "double"}
    check(df.collect(), table)


@pytest.mark.parametrize("top", [3, 2**20, 2**40, 2**62])
def test_gram_is_exact(top):
    random.seed(top)
    y = np.array([[random.randint(-top, top) for _ in range(5)] for _ in range(300)], dtype=np.int64)
    y[0] = [top, -top, top - 1, 0, 1]
    y[1] = [-top, -top, -top, -top, -top]
    want = [[sum(int(r[j]) * int(r[k]) for r in y) for k in range(5)] for j in range(5)]
    assert whitening.exact_gram(y).tolist() == want and whitening.exact_gram(y.astype(object)).tolist() == want
    for row in want:
        for value in row:
            assert sum(limb << (40 * i) for i, limb in enumerate(whitening._split(value))) == value


def test_far_entries_lose_nothing(spark):
    """Large numbers beside small differences: double cross-products would lose them all."""
    rng = np.random.default_rng(3)
    rows = [(i, [float(2**45 + a), float(-(2**40) + b), float(c) / 64]) for i, (a, b, c) in enumerate(rng.integers(0, 4, (200, 3)).tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    check(whitening.whitened(df).collect(), dict(rows))


def test_numbers_end_at_the_bounds_of_longs():
    assert whitening.integers(np.array([[1e300, -1e300, 2.0**57, -0.001, 1.5]])).tolist() == [[2**63 - 1, -(2**63) + 10**6, 2**63 - 1, 999_999, 1_000_096]]


def test_odd_rows(spark):
    ok = [(i, [float(i % 3), float(i % 5), float(i % 7) / 8]) for i in range(40)]
    bad = [(50, None), (51, []), (52, [1.0, None, 2.0]), (53, [1.0, float("nan"), 2.0]), (54, [float("inf"), 1.0, 2.0]), (55, [-float("inf"), 1.0, 2.0]), (56, [1.0, 2.0]), (57, [1.0] * 9)]
    df = spark.createDataFrame(ok + bad, "vec_id long, embedding array<double>").selectExpr("*", "'x' AS whitened", "1 AS n", "2 AS id")
    check(whitening.whitened(df).collect(), dict(ok))
    twice = [*ok, *ok, (None, [1.0, 2.0, 3.0])]
    rows = whitening.whitened(spark.createDataFrame(twice, "vec_id long, embedding array<double>")).collect()
    assert len(rows) == 3 * 81 and all(r.n == 81 for r in rows) and sum(r.vec_id is None for r in rows) == 3
    assert whitening.whitened(df.limit(0)).collect() == [] and whitening.whitened(df.where("vec_id >= 50 AND vec_id < 56")).collect() == []
    assert whitening.whitened(df.where("vec_id = 7")).collect() == []  # one row: no variance
    flat = spark.createDataFrame([(i, [float(i), 2.0 * i, 5.0]) for i in range(9)], "vec_id long, embedding array<double>")
    assert {r.component for r in whitening.whitened(flat).collect()} == {1}  # of rank one
    assert [r.component for r in whitening.whitened(spark.createDataFrame(ok, "vec_id long, embedding array<double>"), components=1).where("vec_id = 3").collect()] == [1]


def test_one_task_or_many_give_one_result(spark):
    rows = [(i, [float(i % 11), float(i * i % 13)]) for i in range(500)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    get = lambda d: {(r.vec_id, r.component): (r.deviation, round(abs(r.whitened), 9)) for r in whitening.whitened(d).collect()}
    assert get(df.coalesce(1)) == get(df.repartition(9))
