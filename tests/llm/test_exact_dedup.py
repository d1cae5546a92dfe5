import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pactlake.llm import exact_dedup as ed
from tests.conftest import SF, canonical

ODD = "doc_id long, text string, fp string, `a.b` int, row array<int>, m map<string,int>"


def odd_rows():
    return [(1, None, "x", 1, [1], {"a": 1}), (2, "", None, None, None, None), (None, "q", "x", 1, [], {}), (3, "q", "x", 2, [2], {}), (3, "q", "x", 2, [2], {}), (4, "z" * 300_000, "y", 3, [3], None), (5, "z" * 300_000, "y", 3, [3], None), (6, "u", "y", 3, [3], None)]


def test_query_equals_sql(spark, duck):
    got = ed.op1_exact_dedup(spark, SF)
    want = duck.execute(ed.SQL["op1_exact_dedup"])
    assert canonical(got.columns, [tuple(r) for r in got.collect()]) == canonical([c[0] for c in want.description], want.fetchall())


@pytest.mark.parametrize("bits", [64, 2])
def test_odd_rows(spark, bits):
    """Nulls equal empties, null ids lose, repeated rows keep one, and colliding fingerprints are told apart."""
    got = sorted(map(tuple, ed.decisions(spark.createDataFrame(odd_rows(), ODD), bits=bits).select("doc_id", "keep_id", "group_size", "kept").collect()), key=str)
    assert [r for r in got if r[0] in (1, 2)] == [(1, 2, 2, False), (2, 2, 2, True)]
    assert sorted((r[1:] for r in got if r[0] in (None, 3)), key=str) == [(3, 3, False), (3, 3, False), (3, 3, True)]
    assert [r for r in got if r[0] in (4, 5, 6)] == [(4, 5, 2, False), (5, 5, 2, True), (6, 6, 1, True)]


def test_survivors_keep_all_columns(spark):
    df = spark.createDataFrame(odd_rows(), ODD)
    out = ed.survivors(df)
    assert out.columns == df.columns and out.schema.fieldNames() == df.schema.fieldNames()
    assert sorted(r.doc_id for r in out.collect()) == [2, 3, 5, 6]
    assert ed.survivors(df.limit(0)).count() == 0 and ed.decisions(df.limit(0)).count() == 0


@settings(deadline=None, max_examples=50)
@given(st.lists(st.integers(0, 2**64 - 1) | st.integers(0, 50), max_size=200), st.integers(1, 5))
def test_filters_merge_without_loss(values, parts):
    whole = np.array(values, dtype=np.uint64)
    blocks = [b for i in range(parts) for b in ed.build_filters(iter([pa.RecordBatch.from_arrays([pa.array(whole[i::parts].view(np.int64))], names=["fp"])]))]
    table = pa.Table.from_batches(blocks).sort_by("block") if blocks else None
    merged = [r for b in ed.merge_filters(iter(table.to_batches(max_chunksize=3))) for r in zip(b.column(0).to_pylist(), b.column(1).to_pylist())] if table else []
    want = {int(np.int64(np.uint64(v).view(np.int64))): n for v, n in zip(*np.unique(whole, return_counts=True)) if n > 1}
    assert dict(merged) == want and len(merged) == len(want)
