import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from pactlake.llm import packing as pk
from tests.conftest import SF


def ids_of(texts):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return [[*e.ids, 0] for e in t.encode_batch(texts, add_special_tokens=False)]


def check(rows, docs, length=pk.LENGTH):
    """Rows reconstruct every document's ids, and sequences are gapless and not overfull."""
    want = {}
    for doc_id, ids in docs:
        first = len(ids) % length or length
        cuts = [0, *range(first, len(ids), length), len(ids)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want.setdefault((doc_id, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())), 0)
            want[doc_id, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    got, by = {}, {}
    for r in rows:
        key = (r.doc_id, r.piece, r.start, r.length, r.ids_crc32)
        got[key] = got.get(key, 0) + 1
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert got == want
    for places in by.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= length
    return len(by)


def test_query_reconstructs_documents_and_packs_tightly(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    ids = ids_of([r.text or "" for r in docs])
    n = check(pk.op7_packing(spark, SF).collect(), [(r.doc_id, i) for r, i in zip(docs, ids)])
    assert n <= -(-sum(map(len, ids)) // pk.LENGTH) + 1


def test_encoders_agree():
    texts = ["", " ", "a\n\n b  c", "Élan vital 123,456 <|endoftext|>", "<|endoftext|>", "a <|endoftext|> b<|endoftext|><|endoftext|>\n c  <|endoftext|>  ", "<|endoftext| >", "日本語 🙂", "x" * 5000, "\u200b\ufeff\x00"]
    assert [[*pk.public_encoder()(t), 0] for t in texts] == ids_of(texts)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (2, ""), (None, "null id"), (3, "word " * 9000), (4, "a b"), (5, "x<|endoftext|> y " * 700)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS piece", "1 AS length")
    got = pk.pack(pk.token_pieces(df)).collect()
    check(got, list(zip([r[0] for r in rows], ids_of([r[1] or "" for r in rows]))))
    assert pk.pack(pk.token_pieces(df.limit(0))).count() == 0
    ids = pk.token_pieces(df.where("doc_id = 4"), keep_ids=True).first()
    assert np.frombuffer(ids.ids, "<u4").tolist() == ids_of(["a b"])[0]


@settings(deadline=None, max_examples=150)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 30), max_size=15))
def test_plan_is_best_fit_decreasing(counts):
    """The runs place each rank once, never overfill, and open as many sequences as item-by-item best fit does."""
    length, fill, seen = 40, {}, set()
    for size, lo, hi, first, each, at in pk.plan(counts, length):
        for rank in range(lo, hi):
            assert (size, rank) not in seen
            seen.add((size, rank))
            fill.setdefault(first + (rank - lo) // each, []).append((at + (rank - lo) % each * size, size))
    assert seen == {(s, r) for s, n in counts.items() for r in range(n)}
    for places in fill.values():
        end = 0
        for offset, size in sorted(places):
            assert offset == end
            end += size
        assert end <= length
    gaps = []
    for size in sorted((s for s, n in counts.items() for _ in range(n)), reverse=True):
        fits = [g for g in gaps if g >= size]
        if fits:
            gaps.remove(min(fits))
            gaps.append(min(fits) - size)
        else:
            gaps.append(length - size)
    assert len(fill) == len(gaps)


@pytest.mark.parametrize("n,want", [(1, [(0, 1)]), (2048, [(0, 2048)]), (2049, [(0, 1), (1, 2048)]), (4100, [(0, 4), (4, 2048), (2052, 2048)])])
def test_cut(n, want):
    assert list(pk.cut(n, 2048)) == want
