import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from pactlake.llm import near_dup as nd
from tests.conftest import SF


def plain_simhash(text, width=3):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0d]+", text)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    """{doc_id: (fingerprint, smallest reachable doc_id)} by comparing all pairs."""
    ids = sorted(prints)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, i in enumerate(ids):
        for j in ids[:n]:
            if bin(prints[i] ^ prints[j]).count("1") <= 3:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (f"{prints[i]:016x}", find(i)) for i in ids}


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    want = plain_components({r.doc_id: plain_simhash(r.text) for r in docs})
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in nd.op3_simhash(spark, SF).collect()}
    assert got == want


def test_odd_texts(spark):
    rows = [(5, None), (4, ""), (3, " \n\t"), (2, "one"), (1, "ONE"), (7, "Éa bé ç d"), (7, "Éa bé ç d"), (None, "one"), (8, "w " * 200_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit("clash")).withColumn("code", F.lit(1))
    got = {(r.doc_id, r.fingerprint, r.component_id) for r in nd.decisions(df).collect()}
    assert {g for g in got if g[0] in (3, 4, 5)} == {(3, "0" * 16, 3), (4, "0" * 16, 3), (5, "0" * 16, 3)}
    assert {g[2] for g in got if g[0] in (1, 2, None)} == {1}
    assert all(g[1] == f"{plain_simhash(dict(rows)[g[0]]):016x}" for g in got)
    assert nd.decisions(df.limit(0)).count() == 0


def near_codes(seed=1, bases=200):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 2**63, bases, dtype=np.uint64)
    flips = [np.uint64(sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 7), replace=False))) for _ in range(6)]
    codes = np.unique(np.concatenate([base, *(base ^ f for f in flips)]))
    rank = codes.copy()
    for s in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(s)
    return codes[np.argsort(rank)]


@pytest.mark.parametrize("distance", [0, 3, 11])
def test_tree_finds_all_pairs(distance):
    codes = near_codes()
    n = len(codes)
    got = {p for q, at in nd.GrayTree(codes).search(codes, np.arange(n) + 1, np.full(n, n), distance) for p in zip(q.tolist(), at.tolist())}
    far = np.bitwise_count(codes[:, None] ^ codes[None, :])
    assert got == {(i, j) for i, j in zip(*np.nonzero(far <= distance)) if i < j}


@pytest.mark.parametrize("distance,most", [(3, nd.SEGMENT), (3, 2), (11, nd.SEGMENT)])
def test_links_connect_what_is_near(spark, distance, most):
    """Also with segments that are too large for one task, and with segments asked by others."""
    codes = near_codes(2, 60)
    codes = np.unique(np.concatenate([codes, (codes & np.uint64(2**48 - 1)) | np.uint64(7 << 48)]))
    df = spark.createDataFrame([(int(c),) for c in codes.view(np.int64)], "code long")
    from pactlake.llm.graph import connected_components

    got = dict(map(tuple, connected_components(nd.fingerprint_links(df, distance, most)).collect()))
    a, b = np.nonzero(np.triu(np.bitwise_count(codes[:, None] ^ codes[None, :]) <= distance, 1))
    node, root = nd.stars(codes[a].view(np.int64), codes[b].view(np.int64))
    want = dict(zip(node.tolist(), root.tolist())) | {r: r for r in root.tolist()}
    assert got == want


def test_similar_documents(spark):
    rng = np.random.default_rng(3)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 6))
    texts = {}
    for g in range(4):
        base = [word() for _ in range(400)]
        for k in range(4):
            edited = list(base)
            for at in rng.choice(400, k, replace=False):
                edited[at] = word()
            texts[g * 10 + k] = " ".join(edited)
    texts |= {100: "", 101: "x y", 102: "x z", 103: texts[0]}
    rows = [(i, t) for i, t in texts.items()] + [(104, None), (0, texts[0])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("th", F.lit("clash"))
    out = nd.survivors(df)
    kept = [r.doc_id for r in out.collect()]
    assert out.columns == df.columns
    assert sorted(k // 10 for k in kept if k < 40) + [k for k in kept if k == 103] in ([0, 1, 2, 3], [1, 2, 3, 103])
    assert {101, 102} <= set(kept) and len({100, 104} & set(kept)) == 1
    assert nd.survivors(df.limit(0)).count() == 0


def crowds(groups, size, words, edits, seed=5):
    """Texts in groups about one base each: edits of runs of words, so that likenesses lie on both sides of 0.8."""
    rng = np.random.default_rng(seed)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 6))
    out = []
    for _ in range(groups):
        base = [word() for _ in range(words)]
        for _ in range(size):
            edited = list(base)
            for at in rng.choice(words, rng.integers(0, edits + 1), replace=False):
                edited[at] = word()
            out.append(" ".join(edited))
    return out


def shingles(text):
    words = text.split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def likeness(a, b):
    return len(a & b) / len(a | b)


def similar_left(kept, distance=nd.SIMILAR_BITS):
    """Pairs of kept texts within the distance whose five-word Jaccard similarity is 0.8 or more, by brute force."""
    codes = np.array([nd.simhash(t, nd.SIMILAR_WIDTH) for t in kept]).view(np.uint64)
    sets = list(map(shingles, kept))
    near = np.triu(np.bitwise_count(codes[:, None] ^ codes[None, :]) <= distance, 1)
    return [(i, j) for i, j in zip(*np.nonzero(near)) if likeness(sets[i], sets[j]) >= 0.8]


def test_each_link_is_settled(spark, monkeypatch):
    """No similar texts stay within the distance, in crowded groups with chains, in one round or in many with one partner each."""
    texts = crowds(120, 12, 120, 4)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert similar_left([r.text for r in nd.survivors(df).collect()]) == []
    monkeypatch.setattr(nd, "PARTNERS", 1)
    monkeypatch.setattr(nd, "MOST_PARTNERS", 1)
    texts = crowds(12, 8, 120, 5, seed=6)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert similar_left([r.text for r in nd.survivors(df).collect()]) == []


def test_texts_with_one_hash_are_told_apart(spark):
    """With hashes of 16 bits many texts clash; what stays is then decided on bytes as before."""
    texts = crowds(100, 8, 120, 4, seed=8)
    df = spark.createDataFrame(list(enumerate(texts)) + [(-1, texts[0])], "doc_id long, text string")
    found, clashes = nd.distinct_texts(df.select("text"), 16)
    assert clashes and clashes[0] and found.count() == len(set(texts))
    kept = [r.text for r in nd.survivors(df, bits=16).collect()]
    assert similar_left(kept) == [] and len(kept) == len(set(kept))


def shingle_sets(texts):
    """Five-word shingles of ASCII-lower-cased texts as sets of hashes."""
    out = []
    for t in texts:
        words = t.encode("utf-8", "replace").lower().split()
        out.append({xxhash.xxh64_intdigest(b" ".join(words[i : i + 5])) for i in range(max(1, len(words) - 4))} if words else set())
    return out


def similar_pairs(texts, least=0.8):
    """All pairs of different texts at `least` or more, exactly: such a pair shares one of either text's rarest shingles."""
    sets = shingle_sets(texts)
    often = {}
    for s in sets:
        for h in s:
            often[h] = often.get(h, 0) + 1
    index, found = {}, []
    for i in sorted(range(len(sets)), key=lambda i: len(sets[i])):
        n = len(sets[i])
        near = set()
        for h in sorted(sets[i], key=lambda h: (often[h], h))[: n - int(np.ceil(least * n - 1e-9)) + 1]:
            if often[h] > 1:
                near.update(index.get(h, ()))
                index.setdefault(h, []).append(i)
        found += [(i, j) for j in near if likeness(sets[i], sets[j]) >= least - 1e-9]
    return found


def test_recall_of_similar_pairs(spark):
    """Of all pairs of different documents at 0.8 or more, at least 0.9 no longer stand side by side; all that went had such a pair."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    texts = sorted({r.text or "" for r in docs.select("text").collect()})
    pairs = similar_pairs(texts)
    assert len(pairs) > 20
    kept = [r.text or "" for r in nd.survivors(docs).collect()]
    stay = set(kept)
    left = [p for p in pairs if texts[p[0]] in stay and texts[p[1]] in stay]
    assert len(kept) == len(stay) and 1 - len(left) / len(pairs) >= 0.9
    assert set(texts) - stay <= {texts[i] for p in pairs for i in p}


def test_minhashes_refuse_only_what_is_clearly_less():
    """Bits differ as the estimate says: never beyond FAR at 0.8 and more, mostly beyond it at 0.5 and less."""
    rng = np.random.default_rng(10)
    far = {0.8: [], 0.5: []}
    for n, likes in ((1600, 0.8), (1500, 0.5)):
        shared = round(likes * n)
        for _ in range(300):
            h = rng.integers(0, 2**63, n, dtype=np.uint64)
            half = (n - shared) // 2
            a, b = (np.array(nd.minhashes(x)).view(np.uint64) for x in (h[: shared + half], np.append(h[:shared], h[shared + half :])))
            x = a ^ b
            far[likes].append(int(np.bitwise_count((x | x >> np.uint64(1)) & np.uint64(0x5555555555555555)).sum()))
    assert max(far[0.8]) <= nd.FAR and np.mean(np.array(far[0.5]) > nd.FAR) > 0.95
    assert abs(np.mean(far[0.8]) - 0.75 * 0.2 * nd.MINHASHES) < 1


def test_least_partners():
    rng = np.random.default_rng(7)
    hi, lo = rng.integers(0, 20, 900), rng.integers(0, 200, 900)
    want = {(h, x) for h in set(hi.tolist()) for x in sorted({b for a, b in zip(hi.tolist(), lo.tolist()) if a == h})[:5]}
    assert sorted(zip(*(c.tolist() for c in nd.least_partners(hi, lo, 5)))) == sorted(want)


def test_long_pairs_are_decided_exactly(spark):
    """Pairs of long texts on both sides of 0.8 and exactly at it: 1000 shingles each, of which k are shared."""
    rows, ties, want = [], [], set()
    for g in range(24):
        shared = 8000 // 9 + [-2, -1, 0, 1, 2, 12][g % 6]  # 889 of 1111 is the first at 0.8 or more
        words = [f"g{g}w{i}" for i in range(1004)]
        other = words[: shared + 4] + [f"x{g}w{i}" for i in range(1000 - shared)]
        rows += [(2 * g, " ".join(words)), (2 * g + 1, " ".join(other))]
        ties.append((2 * g, 2 * g + 1))
        if likeness(shingles(rows[-2][1]), shingles(rows[-1][1])) >= 0.8:
            want.add(ties[-1])
    rows += [(100, " ".join(f"e{i}" for i in range(904))), (101, " ".join(f"e{i}" for i in range(1129)))]  # 900 of 1125: 0.8
    ties.append((100, 101))
    want.add((100, 101))
    docs = spark.createDataFrame(rows, "id long, text string").select(F.xxhash64("text").alias("th"), "text", "id")
    name = {r.th: r.id for r in docs.collect()}
    th = {i: t for t, i in name.items()}
    low = nd._bottom(docs.select("th", "text"))
    pairs = spark.createDataFrame([(th[a], th[b]) for a, b in ties], "a long, b long")
    got = {(name[r.a], name[r.b]) for r in nd._verified(pairs, low, docs.select("th", "text")).collect()}
    assert got == want and 0 < len(want) < len(ties)


def test_several_fingerprints_find_what_one_misses(spark):
    """Pairs at 0.8 and more with one run of words replaced, which put one fingerprint's distance about the limit."""
    rng = np.random.default_rng(9)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 6))
    pairs = []
    for _ in range(150):
        base = [word() for _ in range(200)]
        pairs.append((" ".join(base), " ".join(base[:100] + [word() for _ in range(15)] + base[115:])))
    assert all(likeness(shingles(a), shingles(b)) >= 0.8 for a, b in pairs)
    codes = [[np.uint64(c % 2**64) for c in nd.simhashes(t, nd.SIMILAR_WIDTH, nd.PRINTS)] for pair in pairs for t in pair]
    far = np.array([[np.bitwise_count(x ^ y) for x, y in zip(a, b)] for a, b in zip(codes[::2], codes[1::2])])
    df = spark.createDataFrame(list(enumerate(t for pair in pairs for t in pair)), "doc_id long, text string")
    kept = nd.survivors(df).count()
    assert kept == 300 - int((far.min(axis=1) <= nd.SIMILAR_BITS).sum())
    assert (far[:, 0] <= nd.SIMILAR_BITS).sum() < 0.9 * (300 - kept)


def _rows(seg, codes, role, th, more=()):
    import pyarrow as pa

    n = len(codes)
    code = np.asarray(codes, np.int64)
    rank = code.view(np.uint64).copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    order = np.lexsort((rank, seg))
    columns = [np.asarray(seg, np.int64), code, np.asarray(role, np.int32), np.asarray(th, np.int64), *[np.zeros(n, np.int64)] * (nd.PRINTS - 1), *more]
    return pa.RecordBatch.from_arrays([pa.array(c[order]) for c in columns], names=[f"c{i}" for i in range(len(columns))])


@pytest.mark.parametrize("spread", [0, 3, 60])
def test_smallest_partners_of_each_text(monkeypatch, spread):
    """Segments of equal, near and scattered fingerprints, with askers from elsewhere: partners equal brute force, in both directions."""
    rng = np.random.default_rng(spread)
    monkeypatch.setattr(nd, "CROWD", 4)
    n = 300
    codes = np.zeros(n, np.int64)
    for _ in range(spread):
        codes ^= np.int64(1) << rng.integers(0, 30, n)
    seg, th = np.zeros(n, np.int64), rng.permutation(n)
    role = np.where(rng.random(n) < 0.7, nd.OWN | nd.ASKS | nd.FOUND, nd.ASKS | nd.FOUND)
    got = {(a, b) for out in nd.segment_partners(iter([_rows(seg, codes, role, th)]), 7, 5) for a, b in zip(*(c.to_pylist() for c in out.columns))}
    near = np.bitwise_count(codes[:, None].view(np.uint64) ^ codes[None, :].view(np.uint64)) <= 7
    own = role & nd.OWN > 0
    want = set()
    for b in range(n):
        found = sorted(th[a] for a in range(n) if th[a] < th[b] and near[a, b] and (own[a] or own[b]))
        want |= {(int(a), int(th[b])) for a in found[:5]}
    # All pairs are equal in their first block and met by the first fingerprint, so all are reported here.
    assert want == got


def test_dense_segments_take_time_in_proportion():
    """One segment of equal fingerprints: four times the texts, about four times the time."""
    import time

    took = []
    for n in (8_000, 32_000, 128_000):
        rng = np.random.default_rng(1)
        batch = _rows(np.zeros(n, np.int64), np.full(n, 5), np.full(n, 7), rng.integers(-(2**62), 2**62, n))
        began = time.process_time()
        rows = sum(out.num_rows for out in nd.segment_partners(iter([batch]), 7, 4))
        took.append(time.process_time() - began)
        assert rows == 4 * n - 10
    assert took[1] < 10 * max(took[0], 0.2) and took[2] < 10 * max(took[1], 0.2)


def test_large_segments_are_dealt_to_a_grid(spark):
    """Partners are the same whether a segment is one task's or a grid's, in the first round and in later ones."""
    texts = crowds(6, 60, 60, 6, seed=12)
    marked = nd.settle(nd.distinct_texts(spark.createDataFrame([(t,) for t in texts], "text string"))[0].withColumn("after", F.lit(nd.START)))
    for first in (True, False):
        get = lambda most: {(r.a, r.b, r.n) for r in nd.partners(marked, nd.SIMILAR_BITS, 3, first, most).collect()}  # noqa: E731, B023
        assert get(10**6) == get(40) and get(40)


def test_many_texts_of_one_crowd(spark):
    """Near copies of one text by the thousand leave one, in a few rounds."""
    rng = np.random.default_rng(4)
    base = ["".join(rng.choice(list("abcdefghij"), 6)) for _ in range(150)]
    texts = {" ".join([*base[:i], f"x{k}", *base[i + 1 :]]) for k, i in enumerate(rng.integers(0, 150, 2500))}
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert similar_left([r.text for r in nd.survivors(df).collect()]) == []
