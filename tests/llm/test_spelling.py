import itertools
import re
import zlib
from collections import Counter, defaultdict

import pytest

from pactlake.llm import spelling
from tests.conftest import SF


def words_of(rows):
    """The contract's words and their counts, run by run."""
    found = Counter()
    for i, text in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            found[run] += len(run) >= 5
    return {w: n for w, n in found.items() if n >= 3}


def near_of(words):
    """Near words by what they give when a code point is deleted or masked: a plain way that shares nothing with bands."""
    by = defaultdict(set)
    for w in words:
        for i in range(len(w)):
            by[w[:i] + "\0" + w[i + 1 :]].add(w)  # one replaced
            by[w[:i] + w[i + 1 :]].add((w, "cut"))
    near = defaultdict(set)
    for key, found in by.items():
        for a, b in itertools.permutations([x for x in found if isinstance(x, str)], 2):
            near[a].add(b)
        if key in words:
            for x in found:
                if isinstance(x, tuple):
                    near[x[0]].add(key)
                    near[key].add(x[0])
    return near


def expected(rows):
    words = words_of(rows)
    near = near_of(words)
    out = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        out[w] = best if best is not None and words[best] >= 2 * n else None
    result = {}
    for w, n in words.items():
        root = w
        while out[root]:
            root = out[root]
        result[w] = (n, len(near[w]), out[w], words[out[w]] if out[w] else None, root)
    return result


def got(df):
    assert dict(df.dtypes) == {"word": "string", "n": "bigint", "n_near": "bigint", "form": "string", "form_n": "bigint", "root": "string"}
    rows = df.collect()
    found = {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in rows}
    assert len(found) == len(rows)
    return found


def test_query_equals_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = expected(docs)
    assert len(want) > 1000 and any(v[2] for v in want.values())
    assert got(spelling.op11_spelling(spark, SF)) == want


@pytest.mark.parametrize("most", [0, 3, 10**6])
def test_pairs_however_buckets_are_dealt(spark, most):
    import random

    random.seed(5)
    base = ["".join(random.choices("abeéß", k=random.randint(1, 9))) for _ in range(400)]
    words = {w: i for i, w in enumerate({*base, *(w[:i] + c + w[i + 1 :] for w in base[:60] for i in range(len(w)) for c in "ax")})}
    df = spark.createDataFrame([(w, n) for w, n in words.items()], "word string, n long")
    pairs = [(r.a, r.b) for r in spelling.near_pairs(df, most).collect()]
    near = near_of(words)
    want = {frozenset((a, b)) for a, found in near.items() for b in found}
    assert {frozenset(p) for p in pairs} == want and len(pairs) == len(want)


def test_forms_lead_to_roots_and_ties_to_the_smallest(spark):
    counts = {"wordz": 64, "wordy": 31, "words": 31, "wordsa": 15, "wordsab": 3, "other": 40, "othex": 40, "othez": 3}
    text = " ".join(" ".join([w] * n) for w, n in counts.items())
    i = next(i for i in range(10**6) if all(zlib.crc32(f"{i}:{w}".encode()) % 97 for w in counts))
    found = got(spelling.variants(spark.createDataFrame([(i, text)], "doc_id long, text string")))
    assert found == expected([(i, text)])
    assert found["wordsab"][2:] == ("wordsa", 15, "wordz") and found["wordsa"][2] == "words" and found["words"][2] == "wordz"
    assert found["othez"][2:] == ("other", 40, "other") and found["other"][2] is None and found["other"][4] == "other"


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "Éclair éclair ÉCLAIR Éclair"), (3, "Éclair éclair ÉCLAIR Éclair"), (None, "thing " * 4), (4, "x" * 300_000), (5, "thing thinG 日本語thing theİng " * 3), (6, "a b c")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS word", "1 AS n")
    want = expected(rows)
    assert got(spelling.variants(df)) == want and "thing" in want
    assert spelling.variants(df.limit(0)).count() == 0
    assert spelling.variants(df.where("doc_id IN (1, 2, 6)")).count() == 0


def test_hot_word_and_long_words(spark):
    """One word with very many near words, and words of a thousand letters."""
    import string

    hub = "a" * 12
    near = {hub[:i] + c + hub[i:] for i in range(13) for c in string.ascii_lowercase} | {hub[:i] + c + hub[i + 1 :] for i in range(12) for c in string.ascii_lowercase}
    long = "b" * 500 + "c" * 500
    words = {hub: 10**6, long: 9, long + "d": 3, long[1:]: 4} | {w: 5 for w in near - {hub}}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    found = {r.word: r for r in spelling.with_roots(spelling.settle(spelling.with_forms(df, spelling.near_pairs(df)))).collect()}
    assert found[hub].n_near == len(near - {hub}) and all(found[w].form == hub for w in near - {hub})
    assert found[long + "d"].root == long and found[long].n_near == 2
