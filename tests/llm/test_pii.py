import hashlib
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pactlake.llm import pii
from tests.conftest import SF

#: The contract's patterns as they stand.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain(text):
    found = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            ok = kind == "email"
            ok |= kind == "ip" and all(int(p) <= 255 for p in m.group().split("."))
            ok |= kind == "card" and 14 <= len(digits) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0
            ok |= kind == "phone" and 10 <= len(digits) <= 15
            found += [(kind, *m.span())] * ok
    return sorted(found, key=lambda s: (s[1], list(PATTERNS).index(s[0])))


@settings(deadline=None, max_examples=400)
@given(st.text(alphabet="aB@.0129%+-_ ()é\n", max_size=60) | st.lists(st.sampled_from(["a@b.c", "1.2.3.4", "4111 1111 1111 1111", "+1 (415) 555-2671", "@", ".", "_d", " ", "300.1.1.1", "é", "-"]), max_size=12).map("".join))
def test_patterns_equal_the_contract(text):
    assert pii.base_spans(text) == plain(text)


def test_query_equals_brute_force_and_keeps_base_spans(spark):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r.doc_id: r for r in pii.op2_pii(spark, SF).collect()}
    assert set(got) == set(docs)
    for i, text in docs.items():
        base = plain(text)
        said = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert got[i].base_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert [got[i][f"n_{k}"] for k in pii.KINDS] == [sum(s[0] == k for s in base) for k in pii.KINDS]
        assert set(filter(None, said.split(","))) <= set(got[i].spans.split(","))


def trained(spark):
    rows = []
    for i in range(150):
        rows.append((i, f"call me at +1 (415) 555-{2000 + i} today, order {i} of 7 items, version {i}.2 and lot {i * 7}"))
        rows.append((1000 + i, f"mail ann{i}@mail.example.com from 10.0.{i}.7 or 4111 1111 1111 1111 and page {i}"))
        rows.append((2000 + i, f"first +44 20 7946 {1000 + i}9 and then again 7946 {1000 + i}9, room {i}"))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return docs, pii.learned(docs)


def test_field_makes_labels_agree_across_a_document(spark):
    docs, field = trained(spark)
    text = "Reach us: +1 (415) 555-2671. Page 12 of 30. The number 415-555-2671 is open at night; version 4.0 of 2024."
    alone = "Page 12 of 30. The number is open at night; version 4.0 of 2024."
    base = [pii.base_spans(t) for t in (text, alone)]
    t = pii.tokens_of([text, alone], base)
    p = field.beliefs(t)
    again = next(i for i, s in enumerate(t.span) if text[slice(*s)] == "415-555-2671" and t.doc[i] == 0)
    unlinked = pii.tokens_of(["The number 415-555-2671 is open at night"], [[]])
    assert p[again, 4] > field.beliefs(unlinked)[0, 4]  # evidence reaches it over the skip link
    added = pii.added_spans(t, field, 2)
    assert added[1] == [] and all(text[a:b] == "415-555-2671" for _, a, b in added[0])


def test_message_passing_is_exact_on_trees(spark):
    import itertools

    import numpy as np

    rng = np.random.default_rng(0)
    k = 5
    field = pii.Field(rng.normal(size=(pii.FEATURES, k)), rng.normal(size=k), rng.normal(size=(k, k)), np.eye(k))
    t = pii.Tokens([0] * 4, [(i, i + 1) for i in range(4)], [[i, 7 * i] for i in range(4)], [0, 0, 2, 0], [(0, 1), (1, 2)], [(1, 3)])
    local = field.own[np.array(t.features)].sum(axis=1) + field.bias
    p = np.zeros((4, k))
    for ys in itertools.product(range(k), repeat=4):
        if ys[2] != 2:
            continue
        w = np.exp(sum(local[i, y] for i, y in enumerate(ys) if i != 2) + sum(field.chain[ys[a], ys[b]] for a, b in t.chain) + sum(field.skip[ys[a], ys[b]] for a, b in t.skip))
        for i, y in enumerate(ys):
            p[i, y] += w
    assert np.allclose(field.beliefs(t), p / p.sum(axis=1, keepdims=True), atol=1e-3)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (2, ""), (None, "a@b.cd"), (3, "9" * 200_000), (4, "a" * 200_000 + "@"), (5, "é🙂 a@b.cd 1.2.3.4"), (6, "1 " * 50_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS spans")
    docs, field = trained(spark)
    got = pii.digests(pii.find(df, field)).collect()
    assert len(got) == len(rows) and [r.spans for r in got if r.doc_id == 5] == ["email:3:9,ip:10:17"]
    assert pii.find(df.where("doc_id = 5"), field, redact=True).first().redacted == "é🙂 [EMAIL] [IP]"
    assert pii.find(df.limit(0), field).count() == 0
    nothing = pii.learned(spark.createDataFrame([(1, "no such thing")], "doc_id long, text string"))
    assert [r.spans for r in pii.digests(pii.find(df, nothing)).where("doc_id = 5").collect()] == ["email:3:9,ip:10:17"]


@pytest.mark.parametrize("text", ["9" * 300_000, "1." * 150_000, "a." * 150_000 + "@", "@" * 300_000, "+1" * 150_000, "1-" * 150_000])
def test_scans_are_linear(text):
    import time

    begun = time.process_time()
    pii.base_spans(text)
    assert time.process_time() - begun < 5


def test_evidence_reaches_all_repeats(spark):
    """A number given once with its prefix, then fifty times without; and numbers written with blanks."""
    field = trained(spark)[1]
    text = "Reach us: +1 (415) 555-2671. " + "Then the number 415-555-2671 is open at night. " * 50
    t = pii.tokens_of([text], [pii.base_spans(text)])
    p = field.beliefs(t)
    again = [i for i, s in enumerate(t.span) if text[slice(*s)] == "415-555-2671"]
    assert len(again) == 50 and p[again, 4].min() >= pii.SURE
    assert np.ptp(p[again[1:-1], 4]) < 1e-3  # as near to the evidence, wherever they stand
    text = "Reach us: +1 415 555 2671. Room 12 415 555 2671 again"
    t = pii.tokens_of([text], [pii.base_spans(text)])
    linked = {i for pair in t.skip for i in pair}
    said = [text[slice(*t.span[i])] for i in sorted(linked)]
    assert said == ["415", "555", "2671", "415", "555", "2671"]
    assert {t.label[i] for i in sorted(linked)[:3]} == {4}


def test_added_spans_that_overlap_are_dropped_in_linear_time():
    import random
    import time

    random.seed(3)
    spans = lambda n, far: sorted((("ip", a, a + random.randint(1, 30)) for a in (random.randrange(far) for _ in range(n))), key=lambda s: s[1])
    for n in (0, 1, 5, 40):
        base, added = spans(n, 400), spans(40, 400)
        assert pii.not_in(added, base) == [s for s in added if not any(a < s[2] and s[1] < b for _, a, b in base)]
    began = time.time()
    pii.not_in(spans(200_000, 10**8), spans(200_000, 10**8))
    assert time.time() - began < 5


def test_long_documents_count_in_the_fit(spark, monkeypatch):
    """A document with more tokens than a sample takes of one gives a run of them, with its links."""
    text = "call +1 415 555 26 71 or 4155552671 and 4155552671 again; " * 3
    t = pii.tokens_of([text], [pii.base_spans(text)])
    run = pii.run_of(t, 2, 4)
    assert len(run.doc) == len(run.features) == len(run.label) == 4 and run.span == t.span[2:6]
    assert {(a + 2, b + 2) for a, b in run.skip} == {(a, b) for a, b in t.skip if 2 <= a < 6 and 2 <= b < 6}
    monkeypatch.setattr(pii, "LONGEST", 3)
    field = pii.learned(spark.createDataFrame([(1, text)], "doc_id long, text string"))
    assert abs(field.own).sum() > 0


def test_tokens_are_found_in_linear_time():
    """Texts without blanks, with a digit or an @ here and there, and a million letters with one digit."""
    import time

    for text in ("a" * 1_000_000 + "1", "1" + "a" * 1_000_000, "字" * 500_000 + "7" + "字" * 500_000, "a1" * 200_000, "a@" * 200_000):
        began = time.process_time()
        t = pii.tokens_of([text], [pii.base_spans(text)])
        assert t.span == [(0, len(text))] and time.process_time() - began < 2


@settings(deadline=None, max_examples=300)
@given(st.text(alphabet="a1@.-,() \n\x85　=é", max_size=40))
def test_tokens_are_the_runs_with_a_digit_or_an_at(text):
    runs = [m for m in re.finditer(r"[^\s,;:!?\"'()\[\]{}<>|=]+", text) if re.search("[0-9@]", m.group())]
    assert list(pii._words(text)) == [(m.start(), m.group()) for m in runs]


def test_long_numbers_in_blocks_are_linked():
    """A card in four blocks, and one of nineteen digits by single digits, are linked to the same digits in one token."""
    text = "paid with 4111111111111111 today. Later 4111 1111 1111 1111 again"
    t = pii.tokens_of([text], [pii.base_spans(text)])
    assert {text[slice(*t.span[i])] for pair in t.skip for i in pair} >= {"4111111111111111", "4111", "1111"}
    long = "1234567890123456789"
    t = pii.tokens_of([f"{long} and {' '.join(long)} end"], [[]])
    assert {i for pair in t.skip for i in pair} == set(range(20))


def test_field_does_not_depend_on_files(spark, monkeypatch):
    """Also where the sample's tokens overflow: documents are taken by hash, not by place."""
    rows = [(i, f"call +1 (415) 555-{2000 + i} or lot {i * 7} or 10.0.{i}.7 and 555-{2000 + i}") for i in range(120)]
    monkeypatch.setattr(pii, "SAMPLE_TOKENS", 200)
    one = pii.learned(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1))
    many = pii.learned(spark.createDataFrame(rows[::-1], "doc_id long, text string").repartition(7))
    assert abs(one.own).sum() > 0 and np.array_equal(one.own, many.own) and np.array_equal(one.skip, many.skip)


def test_messages_that_do_not_settle_add_nothing(monkeypatch):
    """Two labels that repel each other around an odd ring: with few rounds the document is named and has the patterns' spans only."""
    k = 5
    field = pii.Field(np.zeros((pii.FEATURES, k)), np.array([0, 9.0, 9, 0, 0]), np.zeros((k, k)), -8.0 * np.eye(k))
    ring = pii.Tokens([0] * 3, [(i, i + 1) for i in range(3)], [[0]] * 3, [0] * 3, [], [(0, 1), (1, 2), (2, 0)])
    monkeypatch.setattr(pii, "ROUNDS", 1)
    monkeypatch.setattr(pii, "HALVINGS", 0)
    monkeypatch.setattr(pii, "SURE", 0.0)
    assert pii.added_spans(ring, field, 1) == [[]] and ring.unsettled == [0]
