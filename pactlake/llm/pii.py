"""Personal data by patterns and a skip-chain conditional random field.

Patterns find e-mail addresses, IP addresses, card and phone numbers in whole texts. The field then labels every token that
holds a digit or an @ sign: its own shape and words around it, its neighbours (chain), and distant tokens that repeat it or
resemble it (skip links) share potentials. Loopy message passing over a document's links makes labels agree, with the
pattern's finds as evidence, so that a number which is a phone number in one place is one in another place where no pattern fits.
Repeats are linked to the first of them, so links grow with the tokens, not with their square, and evidence is two hops away
however many repeats there are; messages run until they settle. Runs of neighbouring short numbers, as in numbers written with
blanks, are linked by their joined digits. The field is fitted by pseudo-likelihood on a bounded sample of documents, labelled
by the patterns, and by agreement with what the patterns found.

Defined cases: null text counts as empty and has no spans; offsets are code points; texts of any length are scanned whole, in
linear time (only a fit takes a run of LONGEST tokens from a document that has more, at a place by its hash); messages are damped the
more the longer they take, and a document whose messages don't settle even so has the patterns' spans only; equal texts and repeated rows have equal spans; without documents to fit on the field adds nothing; no rows give
no rows; further columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pactlake.llm.common import bounded_batches, text_of

KINDS = ("email", "ip", "card", "phone")
#: The fit: documents sampled at most (by hash of the id), tokens of a document and in all, hashed features, passes, rate, penalty.
SAMPLE_DOCS, LONGEST, SAMPLE_TOKENS, FEATURES, PASSES, RATE, PENALTY = 4_000, 2_000, 200_000, 1 << 13, 150, 0.5, 1e-4
#: Message passing: rounds after which half as much of new messages is taken, and how often that is done; change below which a document
#: has settled, share of an old message that is kept at first, belief from which a token becomes a span.
ROUNDS, HALVINGS, SETTLED, DAMPING, SURE = 200, 5, 1e-4, 0.3, 0.9
#: Numbers in several tokens: digits at least, and at most, those of the longest card number (so tokens at most, too).
LEAST_DIGITS, MOST_DIGITS = 7, 19

# Each is leftmost, with possessive runs and a look-behind that only skip places where no match can start.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: What tokens are parted by, besides white space.
_PARTING = frozenset(",;:!?\"'()[]{}<>|=")
_REST = re.compile(r"[^\s,;:!?\"'()\[\]{}<>|=]*")
_ANY = re.compile("[0-9@]")


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost addresses, from @ sign to @ sign: the local part is the run before it, bounded by the last match."""
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            last = m.end()
        else:
            last = max(last, at + 1)  # no match can hold this @ in its local part
        at = text.find("@", max(last, at + 1))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the patterns, by start, then kind as listed."""
    if not _ANY.search(text):
        return []
    found = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            found.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(d := _digits(m.group())) <= 19 and luhn(d):
            found.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_digits(m.group())) <= 15:
                found.append(("phone", *m.span()))
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


@dataclass
class Tokens:
    """The labelled tokens of some documents as one graph."""

    doc: list[int]
    span: list[tuple[int, int]]
    features: list[list[int]]
    label: list[int]  # 0 for none, else 1 + the kind, as the patterns have it
    chain: list[tuple[int, int]]
    skip: list[tuple[int, int]]
    #: Documents whose messages have not settled.
    unsettled: list[int] = field(default_factory=list)


def _slot(feature: str) -> int:
    return zlib.crc32(feature.encode()) % FEATURES


def _shape(token: str) -> str:
    out = re.sub("[0-9]+", "9", re.sub("[a-z]+", "a", re.sub("[A-Z]+", "A", token)))
    return out[:24]


def _keys(token: str) -> list[str]:
    """What makes tokens similar: their last seven digits, their letters and digits, or their address's domain-free part."""
    digits, plain = _digits(token), "".join(c for c in token.lower() if c.isalnum())
    keys = ["d" + digits[-7:]] if len(digits) >= 7 else []
    keys += ["p" + plain] if len(plain) >= 5 else []
    return keys + (["l" + token.lower().partition("@")[0]] if "@" in token else [])


def _numbers(run: list[tuple[int, str]], node: int, digits: str) -> Iterator[tuple[str, list[int]]]:
    """(digits, its tokens) of the numbers that end at a token: a long one by itself, or runs of short ones."""
    if len(digits) >= LEAST_DIGITS:
        yield from ((d, [node]) for d in {digits, digits[-10:]})
    joined = ""
    for i in range(len(run) - 1, -1, -1):
        joined = run[i][1] + joined
        if len(joined) > MOST_DIGITS:
            return
        if len(joined) >= LEAST_DIGITS:
            yield joined, [n for n, _ in run[i:]]


def _words(text: str) -> Iterator[tuple[int, str]]:
    """(start, token) of the runs between parting signs that hold a digit or an @, found by these: a run is passed over once."""
    last = 0
    while m := _ANY.search(text, last):
        start = m.start()
        while start > last and not ((c := text[start - 1]) in _PARTING or c.isspace()):
            start -= 1
        last = _REST.match(text, m.start()).end()
        yield start, text[start:last]


def tokens_of(texts: list[str], spans: list[list[tuple[str, int, int]]]) -> Tokens:
    out = Tokens([], [], [], [], [], [])
    for d, (text, own) in enumerate(zip(texts, spans)):
        last_end, last, seen, at = -9, -1, {}, 0
        run: list[tuple[int, str]] = []
        numbers: dict[str, list[int]] = {}
        pairs: set[tuple[int, int]] = set()
        for start, token in _words(text):
            token = token.rstrip(".-")
            end, node = start + len(token), len(out.doc)
            while at < len(own) and own[at][2] <= start:
                at += 1
            label = next((1 + KINDS.index(k) for k, a, b in own[at : at + len(KINDS)] if a < end and start < b), 0)
            before, after = text[max(0, start - 24) : start].split(), text[end : end + 24].split()
            digits = _digits(token)
            names = [f"s{_shape(token)}", f"n{min(len(digits), 20)}", f"l{min(len(token), 30)}", f"@{token.count('@')}", f".{min(token.count('.'), 4)}", f"-{min(token.count('-'), 4)}", f"a{any(c.isalpha() for c in token)}", f"c{text[start - 1 : start]}", f"C{text[end : end + 1]}", f"b{before[-1].lower() if before else ''}", f"f{after[0].lower() if after else ''}", f"g{'-'.join(str(len(g)) for g in re.findall('[0-9]+', token)[:5])}"]
            out.doc.append(d)
            out.span.append((start, end))
            out.features.append([_slot(n) for n in names])
            out.label.append(label)
            if last >= 0 and start - last_end <= 3:
                out.chain.append((last, node))
            for key in _keys(token):
                if (hub := seen.setdefault(key, node)) != node:
                    out.skip.append((hub, node))
                    pairs.add((hub, node))
            near = start - last_end <= 3 and not text[last_end:start].strip(" ().-+") if last >= 0 else False
            short = 0 < len(digits) < LEAST_DIGITS and not token.strip("0123456789+.-")
            run = [*(run if near and short else []), (node, digits)][-MOST_DIGITS:] if short else []
            for key, nodes in _numbers(run, node, digits):
                if key not in numbers:
                    numbers[key] = nodes
                    continue
                first = numbers[key]
                for other in [*first[1:], *nodes]:
                    if other != first[0] and (pair := (first[0], other)) not in pairs:
                        out.skip.append(pair)
                        pairs.add(pair)
                numbers[key] = first[:1]
            last_end, last = end, node
    return out


def run_of(t: Tokens, start: int, many: int) -> Tokens:
    """The tokens of one document from start on, many at most, with the links among them."""
    end = min(len(t.doc), start + many)
    inside = lambda links: [(a - start, b - start) for a, b in links if start <= min(a, b) and max(a, b) < end]
    return Tokens(t.doc[start:end], t.span[start:end], t.features[start:end], t.label[start:end], inside(t.chain), inside(t.skip))


def not_in(added: list[tuple[str, int, int]], base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Those of the added spans that overlap none of the base spans, which are in order of their starts."""
    starts, reach = [s[1] for s in base], [0]
    for _, _, end in base:
        reach.append(max(reach[-1], end))
    return [s for s in added if reach[bisect_left(starts, s[2])] <= s[1]]


def agreed(t: Tokens) -> list[int]:
    """Labels to fit on: a token that no pattern labels takes the label of a token that resembles it in the document."""
    label = list(t.label)
    for pairs in (t.skip, t.skip[::-1]):
        for a, b in pairs:
            label[a], label[b] = label[a] or label[b], label[b] or label[a]
    return label


@dataclass
class Field:
    """Weights: features x labels, label x label of chain links (left, right) and of skip links."""

    own: np.ndarray
    bias: np.ndarray
    chain: np.ndarray
    skip: np.ndarray

    def beliefs(self, t: Tokens, clamp: bool = True) -> np.ndarray:
        """Marginals by loopy message passing; with clamp the patterns' finds are evidence."""
        n, k = len(t.doc), len(self.bias)
        local = self.own[np.array(t.features, dtype=np.int64).reshape(n, -1)].sum(axis=1) + self.bias
        if clamp:
            label = np.array(t.label)
            known = np.flatnonzero(label)
            local[known] = -30.0
            local[known, label[known]] = 0.0
        links = np.array(t.chain + t.skip, dtype=np.int64).reshape(-1, 2)
        weights = np.concatenate([np.broadcast_to(self.chain, (len(t.chain), k, k)), np.broadcast_to(self.skip, (len(t.skip), k, k))])
        e = len(links)
        src, dst = np.concatenate([links[:, 0], links[:, 1]]), np.concatenate([links[:, 1], links[:, 0]])
        weights = np.concatenate([weights, weights.transpose(0, 2, 1)])
        back = np.concatenate([np.arange(e, 2 * e), np.arange(e)])
        message = np.zeros((2 * e, k))
        total = local.copy()
        doc = np.array(t.doc, dtype=np.int64)
        live = np.arange(e)
        for turn in range(ROUNDS * (HALVINGS + 1)):
            if not len(live):
                break
            at = np.concatenate([live, live + e])
            sent = (total[src[at]] - message[back[at]])[:, :, None] + weights[at]
            top = sent.max(axis=1, keepdims=True)
            new = np.log(np.exp(sent - top).sum(axis=1)) + top[:, 0]
            new -= new.max(axis=1, keepdims=True)
            off = new - message[at]
            step = (1 - DAMPING) / 2 ** (turn // ROUNDS) * off
            message[at] += step
            np.add.at(total, dst[at], step)
            moving = np.zeros(doc.max() + 1, bool)
            moving[doc[src[at]][np.abs(off).max(axis=1) > SETTLED]] = True
            live = live[moving[doc[links[live, 0]]]]
        t.unsettled = sorted({int(doc[links[i, 0]]) for i in live})
        total -= total.max(axis=1, keepdims=True)
        p = np.exp(total)
        return p / p.sum(axis=1, keepdims=True)


def fit_field(parts: list[Tokens]) -> Field:
    """Pseudo-likelihood: each token's label given its features and its neighbours' labels, by gradient descent."""
    k = 1 + len(KINDS)
    field = Field(np.zeros((FEATURES, k)), np.zeros(k), np.zeros((k, k)), np.zeros((k, k)))
    features = np.array([f for t in parts for f in t.features], dtype=np.int64)
    if not len(features):
        field.bias[0] = 10.0
        return field
    base = np.cumsum([0] + [len(t.doc) for t in parts])
    label = np.array([y for t in parts for y in t.label])
    link = lambda name: np.array([(a + b, c + b) for t, b in zip(parts, base) for a, c in getattr(t, name)], dtype=np.int64).reshape(-1, 2)
    chain, skip = link("chain"), link("skip")
    truth = np.eye(k)[label]
    n = len(label)
    size = 1.0 / features.shape[1]
    flat = features.ravel()
    seen = np.maximum(np.bincount(flat, minlength=FEATURES), 1)[:, None]
    for _ in range(PASSES):
        z = field.own[features].sum(axis=1) + field.bias
        np.add.at(z, chain[:, 1], field.chain[label[chain[:, 0]]])
        np.add.at(z, chain[:, 0], field.chain.T[label[chain[:, 1]]])
        np.add.at(z, skip[:, 1], field.skip[label[skip[:, 0]]])
        np.add.at(z, skip[:, 0], field.skip.T[label[skip[:, 1]]])
        z -= z.max(axis=1, keepdims=True)
        p = np.exp(z)
        p /= p.sum(axis=1, keepdims=True)
        g = truth - p
        own = np.zeros_like(field.own)
        np.add.at(own, flat, np.repeat(g, features.shape[1], axis=0))
        field.own += RATE * (size * own / np.sqrt(seen) - PENALTY * field.own)
        field.bias += RATE * g.mean(axis=0)
        for w, links in ((field.chain, chain), (field.skip, skip)):
            step = np.zeros((k, k))
            np.add.at(step, label[links[:, 0]], g[links[:, 1]])
            np.add.at(step.T, label[links[:, 1]], g[links[:, 0]])
            w += RATE * (step / max(1, len(links)) - PENALTY * w)
    field.skip = (field.skip + field.skip.T) / 2
    return field


def added_spans(t: Tokens, field: Field, docs: int) -> list[list[tuple[str, int, int]]]:
    """Per document, runs of neighbouring tokens that the field is sure of and no pattern found."""
    out: list[list[tuple[str, int, int]]] = [[] for _ in range(docs)]
    if not t.doc:
        return out
    p = field.beliefs(t)
    linked = {x for pair in t.skip for x in pair}
    follows = dict(t.chain)
    best = p.argmax(axis=1)
    open_docs = set(t.unsettled)
    taken = [i for i in range(len(t.doc)) if t.doc[i] not in open_docs and not t.label[i] and best[i] and p[i, best[i]] >= SURE and i in linked]
    run: list[int] = []
    for i in [*taken, -1]:
        if run and (i < 0 or follows.get(run[-1]) != i or best[i] != best[run[-1]]):
            out[t.doc[run[0]]].append((KINDS[best[run[0]] - 1], t.span[run[0]][0], t.span[run[-1]][1]))
            run = []
        run.append(i)
    return out


def learned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Field:
    """The field fitted on a bounded sample of documents that have a digit or an @ sign: the first by a hash of the row, however the
    table is cut into files."""
    named = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    likely = named.where(F.col("text").rlike("[0-9]") | F.contains("text", F.lit("@"))).select(F.xxhash64("doc_id", "text").alias("h"), "text")
    last = likely.select("h").orderBy("h").limit(SAMPLE_DOCS).agg(F.max("h")).first()[0]
    if last is None:
        return fit_field([])

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for h, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                t = tokens_of([text], [base_spans(text)])
                label = agreed(t)
                if len(t.doc) > LONGEST:
                    start = zlib.crc32(text.encode("utf-8", "replace")) % (len(t.doc) - LONGEST + 1)
                    t, label = run_of(t, start, LONGEST), label[start : start + LONGEST]
                links = lambda x: [v for pair in x for v in pair]
                rows.append((h, len(t.doc), [f for fs in t.features for f in fs], label, links(t.chain), links(t.skip)))
            kinds = [pa.int64(), pa.int64(), *[pa.list_(pa.int32())] * 4]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 6, kinds)], names=["h", "n", "features", "label", "chain", "skip"])

    schema = "h long, n long, features array<int>, label array<int>, chain array<int>, skip array<int>"
    drawn = likely.where(F.col("h") <= last).mapInArrow(extract, schema).where("n > 0")
    # Whole documents in order of the hash, as long as they fit together.
    sizes = sorted(map(tuple, drawn.select("h", "n").orderBy("h").limit(SAMPLE_DOCS).collect()))
    total, end = 0, None
    for h, n in sizes:
        if (total := total + n) > SAMPLE_TOKENS:
            break
        end = h
    parts, total = [], 0
    for r in sorted(drawn.where(F.col("h") <= end).orderBy("h").limit(SAMPLE_DOCS).collect(), key=lambda r: r.h) if end is not None else ():
        if (total := total + r.n) > SAMPLE_TOKENS:
            break
        each = len(r.features) // r.n
        pairs = lambda x: list(zip(x[::2], x[1::2]))
        parts.append(Tokens([0] * r.n, [(0, 0)] * r.n, [r.features[i * each : (i + 1) * each] for i in range(r.n)], r.label, pairs(r.chain), pairs(r.skip)))
    return fit_field(parts)


def find(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text", redact: bool = False) -> DataFrame:
    """One row per document: doc_id, spans (kind, start, end, base), and the redacted text if asked."""
    schema = "doc_id long, spans array<struct<kind: string, start: int, end: int, base: boolean>>" + ", redacted string" * redact
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            base = [base_spans(t) for t in texts]
            added = added_spans(tokens_of(texts, base), field, len(texts))
            rows = []
            for own, more in zip(base, added):
                every = [(s, True) for s in own] + [(s, False) for s in not_in(more, own)]
                every.sort(key=lambda x: (x[0][1], KINDS.index(x[0][0])))
                rows.append([{"kind": k, "start": a, "end": b, "base": is_base} for (k, a, b), is_base in every])
            columns = [batch.column(0), pa.array(rows, kind)]
            if redact:
                columns.append(pa.array([redacted(t, r) for t, r in zip(texts, rows)], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "spans", "redacted"][: len(columns)])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text")).mapInArrow(scan, schema)


def redacted(text: str, spans: list[dict]) -> str:
    """The text with each span, or run of overlapping spans, replaced by its first kind in brackets."""
    out, at = [], 0
    for s in spans:
        if s["start"] >= at:
            out += [text[at : s["start"]], f"[{s['kind'].upper()}]"]
        at = max(at, s["end"])
    return "".join([*out, text[at:]])


def digests(found: DataFrame) -> DataFrame:
    """The query's columns of found spans."""
    is_base = F.filter("spans", lambda s: s.base)
    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter(is_base, lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, KINDS), F.sha2(said(is_base), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return digests(find(docs, learned(docs)))


QUERIES = {"op2_pii": op2_pii}
SQL: dict[str, str] = {}
