"""SimHash near-deduplication over a Gray-order hierarchical index.

Fingerprints within `distance` bits differ in at most distance // 4 bits of one of their four 16-bit blocks, so each
distinct fingerprint is dealt to four segments (block, value), and for larger distances asks the segments whose value is
that near. In a segment the fingerprints stand in Gray order, where neighbours share long bit patterns. Runs of eight form
the nodes of a tree; a node keeps the mask and value of the bits that all below it share, less what its parent already
keeps. A search adds up differences from the root down and drops a whole group once the sum exceeds the distance. A task
returns the links it finds as stars (node, smallest linked node), never all pairs of a group. Segments that hold too many
fingerprints for one task are dealt again by four 12-bit blocks of the other 48 bits.

Defined cases: null text counts as empty; texts without words have fingerprint zero and link like any other; equal
texts and repeated rows share a fingerprint and so a component; null ids are never a component_id unless no member has an
id; no rows give no rows; further columns are ignored (decisions) or carried along (survivors).
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pactlake.llm import exact_dedup
from pactlake.llm.common import bounded_batches, join_small, settle, text_of, unused
from pactlake.llm.graph import connected_components
from pactlake.llm.sketch import with_sketch

#: Children of a node; (query, node) pairs that a task holds at once; fingerprints of a segment that one task searches.
FANOUT, FRONT, SEGMENT = 8, 500_000, 2_000_000
#: Rows that a task reads at once about; rows of a segment by rising key that a text is compared with first.
CHUNK, CROWD = 1 << 16, 64
#: Similar documents: words of the shingles of their fingerprints, bits between these at most; words of the shingles on which they
#: are verified, similarity from which they are similar, and smallest shingle hashes by which long pairs that are clearly less are
#: refused (estimates below CLEAR, six standard errors away); all others are decided on all their shingles.
SIMILAR_WIDTH, SIMILAR_BITS, SIMILAR_WORDS, SIMILAR, BOTTOM, CLEAR = 2, 7, 5, 0.8, 256, 0.65
#: Independent fingerprints of a text; a pair is linked if any two of one number are within the distance.
PRINTS = 4
#: Min-hashes of a text's five-word shingles, of each of which two bits are kept; a pair at SIMILAR differs in 38 of them on average,
#: with a standard error of 5.7, so one that differs in more than FAR (four errors away) is refused without a test.
MINHASHES, FAR = 256, 62
_ODD = np.random.default_rng(11).integers(0, 2**63, (2, MINHASHES), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Untested partners that a text is given in a round: at least, and at most when few texts still ask (as many pairs as in round one).
PARTNERS, MOST_PARTNERS = 4, 4096
#: Cursors of a text that has tested no partner and of one that has tested all.
START, DONE = -(2**63), 2**63 - 1
#: Texts with one 64-bit hash but other bytes that are told apart (some are expected beyond 10^9 texts); more of them are an error.
CLASHES = 1000


def simhash(text: str | None, width: int = 3) -> int:
    """64-bit SimHash, as a signed long, of the ASCII-lower-cased text's word shingles (repeats count)."""
    return simhashes(text, width, 1)[0]


def _hashes(words: list[bytes], width: int) -> np.ndarray:
    """Hashes of the words' shingles; fewer words than a shingle's are one shingle."""
    shingles = map(b" ".join, zip(*(words[i:] for i in range(width)))) if len(words) >= width else iter([b" ".join(words)])
    return np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=42), shingles), np.uint64, max(1, len(words) - width + 1))


def _majorities(hashes: np.ndarray, prints: int) -> list[int]:
    found = []
    for k in range(prints):
        ones = np.zeros(64, np.int64)
        for i in range(0, len(hashes), CHUNK):
            part = remixed(hashes[i : i + CHUNK], k).astype(">u8").view(np.uint8).reshape(-1, 8)
            ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
        found.append(int(np.packbits(2 * ones > len(hashes)).view(">i8")[0]))
    return found


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").lower().split()  # bytes: lower() and split() touch ASCII only


def simhashes(text: str | None, width: int, prints: int) -> list[int]:
    """The SimHash and further ones over remixed hashes of the same shingles."""
    words = _words(text)
    return _majorities(_hashes(words, width), prints) if words else [0] * prints


def minhashes(shingles: np.ndarray) -> list[int]:
    """Two bits each of MINHASHES min-hashes of the shingles' hashes, as longs."""
    shingles = np.unique(shingles)
    least = np.full(MINHASHES, 2**64 - 1, np.uint64)
    for i in range(0, len(shingles), 512):
        least = np.minimum(least, (shingles[i : i + 512, None] * _ODD[0] + _ODD[1]).min(axis=0))
    pairs = (remixed(least, 1) & np.uint64(3)) << np.tile(np.arange(0, 64, 2, dtype=np.uint64), MINHASHES // 32)
    return np.bitwise_or.reduce(pairs.reshape(-1, 32), axis=1).view(np.int64).tolist()


def marks(text: str | None) -> tuple[list[int], list[int]]:
    """The SimHashes by which similar texts are found, and the min-hashes by which pairs that clearly aren't similar are refused."""
    words = _words(text)
    if not words:
        return [0] * PRINTS, [0] * (MINHASHES // 32)
    two = _hashes(words, SIMILAR_WIDTH)
    if len(words) < SIMILAR_WORDS:
        five = _hashes(words, SIMILAR_WORDS)
    else:  # a shingle of five words is one of the first two, the next two and the last two
        n, odd = len(words) - SIMILAR_WORDS + 1, _ODD[0]
        five = remixed(two[:n] * odd[0] + two[2 : 2 + n] * odd[1] + two[3 : 3 + n] * odd[2], 1)
    return _majorities(two, PRINTS), minhashes(five)


def remixed(hashes: np.ndarray, k: int) -> np.ndarray:
    """The k-th of independent hashes made from hashes (SplitMix64); the 0-th are the hashes themselves."""
    if not k:
        return hashes
    z = hashes + np.uint64(k * 0x9E3779B97F4A7C15 % 2**64)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def simhash_column(text: Column, width: int = 3) -> Column:
    @F.pandas_udf("long")
    def fingerprint(texts: pd.Series) -> pd.Series:
        return pd.Series([simhash(t, width) for t in texts], dtype="int64")

    return fingerprint(text)


def marks_column(text: Column) -> Column:
    @F.pandas_udf("fps array<long>, low array<long>")
    def marked(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([marks(t) for t in texts], columns=["fps", "low"])

    return marked(text)


def gray_rank(code: Column) -> Column:
    """Place of a 64-bit code in the reflected Gray sequence, as a long that sorts like the unsigned rank."""
    for shift in (1, 2, 4, 8, 16, 32):
        code = code.bitwiseXOR(F.shiftrightunsigned(code, shift))
    return code.bitwiseXOR(F.lit(-(2**63)))


class GrayTree:
    """Levels of nodes over codes in Gray order: level 0 has the codes, each node above covers FANOUT nodes."""

    def __init__(self, codes: np.ndarray) -> None:
        full = np.uint64(2**64 - 1)
        values, masks = [codes], [np.full(len(codes), full)]
        while len(values[-1]) > 1:
            at = np.arange(0, len(values[-1]), FANOUT)
            low, high = np.bitwise_and.reduceat(values[-1], at), np.bitwise_or.reduceat(values[-1], at)
            shared = np.bitwise_and.reduceat(masks[-1], at) & ~(low ^ high)
            values.append(values[-1][at] & shared)
            masks.append(shared)
        #: What a node keeps beyond its parent.
        self.values = values
        self.own = [m if i + 1 == len(masks) else m & ~np.repeat(masks[i + 1], FANOUT)[: len(m)] for i, m in enumerate(masks)]
        self.masks = masks

    def search(self, queries: np.ndarray, start: np.ndarray, end: np.ndarray, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, place) pairs within the distance, for places from start to end of each query; some at a time."""
        todo = np.flatnonzero(end > start)
        level = np.zeros(len(queries), np.int64)
        span = np.maximum(end - start, 1)
        for k in range(1, len(self.values)):
            level[span > FANOUT**k] = k
        for k in np.unique(level[todo]):
            who = todo[level[todo] == k]
            lo, hi = start[who] // FANOUT**k, (end[who] - 1) // FANOUT**k + 1
            for part in np.array_split(np.arange(len(who)), max(1, int((hi - lo).sum()) // (FRONT // FANOUT))):
                n = (hi - lo)[part]
                q = np.repeat(who[part], n)
                node = np.repeat(lo[part], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                seen = np.bitwise_count((queries[q] ^ self.values[k][node]) & self.masks[k][node]).astype(np.int64)
                yield from self._below(queries, start, end, distance, int(k), q, node, seen)

    def _below(self, queries, start, end, distance, k, q, node, seen):
        keep = seen <= distance
        q, node, seen = q[keep], node[keep], seen[keep]
        if k == 0:
            inside = (node >= start[q]) & (node < end[q])
            yield q[inside], node[inside]
            return
        for part in np.array_split(np.arange(len(q)), max(1, len(q) * FANOUT // FRONT)):
            child = (node[part, None] * FANOUT + np.arange(FANOUT)).ravel()
            who, acc = np.repeat(q[part], FANOUT), np.repeat(seen[part], FANOUT)
            size = FANOUT ** (k - 1)
            ok = (child < len(self.values[k - 1])) & (child * size < end[who]) & ((child + 1) * size > start[who])
            child, who, acc = child[ok], who[ok], acc[ok]
            acc = acc + np.bitwise_count((queries[who] ^ self.values[k - 1][child]) & self.own[k - 1][child])
            yield from self._below(queries, start, end, distance, k - 1, who, child, acc)


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links -> (node, smallest node of its component here), without the smallest ones themselves."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], least)
        np.minimum.at(new, label[y], least)
        while not np.array_equal(down := new[new], new):
            new = down
        new = new[label]
        if np.array_equal(new, label):
            break
        label = new
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def least_partners(hi: np.ndarray, lo: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct links, of each greater end the `count` smallest partners."""
    if not len(hi):
        return hi, lo
    order = np.lexsort((lo, hi))
    hi, lo = hi[order], lo[order]
    new = np.append(True, (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1]))
    hi, lo = hi[new], lo[new]
    first = np.flatnonzero(np.append(True, hi[1:] != hi[:-1]))
    rank = np.arange(len(hi)) - np.repeat(first, np.diff(np.append(first, len(hi))))
    return hi[rank < count], lo[rank < count]


def whole_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """Columns (segment, code, ...) of rows that arrive by segment and Gray rank; the last segment of a batch waits."""
    held: list[tuple] = []
    for batch in batches:
        new = tuple(c.to_numpy(zero_copy_only=False) for c in batch.columns)
        if len(new[0]):
            held.append((new[0], new[1].astype(np.int64).view(np.uint64), *new[2:]))
        if sum(len(x[0]) for x in held) < CHUNK or held[-1][0][-1] == held[0][0][0]:
            continue
        rows = tuple(np.concatenate(c) for c in zip(*held))
        cut = int(np.searchsorted(rows[0], rows[0][-1]))
        yield tuple(c[:cut] for c in rows)
        held = [tuple(c[cut:] for c in rows)]
    if held:
        yield tuple(np.concatenate(c) for c in zip(*held))


def segment_links(batches: Iterator[pa.RecordBatch], distance: int) -> Iterator[pa.RecordBatch]:
    """Stars of the links among rows (segment, code, asks)."""
    for seg, code, asks in whole_segments(batches):
        own = np.flatnonzero(~asks)
        tree, at = GrayTree(code[own]), seg[own]
        first, last = np.searchsorted(at, seg, "left"), np.searchsorted(at, seg, "right")
        first[own] = np.arange(len(own)) + 1  # a pair in a segment is met once
        a, b = np.empty(0, np.int64), np.empty(0, np.int64)
        for q, place in tree.search(code, first, last, distance):
            a, b = np.concatenate([a, code[q].view(np.int64)]), np.concatenate([b, code[own][place].view(np.int64)])
            if len(a) > FRONT:
                a, b = stars(a, b)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in stars(a, b)], names=["a", "b"])


def near_in_order(seg: np.ndarray, code: np.ndarray, th: np.ndarray, after: np.ndarray, index: np.ndarray, queries: np.ndarray, distance: int, count: int, fits: Callable) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(b, a) places of queries and of indexed rows of their segment with th[a] below th[b], beyond its cursor, near and fit, by rising th.

    The index is searched in chunks by rank of th, each twice the one before, and a query ends with the chunk in which it has
    found `count`. Ranks are as good as random, so a query meets O(count) rows more than it needs, however dense its segment is.
    """
    index = np.flatnonzero(index)
    if not len(index):
        return
    segments = np.unique(seg)
    sid, order = np.searchsorted(segments, seg), np.sort(th[index])
    key = lambda who, values, side: sid[who] * (len(index) + 1) + np.searchsorted(order, values, side)
    own = key(index, th[index], "left")
    keys = np.sort(own)
    begin = np.searchsorted(keys, np.arange(len(segments)) * (len(index) + 1))
    rank = np.searchsorted(keys, own) - begin[sid[index]]
    todo = np.flatnonzero(queries)
    low, high = np.zeros(len(seg), np.int64), np.zeros(len(seg), np.int64)
    low[todo] = np.searchsorted(keys, key(todo, after[todo], "right")) - begin[sid[todo]]
    high[todo] = np.searchsorted(keys, key(todo, th[todo], "left")) - begin[sid[todo]]
    found = np.zeros(len(seg), np.int64)
    start, size, todo = 0, CROWD, todo[high[todo] > low[todo]]
    while len(todo):
        end = start + size
        part = index[(rank >= start) & (rank < end)]
        active = todo[(low[todo] < end) & (high[todo] > start)]
        first, last = np.searchsorted(seg[part], seg[active], "left"), np.searchsorted(seg[part], seg[active], "right")
        for q, place in GrayTree(code[part]).search(code[active], first, last, distance) if len(active) and len(part) else ():
            b, a = active[q], part[place]
            ok = (th[a] < th[b]) & (th[a] > after[b])
            b, a = b[ok], a[ok]
            ok = fits(b, a)
            found += np.bincount(b[ok], minlength=len(found))
            yield b[ok], a[ok]
        todo = todo[(high[todo] > end) & (found[todo] < count)]
        start, size = end, 2 * size


#: What a row is in its segment: one of its own, not of a near one; one that looks for partners; one that may be found.
OWN, ASKS, FOUND = 1, 2, 4


def segment_partners(batches: Iterator[pa.RecordBatch], distance: int, count: int) -> Iterator[pa.RecordBatch]:
    """(a, b) among rows (segment, code, role, th, earlier fingerprints...) and, where not all ask, (after, min-hashes...): of each
    text b the `count` smallest texts a < b beyond its cursor; pairs whose min-hashes are far apart are left out. A pair comes from
    the first fingerprint in which it is near, there from the first near block, so that it is returned once; where it is left to
    another segment it counts as found, as one of the `count` smallest of all is among those of each segment that it is met in."""
    for seg, code, role, th, *more in whole_segments(batches):
        earlier, more = [c.astype(np.int64).view(np.uint64) for c in more[: PRINTS - 1]], more[PRINTS - 1 :]
        own, asks, findable = (role & bit > 0 for bit in (OWN, ASKS, FOUND))
        after, fits = np.full(len(seg), START), lambda b, a: np.ones(len(b), bool)
        if more:
            after, low = more[0], np.stack(more[1:], axis=1).view(np.uint64)

            def fits(b: np.ndarray, a: np.ndarray) -> np.ndarray:
                x = low[a] ^ low[b]
                return np.bitwise_count((x | x >> np.uint64(1)) & np.uint64(0x5555555555555555)).sum(axis=1, dtype=np.int64) <= FAR

        hi, lo, full = np.empty(0, np.int64), np.empty(0, np.int64), FRONT
        for index, queries in ((own & findable, asks), (~own & findable, own & asks)):
            for b, a in near_in_order(seg, code, th, after, index, queries, distance, count, fits):
                x, block, here = code[b] ^ code[a], seg[b] >> 16 & 3, np.ones(len(b), bool)
                for i in range(3):
                    near = np.bitwise_count(x >> np.uint64(48 - 16 * i) & np.uint64(0xFFFF)) <= distance // 4
                    here &= ~near | (block <= i)
                for k, prints in enumerate(earlier):
                    here &= (seg[b] >> 18 & 3 <= k) | (np.bitwise_count(prints[b] ^ prints[a]) > distance)
                hi, lo = np.concatenate([hi, th[b[here]]]), np.concatenate([lo, th[a[here]]])
                if len(hi) > full:
                    hi, lo = least_partners(hi, lo, count)
                    full = max(FRONT, 2 * len(hi))
        hi, lo = least_partners(hi, lo, count)
        yield pa.RecordBatch.from_arrays([pa.array(lo), pa.array(hi)], names=["a", "b"])


def _grid(rows: DataFrame, most: int) -> DataFrame:
    """Rows (seg, role, th, ...) where segments with more than `most` rows are dealt to the cells of a grid, without loss: rows are
    split into g groups by th; as one that asks a row goes to the g cells of its line, as one that is found to those of its column."""
    sizes = settle(rows.groupBy("seg").count().where(F.col("count") > most).select("seg", F.ceil(2 * F.col("count") / most).cast("int").alias("g")), "large")
    if not sizes.limit(1).count():
        return rows
    cell = lambda line, column: F.col("seg") + F.shiftleft(line.cast("long") * F.col("g") + column + 1, 20)
    mine, every = F.pmod(F.xxhash64("th"), F.col("g")).cast("int"), F.sequence(F.lit(0), F.col("g") - 1)
    copy = lambda bit, at: F.when(F.col("role").bitwiseAND(bit) > 0, F.transform(every, lambda i: F.struct(at(i).alias("seg"), F.col("role").bitwiseAND(F.lit(OWN | bit)).alias("role")))).otherwise(F.array().cast("array<struct<seg: long, role: int>>"))
    dealt = F.concat(copy(ASKS, lambda i: cell(mine, i)), copy(FOUND, lambda i: cell(i, mine)))
    cells = F.when(F.col("g").isNull(), F.array(F.struct("seg", "role"))).otherwise(dealt)
    rest = [c for c in rows.columns if c not in ("seg", "role")]
    return join_small(rows, sizes, "seg", "left").select(*rest, F.explode(cells).alias("p")).select(*rest, "p.*")


def _segments(codes: DataFrame, distance: int, every: Column | None = None) -> DataFrame:
    """codes with (seg, asks): the segments of each code, and those that it asks.

    Each pair of segments is asked in one direction, or with `every` in both, by the rows for which that holds.
    """
    near = [sum(1 << i for i in bits) for r in range(1, distance // 4 + 1) for bits in combinations(range(16), r)]

    def places(block: int) -> Column:
        value = F.shiftrightunsigned("code", 48 - 16 * block).bitwiseAND(F.lit(0xFFFF))
        place = lambda v, asks: F.struct((F.lit(block << 16) + v).cast("long").alias("seg"), F.lit(asks).alias("asks"))
        own = F.array(place(value, False))
        if not near:
            return own
        others = F.transform(F.array(*map(F.lit, near)), lambda m: value.bitwiseXOR(m.cast("long")))
        asked = F.filter(others, lambda v: v < value) if every is None else F.filter(others, lambda v: every)
        return F.concat(own, F.transform(asked, lambda v: place(v, True)))

    return codes.select("*", F.explode(F.concat(*map(places, range(4)))).alias("p")).select(*codes.columns, "p.seg", "p.asks")


def _deal_large(rows: DataFrame, distance: int, most: int) -> DataFrame:
    """Rows of segments with more than `most` codes are dealt by four 12-bit blocks of the bits outside the segment's own.

    Only where the segment's own block is equal for all its rows (distance 3): the other 48 bits then differ in at most
    three places, so one of four blocks is equal.
    """
    sizes = settle(rows.groupBy("seg").count().where(F.col("count") > most).select("seg", F.lit(True).alias("large")), "large")
    rest = F.when(F.shiftright("seg", 16) == 0, F.col("code"))
    for block in (1, 2, 3):  # the segment's own block is turned to the front
        turn = 16 * block
        rest = rest.when(F.shiftright("seg", 16) == block, F.shiftleft("code", turn).bitwiseOR(F.shiftrightunsigned("code", 64 - turn)))
    finer = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.shiftleft(F.col("seg"), 16).bitwiseOR(F.shiftleft(i.cast("long"), 12)).bitwiseOR(F.element_at(F.array(*(F.shiftrightunsigned(rest, 36 - 12 * j).bitwiseAND(0xFFF) for j in range(4))), i + 1)).bitwiseOR(F.lit(1 << 62)))
    marked = rows.join(sizes, "seg", "left")
    keys = F.when(F.col("large"), finer).otherwise(F.array("seg"))
    return marked.select("code", "asks", F.explode(keys).alias("seg"))


def fingerprint_links(codes: DataFrame, distance: int = 3, most: int = SEGMENT) -> DataFrame:
    """Distinct (code) -> stars (a, b) that connect all codes within the distance of each other."""
    rows = _segments(codes, distance)
    if distance < 4:
        rows = _deal_large(rows, distance, most)
    return _by_segment(rows, "seg", "code", "asks").mapInArrow(partial(segment_links, distance=distance), "a long, b long")


def _by_segment(rows: DataFrame, *columns: str) -> DataFrame:
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "seg").sortWithinPartitions("seg", gray_rank(F.col("code"))).select(*columns)


def partners(texts: DataFrame, distance: int, count: int, first: bool, most: int = SEGMENT) -> DataFrame:
    """(th, fps, low, after) -> distinct (a, b, n): of each text b the `count` smallest texts a < b that have a fingerprint within the
    distance and are beyond b's cursor, numbered from one. With `first` all texts ask, from the start; later, when those that ask
    stand in crowds, their min-hashes are compared too before a pair is returned, and only segments that are asked are indexed."""
    more = [] if first else ["after", *(f"l{i}" for i in range(MINHASHES // 32))]
    known = texts if first else texts.select("*", *(F.get("low", F.lit(i)).alias(c) for i, c in enumerate(more[1:])))
    prints = known.select("th", "fps", *more, F.posexplode("fps").alias("print", "code"))
    earlier = [f"p{k}" for k in range(PRINTS - 1)]
    prints = prints.select("th", "print", "code", *(F.when(F.col("print") > k, F.get("fps", F.lit(k))).otherwise(0).alias(c) for k, c in enumerate(earlier)), *more)
    rows = _segments(prints, distance, None if first else F.col("after") < DONE)
    asking = F.lit(True) if first else F.col("after") < DONE
    role = F.when(F.col("asks"), ASKS | (FOUND if first else 0)).otherwise(F.when(asking, OWN | ASKS | FOUND).otherwise(OWN | FOUND))
    rows = rows.withColumn("seg", F.shiftleft(F.col("print").cast("long"), 18) + F.col("seg")).withColumn("role", role)
    if not first:  # segments that no text asks need no index
        asked = settle(rows.where(F.col("role").bitwiseAND(ASKS) > 0).select("seg").distinct(), "asked")
        rows = join_small(rows, asked, "seg", "left_semi")
    rows = _grid(rows, most)
    found = _by_segment(rows, "seg", "code", "role", "th", *earlier, *more).mapInArrow(partial(segment_partners, distance=distance, count=count), "a long, b long")
    ranked = found.distinct().withColumn("n", F.row_number().over(Window.partitionBy("b").orderBy("a")))
    return ranked.where(F.col("n") <= count)


def components(prints: DataFrame, distance: int = 3) -> DataFrame:
    """(doc_id, fp) -> (fp, component_id): the smallest doc_id among all documents that links reach."""
    reps = settle(prints.groupBy(F.col("fp").alias("code")).agg(F.min("doc_id").alias("rep")), "codes")
    roots = settle(connected_components(fingerprint_links(reps.select("code"), distance)), "roots")
    least = roots.join(reps, roots["node"] == reps["code"]).groupBy("root").agg(F.min("rep").alias("component_id"))
    linked = roots.join(least, "root").select(F.col("node").alias("code"), "component_id")
    return reps.join(linked, "code", "left").select(F.col("code").alias("fp"), F.coalesce("component_id", "rep").alias("component_id"))


def decisions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, distance: int = 3) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id."""
    bounded_batches(docs.sparkSession)
    prints = settle(docs.select(F.col(id_col).alias("doc_id"), simhash_column(text_of(text_col), width).alias("fp")), "prints")
    joined = join_small(prints, settle(components(prints, distance), "components"), "fp", "inner")
    return joined.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _bottom(docs: DataFrame) -> DataFrame:
    """(th, text) -> (th, low, n): the BOTTOM smallest hashes of the text's five-word shingles, and how many there are."""
    return with_sketch(docs, F.col("text"), "low", SIMILAR_WORDS, 1).select("th", F.slice("low", 1, BOTTOM).alias("low"), F.size("low").alias("n"))


def _alike(shared: Column, union: Column) -> Column:
    return (union > 0) & (shared >= SIMILAR * union - 1e-6)


def _verified(ties: DataFrame, low: DataFrame, docs: DataFrame) -> DataFrame:
    """Ties (a, b) whose texts' five-word shingles have a Jaccard similarity of SIMILAR or more.

    Pairs of short texts are decided on the hashes at hand. Of the others those go that can't be similar by their sizes or clearly
    aren't by estimate; the rest are decided by counts of (pair, hash), so that no row holds two whole texts.
    """
    side = lambda end: low.select(F.col("th").alias(end), F.col("low").alias(f"l{end}"), F.col("n").alias(f"n{end}"))
    both = ties.join(side("a"), "a").join(side("b"), "b").where(_alike(F.least("na", "nb"), F.greatest("na", "nb")))
    union = F.slice(F.array_sort(F.array_union("la", "lb")), 1, BOTTOM)
    shared = F.size(F.array_intersect("la", "lb"))
    short = F.greatest("na", "nb") <= BOTTOM
    likeness = F.when(short, shared / (F.col("na") + F.col("nb") - shared)).otherwise(F.size(F.array_intersect(union, F.array_intersect("la", "lb"))) / F.size(union))
    judged = settle(both.select("a", "b", (F.col("na") + F.col("nb")).alias("n"), short.alias("short"), likeness.alias("likeness")).where(F.col("likeness") >= F.when(F.col("short"), SIMILAR - 1e-9).otherwise(CLEAR)), "judged")
    exact, open_ = judged.where("short").select("a", "b"), judged.where("NOT short").select("a", "b", "n")
    ends = settle(open_.select(F.explode(F.array("a", "b")).alias("th")).distinct(), "ends")
    if not ends.limit(1).count():
        return exact
    texts = join_small(docs, ends, "th", "left_semi").dropDuplicates(["th"])
    hashes = settle(with_sketch(texts, F.col("text"), "all", SIMILAR_WORDS, 1).select("th", F.explode("all").alias("h")), "hashes")
    sides = open_.select("a", "b", "n", F.explode(F.array("a", "b")).alias("th"))
    common = sides.join(hashes, "th").groupBy("a", "b", "n", "h").count().where("count = 2").groupBy("a", "b", "n").count()
    return exact.unionByName(common.where(_alike(F.col("count"), F.col("n") - F.col("count"))).select("a", "b"))


def text_key(text: Column, clashes: list[list[int]], bits: int = 64) -> Column:
    """A long that names a text: its hash, or where that is known to clash, the next of other hashes."""
    key = F.xxhash64(text) if bits == 64 else F.shiftrightunsigned(F.xxhash64(text), 64 - bits)
    for salt, clashing in enumerate(clashes):
        key = F.when(key.isin(clashing), F.xxhash64(F.lit(salt), text)).otherwise(key)
    return key


def distinct_texts(docs: DataFrame, bits: int = 64) -> tuple[DataFrame, list[list[int]]]:
    """(text) -> settled (th, fps, low), one row a distinct text, and the hashes that clash. Bytes are told apart by SHA-256."""
    clashes: list[list[int]] = []
    while True:
        each = docs.select(text_key(F.col("text"), clashes, bits).alias("th"), F.unhex(F.sha2("text", 256)).alias("sha"), marks_column(F.col("text")).alias("marks"))
        texts = settle(each.groupBy("th").agg(F.first("marks").alias("marks"), F.min("sha").alias("least"), F.max("sha").alias("most")), "texts")
        found = [r.th for r in texts.where("least <> most").select("th").limit(CLASHES + 1).collect()]
        if not found:
            return texts.select("th", "marks.fps", "marks.low"), clashes
        if len(found) > CLASHES:
            raise ValueError("too many texts share a hash")
        clashes.append(found)


def similar_texts(docs: DataFrame, distance: int = SIMILAR_BITS, bits: int = 64) -> tuple[DataFrame, list[list[int]]]:
    """(text) -> (th): keys of the texts that go, so that no two that stay are similar and within the distance; and the hashes that clash.

    A link is tested by its greater text, which goes if the link is verified on five-word shingles; so from each text that goes
    verified links lead down to one that stays. In a round each text tests its smallest partners beyond a cursor, at least
    PARTNERS of them, and if it stays and there may be more, it asks again with its cursor at the last one. So pairs of a round
    grow with the texts however dense a group is, and at the end each link was verified, refused or had an end that went. All
    texts that stay are indexed in each round; those that have tested all their partners are only found. The rounds end, as each
    asking text's cursor rises; there are about as many as the most partners of a text / PARTNERS, and fewer as askers grow few.
    """
    texts, clashes = distinct_texts(docs, bits)
    docs = docs.select(text_key(F.col("text"), clashes, bits).alias("th"), "text")
    texts = texts.withColumn("after", F.lit(START))
    total = asking = texts.count()
    low, gone = None, [texts.select("th").limit(0)]
    while asking:
        count = min(MOST_PARTNERS, max(PARTNERS, PARTNERS * total // asking))
        pairs = settle(partners(texts, distance, count, low is None), "pairs")
        ends = pairs.select(F.explode(F.array("a", "b")).alias("th")).distinct()
        ends = settle(ends if low is None else ends.join(low, "th", "left_anti"), "ends")
        if low is None or ends.limit(1).count():
            new = settle(_bottom(join_small(docs, ends, "th", "left_semi").dropDuplicates(["th"])), "low")
            low = new if low is None else low.unionByName(new)
        gone.append(settle(_verified(pairs.select("a", "b"), low, docs).select(F.col("b").alias("th")).distinct(), "gone"))
        more = settle(pairs.where(F.col("n") == count).select(F.col("b").alias("th"), F.col("a").alias("last")).join(gone[-1], "th", "left_anti"), "more")
        if asking := more.count():
            left = join_small(texts.drop("after"), gone[-1], "th", "left_anti")
            texts = settle(join_small(left, more, "th", "left").select("th", "fps", "low", F.coalesce("last", F.lit(DONE)).alias("after")), "texts")
    return settle(functools.reduce(DataFrame.unionByName, gone), "gone"), clashes


def survivors(docs: DataFrame, distance: int = SIMILAR_BITS, bits: int = 64) -> DataFrame:
    """The documents that stay, with all their columns: one of each group of similar texts, and one of equal texts."""
    bounded_batches(docs.sparkSession)
    th = unused(docs, "th")
    gone, clashes = similar_texts(docs.select(text_of().alias("text")), distance, bits)
    key = text_key(text_of(), clashes, bits)
    left = join_small(docs.withColumn(th, key), gone.select(F.col("th").alias(th)), th, "left_anti").drop(th)
    repeated = docs.select(key.alias("th")).groupBy("th").count().where("count > 1").limit(1).count()
    return exact_dedup.survivors(left) if repeated else left


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decisions(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op3_simhash": op3_simhash}
SQL: dict[str, str] = {}
