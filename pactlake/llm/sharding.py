"""Resharding as a minimum-cost flow.

Old shards supply their bytes, new shards take up to their capacities, staying costs nothing and a moved byte its cost, so
the cheapest flow moves the fewest bytes. The flow is between shards and is solved from their sizes alone; it is carried out
in blocks, runs of rows by a hash of the row, whose bounds are found by radix selection: each level counts bytes by the
next bits of the keys near a bound, so no shard is sorted or gathered anywhere. As a bound falls between rows, repairing flows over
what is left over and short move rows that have left their old shard already, which costs nothing more, and others only
where a shard has no such rows; the smallest rows go first. They end when no shard is off by more than OVERHEAD bytes or
a flow makes nothing better, and the result must then be within twice the largest row of equal, else it is an error. Only shards
that gain or lose rows are written again.

The driver holds one number an old shard (a file), never rows or names. With equal costs any pairing of surplus and room is a
cheapest flow, so the query's is solved in one pass over the shards; a cost makes it successive shortest paths.

Law: `bytes`. Defined cases: null text has no bytes, and like every row costs OVERHEAD; repeated rows
are told apart by their places (rows without given places are written once to number them), however many and whatever is null; with fewer rows than shards, or a row larger than a
shard's share, sizes are as near as whole rows allow; no rows give no rows; further columns are carried into the files; where a
column is named shard or slot, the new ones have a leading underscore.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pactlake.llm.common import BROADCAST_ROWS, join_small, local_table, new_path, settle, text_of, unused

SHARDS, OVERHEAD = 40, 16
#: Bits that one level of the selection tells apart at least and at most, counts that it brings to the driver about; rows of a written piece about.
LEVEL_BITS, MOST_BITS, COUNTS, PIECE_ROWS = 8, 16, 1 << 18, 20_000


def flow(sizes: dict[int, int], capacity: dict[int, int], cost=None) -> list[tuple[int, int, int]]:
    """Cheapest (from, to, bytes) from old to new shards; sum(capacity) >= sum(sizes).

    Without a cost every moved byte costs the same: all that fits stays, and any pairing of surplus and room is cheapest.
    With cost(from, to) it is solved by successive shortest paths.
    """
    if cost is None:
        moves, surplus = [], deque()
        for i, size in sorted(sizes.items()):
            stay = min(size, capacity.get(i, 0))
            moves += [(i, i, stay)] * bool(stay)
            surplus.extend([[i, size - stay]] * (size > stay))
        room = deque([j, c - min(c, sizes.get(j, 0))] for j, c in sorted(capacity.items()) if c > sizes.get(j, 0))
        while surplus and room:
            n = min(surplus[0][1], room[0][1])
            moves.append((surplus[0][0], room[0][0], n))
            for side in (surplus, room):
                side[0][1] -= n
                if not side[0][1]:
                    side.popleft()
        return moves
    # Residual graph: "s" -> ("o", i) -> ("n", j) -> "t".
    graph: dict = {}

    def arc(a, b, room: int, price: float) -> None:
        graph.setdefault(a, {})[b] = [room, price]
        graph.setdefault(b, {})[a] = [0, -price]

    for i, size in sizes.items():
        arc("s", ("o", i), size, 0)
        for j in capacity:
            arc(("o", i), ("n", j), size, 0 if i == j else cost(i, j))
    for j, c in capacity.items():
        arc(("n", j), "t", c, 0)
    while True:
        best, back, queue = {"s": 0}, {}, ["s"]
        while queue:
            a = queue.pop(0)
            for b, (room, price) in graph.get(a, {}).items():
                if room and best[a] + price < best.get(b, float("inf")) - 1e-12:
                    best[b], back[b] = best[a] + price, a
                    queue.append(b)
        if "t" not in back:
            break
        way, at = [], "t"
        while at != "s":
            way.append((back[at], at))
            at = back[at]
        n = min(graph[a][b][0] for a, b in way)
        for a, b in way:
            graph[a][b][0] -= n
            graph[b][a][0] += n
    return [(i, j, graph[("n", j)][("o", i)][0]) for i in sizes for j in capacity if graph[("n", j)][("o", i)][0]]


def _listed(df: DataFrame, rows: list[tuple], schema: str, on: list[str], how: str) -> DataFrame:
    """df joined with rows that the driver has counted: broadcast only up to BROADCAST_ROWS."""
    table = local_table(df.sparkSession, rows, schema)
    return df.join(F.broadcast(table) if len(rows) <= BROADCAST_ROWS else table, on, how)


def select_keys(rows: DataFrame, cuts: dict[int, list[int]]) -> dict[int, list[int]]:
    """rows (grp, key, size), cuts: cumulative bytes by group -> the keys below which about so many bytes lie.

    Every level reads only the rows near a cut, and brings about COUNTS counts to the driver, or 2**LEVEL_BITS a cut if they are many.
    """
    top = rows.agg(F.max("key")).first()[0]
    if top is None:
        return {g: [0] * len(c) for g, c in cuts.items()}
    bits = max(1, int(top).bit_length())
    open_cuts = [(g, n, target, 0, 0) for g, c in cuts.items() for n, target in enumerate(c)]  # group, which, target, prefix, bytes before it
    found: dict[tuple[int, int], int] = {}
    done = 0
    while open_cuts:
        near = sorted({(g, p) for g, _, _, p, _ in open_cuts})
        step = min(MOST_BITS, max(LEVEL_BITS, (COUNTS // len(near)).bit_length() - 1), bits - done)
        if done:
            part = _listed(rows.withColumn("prefix", F.shiftrightunsigned("key", bits - done)), near, "grp int, prefix long", ["grp", "prefix"], "inner")
        else:
            part = _listed(rows, [(g,) for g in cuts], "grp int", ["grp"], "inner")
        counts: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
        for g, child, size, n in part.groupBy("grp", F.shiftrightunsigned("key", bits - done - step).alias("child")).agg(F.sum("size"), F.count("*")).collect():
            counts.setdefault((g, child >> step), []).append((child, size, n))
        done += step
        left = bits - done
        still = []
        for g, which, target, prefix, before in open_cuts:
            cut = 1 << bits
            for child, size, n in sorted(counts.get((g, prefix), [])):
                if before + size > target:
                    if n > 1 and left:
                        still.append((g, which, target, child, before))
                        cut = None
                    else:
                        cut = (child if target - before < size / 2 else child + 1) << left
                    break
                before += size
            if cut is not None:
                found[g, which] = cut
        open_cuts = still
    return {g: [found[g, n] for n in range(len(c))] for g, c in cuts.items()}


@dataclass(frozen=True)
class Moves:
    """For each shard the bounds of its blocks by key, and where each block goes."""

    bounds: dict[int, list[int]]
    dests: dict[int, list[int]]

    def apply(self, rows: DataFrame, shard: str, key: str) -> DataFrame:
        """rows with `shard` replaced by where the row's block goes; the table has one row a shard that loses rows."""
        table = [(g, b, self.dests[g]) for g, b in self.bounds.items()]
        joined = _listed(rows, table, f"{shard} int, _bounds array<long>, _dests array<int>", [shard], "left")
        block = F.size(F.filter("_bounds", lambda b: b <= F.col(key)))
        return joined.withColumn(shard, F.when(F.col("_bounds").isNull(), F.col(shard)).otherwise(F.get("_dests", block))).drop("_bounds", "_dests")


def moves_for(rows: DataFrame, arcs: list[tuple[int, int, int]], stay_first: bool) -> Moves:
    """Blocks for the arcs of a flow; the block that stays is the first or the last of its shard by key."""
    by: dict[int, list[tuple[int, int]]] = {}
    for i, j, n in sorted(arcs, key=lambda a: (a[0], (a[0] != a[1]) == stay_first, a[1])):
        by.setdefault(i, []).append((j, n))
    by = {i: out for i, out in by.items() if [j for j, _ in out] != [i]}
    cuts = {}
    for i, out in by.items():
        total, cuts[i] = 0, []
        for _, n in out[:-1]:
            total += n
            cuts[i].append(total)
    return Moves(select_keys(rows, cuts), {i: [j for j, _ in out] for i, out in by.items()})


def _keyed(docs: DataFrame) -> DataFrame:
    """docs (_shard, _place, ...) with _size, _hash (62 bits, of the row and its place, so that repeated rows differ), _small, a key by
    which smaller rows come first, and _old, the shard it comes from."""
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + OVERHEAD
    mixed = F.shiftrightunsigned(F.xxhash64(F.col("doc_id"), F.crc32(text_of()), F.col("_shard"), F.col("_place")), 2)
    out = docs.withColumn("_size", size).withColumn("_hash", mixed).withColumn("_old", F.col("_shard"))
    return out.withColumn("_small", F.shiftleft(F.least("_size", F.lit((1 << 30) - 1)), 31).bitwiseOR(F.shiftrightunsigned("_hash", 31)))


#: Key of the repairs: rows that have left their old shard come first, then small ones.
_REPAIR = "_small + CASE WHEN _shard = _old THEN shiftleft(1L, 61) ELSE 0L END"


def equal_capacity(total: int, shards: int) -> dict[int, int]:
    return {j: total // shards + (j < total % shards) for j in range(shards)}


def plan(slim: DataFrame, shards: int = SHARDS, cost: Callable[[int, int], float] | None = None) -> tuple[list[tuple[str, Moves]], dict[int, int], set[int]]:
    """Settled rows (_shard, _old, _hash, _small, _size) -> the moves in turn (key, moves), final sizes, affected shards."""
    sizes_of = lambda rows: {s: n for s, n in rows.groupBy("_shard").agg(F.sum("_size")).collect()}  # noqa: E731  one row a shard
    sizes = sizes_of(slim)
    capacity = equal_capacity(sum(sizes.values()), shards)
    worst = lambda s: max(abs(s.get(j, 0) - capacity.get(j, 0)) for j in {*s, *capacity})
    steps: list[tuple[str, Moves]] = []
    affected: set[int] = set()
    rows = slim
    while worst(sizes) > OVERHEAD:
        arcs = flow(sizes, capacity, cost)
        key = _REPAIR if steps else "_hash"
        moves = moves_for(rows.select(F.col("_shard").alias("grp"), F.expr(key).alias("key"), F.col("_size").alias("size")), arcs, stay_first=not steps)
        moved = settle(moves.apply(rows.withColumn("_key", F.expr(key)), "_shard", "_key").drop("_key"), "assigned")
        new = sizes_of(moved)
        if steps and worst(new) >= worst(sizes):
            break
        affected |= {x for i, j, _ in arcs if i != j for x in (i, j)}
        steps.append((key, moves))
        rows, sizes = moved, new
    if sizes and worst(sizes) > (bound := 2 * slim.agg(F.max("_size")).first()[0]):
        raise ValueError(f"a shard is off by {worst(sizes)} bytes, more than {bound}")
    return steps, sizes, affected


def reshard(docs: DataFrame, old: Column, folder: str, shards: int = SHARDS, cost: Callable[[int, int], float] | None = None, old_slot: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """docs (doc_id, text, ...) and their old shard (int) -> rows of the new layout with shard and slot, and its sizes.

    Affected shards are written to folder as shard=<n>/ and read back; other rows stay in their files, and in their places if
    those are given by old_slot.
    """
    spark = docs.sparkSession
    shard, slot = unused(docs, "shard"), unused(docs, "slot")
    given = None if old_slot is None else old_slot.cast("long")
    if old_slot is None:  # rows get numbers that stay the same however often they are read
        given = F.monotonically_increasing_id()
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_doc"), "doc_id", "text", old.cast("int").alias("_shard"), given.alias("_place"))
    keyed = _keyed(settle(packed, "placed") if old_slot is None else packed)
    slim = settle(keyed.select("_shard", "_old", "_hash", "_small", "_size"), "sizes")
    steps, sizes, affected = plan(slim, shards, cost)

    def assigned(rows: DataFrame) -> DataFrame:
        for key, moves in steps:
            rows = moves.apply(rows.withColumn("_key", F.expr(key)), "_shard", "_key").drop("_key")
        return rows

    def numbered(rows: DataFrame, slim_rows: DataFrame) -> DataFrame:
        """rows with slots: counts by shard and piece are made on the slim table, and each piece is numbered in a small window."""
        most = slim_rows.groupBy("_shard").count().agg(F.max("count")).first()[0] or 0
        piece = F.pmod("_hash", F.lit(max(1, -(-most // PIECE_ROWS)))).cast("int")
        counts = slim_rows.groupBy("_shard", piece.alias("_piece")).count()
        before = Window.partitionBy("_shard").orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
        offsets = settle(counts.select("_shard", "_piece", F.coalesce(F.sum("count").over(before), F.lit(0)).cast("long").alias("_before")), "offsets")
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        placed = rows.withColumn("_piece", piece).repartition(parts, "_shard", "_piece")
        order = Window.partitionBy("_shard", "_piece").orderBy("_hash", "doc_id")
        slotted = join_small(placed.withColumn("_at", F.row_number().over(order) - 1), offsets, ["_shard", "_piece"], "inner")
        return slotted.select("_doc.*", (F.col("_before") + F.col("_at")).cast("long").alias(slot), F.col("_shard").alias(shard))

    part = lambda rows, how: _listed(assigned(rows), [(s,) for s in sorted(affected)], "_shard int", ["_shard"], how)
    ready = numbered(part(keyed, "left_semi"), part(slim, "left_semi"))
    ready.write.partitionBy(shard).parquet(folder)
    back = spark.read.schema(ready.schema).parquet(folder)
    if set(sizes) - affected:
        stay = part(keyed, "left_anti")
        stay = numbered(stay, part(slim, "left_anti")) if old_slot is None else stay.select("_doc.*", F.col("_place").alias(slot), F.col("_shard").alias(shard))
        back = back.unionByName(stay)
    return back, local_table(spark, sorted(sizes.items()), "shard int, bytes long")


def file_shards(docs: DataFrame) -> DataFrame:
    """docs (with _metadata) plus _old, the place of a row's file among the table's files in order, and _place, the row's place in it.

    Files are numbered where they are sorted, by offsets of the sorted parts, so the driver has no list of them.
    """
    with_file = docs.withColumn("_file", F.col("_metadata.file_path")).withColumn("_place", F.col("_metadata.row_index"))
    names = settle(with_file.select("_file").distinct().orderBy("_file").select("_file", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("_at")), "files")
    before = F.coalesce(F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = names.groupBy("_part").agg(F.count("*").alias("n")).select("_part", before.alias("_before"))  # one row a sorted part
    table = settle(names.join(offsets, "_part").select("_file", (F.col("_before") + F.col("_at")).cast("int").alias("_old")), "numbers")
    return join_small(with_file, table, "_file", "left").drop("_file", "_metadata")


def op4_reshard(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = file_shards(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "_metadata"))
    rows, _ = reshard(docs, F.col("_old"), new_path(spark, "shards"), old_slot=F.col("_place"))
    return rows.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + OVERHEAD).alias("size"),
        F.crc32(text_of()).alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


QUERIES = {"op4_reshard": op4_reshard}
SQL: dict[str, str] = {}
