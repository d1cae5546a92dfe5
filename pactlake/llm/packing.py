"""Best-fit packing of token pieces into sequences, by bulk-synchronous supersteps.

Every piece has a size class, its length from 1 to the sequence length, and every open sequence has a gap class. Pieces are
ranked within their class over the whole corpus (counts per partition, then offsets), so a class and a rank name a piece,
and a class's sequences are runs of consecutive ids. A superstep takes the largest class that is left: its pieces go to the
successor, the smallest gap that holds them, in rank order where several want the same one; gaps are updated and
the next superstep follows; pieces without a gap open sequences. A superstep moves whole runs (rank from, rank to, first
sequence id), so the plan's size follows the number of classes, not of documents; it is then matched to the ranked pieces
by a distributed join on the class, where each rank finds its run.

Defined cases: null text counts as empty, which is the single token 0; longer documents than a sequence are cut from the
end into full sequences, so only their first piece may be shorter; equal texts and repeated rows are packed each; no rows
give no rows; further columns are ignored.
"""

from __future__ import annotations

import bisect
import functools
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pactlake.llm.common import bounded_batches, settle, text_of

LENGTH, SEPARATOR = 2048, 0
#: The special tokens of the public vocabularies, which a text may hold.
SPECIAL = {"byte_bpe_50k": {"<|endoftext|>": 50256}}
#: Rows of a plan that are sent to every executor; a plan beyond it is shuffled.
PLAN_ROWS = 1_000_000


@functools.lru_cache
def public_encoder(name: str = "byte_bpe_50k") -> Callable[[str], list[int]]:
    """A tokenizer of the installed public vocabulary files, loaded once in a worker process.

    The .tiktoken file has the same vocabulary and merge order as the .json file and gives the same ids several times faster;
    it lists no special tokens, so they are added: their strings in a text get their ids, as by the .json file.
    """
    import base64

    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    special = SPECIAL.get(name, {})
    held = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def encode(text: str) -> list[int]:
        return held.encode(text, allowed_special="all") if any(s in text for s in special) else held.encode_ordinary(text)

    return encode


def cut(n: int, length: int) -> Iterator[tuple[int, int]]:
    """(start, length) of the pieces of n tokens."""
    first = n % length or length
    yield 0, min(first, n)
    for start in range(first, n, length):
        yield start, length


def token_pieces(docs: DataFrame, encoder: Callable[[], Callable[[str], list[int]]] = public_encoder, length: int = LENGTH, keep_ids: bool = False) -> DataFrame:
    """(doc_id, text) -> doc_id, piece, start, length, ids_crc32 and, if asked, ids (little-endian unsigned 32-bit)."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, names = encoder(), [c.split()[0] for c in schema.split(", ")]
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = np.array([*encode(text), SEPARATOR], dtype="<u4")
                for i, (start, n) in enumerate(cut(len(ids), length)):
                    part = ids[start : start + n].tobytes()
                    rows.append((doc_id, i, start, n, zlib.crc32(part), part)[: len(names)])
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * len(names), types)], names=names)

    return docs.select(F.col("doc_id").cast("long"), text_of().alias("text")).mapInArrow(pieces, schema)


def plan(counts: dict[int, int], length: int = LENGTH) -> list[tuple[int, int, int, int, int, int]]:
    """Supersteps over class counts -> runs (class, rank from, rank to, first sequence id, pieces a sequence, offset of the first).

    In a run, rank r lies in sequence first + (r - from) // each at offset + (r - from) % each * class.
    """
    runs: list[tuple[int, int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap class -> runs of open sequences (first id, how many)
    order: list[int] = []  # gap classes that are open, ascending
    opened = 0

    def free(gap: int, first: int, many: int) -> None:
        if gap and many:
            if gap not in gaps:
                gaps[gap] = []
                bisect.insort(order, gap)
            gaps[gap].append((first, many))

    for size in sorted(counts, reverse=True):
        rank, total = 0, counts[size]
        while rank < total and (at := bisect.bisect_left(order, size)) < len(order):
            gap = order[at]
            first, many = gaps[gap].pop()
            if not gaps[gap]:
                del gaps[gap], order[at]
            each = gap // size
            whole = min(many, (total - rank) // each)
            if whole:
                runs.append((size, rank, rank + whole * each, first, each, length - gap))
                free(gap - each * size, first, whole)
                rank += whole * each
            if whole < many and rank < total:
                left = total - rank
                runs.append((size, rank, total, first + whole, left, length - gap))
                free(gap - left * size, first + whole, 1)
                rank, whole = total, whole + 1
            free(gap, first + whole, many - whole)
        if rank < total:
            each = length // size
            whole, left = divmod(total - rank, each)
            if whole:
                runs.append((size, rank, rank + whole * each, opened, each, 0))
                free(length - each * size, opened, whole)
            if left:
                runs.append((size, rank + whole * each, total, opened + whole, left, 0))
                free(length - left * size, opened + whole, 1)
            opened += whole + (left > 0)
    return runs


def ranked(pieces: DataFrame) -> DataFrame:
    """Settled pieces with `rank`, gapless from 0 within each length over the whole table."""
    spark = pieces.sparkSession

    def number(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = np.zeros(LENGTH * 64, np.int64)
        for rows in batches:
            if rows["length"].max() >= len(seen):
                seen = np.append(seen, np.zeros(int(rows["length"].max()) + 1, np.int64))
            n = rows["length"].to_numpy()
            rows["rank"] = seen[n] + rows.groupby("length").cumcount().to_numpy()
            seen += np.bincount(n, minlength=len(seen))
            yield rows

    local = settle(pieces.withColumn("part", F.spark_partition_id()).mapInPandas(number, _ddl(pieces) + ", part int, rank long"), "ranked")
    # Parts x classes rows; each class's parts are summed in one small window.
    sums = local.groupBy("length", "part").count()
    before = F.sum("count").over(_window())
    offsets = settle(sums.select("length", "part", F.coalesce(before, F.lit(0)).cast("long").alias("before")), "offsets")
    joined = local.join(F.broadcast(offsets) if offsets.limit(PLAN_ROWS + 1).count() <= PLAN_ROWS else offsets, ["length", "part"])
    return joined.withColumn("rank", F.col("rank") + F.col("before")).drop("part", "before")


def _window():
    from pyspark.sql import Window

    return Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{n}` {t}" for n, t in df.dtypes)


def pack(pieces: DataFrame, length: int = LENGTH) -> DataFrame:
    """Pieces (with column length) -> the same with sequence_id and offset."""
    spark = pieces.sparkSession
    # Written first, so that tokenizing and numbering never hold two Python workers in one task.
    numbered = ranked(settle(pieces, "pieces"))
    counts = {r["length"]: r["n"] for r in numbered.groupBy("length").agg((F.max("rank") + 1).alias("n")).collect()}  # at most `length` rows
    runs = pd.DataFrame(plan(counts, length), columns=["length", "lo", "hi", "first", "each", "at"]).astype("int64")
    table = spark.createDataFrame(runs) if len(runs) else spark.createDataFrame([], "length long, lo long, hi long, first long, each long, at long")
    table = F.broadcast(table) if len(runs) <= PLAN_ROWS else table
    k = F.col("rank") - F.col("lo")
    placed = numbered.join(table, "length").where("rank >= lo AND rank < hi")
    return placed.select(*pieces.columns, (F.col("first") + F.floor(k / F.col("each"))).cast("long").alias("sequence_id"), (F.col("at") + k % F.col("each") * F.col("length")).cast("long").alias("offset"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return pack(token_pieces(spark.read.parquet(f"{sf_dir}/documents.parquet")))


QUERIES = {"op7_packing": op7_packing}
SQL: dict[str, str] = {}
