"""Exact deduplication with counting quotient filters.

Each partition builds a filter of the 64-bit fingerprints of its texts: the high bits (block, home quotient) say where a
fingerprint lives, the low bits are the stored remainder, and equal remainders share one counter. A block's filters merge
without loss by merging their sorted remainders and adding counters, so the merged filter holds the exact multiplicity of
each fingerprint over the corpus. Texts whose fingerprint counts one are unique; all others go to byte verification, a
grouping by the whole text.

Defined cases: null text counts as empty, and empty texts are equal; of equal texts the row with the largest id stays
(null ids count as smallest); of rows with the same id and text one stays, the greatest by its other columns, nested ones by their JSON; no rows give no rows; further columns
are carried along, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pactlake.llm.common import bounded_batches, join_small, settle, text_of, unused

#: Bits of a fingerprint that name its block (the unit that is shuffled) and its home quotient in the block.
BLOCK_BITS, HOME_BITS = 14, 6
REST_BITS = 64 - BLOCK_BITS - HOME_BITS
#: Fingerprints that a task holds before it writes its filter out and begins another.
FILTER_SIZE = 1_000_000


def encode_filter(prints: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    """A filter's occupied blocks from sorted distinct fingerprints: run lengths by home quotient, remainders, counters."""
    block = (prints >> np.uint64(64 - BLOCK_BITS)).astype(np.int64)
    home = (prints >> np.uint64(REST_BITS)).astype(np.int64) & ((1 << HOME_BITS) - 1)
    rest = prints & np.uint64((1 << REST_BITS) - 1)
    at = np.flatnonzero(np.diff(block, prepend=-1))
    ends = np.append(at[1:], len(block))
    runs = [np.bincount(home[i:j], minlength=1 << HOME_BITS).astype("<u4").tobytes() for i, j in zip(at, ends)]
    return pa.RecordBatch.from_arrays(
        [
            pa.array(block[at].astype(np.int32)),
            pa.array(runs, pa.binary()),
            pa.array([rest[i:j].astype("<u8").tobytes() for i, j in zip(at, ends)], pa.binary()),
            pa.array([counts[i:j].astype("<i8").tobytes() for i, j in zip(at, ends)], pa.binary()),
        ],
        names=["block", "runs", "remainders", "counters"],
    )


def decode_filter(rows: pa.RecordBatch | pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints and counts of blocks, each block's in order."""
    if not rows.num_rows:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    cols = {c: rows.column(c).to_pylist() for c in rows.schema.names}
    runs = np.frombuffer(b"".join(cols["runs"]), "<u4").astype(np.int64).reshape(-1, 1 << HOME_BITS)
    per_block = runs.sum(axis=1)
    home = np.repeat(np.tile(np.arange(1 << HOME_BITS, dtype=np.uint64), len(runs)), runs.ravel())
    block = np.repeat(np.array(cols["block"], dtype=np.uint64), per_block)
    rest = np.frombuffer(b"".join(cols["remainders"]), "<u8")
    return block << np.uint64(64 - BLOCK_BITS) | home << np.uint64(REST_BITS) | rest, np.frombuffer(b"".join(cols["counters"]), "<i8")


def merge_sorted(prints: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(prints, kind="stable")
    prints, counts = prints[order], counts[order]
    first = np.flatnonzero(np.append(True, prints[1:] != prints[:-1])) if len(prints) else np.empty(0, np.int64)
    return prints[first], np.add.reduceat(counts, first) if len(first) else counts


def build_filters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One filter of a partition's fingerprints (several if it has more than FILTER_SIZE distinct ones)."""
    prints, counts = np.empty(0, np.uint64), np.empty(0, np.int64)
    for batch in batches:
        new = np.asarray(batch.column(0).to_numpy(zero_copy_only=False), dtype=np.int64).view(np.uint64)
        prints, counts = merge_sorted(np.concatenate([prints, new]), np.concatenate([counts, np.ones(len(new), np.int64)]))
        if len(prints) >= FILTER_SIZE:
            yield encode_filter(prints, counts)
            prints, counts = prints[:0], counts[:0]
    if len(prints):
        yield encode_filter(prints, counts)


def merge_filters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fingerprints that count above one, from blocks that arrive in order; only the last block waits for the next batch."""
    held = None
    out = lambda p, n: pa.RecordBatch.from_arrays([pa.array(p[n > 1].view(np.int64)), pa.array(n[n > 1])], names=["fp", "n"])
    for batch in batches:
        prints, counts = decode_filter(batch)
        if held is not None:
            prints, counts = np.concatenate([held[0], prints]), np.concatenate([held[1], counts])
        prints, counts = merge_sorted(prints, counts)
        open_from = np.searchsorted(prints >> np.uint64(64 - BLOCK_BITS), prints[-1] >> np.uint64(64 - BLOCK_BITS)) if len(prints) else 0
        yield out(prints[:open_from], counts[:open_from])
        held = prints[open_from:], counts[open_from:]
    if held is not None:
        yield out(*held)


def repeated_fingerprints(prints: DataFrame) -> DataFrame:
    """(fp) of all texts -> (fp, n) of those that count above one, settled."""
    spark = prints.sparkSession
    filters = prints.select("fp").mapInArrow(build_filters, "block int, runs binary, remainders binary, counters binary")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    merged = filters.repartition(parts, "block").sortWithinPartitions("block").mapInArrow(merge_filters, "fp long, n long")
    return settle(merged, "repeated")


def _fingerprint(bits: int):
    fp = F.xxhash64(text_of("text"))
    return fp if bits == 64 else fp.bitwiseAND(~((1 << (64 - bits)) - 1))


def decisions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = 64) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256. Fewer bits only make more collisions to verify."""
    bounded_batches(docs.sparkSession)
    text = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    prints = text.select("doc_id", _fingerprint(bits).alias("fp"), F.sha2(text_of(), 256).alias("text_sha256"))
    slim = settle(prints.withColumn("row", F.monotonically_increasing_id()), "prints")
    heavy = repeated_fingerprints(slim).select("fp")
    # Byte verification: texts that share a fingerprint are grouped by their whole bytes.
    suspects = join_small(text.select(_fingerprint(bits).alias("fp"), text_of().alias("text")), heavy, "fp", "left_semi")
    verified = suspects.groupBy("fp", "text").agg(F.count("*").alias("rows")).groupBy("fp", F.sha2("text", 256).alias("text_sha256")).agg(F.count("*").alias("texts"))
    groups = join_small(slim, heavy, "fp", "left_semi").groupBy("fp", "text_sha256").agg(F.max(F.struct("doc_id", "row")).alias("keep"), F.count("*").alias("group_size"))
    # Two texts with one SHA-256 are not known to exist; a row that met them would not be told apart below, so it fails loudly.
    checked = groups.join(verified, ["fp", "text_sha256"]).withColumn("group_size", F.when(F.col("texts") == 1, F.col("group_size")).otherwise(F.raise_error(F.lit("two texts share a SHA-256")).cast("long")))
    joined = join_small(slim, settle(checked.drop("texts"), "groups"), ["fp", "text_sha256"], "left")
    return joined.select(
        "doc_id",
        F.when(F.col("keep").isNull(), F.col("doc_id")).otherwise(F.col("keep.doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (F.col("keep").isNull() | (F.col("row") == F.col("keep.row"))).alias("kept"),
        "text_sha256",
    )


def survivors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay, with all their columns. Only texts with a repeated fingerprint are shuffled."""
    bounded_batches(docs.sparkSession)
    fp, key, row = (unused(docs, c) for c in ("fp", "key", "row"))
    heavy = repeated_fingerprints(docs.select(F.xxhash64(text_of(text_col)).alias("fp"))).select(F.col("fp").alias(fp))
    docs_fp = docs.withColumn(fp, F.xxhash64(text_of(text_col)))
    single = join_small(docs_fp, heavy, fp, "left_anti").drop(fp)
    nested = ("map", "variant", "struct", "array")
    others = [(F.col(f"`{f.name}`"), f.dataType.typeName() in nested) for f in docs.schema.fields if f.name not in (id_col, text_col)]
    ordered = F.struct(F.col(id_col), *(F.to_json(F.struct(c)) if is_nested else c for c, is_nested in others))
    shared = join_small(docs_fp, heavy, fp, "left_semi").groupBy(text_of(text_col).alias(key)).agg(F.max_by(F.struct(*(F.col(f"`{c}`") for c in docs.columns)), ordered).alias(row))
    return single.unionByName(shared.select(f"{row}.*"))


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decisions(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op1_exact_dedup": op1_exact_dedup}
SQL = {
    "op1_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC) = 1 AS kept,
               sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
    """
}
