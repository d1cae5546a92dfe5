"""Document fingerprints: threshold-scaled sketches of word shingles.

A sketch holds every five-word shingle's hash that lies below a fixed fraction of the hash space, so a sketch grows with its
document, the sketch of a union is the union of the sketches, and the share of a sketch that another one holds estimates
containment without bias, however unequal the two documents are. All of it is expressions inside Spark.

Each document is also held against its successor in a total order, by id and then by text hash. The order is cut into buckets of
about equal size at quantiles of a bounded sample of these keys, so that neither outlying nor repeated nor null ids crowd a
bucket; a bucket is one small window, and a copy of the first row of each bucket is lent to the bucket before it. So
whole texts are shuffled once, and no task sees more than a few buckets. Of more than BUCKETS x BUCKET rows buckets grow in proportion.

Defined cases: null text counts as empty; a text of one to four words is one shingle; a text without words has an empty
sketch; two empty sketches are alike (1) if their texts are equal and else not (0), an empty and another one are not;
equal texts have equal fingerprints; rows with one id follow each other by their texts' hashes; null ids come after all others;
rows that repeat both id and text stand in one bucket; a single document is followed by itself; no rows give no rows; further columns
are ignored. At this scale 10 of the 1,000 documents of sf0.01, of up to 229 characters, have an empty sketch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pactlake.llm.common import settle, text_of

#: Words of a shingle; a shingle stays if its unsigned hash is below 2**64 / SCALE.
WIDTH, SCALE = 5, 4
#: Documents of a bucket about, buckets at most, sampled keys a bucket and in all at most, cuts that a row is compared with at once.
BUCKET, BUCKETS, POINTS, SAMPLE, FANOUT = 1024, 65_536, 64, 1 << 20, 256


def _retained(hashes: Column, width: int, scale: int) -> Column:
    n = F.size(hashes)
    last = F.greatest(n - width, F.lit(0))
    every = F.when(n > 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*(F.get(hashes, i + k) for k in range(width))))).otherwise(F.array().cast("array<bigint>"))
    below = F.filter(every, lambda h: h < -(2**63) + 2**64 // scale) if scale > 1 else every
    return F.array_sort(F.array_distinct(below))


def with_sketch(rows: DataFrame, text: Column, name: str, width: int = WIDTH, scale: int = SCALE) -> DataFrame:
    """rows with the text's sketch; word hashes stand in a generator, so that they are made once."""
    spaced = F.translate(F.lower(text), "\t\n\x0b\f\r", "     ")
    words = F.transform(F.split(spaced, " "), lambda w: F.when(w != "", F.xxhash64(w)))
    held = rows.select("*", F.explode(F.array(F.array_compact(words))).alias("_hashes"))
    return held.select(*rows.columns, F.explode(F.array(_retained(F.col("_hashes"), width, scale))).alias(name))


def containment(a: Column, b: Column, same_text: Column) -> Column:
    """The share of sketch a that sketch b holds."""
    return F.when(F.size(a) > 0, F.size(F.array_intersect(a, b)) / F.size(a)).otherwise(F.when((F.size(b) == 0) & same_text, 1.0).otherwise(0.0)).cast("double")


def fingerprint(hashes: Column) -> Column:
    """The sketch as a string: 16 hex digits a hash, in order; nothing for an empty one."""
    return F.lower(F.array_join(F.transform(hashes, lambda h: F.lpad(F.hex(h), 16, "0")), ""))


def _keyed(docs: DataFrame) -> DataFrame:
    """docs with k, which ascends as ids descend (null ids last), and h, the text's hash."""
    return docs.withColumn("k", F.bitwise_not(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))))).withColumn("h", F.xxhash64("text"))


def bucket_cuts(keys: DataFrame, size: int = BUCKET) -> list[tuple[int, int]]:
    """Settled keys (k, h) -> the keys at which buckets of about `size` rows begin, by a sample of at most SAMPLE keys."""
    n = keys.count()
    buckets = min(BUCKETS, -(-n // size))
    if buckets < 2:
        return []
    drawn = sorted(map(tuple, keys.orderBy(F.xxhash64(F.lit(0), "k", "h")).limit(min(n, SAMPLE, POINTS * buckets)).collect()))
    return sorted({drawn[i * len(drawn) // buckets] for i in range(1, buckets)})


def _passed(ks: Column, hs: Column) -> Column:
    """How many of the cuts, given as two arrays, lie at or before the row's key."""
    return F.size(F.filter(ks, lambda k, i: (k < F.col("k")) | ((k == F.col("k")) & (F.get(hs, i) <= F.col("h")))))


def with_bucket(rows: DataFrame, cuts: list[tuple[int, int]]) -> DataFrame:
    """rows (k, h, ...) with their bucket: the number of cuts passed, found in two steps if there are many."""
    array = lambda values: F.lit(list(values)).cast("array<bigint>") if values else F.array().cast("array<bigint>")
    if len(cuts) <= FANOUT:
        return rows.withColumn("bucket", _passed(array([k for k, _ in cuts]), array([h for _, h in cuts])))
    groups = [cuts[i : i + FANOUT] for i in range(0, len(cuts), FANOUT)]
    heads = [g[0] for g in groups]
    table = rows.sparkSession.createDataFrame([(i + 1, [k for k, _ in g], [h for _, h in g]) for i, g in enumerate(groups)], "_group int, _ks array<bigint>, _hs array<bigint>")
    found = rows.withColumn("_group", _passed(array([k for k, _ in heads]), array([h for _, h in heads])))
    joined = found.join(F.broadcast(table), "_group", "left")  # at most BUCKETS cuts in all
    inner = F.when(F.col("_group") > 0, (F.col("_group") - 1) * FANOUT + _passed(F.col("_ks"), F.col("_hs"))).otherwise(0)
    return joined.withColumn("bucket", inner.cast("int")).drop("_group", "_ks", "_hs")


def with_next(docs: DataFrame, size: int = BUCKET) -> DataFrame:
    """(doc_id, text) plus its sketch, and next_text and next_sketch of the document that follows by descending id.

    One pass brings the slim keys, one sketches all rows, and one finds the lent heads, which alone are sketched twice.
    """
    spark = docs.sparkSession
    keyed = _keyed(docs)
    keys = settle(keyed.select("k", "h"), "keys")
    cuts = bucket_cuts(keys, size)
    heads = with_bucket(keys, cuts).groupBy("bucket").agg(F.min(F.struct("k", "h")).alias("head"))  # BUCKETS rows at most
    before = F.lag("bucket").over(Window.orderBy("bucket"))
    lent = settle(heads.select("head.k", "head.h", F.coalesce(before, F.max("bucket").over(Window.partitionBy())).alias("bucket")), "heads")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    own = with_bucket(keyed, cuts).select("doc_id", "text", "k", "h", "bucket", F.lit(False).alias("lent"))
    # Rows that repeat a head are one guest.
    guests = keyed.join(F.broadcast(lent), ["k", "h"]).groupBy("bucket").agg(F.first(F.struct("doc_id", "text", "k", "h")).alias("row"))
    guests = guests.select("row.*", "bucket", F.lit(True).alias("lent"))
    sketched = [with_sketch(rows, F.col("text"), "sketch") for rows in (own, guests)]
    rows = sketched[0].unionByName(sketched[1]).repartition(parts, "bucket")
    order = Window.partitionBy("bucket").orderBy("lent", "k", "h")
    return rows.withColumns({f"next_{c}": F.lead(c).over(order) for c in ("text", "sketch")}).where("NOT lent").drop("lent", "bucket", "k", "h")


def decisions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket: int = BUCKET) -> DataFrame:
    """One row per document with its fingerprint, that of its edited text, and likenesses, as the query returns them."""
    n = F.length("text")
    third = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - third), F.substring("next_text", F.lit(1), third))
    rows = with_next(docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text")), bucket).withColumn("n_chars", n.cast("long")).withColumn("edited", edited)
    rows = with_sketch(rows.select("doc_id", "n_chars", "text", "sketch", "edited", F.sha2("edited", 256).alias("edited_sha256"), "next_sketch", (F.col("text") == F.col("next_text")).alias("same_next"), (F.col("text") == F.col("edited")).alias("same_edited")), F.col("edited"), "edited_sketch")
    return rows.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        fingerprint(F.col("sketch")).alias("fingerprint"),
        fingerprint(F.col("edited_sketch")).alias("edited_fingerprint"),
        containment(F.col("sketch"), F.col("edited_sketch"), F.col("same_edited")).alias("near_edited"),
        containment(F.col("sketch"), F.col("next_sketch"), F.col("same_next")).alias("near_next"),
    )


def op9_scaled_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decisions(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op9_scaled_sketch": op9_scaled_sketch}
SQL: dict[str, str] = {}
