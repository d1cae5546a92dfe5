"""Joins by containment: pairs of texts of which one holds the other, by an inverted index of q-grams.

A needle can only stand in a text that has all of its q-grams, so each needle is looked up by the one of them that is in the fewest
texts: an equi-join, which spreads over the cluster, in place of a nested loop. Candidates are then verified. Long needles are
looked up by longer grams, which few texts share, so that candidates don't grow with needles times texts. Needles shorter
than q are their own gram, and the index holds grams of a length only where there are needles that ask for it; an empty needle stands
in every text. Where needles are few, grams that none of them has are dropped where texts are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Shortest gram of a needle that has it; longer ones are LONGER times as long. Characters of needles up to which these are broadcast.
#: Rows that share a needle are dealt in blocks of about DEALT, each of which meets the needle's texts by itself.
Q, LONGER, FEW_CHARS, DEALT = 3, (2, 4), 1_000_000, 1024


def contains_join(needles: DataFrame, texts: DataFrame, needle: str, text: str, on: tuple[str, ...] = (), q: int = Q, dealt: int = DEALT) -> DataFrame:
    """Rows of needles and texts, paired where the text contains the needle and the columns `on` are equal; null contains nothing.

    Column names of the two sides must differ, but for `on`.
    """
    keys = list(on)
    size = F.least(F.length(needle), F.lit(q))
    for times in LONGER:
        size = F.when(F.length(needle) >= q * times, q * times).otherwise(size)
    copies = needles.where(F.col(needle).isNotNull()).groupBy(*keys, needle).agg(F.count("*").alias("_copies"))
    told = copies.agg(F.collect_set(size).alias("lengths"), F.coalesce(F.sum(F.length(needle) + 1), F.lit(0)).alias("chars"), F.max("_copies").alias("most")).first()
    if not (lengths := sorted(told.lengths)):  # q + 3 numbers at most
        return needles.limit(0).join(texts, keys) if keys else needles.limit(0).join(texts, F.lit(True))
    small = F.broadcast if told.chars <= FEW_CHARS else lambda df: df
    n = F.length(text)
    grams = lambda size: F.when(n >= size, F.transform(F.sequence(F.lit(1), n - size + 1), lambda i: F.substring(text, i, F.lit(size)))) if size else F.array(F.lit(""))
    index = texts.where(F.col(text).isNotNull()).select("*", F.explode(F.array_distinct(F.flatten(F.array_compact(F.array(*map(grams, lengths)))))).alias("_gram"))
    own = F.when(size > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(needle) - size + 1), lambda i: F.substring(needle, i, size)))).otherwise(F.array(F.lit("")))
    asked = copies.select(*keys, F.col(needle).alias("_needle"), F.explode(own).alias("_gram"))
    if told.chars <= FEW_CHARS:
        index = index.join(F.broadcast(asked.select(*keys, "_gram").distinct()), [*keys, "_gram"], "left_semi")
    often = index.groupBy(*keys, "_gram").agg(F.count("*").alias("_often"))
    counted = asked.join(often, [*keys, "_gram"], "left")
    # A gram that no text has rules its needle out.
    rarest = counted.groupBy(*keys, "_needle").agg(F.min(F.struct(F.coalesce("_often", F.lit(0)).alias("n"), "_gram")).alias("_rarest")).where("_rarest.n > 0")
    chosen = rarest.select(*keys, "_needle", F.col("_rarest._gram").alias("_gram"))
    pairs = index.join(small(chosen), [*keys, "_gram"]).where(F.contains(text, F.col("_needle"))).drop("_gram")
    sides = needles.withColumn("_needle", F.col(needle))
    if told.most <= dealt:
        return sides.join(pairs, [*keys, "_needle"]).drop("_needle")
    # The rows made are copies times texts, so a needle with many copies is dealt; its texts go to each block, one row for `dealt` rows made.
    by = [*keys, "_needle"]
    blocks = F.broadcast(copies.where(F.col("_copies") > dealt).select(*keys, F.col(needle).alias("_needle"), F.ceil(F.col("_copies") / dealt).alias("_blocks")))  # a row for `dealt` needles at most
    count = F.coalesce("_blocks", F.lit(1).cast("long"))
    parts = int(needles.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # by number, as bytes read don't tell how many rows are made
    left = sides.join(blocks, by, "left").withColumn("_block", F.pmod(F.xxhash64(*needles.columns), count)).drop("_blocks")
    right = pairs.join(blocks, by, "left").withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), count - 1))).drop("_blocks")
    return left.repartition(parts, *by, "_block").join(right.repartition(parts, *by, "_block"), [*by, "_block"]).drop("_needle", "_block")
