"""Grouping of spelling variants by letter-parity bitmask bands.

A word's mask has a bit for each residue of its code points that tells whether the letters of that residue are odd in number.
One inserted, deleted or replaced letter flips at most two bits, so of three bands of the mask one is equal. Words meet in
buckets of an equal band and a length class: class n takes words of n letters and, as the longer partners, of n + 1. In a
bucket masks are compared first (two bits at most), then the words themselves are verified. A pair is made in its first equal
band only, so pairs need no distinct.

Bands tell few words apart when the vocabulary is large. A bucket with more than MOST words is therefore dealt again, without
loss: an edit in the second half of the shorter word leaves the first half of both equal, one in the first half leaves the rest, so
its words meet by their first half and by the rest, and a pair comes from the rest only if the first halves differ.

A word's form is its near word of largest count, if that is at least twice its own. Counts rise along forms, at least by the
factor, so forms make no cycles, and roots are found by pointer doubling in a few rounds.

Defined cases: null text has no words; a null id counts as empty; texts and runs of any length are read whole; equal texts and
repeated rows count each; ties of forms go to the smallest word in code-point order; no rows give no rows; further columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pactlake.llm.common import join_small, settle, text_of

#: Letters of a run, code points and occurrences of a word at least, factor by which a form's count is larger.
LETTERS, SHORTEST, RAREST, FACTOR = r"[A-Za-zÀ-ÿ]", 5, 3, 2
#: A run loses a letter where this divides its hash.
EVERY = 97
#: Bits of a mask, bands of it; words of a bucket that are compared pair by pair.
BITS, BANDS, MOST = 63, 3, 128
_BAND = [sum(1 << i for i in range(k, BITS, BANDS)) for k in range(BANDS)]
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def occurrences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (word) for each run of letters that leaves a word of SHORTEST code points or more."""
    text = F.translate(text_of(text_col), _UPPER, _UPPER.lower())
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(text, F.lit(f"{LETTERS}{{{SHORTEST},}}"), F.lit(0))).alias("run"))
    hashed = runs.select("run", F.crc32(F.concat_ws(":", "id", "run")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    word = F.when(F.col("h") % EVERY == 0, F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2))).otherwise(F.col("run"))
    return hashed.select(word.alias("word")).where(F.length("word") >= SHORTEST)


def vocabulary(words: DataFrame, rarest: int = RAREST) -> DataFrame:
    """(word) -> (word, n) of the words that occur often enough."""
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= rarest)


def parity_mask(word: Column) -> Column:
    flip = lambda mask, c: mask.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.ascii(c) % BITS))
    return F.aggregate(F.split(word, ""), F.lit(0).cast("long"), lambda mask, c: F.when(c == "", mask).otherwise(flip(mask, c)))


def _band(mask: str, k: int) -> Column:
    return F.col(mask).bitwiseAND(F.lit(_BAND[k]))


def near_pairs(words: DataFrame, most: int = MOST) -> DataFrame:
    """Distinct words (word, n) -> each pair (a, na, b, nb) that differs by one edit once; a is the shorter, or of equal length the smaller."""
    slim = settle(words.select("word", "n", F.length("word").alias("len"), parity_mask(F.col("word")).alias("mask")), "masks")
    places = lambda classes: F.array(*(F.struct(F.lit(k).cast("tinyint").alias("band"), _band("mask", k).alias("value"), c.alias("cls")) for k in range(BANDS) for c in classes))
    dealt = lambda classes: slim.select("*", F.explode(places(classes)).alias("p")).select(*slim.columns, "p.*")
    own, other = dealt([F.col("len")]), dealt([F.col("len"), F.col("len") - 1])
    key = ["band", "value", "cls"]
    large = settle(other.groupBy(*key).count().where(F.col("count") > most).select(*key, F.lit(True).alias("large")), "large")
    half = F.shiftright("cls", 1)
    first, rest = F.substr("word", F.lit(1), half), F.right("word", F.col("cls") - half)
    halves = F.array(F.struct(F.lit(1).cast("tinyint").alias("side"), first.alias("part")), F.struct(F.lit(2).cast("tinyint").alias("side"), rest.alias("part")))
    whole = F.array(F.struct(F.lit(0).cast("tinyint").alias("side"), F.lit("").alias("part")))
    split = lambda rows: join_small(rows, large, key, "left").select(*slim.columns, *key, F.explode(F.when(F.col("large"), halves).otherwise(whole)).alias("h")).select(*slim.columns, *key, "h.*")
    mine = split(own).select(*key, "side", "part", F.col("word").alias("a"), F.col("n").alias("na"), F.col("mask").alias("ma"))
    theirs = split(other).select(*key, "side", "part", F.col("word").alias("b"), F.col("n").alias("nb"), F.col("mask").alias("mb"), F.col("len").alias("lb"))
    ordered = (F.col("lb") > F.col("cls")) | (F.col("a") < F.col("b"))
    first_band = (F.col("band") == 0) | ((_band("ma", 0) != _band("mb", 0)) & ((F.col("band") == 1) | (_band("ma", 1) != _band("mb", 1))))
    first_side = (F.col("side") < 2) | (F.substr("a", F.lit(1), half) != F.substr("b", F.lit(1), half))
    near_masks = F.bit_count(F.col("ma").bitwiseXOR(F.col("mb"))) <= 2
    one_edit = F.levenshtein("a", "b", 1) == 1
    met = mine.join(theirs, [*key, "side", "part"])
    return met.where(near_masks & ordered & first_band & first_side & one_edit).select("a", "na", "b", "nb")


def with_forms(words: DataFrame, pairs: DataFrame, factor: int = FACTOR) -> DataFrame:
    """words (word, n) with n_near, form and form_n. Neighbours are summed up where they are made, so a word with many costs one row a task."""
    sides = F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("nb").alias("near_n")), F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("na").alias("near_n")))
    best = pairs.select(F.explode(sides).alias("s")).select("s.*").groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), "near")).alias("best"))
    joined = words.join(best, "word", "left")
    fits = -F.col("best.m") >= factor * F.col("n")
    return joined.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(fits, F.col("best.near")).alias("form"), F.when(fits, -F.col("best.m")).alias("form_n"))


def with_roots(formed: DataFrame) -> DataFrame:
    """Settled words with form -> with root, the last word that forms lead to. Each round doubles the steps that are made."""
    links = settle(formed.where("form IS NOT NULL").select("word", F.col("form").alias("root")), "links")
    while True:
        ends = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        new = settle(join_small(links, ends, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "links")
        links = new.select("word", "root")
        if not new.where("moved").limit(1).count():
            break
    return join_small(formed, links, "word", "left").withColumn("root", F.coalesce("root", "word"))


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per word: word, n, n_near, form, form_n, root."""
    words = settle(vocabulary(occurrences(docs, id_col, text_col)), "words")
    return with_roots(settle(with_forms(words, settle(near_pairs(words), "pairs")), "forms"))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


QUERIES = {"op11_spelling": op11_spelling}
#: CRC-32 is no function of the oracle's SQL; the tests hold the query against a brute-force version.
SQL: dict[str, str] = {}
