"""Text and embedding drift: TF-IDF in long form, centroids, cosine similarity."""

from __future__ import annotations

import pandas as pd
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pactlake.functions.scalar import tokens

TFIDF_SIMILARITY, DENSE_DRIFT = 0.25, 0.15
#: Characters of documents whose terms a task counts.
TASK_CHARS = 4_000_000


def terms(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, term, n): counts are made where a document's text has been dealt to."""
    return by_document(docs, id_col, text_col).select("doc", F.explode(tokens(F.col("text"))).alias("term")).groupBy("doc", "term").agg(F.count("*").alias("n"))


def by_document(docs: DataFrame, id_col: str, text_col: str, *keep: str) -> DataFrame:
    """(keep, doc, text), dealt by document: a text is moved once, its terms, which take far more room, are then counted where it lies.

    Tasks get about TASK_CHARS each, however large files and table are, so that what one holds doesn't grow with them.
    """
    chars = docs.agg(F.coalesce(F.sum(F.length(text_col)), F.lit(0))).first()[0]
    return docs.select(*keep, F.col(id_col).alias("doc"), F.col(text_col).alias("text")).repartition(1 + chars // TASK_CHARS, "doc")


def document_frequency(counts: DataFrame) -> DataFrame:
    return counts.groupBy("term").agg(F.count("*").alias("df"))


def tfidf(docs: DataFrame, id_col: str, text_col: str, group: str | None = None) -> DataFrame:
    """(doc, term, w), w = n / total x (ln((N + 1) / (df + 1)) + 1), fitted on the documents given (per group, if any).

    The vocabulary is joined: once its size is known, adaptive execution broadcasts a small one and splits frequent terms otherwise.
    """
    keys = [group] if group else []
    rows = by_document(docs, id_col, text_col, *keys).select(*keys, "doc", F.explode(tokens(F.col("text"))).alias("term"))
    counts = rows.groupBy(*keys, "doc", "term").agg(F.count("*").alias("n"))
    df = counts.groupBy(*keys, "term").agg(F.count("*").alias("df"))
    counts = counts.withColumn("total", F.sum("n").over(Window.partitionBy(*keys, "doc")))  # a document's terms, not the corpus's
    if keys:
        sizes = docs.groupBy(*keys).agg(F.count("*").alias("docs"))
        joined = counts.join(df, [*keys, "term"]).join(sizes, keys)
        n = F.col("docs")
    else:
        joined, n = counts.join(df, "term"), docs.agg(F.count("*")).scalar()
    return joined.select(*keys, "doc", "term", (F.col("n") / F.col("total") * (F.log((n + 1) / (F.col("df") + 1)) + 1)).alias("w"))


def centroid(weights: DataFrame, documents: DataFrame, group: str) -> DataFrame:
    """(group, term, w): the mean vector of each group's documents; a term that a document lacks counts as zero."""
    sizes = documents.groupBy(group).agg(F.count("*").alias("docs"))
    return weights.groupBy(group, "term").agg(F.sum("w").alias("s")).join(sizes, group).select(group, "term", (F.col("s") / F.col("docs")).alias("w"))


def sparse_cosine(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row, similarity: cosine of two (term, w) vectors; 0 where a norm is 0."""
    both = a.select("term", F.col("w").alias("x")).join(b.select("term", F.col("w").alias("y")), "term", "full")
    dot, nx, ny = F.sum(F.coalesce(F.col("x") * F.col("y"), F.lit(0.0))), F.sqrt(F.sum(F.col("x") ** 2)), F.sqrt(F.sum(F.col("y") ** 2))
    return both.agg(F.coalesce(F.try_divide(dot, nx * ny), F.lit(0.0)).alias("similarity"))


def term_weights(docs: DataFrame, id_col: str, text_col: str, size: Column) -> DataFrame:
    """(term, w): the sum of the documents' TF-IDF weights; a mean's length doesn't matter to a cosine.

    As the idf depends on the term alone, shares and documents are summed up by term and weighed afterwards, without a join: one row a
    term and task is shuffled. Ids must tell documents apart.
    """
    found = by_document(docs, id_col, text_col).select("doc", F.explode(F.array(tokens(F.col("text")))).alias("found"))  # in a generator, so that it is made once
    rows = found.select("doc", F.size("found").alias("total"), F.explode("found").alias("term"))
    counts = rows.groupBy("doc", "term").agg(F.count("*").alias("n"), F.first("total").alias("total"))
    sums = counts.groupBy("term").agg(F.sum(F.col("n") / F.col("total")).alias("s"), F.count("*").alias("df"))
    return sums.select("term", (F.col("s") * (F.log((size + 1) / (F.col("df") + 1)) + 1)).alias("w"))


def text_drift(base: DataFrame, current: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row: similarity of the centroids, drift, status (PASS, WARN; SKIP where a side is empty)."""
    sizes = base.agg(F.count("*").alias("n")).scalar(), current.agg(F.count("*").alias("m")).scalar()
    out = sparse_cosine(*(term_weights(d, id_col, text_col, n) for d, n in zip((base, current), sizes)))
    empty = (sizes[0] == 0) | (sizes[1] == 0)
    sim = F.round("similarity", 4)
    return out.select(sim.alias("similarity"), F.round(1 - F.col("similarity"), 4).alias("drift"), F.when(empty, "SKIP").when(sim >= TFIDF_SIMILARITY, "PASS").otherwise("WARN").alias("status"))


def embedding_drift(base: DataFrame, current: DataFrame, text_col: str, provider, keep=None) -> DataFrame | None:
    """As text_drift, by the centroids of a provider's vectors (see embed); None where a side is empty or the provider fails.

    keep, if given, is called with the first side's centroid, as one row.
    """
    try:
        first, second = (dense_centroid(embed(d, text_col, provider), "embedding").first()["centroid"] for d in (base, current))
    except PySparkException:  # a provider's failure leaves the terms to tell
        return None
    if not first or not second:
        return None
    both = base.sparkSession.createDataFrame([(first, second)], "centroid array<double>, other array<double>")
    if keep:
        keep(both.select("centroid"))
    sim = F.round(cosine(F.col("centroid"), F.col("other")), 4)
    drift = F.round(1 - sim, 4)
    return both.select(sim.alias("similarity"), drift.alias("drift"), F.when(drift <= DENSE_DRIFT, "PASS").otherwise("WARN").alias("status"))


def dense_centroid(df: DataFrame, vector: str, *keys: str) -> DataFrame:
    """(keys, centroid): element-wise mean; values are averaged per position before anything is gathered."""
    cells = df.select(*keys, F.posexplode(vector).alias("pos", "x")).groupBy(*keys, "pos").agg(F.avg("x").alias("m"))
    return cells.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda p: p.m).alias("centroid"))


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))), F.lit(0.0))


def halves(df: DataFrame) -> DataFrame:
    """df with `second`, false for its first half by position (the smaller one where the count is odd).

    Positions are counted per partition; only these counts, a number a partition, are summed, so no row leaves its place.
    """
    rows = df.withColumns({"_part": F.spark_partition_id(), "_n": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))})
    counts = {r["_part"]: r["count"] for r in rows.groupBy("_part").count().collect()}
    left, second = sum(counts.values()) // 2, F.lit(True)
    for part in sorted(counts):
        if left < counts[part]:
            second = (F.col("_part") > part) | (F.col("_part") == part) & (F.col("_n") >= left)
            break
        left -= counts[part]
    return rows.withColumn("second", second).drop("_part", "_n")


def hashed_sample(df: DataFrame, key: str, n: int = 200, seed: int = 42) -> DataFrame:
    """A repeatable sample without replacement (a sampling operator, so its limit is the feature)."""
    return df.orderBy(F.xxhash64(F.col(key), F.lit(seed)), F.col(key)).limit(n)


def embed(df: DataFrame, text_col: str, provider, batch: int = 256) -> DataFrame:
    """df with an embedding by a provider(list of texts) -> list of vectors; called in batches in Python workers."""

    def run(texts: pd.Series) -> pd.Series:
        out: list = []
        for i in range(0, len(texts), batch):
            out += provider(texts.iloc[i : i + batch].fillna("").tolist())
        return pd.Series(out)

    return df.withColumn("embedding", F.pandas_udf(run, "array<double>")(F.col(text_col)))
