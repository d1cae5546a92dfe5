"""Quality classifier: a sparse ensemble of conjunctive rules over text statistics.

Shallow trees are grown on statistics of labelled documents; every path from a root to a node becomes a rule, a
conjunction of threshold tests; a logistic regression with a lasso penalty weighs the rules and drops most of them; what
is left is compiled into one Spark column expression, so scoring is a scan without joins, shuffles or Python.

Defined cases: null text counts as empty; every text, also an empty one, has a score from 0 to 1; rows are scored one by
one, so ties, equal texts and repeated rows score alike; a null id is never held out and has no label; without labelled
rows of both classes all scores are the smoothed share of label 1; no rows give no rows; further columns are carried along
(`keep`) or ignored (`decisions`), whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pactlake.llm.common import settle, text_of, unused

#: The fit: labelled rows that are used at most (the first by hash of the id), trees, their depth, the lasso penalty.
SAMPLE, TREES, DEPTH, PENALTY, SEED = 20_000, 16, 3, 0.002, 7
#: Score from which a document stays.
ACCEPT = 0.3


def statistics(docs: DataFrame, text: Column, prefix: str) -> tuple[DataFrame, list[str]]:
    """docs with one column per statistic of the text.

    Each step stands in a generator of one row, which the optimizer neither copies into each use nor moves.
    """
    part = {
        "words": F.array_remove(F.split(F.replace(F.replace(text, F.lit("\n"), F.lit(" ")), F.lit("\t"), F.lit(" ")), " "), ""),
        "lines": F.split(text, "\n"),
        "chars": F.length(text),
        "symbols": F.regexp_count(text, F.lit(r"[#$%&*|{}<>=_~^@\\/+]")),
        "marks": F.regexp_count(text, F.lit("[!?]")),
        "digits": F.regexp_count(text, F.lit("[0-9]")),
        "capitals": F.regexp_count(text, F.lit(r"\p{Lu}")),
    }
    p, s = unused(docs, f"{prefix}_part"), unused(docs, f"{prefix}_stats")
    out = docs.select("*", F.explode(F.array(F.struct(*(c.alias(n) for n, c in part.items())))).alias(p))
    words, n, chars = F.col(f"{p}.words"), F.greatest(F.size(f"{p}.words"), F.lit(1)), F.greatest(F.col(f"{p}.chars"), F.lit(1))
    stats = {
        "log_words": F.log1p(F.size(words)),
        "word_length": F.col(f"{p}.chars") / n,
        "distinct_words": F.size(F.array_distinct(words)) / n,
        "short_words": F.size(F.filter(words, lambda w: F.length(w) <= 3)) / n,
        "repeats": F.size(F.filter(words, lambda w, i: w == F.get(words, i + 1))) / n,
        "repeated_lines": 1 - F.size(F.array_distinct(f"{p}.lines")) / F.size(f"{p}.lines"),
        **{c: F.col(f"{p}.{c}") / chars for c in ("symbols", "marks", "digits", "capitals")},
    }
    out = out.select(*(F.col(f"`{c}`") for c in docs.columns), F.explode(F.array(F.struct(*(c.cast("double").alias(k) for k, c in stats.items())))).alias(s))
    return out, [f"{s}.{k}" for k in stats]


@dataclass(frozen=True)
class Rules:
    """A rule is a tuple of (statistic, below, threshold): statistic <= threshold if below, else statistic > threshold."""

    rules: tuple[tuple[tuple[int, bool, float], ...], ...]
    weights: tuple[float, ...]
    bias: float

    def fires(self, names: list[str]) -> list[Column]:
        test = lambda i, below, at: F.col(names[i]) <= at if below else F.col(names[i]) > at
        out = []
        for rule in self.rules:
            c = test(*rule[0])
            for t in rule[1:]:
                c = c & test(*t)
            out.append(c.cast("double"))
        return out

    def score(self, names: list[str]) -> Column:
        total = F.lit(self.bias)
        for fires, weight in zip(self.fires(names), self.weights):
            total = total + fires * weight
        return 1 / (1 + F.exp(-total))


def paths(tree) -> list[tuple[tuple[int, bool, float], ...]]:
    """Rules of a fitted tree: the tests on the way to each node below the root."""
    found, todo = [], [(tree._java_obj.rootNode() if hasattr(tree, "_java_obj") else tree, ())]
    while todo:
        node, way = todo.pop()
        if way:
            found.append(tuple(sorted(way)))
        if node.getClass().getSimpleName() == "InternalNode":
            split = node.split()
            todo += [(node.leftChild(), (*way, (split.featureIndex(), True, split.threshold()))), (node.rightChild(), (*way, (split.featureIndex(), False, split.threshold())))]
    return found


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, penalty: float = PENALTY) -> Rules:
    """docs (doc_id, text), labels (doc_id, label 0 or 1) -> rules fitted on at most `sample` labelled rows."""
    chosen = settle(labels.where("label IN (0, 1) AND doc_id IS NOT NULL").orderBy(F.xxhash64("doc_id"), "label").limit(sample).select("doc_id", F.col("label").cast("double").alias("label")), "labels")
    known = docs.select("doc_id", text_of().alias("text")).join(F.broadcast(chosen), "doc_id")
    rows, names = statistics(known, F.col("text"), "q")
    rows = settle(rows.select("label", F.array(*names).alias("stats")), "stats").coalesce(4)
    n, ones = rows.agg(F.count("*"), F.sum("label")).first()
    if not n or not 0 < ones < n:
        import math

        share = ((ones or 0) + 1) / (n + 2)
        return Rules((), (), math.log(share / (1 - share)))
    data = rows.select("label", array_to_vector("stats").alias("features")).cache()
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, subsamplingRate=0.7, minInstancesPerNode=5).fit(data)
    rules = list(dict.fromkeys(r for tree in forest.trees for r in paths(tree)))
    data.unpersist()
    if not rules:
        import math

        return Rules((), (), math.log(ones / (n - ones)))
    every = Rules(tuple(rules), (0.0,) * len(rules), 0.0)
    names = [f"s{i}" for i in range(len(names))]
    fired = rows.select("label", *(F.get("stats", F.lit(i)).alias(k) for i, k in enumerate(names))).select("label", array_to_vector(F.array(*every.fires(names))).alias("features")).cache()
    lasso = LogisticRegression(elasticNetParam=1.0, regParam=penalty, maxIter=60, standardization=False).fit(fired)
    fired.unpersist()
    kept = [(r, float(w)) for r, w in zip(rules, lasso.coefficients.toArray()) if w]
    return Rules(tuple(r for r, _ in kept), tuple(w for _, w in kept), float(lasso.intercept))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def learned(docs: DataFrame, labels: DataFrame) -> Rules:
    """Rules from labels.quality of the rows that aren't held out."""
    known = labels.where(~held_out(F.col("doc_id"))).select("doc_id", F.col("quality").alias("label"))
    return fit(docs.select("doc_id", "text"), known)


def decisions(docs: DataFrame, rules: Rules) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    rows, names = statistics(docs.select("doc_id", text_of().alias("text")), F.col("text"), "q")
    scored = rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), rules.score(names).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= ACCEPT).cast("int"))


def keep(docs: DataFrame, rules: Rules) -> DataFrame:
    """The documents that are accepted, with all their columns."""
    rows, names = statistics(docs, text_of(), "q")
    return rows.where(rules.score(names) >= ACCEPT).select(*(F.col(f"`{c}`") for c in docs.columns))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return decisions(docs, learned(docs, labels))


QUERIES = {"op6_quality": op6_quality}
SQL: dict[str, str] = {}
