"""Mixing by soft membership.

A classifier that is fitted on a labelled table gives each document a posterior over domains, so a document belongs to
several domains in part. Projected gradient descent then fits a nonnegative rate for each document, the number of times it
is to be seen, so that the expected tokens of each domain, the sum of rate x tokens x posterior, match target weights with
the least squared error (and, by a small ridge, the least change of rates from 1). The gradient of a document's rate is its posterior times
the domains' errors, so the summed steps are one number a domain, and a rate is 1 plus posterior x these numbers, projected
to nonnegative values. A step is one aggregation over a slim table, and only the domains' totals and second moments go to the
driver. A step is scaled by the inverse second moments of the documents whose rates aren't at zero, and halved until it
gains; so without projection one step is exact, and with it a few are. Steps end where the gradient vanishes; if it doesn't within
STEPS it is an error, and targets that nonnegative rates can't meet are reported in a warning.

Defined cases: null text counts as empty and has no tokens; such rows have a posterior and a rate, but weigh nothing; a
domain without labelled rows or tokens can't be matched and is left out; with fewer than two labelled domains all rates
are 1; equal texts have equal posteriors and rates; rows repeated with one id get equal copies; no rows give no rows;
further columns are carried along (`mixed`) or ignored (`rates`), whatever their names.
"""

from __future__ import annotations

import warnings

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pactlake.llm.common import settle, text_of

#: The fit: labelled rows that are used at most (the first by hash of the id), hashed features, ridge penalty.
SAMPLE, FEATURES, PENALTY = 20_000, 1 << 14, 3e-4
#: Gradient steps and halvings of a step at most, relative gradient that ends them, relative error from which missed targets are
#: reported, the ridge.
STEPS, HALVINGS, CLOSE, REPORTED, RIDGE = 100, 30, 1e-5, 0.01, 1e-6
#: Target weights of the query; the anchor keeps its expected tokens, so the others are scaled against it.
TARGETS, ANCHOR = {"clean": 0.96, "junk": 0.02, "toxic": 0.02}, "clean"


def features(docs: DataFrame, text: Column) -> DataFrame:
    """docs with tokens (words between blanks) and a feature vector: hashed presence of words, and their variety."""
    spaced = F.replace(F.replace(text, F.lit("\n"), F.lit(" ")), F.lit("\t"), F.lit(" "))
    held = docs.select("*", F.explode(F.array(F.array_remove(F.split(spaced, " "), ""))).alias("_words"))
    # array_distinct first: presence is all that counts, and most words of a long text repeat.
    rows = held.select(*(F.col(f"`{c}`") for c in docs.columns), F.size("_words").cast("long").alias("_tokens"), F.array_distinct("_words").alias("_words"))
    hashed = HashingTF(inputCol="_words", outputCol="_hashed", numFeatures=FEATURES, binary=True).transform(rows)
    ready = hashed.withColumn("_variety", F.size("_words") / F.greatest("_tokens", F.lit(1))).withColumn("_length", F.log1p("_tokens") / 10)
    return VectorAssembler(inputCols=["_hashed", "_variety", "_length"], outputCol="_features").transform(ready).drop("_words", "_hashed", "_variety", "_length")


class Domains:
    """Posteriors over the domains of a labelled table (doc_id, domain)."""

    def __init__(self, docs: DataFrame, labelled: DataFrame, sample: int = SAMPLE) -> None:
        chosen = settle(labelled.where("domain IS NOT NULL AND doc_id IS NOT NULL").orderBy(F.xxhash64("doc_id"), "domain").limit(sample).select("doc_id", "domain"), "labelled")
        known = docs.select("doc_id", text_of().alias("text")).join(F.broadcast(chosen), "doc_id")
        rows = settle(features(known, F.col("text")).select("domain", "_features"), "features").coalesce(4)
        self.names = sorted(r[0] for r in rows.select("domain").distinct().collect())
        self.model = None
        if len(self.names) > 1:
            index = F.array_position(F.array(*map(F.lit, self.names)), F.col("domain")) - 1
            data = rows.select(index.cast("double").alias("label"), F.col("_features").alias("features")).cache()
            self.model = LogisticRegression(regParam=PENALTY, maxIter=40, featuresCol="features", family="multinomial", standardization=False).fit(data)
            data.unpersist()

    def posteriors(self, docs: DataFrame, text: Column) -> DataFrame:
        """docs with _tokens and _p, an array in the order of names."""
        rows = features(docs, text)
        if self.model is None:
            return rows.withColumn("_p", F.array(*[F.lit(1.0)] * len(self.names)).cast("array<double>")).drop("_features")
        scored = self.model.setFeaturesCol("_features").setProbabilityCol("_probability").setPredictionCol("").setRawPredictionCol("").transform(rows)
        return scored.withColumn("_p", vector_to_array("_probability")).drop("_features", "_probability")


def rate_of(moves: dict[int, float], p: str) -> Column:
    """The rate after steps that sum to the moves: 1 plus posterior x move, projected to nonnegative values."""
    return F.greatest(F.lit(0.0), sum((F.get(p, F.lit(i)) * F.lit(float(m)) for i, m in moves.items()), F.lit(1.0)))


def fit_moves(rows: DataFrame, names: list[str], targets: dict[str, float], anchor: str) -> tuple[dict[int, float], dict[str, tuple[float, float]]]:
    """Settled rows (tokens, p) -> the sum of all steps, by domain; and each matched domain's (target, reached) tokens.

    One aggregation a step brings a few numbers, whatever the size of the corpus.
    """
    k = len(names)
    if k < 2:
        return {}, {}
    p = [F.get("p", F.lit(i)) for i in range(k)]
    pairs = [(i, j) for i in range(k) for j in range(i, k)]

    def state(moves: dict[int, float]) -> tuple[np.ndarray, np.ndarray, float]:
        """Reached tokens, second moments over the documents whose rate isn't at zero, and half the sum of tokens x rate^2."""
        rate = F.col("rate")
        free = F.when(rate > 0, F.col("tokens"))
        row = rows.withColumn("rate", rate_of(moves, "p")).agg(*(F.sum(rate * F.col("tokens") * p[i]) for i in range(k)), *(F.sum(free * p[i] * p[j]) for i, j in pairs), F.sum(F.col("tokens") * rate * rate)).first()
        numbers = np.array([float(x or 0) for x in row])
        moments = np.zeros((k, k))
        for (i, j), v in zip(pairs, numbers[k:-1]):
            moments[i, j] = moments[j, i] = v
        return numbers[:k], moments, numbers[-1] / 2

    start, moments, squares = state({})
    live = [i for i, d in enumerate(names) if start[i] > 0 and d in targets]
    if anchor not in [names[i] for i in live] and len(live) > 1:
        instead = names[max(live, key=lambda i: start[i])]
        warnings.warn(f"no tokens are expected of {anchor!r}, the domain that keeps its own; {instead!r} keeps its own instead", stacklevel=2)
        anchor = instead
    if len(live) < 2:
        return {}, {}
    goal = (start[names.index(anchor)] / targets[anchor] * np.array([targets.get(d, 0.0) for d in names]))[live]
    reached, start = start[live], start[live]
    ridge = RIDGE * start**2 / start.max()
    total = np.zeros(len(live))
    loss = lambda total, squares: ridge @ total**2 / 2 + squares - goal @ total
    for _ in range(STEPS):
        gradient = ridge * total - (goal - reached)
        if np.max(np.abs(gradient) / start) < CLOSE:
            break
        step = -np.linalg.solve(np.diag(ridge) + moments[np.ix_(live, live)], gradient)
        for _ in range(HALVINGS):
            new, new_moments, new_squares = state(dict(zip(live, total + step)))
            if loss(total + step, new_squares) <= loss(total, squares) + 1e-4 * gradient @ step:
                break
            step = step / 2
        total, reached, moments, squares = total + step, new[live], new_moments, new_squares
    else:
        raise ValueError(f"rates haven't settled after {STEPS} steps")
    outcome = {names[i]: (float(g), float(r)) for i, g, r in zip(live, goal, reached)}
    if np.max(np.abs(goal - reached) / start) > REPORTED:
        warnings.warn(f"targets that can't be met, as (target, reached) tokens: {outcome}", stacklevel=2)
    return dict(zip(live, map(float, total))), outcome


def copies(rate: Column, *key: Column | str) -> Column:
    """Whole copies whose mean is the rate: its floor, and one more where the key's hash falls below the fraction."""
    u = F.pmod(F.xxhash64(*key), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return F.floor(rate + u).cast("int")


def rates(docs: DataFrame, labelled: DataFrame, targets: dict[str, float] | None = None, anchor: str = ANCHOR) -> DataFrame:
    """One row per document: doc_id, tokens, p_<domain>..., rate, copies."""
    domains = Domains(docs, labelled)
    scored = domains.posteriors(docs.select("doc_id", text_of().alias("text")), F.col("text"))
    slim = settle(scored.select("doc_id", F.xxhash64("text").alias("th"), F.col("_tokens").alias("tokens"), F.col("_p").alias("p")), "posteriors")
    moves, _ = fit_moves(slim, domains.names, targets or TARGETS, anchor)
    fitted = slim.withColumn("rate", rate_of(moves, "p"))
    return fitted.select("doc_id", "tokens", *(F.get("p", F.lit(i)).alias(f"p_{d}") for i, d in enumerate(domains.names)), "rate", copies(F.col("rate"), "doc_id", "th").alias("copies"))


def mixed(docs: DataFrame, labelled: DataFrame, targets: dict[str, float] | None = None, anchor: str = ANCHOR) -> DataFrame:
    """The documents, each as often as its copies say, with all their columns.

    The fitted rate is a function of a document's posterior alone, so it is computed again while the documents are read,
    from the sum of the steps, and whole texts are never shuffled.
    """
    domains = Domains(docs, labelled)
    slim = settle(domains.posteriors(docs.select(text_of().alias("text")), F.col("text")).select(F.col("_tokens").alias("tokens"), F.col("_p").alias("p")), "posteriors")
    moves, _ = fit_moves(slim, domains.names, targets or TARGETS, anchor)
    text, n = "_text", "_copies"
    named = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_doc"), text_of().alias(text), F.col("doc_id").alias("_id"))
    rows = domains.posteriors(named, F.col(text))
    times = copies(rate_of(moves, "_p"), F.col("_id"), F.xxhash64(text))
    return rows.withColumn(n, times).where(F.col(n) > 0).select(F.explode(F.array_repeat("_doc", F.col(n))).alias("_doc")).select("_doc.*")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return rates(docs, domains_of(labels))


def domains_of(labels: DataFrame) -> DataFrame:
    """(doc_id, domain) of the labels table: toxic before junk before clean."""
    return labels.select("doc_id", F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "junk").when(F.col("quality") == 1, "clean").alias("domain"))


QUERIES = {"op10_mixing": op10_mixing}
SQL: dict[str, str] = {}
