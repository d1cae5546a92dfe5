"""Baselines as mergeable state: counts, moments, a quantile sketch and a distinct-count sketch for each column of a contract.

A run's state is one row a column, whatever the data's size. States of later runs, other files or other periods merge into
one without reading old data, and a profile is read off the merged state: counts, mean, deviation, least and greatest value are
exact, quantiles are within RANK_ERROR of their rank and distinct counts within about DISTINCT_ERROR of the truth.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pactlake.operators.profile import QUANTILES, SKETCH, _present, numeric_columns

#: Size of a quantile sketch; its error of a rank (99 % sure), and two standard errors of a distinct count.
KLL_SIZE, RANK_ERROR, DISTINCT_ERROR = 400, 0.01, 0.02
STATE_DDL = "contract_id string, column string, n long, missing long, mean double, m2 double, min double, max double, quantiles binary, distinct binary"


def state(df: DataFrame, contract_id: str, columns: list[str] | None = None) -> DataFrame:
    """One row of state for each numeric column, from one aggregation."""
    columns = columns or numeric_columns(df)
    parts = []
    for i, c in enumerate(columns):
        v = _present(df, c).cast("double")
        parts += [F.count(v).alias(f"n{i}"), F.count_if(v.isNull()).alias(f"z{i}"), F.avg(v).alias(f"a{i}"), (F.var_pop(v) * F.count(v)).alias(f"q{i}"), F.min(v).alias(f"l{i}"), F.max(v).alias(f"h{i}")]
        parts += [F.kll_sketch_agg_double(v, KLL_SIZE).alias(f"k{i}"), F.hll_sketch_agg(v.cast("string"), SKETCH).alias(f"d{i}")]
    names = ["n", "missing", "mean", "m2", "min", "max", "quantiles", "distinct"]
    cells = F.array(*(F.struct(F.lit(contract_id).alias("contract_id"), F.lit(c).alias("column"), *(F.col(f"{k}{i}").alias(name) for k, name in zip("nzaqlhkd", names))) for i, c in enumerate(columns)))
    return df.agg(*parts).select(F.explode(cells).alias("r")).select("r.*")


def merged(*states: DataFrame) -> DataFrame:
    """One row a contract and column over all states. Columns without values don't count."""
    every = reduce(DataFrame.unionByName, states)
    n = F.sum("n")
    mean = F.try_divide(F.sum(F.col("n") * F.col("mean")), n)
    some = F.col("n") > 0
    out = every.groupBy("contract_id", "column").agg(
        n.alias("n"),
        F.sum("missing").alias("missing"),
        mean.alias("mean"),
        F.greatest(F.lit(0.0), F.sum("m2") + F.sum(F.col("n") * F.col("mean") * F.col("mean")) - n * mean * mean).alias("m2"),
        F.min("min").alias("min"),
        F.max("max").alias("max"),
        F.kll_merge_agg_double(F.when(some, F.col("quantiles"))).alias("quantiles"),
        F.hll_union_agg(F.when(some, F.col("distinct"))).alias("distinct"),
    )
    return out


def profile_of(states: DataFrame) -> DataFrame:
    """States -> contract_id, column, n, null_fraction, cardinality and the statistics of a profile."""
    held = F.when(F.col("n") > 0, F.col("quantiles"))
    return states.select(
        "contract_id",
        "column",
        "n",
        F.try_divide("missing", F.col("n") + F.col("missing")).alias("null_fraction"),
        F.coalesce(F.hll_sketch_estimate("distinct"), F.lit(0).cast("long")).alias("cardinality"),
        "mean",
        F.when(F.col("n") > 1, F.sqrt(F.col("m2") / (F.col("n") - 1))).when(F.col("n") == 1, 0.0).alias("stddev"),
        "min",
        "max",
        *(F.kll_sketch_get_quantile_double(held, F.lit(q)).alias(p) for p, q in QUANTILES.items()),
    )
