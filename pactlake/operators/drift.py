"""Baselines of numeric columns: a table keyed by contract and column."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pactlake.contract import STATISTICS
from pactlake.operators.checks import drift_status, z_score


def upsert(old: DataFrame, new: DataFrame, refresh: bool = False) -> DataFrame:
    """Merged baselines (contract_id, column, statistics): known ones stay unless refreshed, new ones are added."""
    key = ["contract_id", "column"]
    values = [c for c in STATISTICS if c in old.columns and c in new.columns]
    o, n = old.select(*key, F.struct(*values).alias("o")), new.select(*key, F.struct(*values).alias("n"))
    chosen = F.coalesce("n", "o") if refresh else F.coalesce("o", "n")
    return o.join(n, key, "full").select(*key, chosen.alias("v")).select(*key, *(f"v.{c}" for c in values))


def drift(current: DataFrame, baselines: DataFrame) -> DataFrame:
    """column, mean, stddev against a baseline table by column: z_score and status; a column without one passes."""
    joined = current.join(baselines.select("column", F.col("mean").alias("base_mean"), F.col("stddev").alias("base_stddev")), "column", "left")
    z = z_score(F.col("mean"), F.col("base_mean"), F.col("base_stddev"))
    return joined.select("column", "mean", "base_mean", z.alias("z_score"), F.when(F.col("base_mean").isNull(), "PASS").otherwise(drift_status(z)).alias("status"), F.col("base_mean").isNull().alias("first_run"))
