"""Consumers of contracts: subscriptions joined with changed or failing fields.

A registry is small beside data, and is broadcast by Spark itself when it is; every join has an equality on the contract, and
names that contain others are found by q-grams.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pactlake.operators.substrings import contains_join

#: Fixed value: the text of a risk that a subscriber hasn't declared.
UNVERIFIED = "Field '%s' is consumed but not declared in breaking_fields — unverified risk."
PREFIX = r"^(fact|node|edge|event|item)_"


def breaking_rows(subscriptions: DataFrame) -> DataFrame:
    """Subscriptions with one row per breaking field and its place: position, breaking_field, reason."""
    keep = [c for c in subscriptions.columns if c not in ("breaking_fields",)]
    rows = subscriptions.select(*keep, F.posexplode("breaking_fields").alias("position", "b"))
    return rows.select(*keep, "position", F.col("b.field").alias("breaking_field"), F.col("b.reason").alias("reason"))


def _related(changed: Column, breaking: Column) -> Column:
    return (changed == breaking) | F.startswith(changed, F.concat(breaking, F.lit("."))) | F.startswith(breaking, F.concat(changed, F.lit(".")))


def consumer_impact(changes: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """Changes (contract_id, field) x subscriptions -> who is hit, by the first matching breaking field, else as unverified risk.

    Only a declared breaking field blocks, and only where the subscriber enforces. Further columns of the subscriptions (tier,
    contact) are carried along.
    """
    told = [c for c in subscriptions.columns if c not in ("contract_id", "subscriber_id", "breaking_fields", "fields_consumed")]
    rows = breaking_rows(subscriptions).drop("fields_consumed")
    hit = changes.join(rows, "contract_id").where(_related(F.col("field"), F.col("breaking_field")))
    first = hit.withColumn("r", F.row_number().over(Window.partitionBy("contract_id", "field", "subscriber_id").orderBy("position"))).where("r = 1")
    keys = ["contract_id", "field", "subscriber_id"]
    blocks = F.coalesce(F.col("validation_mode") == "ENFORCE", F.lit(False))
    declared = first.select(*keys, *told, "breaking_field", F.lit("declared").alias("risk"), F.coalesce("reason", F.lit("")).alias("failure_mechanism"), blocks.alias("will_block_pipeline"))
    used = changes.join(subscriptions, "contract_id").where(F.array_contains("fields_consumed", F.col("field"))).join(declared.select(*keys), keys, "left_anti")
    said = F.format_string(UNVERIFIED, "field")
    rest = used.select(*keys, *told, F.lit(None).cast("string").alias("breaking_field"), F.lit("unverified").alias("risk"), said.alias("failure_mechanism"), F.lit(False).alias("will_block_pipeline"))
    return declared.unionByName(rest)


def bare(field: Column) -> Column:
    """A flat column's name without the prefix of its array."""
    return F.regexp_replace(field, PREFIX, "")


def blast_radius(failing: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """Failing fields (contract_id, field) -> subscribers with a breaking field that contains the name, bare or not.

    What contains the whole name contains the bare one, so that alone is looked up, by its q-grams.
    """
    rows = breaking_rows(subscriptions)
    hit = contains_join(failing.withColumn("_bare", bare(F.col("field"))), rows, "_bare", "breaking_field", ("contract_id",))
    first = hit.withColumn("r", F.row_number().over(Window.partitionBy("contract_id", "field", "subscriber_id").orderBy("position"))).where("r = 1")
    return first.select("contract_id", "field", "subscriber_id", "tier", "breaking_field")
