"""Commits ranked as causes of a violation, and violation entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pactlake.functions.scalar import keyword_hits
from pactlake.operators.registry import bare

#: Words that make a commit message suspicious.
KEYWORDS = ["confidence", "scale", "percent", "0-100", "0.0", "1.0", "type", "rename", "change", "fix", "update", "schema", "event_type", "enum", "format"]


def confidence(days: Column, hops: Column) -> Column:
    """1 less a tenth a day and two tenths a hop, within 0 and 1; an unknown age counts as 30 days."""
    raw = F.lit(1.0) - F.coalesce(days.cast("double"), F.lit(30.0)) * 0.1 - hops * 0.2
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw)), 3)


def rank_commits(commits: DataFrame, now: Column, most: int = 5) -> DataFrame:
    """Commits (commit_hash, message, ts, depth, seq) -> the first few by keyword hits, then confidence, each hash once."""
    days = F.datediff(now, F.col("ts"))
    rows = commits.withColumn("hits", keyword_hits(F.col("message"), KEYWORDS)).withColumn("confidence_score", confidence(days, F.col("depth")))
    order = [F.col("hits").desc(), F.col("confidence_score").desc(), F.col("seq")]
    once = rows.withColumn("r", F.row_number().over(Window.partitionBy("commit_hash").orderBy(*order))).where("r = 1")
    top = once.orderBy(*order).limit(most)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order))).drop("r")


CHAIN_DDL = "rank int, file_path string, commit_hash string, author string, commit_timestamp string, commit_message string, confidence_score double, note string"


def blame_chain(ranked: DataFrame, tier: int | None, has_root: bool, fallback: DataFrame | None = None) -> DataFrame:
    """The ranked commits, else those of the fallback, or the note that stands for them: far tiers, no code at hand, or no commits."""
    spark = ranked.sparkSession
    note = lambda text: spark.createDataFrame([(1, None, None, None, None, None, 0.0, text)], CHAIN_DDL)
    if tier is not None and tier >= 3:
        return note("Only notified: the first affected subscriber is of tier 3.")
    if not has_root:
        return note("The code that writes this data is not at hand, so there are no commits to rank.")
    named = {"file_path": "file_path", "commit_hash": "commit_hash", "author": "email", "commit_timestamp": "ts", "commit_message": "message", "confidence_score": "confidence_score"}
    for rows in (ranked, fallback):
        if rows is not None and rows.limit(1).count():
            cells = ((F.col(c) if c in rows.columns else F.lit(None)).cast("double" if n == "confidence_score" else "string").alias(n) for n, c in named.items())
            return rows.select("rank", *cells, F.lit(None).cast("string").alias("note"))
    return note("No commits in the period.")


def violations(results: DataFrame, blast: DataFrame, subscriptions: DataFrame, depths: DataFrame, labels: DataFrame, chain: DataFrame, far: DataFrame, source_path: str, most: int = 5) -> DataFrame:
    """Non-passing results (check_order, contract_id, check_id, column_name, ...), the first few, as log entries.

    blast (contract_id, field, subscriber_id); subscriptions with `place`, their order in the registry; depths (node_id, depth);
    labels (node_id, label); chain for checks whose first affected subscriber is near, far for the others. What is gathered is
    bounded: commits by the ranking, subscribers by the registry.
    """
    failing = results.where("status <> 'PASS'").orderBy("check_order").limit(most)
    known = blast.select("contract_id", "field", "subscriber_id").distinct().join(subscriptions, ["contract_id", "subscriber_id"])
    known = known.join(labels.withColumnRenamed("node_id", "subscriber_id"), "subscriber_id", "left").join(depths.withColumnRenamed("node_id", "subscriber_id"), "subscriber_id", "left")
    names = F.transform("breaking_fields", lambda b: b["field"])
    node = F.struct(
        "place",
        F.col("subscriber_id").alias("node_id"),
        F.coalesce("label", "subscriber_id").alias("label"),
        F.coalesce("tier", F.lit(1)).alias("tier"),
        "fields_consumed",
        F.filter(names, lambda f: F.contains(f, bare(F.col("field"))) | F.contains(f, F.col("field"))).alias("matched_breaking_fields"),
        F.coalesce("contact", F.lit("")).alias("contact"),
        F.coalesce("validation_mode", F.lit("AUDIT")).alias("validation_mode"),
        F.coalesce("depth", F.lit(1)).alias("contamination_depth"),
    )
    hit = known.groupBy("contract_id", F.col("field").alias("column_name")).agg(F.array_sort(F.collect_list(node)).alias("nodes"))
    ranks = lambda c: c.agg(F.array_sort(F.collect_list(F.struct(*(x.split()[0] for x in CHAIN_DDL.split(", "))))).alias("c")).scalar()
    rows = failing.join(hit, ["contract_id", "column_name"], "left").withColumn("nodes", F.coalesce("nodes", F.filter(F.array(F.lit(None).cast(hit.schema["nodes"].dataType.elementType)), lambda x: x.isNotNull())))
    return rows.select(
        F.expr("uuid()").alias("violation_id"),
        "check_id",
        "contract_id",
        F.lit(source_path).alias("source_path"),
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX").alias("detected_at"),
        F.col("status").alias("severity"),
        F.struct("column_name", "check_type", "actual_value", "expected", "message", "records_failing").alias("failing_check"),
        F.when(F.get("nodes", F.lit(0))["tier"] >= 3, ranks(far)).otherwise(ranks(chain)).alias("blame_chain"),
        F.struct(
            F.transform("nodes", lambda n: n.dropFields("place")).alias("affected_nodes"),
            F.array_distinct(F.transform("nodes", lambda n: F.concat(n["node_id"], F.lit("-pipeline")))).alias("affected_pipelines"),
            F.col("records_failing").alias("estimated_records"),
            F.coalesce(F.array_max(F.transform("nodes", lambda n: n["contamination_depth"])), F.lit(0)).alias("max_contamination_depth"),
        ).alias("blast_radius"),
    )
