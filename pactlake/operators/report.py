"""Roll-up of reports, diffs and subscriptions."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def is_baseline_run(data_path: Column) -> Column:
    """Whether a report is of clean data, by its file name."""
    name = F.element_at(F.split(data_path, "/"), -1)
    return ~(name.startswith("violated") | name.endswith("_violated.jsonl"))


def grade(score: Column) -> Column:
    return F.when(score >= 90, "A").when(score >= 80, "B").when(score >= 70, "C").when(score >= 60, "D").otherwise("F")


def health(reports: DataFrame, ai_fails: int = 0) -> DataFrame:
    """Reports (data_path, total_checks, passed, critical, high) -> one row: totals, score, grade."""
    own = reports.where(F.col("total_checks").isNotNull() & is_baseline_run(F.col("data_path")))
    s = lambda c: F.coalesce(F.sum(F.coalesce(F.col(c), F.lit(0))), F.lit(0))
    out = own.agg(s("total_checks").alias("total"), s("passed").alias("passed"), s("critical").alias("critical"), s("high").alias("high"))
    base = F.when(F.col("total") > 0, 100.0 * F.col("passed") / F.col("total")).otherwise(100.0)
    score = F.greatest(F.lit(0.0), base - 20 * F.col("critical") - 10 * F.col("high") - 5 * ai_fails).cast("int")
    return out.withColumn("score", score).withColumn("grade", grade(F.col("score")))


def totals(reports: DataFrame, changes: DataFrame) -> DataFrame:
    """One row over reports not named violated*, and changes: contracts, checks, passed, critical, high, breaking changes.

    Unlike the health score it counts reports of *_violated files, as the summary always did.
    """
    own = reports.where(F.col("total_checks").isNotNull() & ~F.element_at(F.split("data_path", "/"), -1).startswith("violated"))
    s = lambda c: F.coalesce(F.sum(F.coalesce(F.col(c), F.lit(0))), F.lit(0)).alias(c)
    breaking = changes.agg(F.count_if(F.col("classification").isin("BREAKING", "CRITICAL"))).scalar()
    return own.agg(F.count_distinct("contract_id").alias("contracts"), *map(s, ("total_checks", "passed", "critical", "high"))).withColumn("breaking", breaking)


def last_reports(reports: DataFrame, key: str = "contract_id", order: str = "file_name") -> DataFrame:
    """The last report of each contract by file name."""
    return reports.withColumn("r", F.row_number().over(Window.partitionBy(key).orderBy(F.col(order).desc()))).where("r = 1").drop("r")


def contract_table(reports: DataFrame, diffs: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """One row per contract that has a report or a diff, with its subscribers by tier and mode."""
    subs = subscriptions.groupBy("contract_id").agg(F.count_if(F.col("tier") < 3).alias("direct"), F.count_if(F.col("tier") == 3).alias("notified"), F.count_if(F.col("validation_mode") == "ENFORCE").alias("enforcing"))
    joined = last_reports(reports).select("contract_id", "total_checks", "passed", "critical", "high").join(diffs.select("contract_id", "verdict"), "contract_id", "full").join(subs, "contract_id", "left")
    dash = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("—")).alias(c)
    return joined.select("contract_id", *(dash(c) for c in ("total_checks", "passed", "critical", "high", "verdict")), *(F.coalesce(c, F.lit(0)).alias(c) for c in ("direct", "notified", "enforcing")))


def recommendations(results: DataFrame, diffs: DataFrame, subscriptions: DataFrame, ai: DataFrame, most: int = 3) -> DataFrame:
    """The most urgent actions (a top-k report).

    results (contract_id, column_name, check_type, status), diffs (contract_id, field, change_type, classification),
    subscriptions (contract_id, validation_mode), ai (check_name, status, trend).
    """
    pick = lambda df, priority, text, *order: df.select(F.lit(priority).alias("priority"), F.concat_ws(":", *order).alias("seq"), text.alias("action"))
    say = F.format_string
    parts = [
        pick(results.where("status = 'HIGH' AND check_type = 'range'"), 1, say("'%s': values of '%s' left their range; look for a change of scale.", "contract_id", "column_name"), F.lit("a"), "contract_id", "column_name"),
        pick(results.where("status = 'CRITICAL'"), 1, say("'%s': '%s' breaks the contract; repair its producer first.", "contract_id", "column_name"), F.lit("b"), "contract_id", "column_name"),
        pick(diffs.where("classification = 'BREAKING'").groupBy("contract_id").agg(F.array_join(F.array_sort(F.collect_set("field")), ", ").alias("fields")), 2, say("'%s': release a new version, as %s changed incompatibly.", "contract_id", "fields"), F.lit("c"), "contract_id"),
        pick(subscriptions.where("validation_mode = 'ENFORCE'").agg(F.array_join(F.array_sort(F.collect_set("contract_id")), ", ").alias("ids"), F.count("*").alias("n")).where("n > 0"), 3, say("Gate production on these contracts: %s.", "ids"), F.lit("d")),
        pick(ai.where("check_name = 'embedding_drift' AND status = 'WARN'"), 3, F.lit("Investigate text drift."), F.lit("e")),
        pick(ai.where("check_name = 'output_rate' AND (status = 'WARN' OR trend = 'rising')"), 2, F.lit("Review recent prompt changes: output violations rise."), F.lit("f")),
    ]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.orderBy("priority", "seq").limit(most).select("priority", "action")


def issues(results: DataFrame, diffs: DataFrame, ai: DataFrame, most: int = 2) -> DataFrame:
    """What a narrator should know (seq, said): the first few critical and high results and incompatible contracts (a top-k report), and warnings of drift and rates.

    results, diffs and ai are as in recommendations; results have records_failing, too.
    """
    say = F.format_string
    failing = lambda level: results.where(F.col("status") == level).select("contract_id", "column_name", "check_type", "records_failing").distinct().orderBy("contract_id", "column_name", "check_type", "records_failing").limit(most)
    told = lambda level: failing(level).select(F.concat_ws(":", F.lit("a" if level == "CRITICAL" else "b"), "contract_id", "column_name", "check_type").alias("seq"), say(f"{level}: %s of %s.%s fails for %d records", "check_type", "contract_id", "column_name", "records_failing").alias("said"))
    broken = diffs.where("classification = 'BREAKING'").groupBy("contract_id").agg(F.count("*").alias("n")).orderBy("contract_id").limit(most)
    parts = [told("CRITICAL"), told("HIGH"), broken.select(F.concat(F.lit("c:"), "contract_id").alias("seq"), say("BREAKING: %d changes of %s", "n", "contract_id").alias("said"))]
    for seq, check, text in (("d", "embedding_drift", "WARN: texts drift"), ("e", "output_rate", "WARN: too many outputs violate their schema")):
        parts.append(ai.where((F.col("check_name") == check) & (F.col("status") == "WARN")).select(F.lit(seq).alias("seq"), F.lit(text).alias("said")))
    return functools.reduce(DataFrame.unionByName, parts)


def violation_text(results: DataFrame, blast: DataFrame) -> DataFrame:
    """Failing results in plain words, with the first three subscribers that they reach, and their pipelines.

    What is gathered is bounded by the registry.
    """
    who = blast.groupBy("contract_id", F.col("field").alias("column_name")).agg(F.slice(F.array_sort(F.collect_set("subscriber_id")), 1, 3).alias("who"))
    joined = results.where("status NOT IN ('PASS')").join(who, ["contract_id", "column_name"], "left")
    lines = F.array_join(F.transform("who", lambda w: F.concat(w, F.lit("-pipeline"))), ", ")
    reach = F.when(F.size("who") > 0, F.concat(F.lit(" It reaches "), F.array_join("who", ", "), F.lit(" by way of "), lines, F.lit("."))).otherwise(" No registered subscriber is affected.")
    return joined.select("contract_id", "column_name", F.concat(F.format_string("The %s check of '%s' failed for %d records (%s).", "check_type", "column_name", "records_failing", "severity"), reach).alias("said"))
