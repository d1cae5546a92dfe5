"""Prompt inputs and model outputs: schema checks, quarantine, violation rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pactlake.functions.scalar import is_uuid, two_digits

#: Verdicts that are allowed, the rate from which outputs warn, and the growth that counts as rising.
VERDICTS, WARN_RATE, RISING = ("PASS", "FAIL", "WARN"), 0.02, 1.5
SEVERITY = {"PASS": "LOW", "SKIP": "LOW", "WARN": "MEDIUM", "FAIL": "HIGH"}


def prompt_issues(doc_id: Column, source_path: Column, preview: Column) -> Column:
    """What is wrong with a prompt input, as an array of texts."""
    missing = lambda c, name: F.when(c.isNull(), F.lit(f"missing required field '{name}'"))
    short = lambda c, name, n: F.when(F.length(c) < n, F.format_string(f"'{name}' too short (len=%d, min={n})", F.length(c)))
    long = lambda c, name, n: F.when(F.length(c) > n, F.format_string(f"'{name}' too long (len=%d, max={n})", F.length(c)))
    return F.array_compact(
        F.array(
            missing(doc_id, "doc_id"),
            short(doc_id, "doc_id", 36),
            long(doc_id, "doc_id", 36),
            F.when(~is_uuid(doc_id), F.concat(F.lit("'doc_id' is not a valid UUID v4: "), F.substring(doc_id, 1, 40))),
            missing(source_path, "source_path"),
            short(source_path, "source_path", 1),
            missing(preview, "content_preview"),
            long(preview, "content_preview", 8000),
        )
    )


def with_issues(df: DataFrame, doc_id: str, source_path: str, preview: str) -> DataFrame:
    return df.withColumn("issues", prompt_issues(F.col(doc_id), F.col(source_path), F.col(preview)))


def quarantine(checked: DataFrame) -> DataFrame:
    """Records with issues, with the reason; they are routed by predicate, so good ones go on unshuffled."""
    return checked.where(F.size("issues") > 0).withColumn("_quarantine_reason", F.array_join("issues", "; ")).drop("issues")


def prompt_status(checked: DataFrame) -> DataFrame:
    """One row: records, violations, rate, status (SKIP without records, PASS without violations, WARN below a tenth, else FAIL)."""
    out = checked.agg(F.count("*").alias("records"), F.count_if(F.size("issues") > 0).alias("violations"))
    rate = F.coalesce(F.try_divide("violations", "records"), F.lit(0.0))
    return out.withColumn("rate", F.round(rate, 4)).withColumn("status", F.when(F.col("records") == 0, "SKIP").when(F.col("violations") == 0, "PASS").when(rate < 0.1, "WARN").otherwise("FAIL"))


def output_rate(verdicts: DataFrame, column: str = "overall_verdict", baseline: float | None = None) -> DataFrame:
    """One row: outputs, violations (null counts as one), rate, status (SKIP without outputs), trend."""
    bad = F.col(column).isNull() | ~F.col(column).isin(*VERDICTS)
    out = verdicts.agg(F.count("*").alias("outputs"), F.count_if(bad).alias("violations"))
    rate = F.coalesce(F.try_divide("violations", "outputs"), F.lit(0.0))
    trend = F.lit("unknown") if baseline is None else F.when(rate > RISING * baseline, "rising").otherwise("stable")
    none = F.col("outputs") == 0
    return out.withColumn("rate", F.round(rate, 4)).withColumn("status", F.when(none, "SKIP").when(rate > WARN_RATE, "WARN").otherwise("PASS")).withColumn("trend", F.when(none, "unknown").otherwise(trend))


def verdict_of_score(score: Column) -> Column:
    """PASS from a score of 3, else FAIL; what is not a number has no verdict."""
    number = score.try_cast("double")
    return F.when(number >= 3, "PASS").when(number.isNotNull(), "FAIL")


def trace_verdicts(runs: DataFrame) -> DataFrame:
    """Runs (id, run_type, outputs: JSON) -> (run_id, overall_verdict) of the model runs whose outputs have a score, null or not."""
    scored = runs.where((F.col("run_type") == "llm") & F.array_contains(F.json_object_keys("outputs"), "score"))
    return scored.select(F.col("id").alias("run_id"), verdict_of_score(F.get_json_object("outputs", "$.score")).alias("overall_verdict"))


def severity(status: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for p in SEVERITY.items() for x in p)), status), F.lit("LOW"))


def status_line(check: Column, status: Column, rate: Column) -> Column:
    """An outcome in plain words."""
    said = F.when(status == "PASS", "holds").when(status == "SKIP", "was skipped").when(status == "WARN", "needs a look").otherwise("fails")
    return F.concat(check, F.lit(" "), said, F.coalesce(F.when(rate.isNotNull(), F.concat(F.lit(" ("), two_digits(rate * 100), F.lit("%)"))), F.lit("")), F.lit("."))
