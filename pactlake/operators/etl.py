"""Raw exports to canonical records, and faults for tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pactlake.functions.scalar import clamp01, completion_tokens, is_uuid, iso_from_postgres, lookup, prompt_tokens, semver, token_cost, uuid5

#: Canonical node types by kind, and relationships.
NODE_TYPES = {
    "transformation": "MODEL",
    "dataset": "TABLE",
    "table": "TABLE",
    "view": "TABLE",
    "model": "MODEL",
    "file": "FILE",
    "service": "SERVICE",
    "pipeline": "PIPELINE",
    "external": "EXTERNAL",
    "__unresolved__": "EXTERNAL",
}
RELATIONSHIPS = {r: r for r in ("CONSUMES", "PRODUCES", "IMPORTS", "CALLS", "READS", "WRITES")}


def _fact(key: Column, n: Column, i: Column, confidence: Column) -> dict[str, Column]:
    """Fields of the i-th of n facts; a single one has no page."""
    return {
        "fact_id": uuid5(F.concat_ws(":", key.cast("string"), i.cast("string"))),
        "text": F.format_string("Fact %d of %s", i, key.cast("string")),
        "confidence": clamp01(confidence),
        "page_ref": F.when(n > 1, (i + 1).cast("long")),
    }


def _facts_of(blocks: Column) -> Column:
    return F.greatest(F.coalesce(blocks, F.lit(1)), F.lit(1)).cast("int")


def facts(key: Column, blocks: Column, confidence: Column) -> Column:
    """max(blocks, 1) facts as an array of structs."""
    n = _facts_of(blocks)
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(*(c.alias(k) for k, c in _fact(key, n, i, confidence).items())))


def fact_rows(df: DataFrame, key: Column, blocks: Column, confidence: Column, *keep: str) -> DataFrame:
    """Columns to keep and the fields of facts, a row a fact. Fields that aren't read are not made, as in an array of structs they are."""
    told = df.select(*keep, key.alias("_key"), _facts_of(blocks).alias("_n"), confidence.alias("_confidence"))
    each = told.select("*", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("_i"))
    return each.select(*keep, *(c.alias(k) for k, c in _fact(F.col("_key"), F.col("_n"), F.col("_i"), F.col("_confidence")).items()))


def extractions(ledger: DataFrame, models: dict[str, str], tokens_per_block: dict[str, int], base_time: str = "2026-04-01 00:00:00") -> DataFrame:
    """A ledger (doc_id, strategy_used, confidence, block_count, processing_time, index) -> canonical extraction records."""
    key = F.concat_ws(":", "doc_id", F.col("index").cast("string"))
    blocks = F.greatest(F.coalesce("block_count", F.lit(1)), F.lit(1))
    per = lookup({k: str(v) for k, v in tokens_per_block.items()}, F.col("strategy_used"), "100").cast("long")
    seconds = F.coalesce("processing_time", F.lit(0.0)) + 5 * F.col("index")
    return ledger.select(
        uuid5(F.col("doc_id")).alias("doc_id"),
        F.col("doc_id").alias("source_path"),
        F.sha2("doc_id", 256).alias("source_hash"),
        facts(key, F.col("block_count"), F.col("confidence")).alias("extracted_facts"),
        F.array().cast("array<string>").alias("entities"),
        lookup(models, F.col("strategy_used"), "unknown").alias("extraction_model"),
        F.floor(F.coalesce("processing_time", F.lit(0.0)) * 1000).cast("long").alias("processing_time_ms"),
        F.struct((blocks * per).alias("input"), F.ceil(blocks * per * 0.15).cast("long").alias("output")).alias("token_count"),
        F.date_format(F.lit(base_time).cast("timestamp") + F.make_dt_interval(secs=seconds.cast("decimal(18,6)")), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("extracted_at"),
        F.struct(F.col("doc_id").alias("original_doc_id"), "strategy_used", "block_count").alias("_migration_meta"),
    )


def with_criteria(dimensions: DataFrame, criteria: DataFrame) -> DataFrame:
    """Rubric dimensions (run_id, dimension_id, ...) with the final_score and remediation (200 characters) of their criterion, if any."""
    found = criteria.select("run_id", "dimension_id", "final_score", F.substring("remediation", 1, 200).alias("remediation"))
    return dimensions.join(found, ["run_id", "dimension_id"], "left").withColumn("remediation", F.coalesce("remediation", F.lit("")))


def remapped(before: Column, after: Column) -> Column:
    """Aggregate: how many distinct keys a mapping changes."""
    return F.count_distinct(F.when(before != after, before))


def nodes(raw: DataFrame) -> DataFrame:
    """Raw nodes (id, label) -> node_id, type by the kind before the colon, label from label, file name or id."""
    kind = F.split_part("id", F.lit(":"), F.lit(1))
    base = F.regexp_extract("id", r"([^/:]+)(?::\d+)?$", 1)
    return raw.select(F.col("id").alias("node_id"), lookup(NODE_TYPES, F.lower(kind), "EXTERNAL").alias("type"), F.coalesce(F.nullif("label", F.lit("")), F.nullif(base, F.lit("")), "id").alias("label"))


def edges(raw: DataFrame) -> DataFrame:
    return raw.select("source", "target", lookup(RELATIONSHIPS, F.upper("type"), "PRODUCES").alias("relationship"), F.lit(1.0).alias("confidence"))


def codebase_root(paths: DataFrame, column: str) -> DataFrame:
    """One row: the longest common path prefix, from the least and the greatest path."""
    from pactlake.functions.scalar import common_prefix

    return paths.agg(common_prefix(F.min(column), F.max(column)).alias("codebase_root"))


def events(raw: DataFrame) -> DataFrame:
    """Events with ids as UUIDs (kept if they are), ISO times and three-part versions."""
    as_uuid = lambda c: F.when(is_uuid(F.col(c)), F.col(c)).otherwise(uuid5(F.col(c)))
    times = {c: iso_from_postgres(F.col(c)) for c in ("occurred_at", "recorded_at") if c in raw.columns}
    return raw.withColumns({"event_id": as_uuid("event_id"), "aggregate_id": as_uuid("aggregate_id"), "schema_version": semver(F.col("schema_version")), **times})


def running_starts(df: DataFrame, order: str, step: str, *keys: str) -> DataFrame:
    """df with `starts_at`, the sum of the steps before each row."""
    window = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("starts_at", F.coalesce(F.sum(step).over(window), F.lit(0)))


def usage(chars: Column) -> dict[str, Column]:
    p = prompt_tokens(chars)
    c = completion_tokens(p)
    return {"prompt_tokens": p, "completion_tokens": c, "total_tokens": p + c, "total_cost": token_cost(p, c)}


def trace_runs(roots: DataFrame, dimensions: int = 10, tools: int = 23, llms: int = 30) -> DataFrame:
    """A root run (run_id) each -> it, and its dimension, tool and llm runs, with start and end seconds by a running cursor."""
    kinds = F.concat(
        F.array(F.struct(F.lit("root").alias("kind"), F.lit(0).alias("i"), F.lit("chain").alias("run_type"))),
        *(_runs(k, t, n) for k, t, n in (("dimension", "chain", dimensions), ("tool", "tool", tools), ("llm", "llm", llms))),
    )
    rows = roots.select("run_id", F.posexplode(kinds).alias("seq", "r")).select("run_id", "seq", "r.*")
    rows = rows.withColumn("seconds", F.when(F.col("run_type") == "llm", 3).when(F.col("run_type") == "tool", 1).otherwise(2))
    timed = running_starts(rows, "seq", "seconds", "run_id")
    return timed.select(uuid5(F.concat_ws(":", "run_id", "seq")).alias("id"), "run_id", "kind", "run_type", F.col("starts_at").alias("start_s"), (F.col("starts_at") + F.col("seconds")).alias("end_s"))


def _runs(kind: str, run_type: str, n: int) -> Column:
    return F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.struct(F.lit(kind).alias("kind"), i.alias("i"), F.lit(run_type).alias("run_type")))


def inject_scale(df: DataFrame, array: str, field: str, factor: float = 100.0) -> DataFrame:
    """A field of an array's structs times a factor; nulls stay."""
    return df.withColumn(array, F.transform(array, lambda f: f.withField(field, F.round(f[field] * factor, 4)))).withColumn("_injected", F.lit(f"{array}.{field} x {factor:g}"))


def inject_enum(df: DataFrame, column: str, order: str, value: str, first: int = 50) -> DataFrame:
    """The first rows by an order get an invalid value; the original is kept. The bound is found by a top-k, not a full sort."""
    last = df.select(order).orderBy(order).limit(first).agg(F.max(order)).scalar()
    hit = F.col(order) <= last
    return df.withColumn(f"_original_{column}", F.when(hit, F.col(column))).withColumn(column, F.when(hit, value).otherwise(F.col(column)))


def must_hold(df: DataFrame, **rules: Column) -> DataFrame:
    """df whose rows are checked while they are read; the first row that breaks a rule fails the job with its name."""
    for name, rule in rules.items():
        df = df.where(F.coalesce(F.assert_true(rule, F.lit(name)).isNull(), F.lit(True)))
    return df
