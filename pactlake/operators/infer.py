"""Contract inference: profile rows to clauses, warnings, tests and baselines, as expressions over the profile."""

from __future__ import annotations

import re
from dataclasses import replace
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pactlake.contract import CONTRACT_TYPE, STATISTICS, UUID_PATTERN, Clause, Contract

#: A string column with so many distinct values at most gets an enum (samples hold five values).
MAX_ENUM = 5
#: Column names in which negative numbers are not expected.
NONNEGATIVE_HINTS = ("confidence", "time_ms", "count", "rate", "score", "tokens", "cost")


def dtype_column(dtype: Column, has_nulls: Column) -> Column:
    """The inferred dtype of a Spark type name, as contract.inferred_dtype has it for schemas."""
    whole = dtype.isin("tinyint", "smallint", "int", "bigint")
    return F.when(dtype == "boolean", F.when(has_nulls, "object").otherwise("bool")).when(whole, F.when(has_nulls, "float64").otherwise("int64")).when(dtype.isin("float", "double"), "float64").otherwise("object")


def clause_rows(profile: DataFrame, uuid_strings_only: bool = False, max_enum: int = MAX_ENUM) -> DataFrame:
    """Profile rows -> column, type, required, format, pattern, minimum, maximum, enum, and the statistics."""
    name = F.lower("column")
    kind = F.element_at(F.create_map(*(F.lit(x) for p in CONTRACT_TYPE.items() for x in p)), dtype_column(F.col("dtype"), F.col("null_fraction") > 0))
    is_id, is_at = F.col("column").endswith("_id"), F.col("column").endswith("_at") | F.col("dtype").isin("timestamp", "timestamp_ntz", "date")
    rows = profile.withColumn("type", kind).withColumn("required", F.col("null_fraction") == 0)
    uuid = is_id & (F.col("type") == "string") if uuid_strings_only else is_id
    numeric = F.col("type").isin("number", "integer")
    confident = F.contains(name, F.lit("confidence")) & (F.col("type") == "number")
    enum = (F.col("type") == "string") & ~is_id & ~is_at & F.col("cardinality").between(1, max_enum)
    return rows.select(
        "column",
        "type",
        "required",
        F.when(uuid, "uuid").when(is_at, "date-time").alias("format"),
        F.when(uuid, UUID_PATTERN).alias("pattern"),
        F.when(confident, 0.0).when(numeric & (F.col("min") >= 0), 0.0).alias("minimum"),
        F.when(confident, 1.0).alias("maximum"),
        F.when(enum, F.array_sort("sample_values")).alias("enum"),
        *(F.round(s, 6).alias(s) for s in STATISTICS),
    )


def warnings(numbers: DataFrame) -> DataFrame:
    """Numeric profile rows (with cardinality) -> column, code, severity of what looks wrong with a distribution."""
    rule = lambda when, code, severity="WARN": F.when(when, F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity")))
    hinted = F.lower("column").rlike("|".join(map(re.escape, NONNEGATIVE_HINTS)))
    found = F.array_compact(
        F.array(
            rule((F.col("max") <= 1) & (F.col("mean") > 0.99), "near_constant_high"),
            rule((F.col("max") <= 1) & (F.col("mean") < 0.01), "near_constant_low"),
            rule((F.col("stddev") < 0.001) & (F.col("cardinality") > 5), "low_variance"),
            rule((F.col("p50") > 0) & (F.col("p99") > 10 * F.col("p50")), "extreme_skew"),
            rule((F.col("min") < 0) & hinted, "unexpected_negatives", "HIGH"),
        )
    )
    return numbers.select("column", F.explode(found).alias("w")).select("column", "w.code", "w.severity")


def dbt_tests(clauses: DataFrame) -> DataFrame:
    """Clause rows -> column, test: not_null, accepted_values, unique."""
    tests = F.array_compact(F.array(F.when(F.col("required"), "not_null"), F.when(F.col("enum").isNotNull(), "accepted_values"), F.when(F.col("format") == "uuid", "unique")))
    return clauses.select("column", F.explode(tests).alias("test"))


def soda_checks(clauses: DataFrame) -> DataFrame:
    """Clause rows -> check texts: no missing values for required columns, no duplicates for required ids."""
    said = F.array_compact(F.array(F.when(F.col("required"), F.format_string("missing_count(%s) = 0", "column")), F.when((F.col("format") == "uuid") & F.col("required"), F.format_string("duplicate_count(%s) = 0", "column"))))
    return clauses.select("column", F.explode(said).alias("check"))


#: Fixed value: what looks like a number once a point and leading minus signs are left out.
LOOKS_NUMERIC = r"^(?:-*\d+\.?\d*|-*\.\d+|\.-+\d+)$"


def mixed_types(df: DataFrame, columns: list[str], first: int = 20) -> DataFrame:
    """column, numeric, seen: string columns of whose first values in the data's order some, but not all, look like numbers.

    Each task hands on its first values of a column only.
    """
    from pactlake.operators.profile import unpivot

    if not columns:
        return df.sparkSession.createDataFrame([], "column string, numeric long, seen long")
    placed = df.withColumn("_at", F.monotonically_increasing_id())
    values = unpivot(placed.select("_at", *(F.col(f"`{c}`") for c in columns)), columns, "string", "_at").where("value IS NOT NULL")
    firsts = values.withColumn("r", F.row_number().over(Window.partitionBy("column").orderBy("_at"))).where(F.col("r") <= first)
    counts = firsts.groupBy("column").agg(F.count_if(F.col("value").rlike(LOOKS_NUMERIC)).alias("numeric"), F.count("*").alias("seen"))
    return counts.where((F.col("numeric") > 0) & (F.col("numeric") < F.col("seen")))


#: The terms of every contract.
TERMS = {"usage": "Internal inter-system data contract. Do not publish.", "limitations": "All confidence fields must remain in 0.0–1.0 float range. All _id fields must be valid UUID v4."}


def with_header(contract: Contract, source: str, snapshot_hash: str | None) -> Contract:
    """The contract with its server, its terms, and in its description the hash of the data it was inferred from."""
    kind = "parquet" if ".parquet" in source else "jsonl"
    info = contract.info | {"description": f"Source snapshot: {snapshot_hash or 'unknown'}. Generated at: {datetime.now(timezone.utc).isoformat()}."}
    return replace(contract, info=info, servers={"local": {"type": "local", "path": source, "format": kind}}, terms=dict(TERMS))


def to_contract(contract_id: str, clauses: DataFrame, warned: DataFrame | None = None, downstream: list[dict] | None = None) -> Contract:
    """The clause rows, one per column, as a contract on the driver."""
    notes: dict[str, list[dict[str, str]]] = {}
    for r in warned.collect() if warned is not None else []:
        notes.setdefault(r["column"], []).append({"code": r["code"], "severity": r["severity"]})
    schema = {}
    for r in clauses.collect():
        stats = {s: r[s] for s in STATISTICS} if r["mean"] is not None else None
        schema[r["column"]] = Clause(r["type"], r["required"], r["minimum"], r["maximum"], r["format"], r["pattern"], tuple(r["enum"]) if r["enum"] is not None else None, baseline_statistics=stats, distribution_warnings=tuple(notes.get(r["column"], ())))
    soda = [f"missing_count({c}) = 0" for c, k in schema.items() if k.required] + [f"duplicate_count({c}) = 0" for c, k in schema.items() if k.format == "uuid" and k.required]
    title = re.sub(r"[-_]+", " ", contract_id).title()
    return Contract(contract_id, schema, info={"title": title}, quality={"type": "SodaChecks", "checks": soda}, lineage={"downstream": downstream or []})


def infer(df: DataFrame, contract_id: str, exact: bool = True, **options) -> Contract:
    from pactlake.operators.profile import profile

    rows = profile(df, exact)
    if "mean" not in rows.columns:
        for s in STATISTICS:
            rows = rows.withColumn(s, F.lit(None).cast("double"))
    return to_contract(contract_id, clause_rows(rows, **options), warnings(rows.where("mean IS NOT NULL")))
