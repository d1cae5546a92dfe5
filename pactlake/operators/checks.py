"""Contract checks: all of a contract's clauses in one aggregation over the data.

`validate` compiles clauses to aggregate expressions, runs them as a single scan, and renders result rows from the one
row that comes back, still inside Spark. Failing samples, where asked for, are a second pass over failing rows only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pactlake.contract import ACCEPTED, Contract, inferred_dtype, is_numeric
from pactlake.functions.scalar import is_iso_datetime, is_missing, is_uuid

#: Order in which checks are reported.
ORDER = {"load": -1, "required": 0, "type_match": 1, "enum": 2, "uuid_pattern": 3, "datetime_format": 4, "range": 5, "statistical_drift": 6, "missing_count": 7, "duplicate_count": 8}


#: What failing checks of formats expect. The levels of checks (CRITICAL, HIGH), the texts of actual_value and expected are fixed, too.
FAILED_UUID, FAILED_TIME = "all values match ^[0-9a-f]{8}-...-[0-9a-f]{12}$", "all values parseable as ISO 8601"
#: Agreed values up to so many are broadcast to the scan; longer lists are joined with the counts of the column's values.
LISTED_ROWS = 1_000_000


def member_of(column: str) -> str:
    """The name of the mark that a value is in its column's list."""
    return f"_listed_{column}"


def z_score(mean: Column, base_mean: Column, base_stddev: Column) -> Column:
    return F.abs(mean - base_mean) / F.greatest(base_stddev, F.lit(1e-9))


def drift_status(z: Column) -> Column:
    return F.when(z > 3, "HIGH").when(z > 2, "MEDIUM").otherwise("PASS")


def _row(contract: str, column: str, kind: str, check: str, status: Column, actual: Column, expected: Column | str, severity: Column, failing: Column, message: Column, order: int) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(
        F.lit(ORDER[kind] * 100_000 + order).alias("check_order"),
        F.concat_ws(".", F.lit(contract), F.lit(column), F.lit(check)).alias("check_id"),
        F.lit(column).alias("column_name"),
        F.lit("type" if kind == "type_match" else kind).alias("check_type"),
        status.alias("status"),
        actual.alias("actual_value"),
        lit(expected).alias("expected"),
        severity.alias("severity"),
        failing.cast("long").alias("records_failing"),
        message.alias("message"),
    )


def _two_way(bad: Column, status: str) -> Column:
    return F.when(bad > 0, status).otherwise("PASS")


class Plan:
    """A contract's checks against a schema: metrics to aggregate, rows to render, and predicates of failing values."""

    def __init__(self, schema: T.StructType, contract: Contract, baselines: dict[str, dict[str, float]] | None = None, drifting: set[str] | None = None, first: int = 0, lists: dict[str, str] | None = None) -> None:
        """drifting: columns that may have a drift check (all by default); first: place of the first clause; lists: columns whose
        agreed values are a table, marked by a column of member_of, and how it is called."""
        self.schema, self.contract, self.baselines, self.lists = schema, contract, baselines, lists or {}
        self.kinds = {f.name: f.dataType for f in schema.fields}
        self.metrics: dict[str, Column] = {"n": F.count("*")}
        self.rows: list[Column] = []
        self.failing: list[tuple[str, str, Column]] = []  # (check_id, column, predicate)
        for i, (column, clause) in enumerate(contract.schema.items()):
            self._clause(first + i, column, clause)
        if baselines is not None:
            for i, f in enumerate(schema.fields):
                if is_numeric(f.dataType) and (drifting is None or f.name in drifting):
                    self._drift(i, f.name)

    def _col(self, c: str) -> Column:
        return F.col(f"`{c}`")

    def _missing(self, c: str) -> Column:
        return is_missing(self._col(c), isinstance(self.kinds[c], (T.DoubleType, T.FloatType)))

    def _metric(self, name: str, column: Column) -> Column:
        self.metrics[name] = column
        return F.col(f"`{name}`")

    def _clause(self, i: int, c: str, clause) -> None:
        cid, text = self.contract.id, F.format_string
        if c not in self.kinds:
            if clause.required:
                n = F.col("n")
                self.rows.append(_row(cid, c, "required", "required.present", F.lit("CRITICAL"), F.lit("column missing entirely"), "column present with 0 nulls", F.lit("CRITICAL"), n, F.lit(f"{c}: required, but the data has no such column."), i))
            return
        nulls = self._metric(f"nulls:{c}", F.count_if(self._missing(c)))
        if clause.required:
            status = _two_way(nulls, "CRITICAL")
            actual = F.when(nulls > 0, text("%d nulls (%.1f%%)", nulls, F.try_divide(nulls, F.col("n")) * 100)).otherwise("0 nulls")
            said = F.when(nulls > 0, text(f"{c}: required, but null in %d rows.", nulls)).otherwise(f"{c}: present in every row.")
            self.rows.append(_row(cid, c, "required", "required.no_nulls", status, actual, "null_count = 0", F.lit("CRITICAL"), nulls, said, i))
        if clause.type:
            some, none = inferred_dtype(self.kinds[c], True), inferred_dtype(self.kinds[c], False)
            dtype, allowed = F.when(nulls > 0, some).otherwise(none), ACCEPTED.get(clause.type, ())
            ok = dtype.isin(*allowed) if allowed else F.lit(True)
            status = F.when(ok, "PASS").otherwise("CRITICAL")
            expected = F.when(ok, f"type={clause.type}").otherwise(f"type={clause.type} (one of {list(allowed)})")
            said = F.when(ok, f"{c}: stored as {clause.type}, as agreed.").otherwise(text(f"{c}: stored as %s where {clause.type} is agreed.", dtype))
            self.rows.append(_row(cid, c, "type_match", "type_match", status, F.concat(F.lit("dtype="), dtype), expected, F.lit("CRITICAL"), F.when(ok, F.lit(0)).otherwise(F.col("n")), said, i))
        if c in self.lists:
            bad = ~self._missing(c) & ~self._col(member_of(c))
            self._counted(i, c, "enum", "enum_conformance", bad, "%d non-conforming values", "all values conforming", f"all values in {self.lists[c]}", f"{c}: %d values are not in the agreed list.", f"{c}: only agreed values.")
        elif clause.enum:
            bad = ~self._missing(c) & ~self._col(c).cast("string").isin(*clause.enum)
            self._counted(i, c, "enum", "enum_conformance", bad, "%d non-conforming values", "all values conforming", f"all values in {list(clause.enum)}", f"{c}: %d values are not in the agreed list.", f"{c}: only agreed values.")
        if clause.format == "uuid":
            bad = ~self._missing(c) & ~is_uuid(self._col(c))
            self._counted(i, c, "uuid_pattern", "uuid_pattern", bad, "%d values fail UUID regex", "all values match UUID pattern", "UUID format", f"{c}: %d values are no UUIDs.", f"{c}: only UUIDs.", FAILED_UUID)
        if clause.format == "date-time":
            native = isinstance(self.kinds[c], (T.TimestampType, T.TimestampNTZType, T.DateType))
            bad = F.lit(False) if native else ~self._missing(c) & ~is_iso_datetime(self._col(c))
            self._counted(i, c, "datetime_format", "datetime_format", bad, "%d unparseable values", "all values parse as ISO 8601", "ISO 8601 date-time", f"{c}: %d values are no ISO 8601 times.", f"{c}: only ISO 8601 times.", FAILED_TIME)
        if is_numeric(self.kinds[c]) and (clause.minimum is not None or clause.maximum is not None):
            self._range(i, c, clause)

    def _counted(self, i, c, kind, check, bad, said_bad, said_ok, expected, long_bad, long_ok, failed: str | None = None) -> None:
        n = self._metric(f"{check}:{c}", F.count_if(bad))
        status = _two_way(n, "CRITICAL")
        self.failing.append((f"{self.contract.id}.{c}.{check}", c, bad))
        self.rows.append(_row(self.contract.id, c, kind, check, status, F.when(n > 0, F.format_string(said_bad, n)).otherwise(said_ok), F.when(n > 0, failed or expected).otherwise(expected), F.lit("CRITICAL"), n, F.when(n > 0, F.format_string(long_bad, n)).otherwise(long_ok), i))

    def _range(self, i: int, c: str, clause) -> None:
        v = F.when(~self._missing(c), self._col(c).cast("double"))
        low, high = self._metric(f"min:{c}", F.min(v)), self._metric(f"max:{c}", F.max(v))
        below = v < clause.minimum if clause.minimum is not None else F.lit(False)
        above = v > clause.maximum if clause.maximum is not None else F.lit(False)
        bad = self._metric(f"range:{c}", F.count_if(F.coalesce(below, F.lit(False))) + F.count_if(F.coalesce(above, F.lit(False))))
        status = _two_way(bad, "HIGH")
        bound = lambda b, none: none if b is None else str(b)
        expected = f"min>={bound(clause.minimum, '-inf')}, max<={bound(clause.maximum, '+inf')}"
        said = F.when(bad > 0, F.format_string(f"{c}: %d values lie beyond the agreed bounds.", bad)).otherwise(f"{c}: all values lie within bounds.")
        row = _row(self.contract.id, c, "range", "range", status, F.format_string("min=%.4f, max=%.4f", low, high), expected, F.lit("HIGH"), bad, said, i)
        self.failing.append((f"{self.contract.id}.{c}.range", c, F.coalesce(below | above, F.lit(False))))
        self.rows.append(F.when(low.isNotNull(), row))

    def _drift(self, i: int, c: str) -> None:
        v = F.when(~self._missing(c), self._col(c).cast("double"))
        count = self._metric(f"count:{c}", F.count(v))
        mean, sd = self._metric(f"mean:{c}", F.avg(v)), self._metric(f"stddev:{c}", F.stddev_samp(v))
        base = self.baselines.get(c)
        if base is None:
            row = _row(self.contract.id, c, "statistical_drift", "statistical_drift", F.lit("PASS"), F.format_string("mean=%.4f, stddev=%.4f", mean, sd), "baseline established (first run)", F.lit("HIGH"), F.lit(0), F.lit(f"{c}: first run, so there is nothing to compare with."), i)
        else:
            z = z_score(mean, F.lit(float(base["mean"])), F.lit(float(base["stddev"])))
            status = drift_status(z)
            actual = F.concat(F.format_string("mean=%.4f, z_score=", mean), F.round(z, 2).cast("string"))
            said = F.when(status == "PASS", f"{c}: the mean is where it was.").otherwise(F.format_string(f"{c}: the mean moved by %.1f standard deviations.", z))
            row = _row(self.contract.id, c, "statistical_drift", "statistical_drift", status, actual, f"z_score <= 2 (baseline mean={base['mean']:.4f})", status, F.lit(0), said, i)
        self.rows.append(F.when(count >= 2, row))


RESULT_DDL = "check_order int, check_id string, column_name string, check_type string, status string, actual_value string, expected string, severity string, records_failing bigint, message string"


def _marked(df: DataFrame, column: str, values: DataFrame) -> DataFrame:
    """df with the mark of member_of(column): whether the value, as text, is in `values` (value).

    A list of checked size is broadcast, so that the mark costs no shuffle; with a longer one the column's distinct values are looked
    up, which are counted where they are read, and rows meet their answer by value (adaptive execution splits frequent ones).
    """
    listed = values.select(F.col("value").cast("string").alias("_value")).where("_value IS NOT NULL").distinct().withColumn(member_of(column), F.lit(True))
    small = listed.limit(LISTED_ROWS + 1).count() <= LISTED_ROWS
    joined = df.join(F.broadcast(listed) if small else listed, F.col(f"`{column}`").cast("string") == F.col("_value"), "left").drop("_value")
    return joined.withColumn(member_of(column), F.coalesce(member_of(column), F.lit(False)))


def validate(df: DataFrame, contract: Contract, baselines: dict[str, dict[str, float]] | None = None, samples: int = 0, batch: int = 40, lists: dict[str, DataFrame] | None = None, corrupt: str | None = None) -> DataFrame:
    """Result rows of all checks, in order (column check_order), from one scan.

    Wide contracts are aggregated in batches of `batch` columns, so that one generated aggregate stays compilable; each batch is a
    scan of its own columns. baselines, if given, adds drift checks of all numeric columns; a column without a baseline passes as its
    first run. lists: tables (value) of agreed values by column, in place of a clause's enum, however long. corrupt: the column in
    which a permissive reader keeps lines that it can't parse; such rows are counted in an ERROR row and take part in no check.
    """
    lists = {c: v for c, v in (lists or {}).items() if c in df.columns and c in contract.schema}
    names = list(contract.schema)
    data = [f.name for f in df.schema.fields if f.name != corrupt]
    alone = [c for c in data if baselines is not None and c not in contract.schema]
    if len(names) > batch or len(alone) > batch:
        groups = [(names[i : i + batch], i) for i in range(0, len(names), batch)] + [(alone[i : i + batch], None) for i in range(0, len(alone), batch)]
        out = None
        for group, first in groups:
            part = Contract(contract.id, {c: contract.schema[c] for c in group if first is not None})
            own = df if out is None or corrupt is None else df.where(F.col(corrupt).isNull()).drop(corrupt)
            rows = _validated(own, part, baselines, samples, lists, corrupt if out is None else None, set(group), first or 0)
            out = rows if out is None else out.unionByName(rows)
        return out
    return _validated(df, contract, baselines, samples, lists, corrupt, None, 0)


def _validated(df: DataFrame, contract: Contract, baselines, samples: int, lists: dict[str, DataFrame], corrupt: str | None, drifting: set[str] | None, first: int) -> DataFrame:
    lists = {c: v for c, v in lists.items() if c in contract.schema}
    schema = T.StructType([f for f in df.schema.fields if f.name != corrupt])
    for column, values in lists.items():
        df = _marked(df, column, values)
    plan = Plan(schema, contract, baselines, drifting, first, dict.fromkeys(lists, "its list"))
    if not plan.rows and corrupt is None:
        return df.sparkSession.createDataFrame([], RESULT_DDL + ", sample_failing array<string>" * bool(samples))
    metrics = [c.alias(n) for n, c in plan.metrics.items()]
    found = F.array_compact(F.array(*plan.rows)) if plan.rows else F.array().cast(f"array<struct<{', '.join(x.replace(' ', ': ') for x in RESULT_DDL.split(', '))}>>")
    if corrupt is None:
        rows = df.agg(*metrics).select(F.explode(found).alias("r")).select("r.*")
    else:  # good rows and bad ones are two groups of one aggregation
        parts = df.groupBy(F.col(corrupt).isNotNull().alias("_bad")).agg(*metrics)
        n = F.col("n")
        bad = _row(contract.id, "__file__", "load", "load", F.lit("ERROR"), F.format_string("%d unreadable records", n), "readable records", F.lit("CRITICAL"), n, F.format_string("%d records can't be read; they are kept aside.", n), 0)
        rows = parts.select(F.explode(F.when(F.col("_bad"), F.array(bad)).otherwise(found)).alias("r")).select("r.*")
        df = df.where(F.col(corrupt).isNull())
    rows = rows.select(*(F.col(x.split()[0]).cast(x.split()[1]) for x in RESULT_DDL.split(", ")))
    if not samples:
        return rows
    return rows.join(failing_samples(df, plan, samples), "check_id", "left")


def failing_samples(df: DataFrame, plan: Plan, n: int = 5) -> DataFrame:
    """(check_id, sample_failing): the n smallest distinct failing values of each check."""
    if not plan.failing:
        return df.sparkSession.createDataFrame([], "check_id string, sample_failing array<string>")
    cells = F.array_compact(F.array(*(F.when(bad, F.struct(F.lit(cid).alias("check_id"), F.col(f"`{c}`").cast("string").alias("value"))) for cid, c, bad in plan.failing)))
    pairs = df.select(F.explode(cells).alias("p")).select("p.*").distinct()
    first = pairs.withColumn("r", F.row_number().over(Window.partitionBy("check_id").orderBy("value"))).where(F.col("r") <= n)
    return first.groupBy("check_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "value"))), lambda x: x.value).alias("sample_failing"))


def missing_and_duplicates(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, missing_count, duplicate_count (values beyond the first of each) on the records' own grain.

    Values of 64 characters or more are shuffled as their SHA-256, whose 64 digits no shorter value has.
    """
    from pactlake.operators.profile import unpivot

    key = F.when(F.length("value") >= 64, F.sha2("value", 256)).otherwise(F.col("value"))
    values = unpivot(df, columns, "string").groupBy("column", key.alias("value")).agg(F.count("*").alias("n"))
    return values.groupBy("column").agg(
        F.sum(F.when(F.col("value").isNull(), F.col("n")).otherwise(0)).alias("missing_count"),
        F.sum(F.when(F.col("value").isNotNull(), F.col("n") - 1).otherwise(0)).alias("duplicate_count"),
    )


def counters(results: DataFrame, *keys: str) -> DataFrame:
    """One row of report counters over result rows (a row per keys, if any)."""
    n = lambda *s: F.count_if(F.col("status").isin(*s))
    return results.groupBy(*keys).agg(
        F.count("*").alias("total_checks"),
        n("PASS").alias("passed"),
        n("FAIL").alias("failed"),
        n("WARNING", "MEDIUM").alias("warned"),
        n("HIGH").alias("high"),
        n("CRITICAL").alias("critical"),
        n("ERROR").alias("errored"),
    )


def blocks(mode: Column, critical: Column, high: Column, errored: Column | None = None, fail_on_error: bool = False) -> Column:
    """Whether a report stops the pipeline: AUDIT never, WARN on critical, ENFORCE on critical or high."""
    stop = F.when(mode == "ENFORCE", critical + high > 0).when(mode == "WARN", critical > 0).otherwise(False)
    return stop | (errored > 0) & (mode != "AUDIT") if fail_on_error and errored is not None else stop


def load_failure(spark, contract_id: str, error: str) -> DataFrame:
    """The single result row of a data file that can't be read."""
    row = (0, f"{contract_id}.__file__.load", "__file__", "load", "ERROR", error[:200], "readable data file", "CRITICAL", 0, f"The data can't be read: {error[:200]}")
    return spark.createDataFrame([row], RESULT_DDL)
