"""Column profiles: one row per column, from as few passes as Spark allows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pactlake.contract import is_numeric
from pactlake.functions.scalar import is_missing

QUANTILES = {"p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95, "p99": 0.99}


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if is_numeric(f.dataType)]


def _present(df: DataFrame, c: str) -> Column:
    """The column with NaN as null."""
    col = F.col(f"`{c}`")
    return F.when(~F.isnan(col), col) if isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType)) else col


def unpivot(df: DataFrame, columns: list[str], kind: str, *keep: str) -> DataFrame:
    """(column, value) of each row and column, beside columns to keep, as one narrow pass."""
    cells = F.array(*(F.struct(F.lit(c).alias("column"), _present(df, c).cast(kind).alias("value")) for c in columns))
    return df.select(*keep, F.explode(cells).alias("cell")).select(*keep, "cell.*")


def moments(df: DataFrame) -> dict[str, dict[str, float | int | None]]:
    """By column the count of values that are present, and of numbers mean and stddev (sample; 0 for one value): one scan."""
    parts, names = [], numeric_columns(df)
    for i, c in enumerate(df.columns):
        v = _present(df, c)
        parts.append(F.count(v).alias(f"n{i}"))
        parts += [F.avg(v.cast("double")).alias(f"a{i}"), F.stddev_samp(v.cast("double")).alias(f"s{i}")] if c in names else []
    row = df.agg(*parts).first().asDict() if parts else {}
    return {c: {"count": row[f"n{i}"]} | ({"mean": row[f"a{i}"], "stddev": row[f"s{i}"] or 0.0} if c in names and row[f"n{i}"] else {}) for i, c in enumerate(df.columns)}


def nulls(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """column, null_count, null_fraction: one aggregation without a shuffle of values."""
    columns = columns or df.columns
    floating = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    row = df.agg(F.count("*").alias("n"), *(F.count_if(is_missing(F.col(f"`{c}`"), c in floating)).alias(f"m{i}") for i, c in enumerate(columns)))
    cells = F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"m{i}").alias("null_count"), F.try_divide(F.col(f"m{i}"), F.col("n")).alias("null_fraction")) for i, c in enumerate(columns)))
    return row.select(F.explode(cells).alias("r")).select("r.*")


def numeric(df: DataFrame, columns: list[str] | None = None, exact: bool = True, accuracy: int = 10_000) -> DataFrame:
    """column, mean, stddev (sample; 0 for one value), min, max and quantiles (linear interpolation).

    One aggregate row over all columns, so values are reduced before any shuffle. Exact quantiles come from ranks in
    histograms that are refined; exact=False takes approximate ones within the same scan. Neither holds a column's values
    in one task.
    """
    columns = columns or numeric_columns(df)
    ranks = quantiles(df, columns) if exact else None
    parts = []
    for i, c in enumerate(columns):
        v = _present(df, c).cast("double")
        parts += [F.avg(v).alias(f"a{i}"), F.stddev_samp(v).alias(f"s{i}"), F.min(v).alias(f"l{i}"), F.max(v).alias(f"h{i}")]
        if not exact:
            parts.append(F.percentile_approx(v, list(QUANTILES.values()), accuracy).alias(f"q{i}"))
    row = df.agg(*parts)
    cells = F.array(
        *(
            F.struct(
                F.lit(c).alias("column"),
                F.col(f"a{i}").alias("mean"),
                F.when(F.col(f"a{i}").isNotNull(), F.coalesce(f"s{i}", F.lit(0.0))).alias("stddev"),
                F.col(f"l{i}").alias("min"),
                F.col(f"h{i}").alias("max"),
                *(F.get(f"q{i}", F.lit(k)).alias(p) for k, p in enumerate(QUANTILES) if not exact),
            )
            for i, c in enumerate(columns)
        )
    )
    out = row.select(F.explode(cells).alias("r")).select("r.*")
    return out.join(ranks, "column", "left") if exact else out


#: Bins a power of two of the first pass over values, and bins of an interval in later ones.
OCTAVE, BINS = 16, 1 << 16


def _holding(bins: DataFrame, wanted: DataFrame, key: str) -> list:
    """The bins (key, bin, n, lo, hi) that hold the wanted ranks (key, column, rank, rest: the rank within the key)."""
    before = F.sum("n").over(Window.partitionBy(key).orderBy("bin")) - F.col("n")
    placed = bins.withColumn("before", before).join(F.broadcast(wanted), key).where("rest >= before AND rest < before + n")
    return placed.select("column", "rank", (F.col("rest") - F.col("before")).alias("rest"), "lo", "hi").collect()


def quantiles(df: DataFrame, columns: list[str]) -> DataFrame:
    """column and its exact quantiles, interpolated linearly, of the values that are present.

    Ranks are selected by refining histograms. The first pass counts values in bins by sign and logarithm, with the least and the greatest
    value of each bin; each further pass opens only the bins that hold a wanted rank, cut evenly between these two values, until such
    bins have one value: after the logarithm a few passes tell any doubles apart. Counts are made where rows are read, so a pass
    shuffles a row a bin and task; nothing is sorted by range or written, and the driver holds ten numbers a column.
    """
    spark = df.sparkSession
    cells = unpivot(df, columns, "double").where("value IS NOT NULL")
    v = F.col("value")
    size = F.when(v == 0, 0.0).otherwise(F.signum(v) * F.least(F.log2(F.abs(v)) + 1100, F.lit(3000.0)))
    stats = [F.count("*").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi")]
    bins = cells.groupBy("column", F.floor(size * OCTAVE).alias("bin")).agg(*stats)
    totals = {r["column"]: r["n"] for r in bins.groupBy("column").agg(F.sum("n").alias("n")).collect()}
    ends = lambda n: {r for q in QUANTILES.values() for r in (math.floor(q * (n - 1)), math.ceil(q * (n - 1)))}
    wanted = [(c, r, r) for c, n in totals.items() for r in sorted(ends(n))]
    found = _holding(bins, spark.createDataFrame(wanted, "column string, rank long, rest long"), "column") if wanted else []
    value: dict[tuple[str, int], float] = {}
    while found:
        value |= {(r["column"], r["rank"]): r["lo"] for r in found if r["lo"] == r["hi"]}
        found = [r for r in found if r["lo"] < r["hi"]]
        if not found:
            break
        ids = {key: i for i, key in enumerate(sorted({(r["column"], r["lo"], r["hi"]) for r in found}))}
        by: dict[str, list] = {}
        for (c, lo, hi), i in ids.items():
            by.setdefault(c, []).append((i, lo, hi))
        table = spark.createDataFrame(list(by.items()), "column string, open array<struct<id: int, lo: double, hi: double>>")
        near = F.explode(F.filter("open", lambda o: (o["lo"] <= v) & (v <= o["hi"])))
        rows = cells.join(F.broadcast(table), "column").select("value", near.alias("o")).select("value", "o.*")
        at = F.least(F.floor((v - F.col("lo")) / (F.col("hi") - F.col("lo")) * BINS), F.lit(BINS - 1).cast("long"))
        bins = rows.groupBy("id", at.alias("bin")).agg(*stats)
        asked = [(ids[r["column"], r["lo"], r["hi"]], r["column"], r["rank"], r["rest"]) for r in found]
        found = _holding(bins, spark.createDataFrame(asked, "id int, column string, rank long, rest long"), "id")

    def quantile(c: str, q: float) -> float:
        at = q * (totals[c] - 1)
        low, high = value[c, math.floor(at)], value[c, math.ceil(at)]
        return low if at == math.floor(at) else (math.floor(at) + 1 - at) * low + (at - math.floor(at)) * high

    ddl = "column string, " + ", ".join(f"{p} double" for p in QUANTILES)
    return spark.createDataFrame([(c, *(quantile(c, q) for q in QUANTILES.values())) for c in totals], ddl)


def distinct_values(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value) of the distinct values as strings, without nulls. One plan for all who need it, so its shuffle is reused."""
    return unpivot(df, columns, "string").where("value IS NOT NULL").distinct()


#: Logarithm of a distinct-count sketch's size: a relative standard error of 0.8 %; a sketch is one binary value of a few KB, so that
#: aggregates of many columns stay compilable.
SKETCH = 14


def cardinality(df: DataFrame, columns: list[str] | None = None, exact: bool = True) -> DataFrame:
    """column, distinct values (nulls excluded).

    Exact counts go through one grouped pass over (column, value), which spreads over the cluster whatever the number of
    columns; approximate ones need a single scan.
    """
    columns = columns or df.columns
    if exact:
        return distinct_values(df, columns).groupBy("column").agg(F.count("*").alias("cardinality"))
    row = df.agg(*(F.hll_sketch_estimate(F.hll_sketch_agg(_present(df, c).cast("string"), SKETCH)).alias(f"c{i}") for i, c in enumerate(columns)))
    return row.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"c{i}").alias("cardinality")) for i, c in enumerate(columns)))).alias("r")).select("r.*")


def samples(df: DataFrame, columns: list[str] | None = None, n: int = 5) -> DataFrame:
    """column, sample_values: the n smallest distinct values as strings, in order; memory is bounded by n a column."""
    pairs = distinct_values(df, columns or df.columns)
    ranked = pairs.withColumn("r", F.row_number().over(Window.partitionBy("column").orderBy("value"))).where(F.col("r") <= n)
    return ranked.groupBy("column").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "value"))), lambda x: x.value).alias("sample_values"))


def _cheap_samples(df: DataFrame, names: list[str], counts: DataFrame, few: int) -> DataFrame:
    low = [r.column for r in counts.where(F.col("cardinality") <= few).collect()]
    ends = [c for c in names if c not in low]
    row = df.agg(*(F.array_compact(F.array_distinct(F.array(F.min(v), F.max(v)))).alias(f"s{i}") for i, v in enumerate(_present(df, c).cast("string") for c in ends)))
    cells = F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"s{i}").alias("sample_values")) for i, c in enumerate(ends)))
    out = row.select(F.explode(cells).alias("r")).select("r.*") if ends else None
    some = samples(df, low) if low else None
    return some.unionByName(out) if some and out else some or out


def profile(df: DataFrame, exact: bool = True, few: int = 1000) -> DataFrame:
    """One row per column: dtype, null fraction, cardinality, sample values and, for numbers, the statistics.

    exact=False needs two scans and shuffles only values of columns with about `few` distinct ones at most; the others'
    samples are their least and greatest value.
    """
    names = df.columns
    kinds = F.create_map(*(F.lit(x) for f in df.schema.fields for x in (f.name, f.dataType.simpleString())))
    counts = cardinality(df, names, exact)
    held = samples(df, names) if exact else _cheap_samples(df, names, counts, few)
    out = nulls(df, names).join(counts, "column", "left").join(held, "column", "left")
    numbers = numeric_columns(df)
    stats = numeric(df, numbers, exact) if numbers else None
    out = out.withColumn("dtype", F.element_at(kinds, F.col("column"))).withColumn("cardinality", F.coalesce("cardinality", F.lit(0)))
    return out.join(stats, "column", "left") if stats else out
