"""Schema evolution: two schemas as rows, joined by field, to classified changes."""

from __future__ import annotations

import re
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Type changes that lose a fraction.
NARROWED = [("number", "integer"), ("float64", "int64"), ("float", "int"), ("float64", "int32"), ("double", "int"), ("double", "bigint")]
RANK = {"CRITICAL": 3, "BREAKING": 2, "COMPATIBLE": 1}


def _change(when: Column, kind: str | Column, classification: str | Column, reason: str | Column, old: Column | None = None, new: Column | None = None) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    text = lambda c: F.lit(None).cast("string") if c is None else c.cast("string")
    return F.when(when, F.struct(lit(kind).alias("change_type"), lit(classification).alias("classification"), lit(reason).alias("reason"), text(old).alias("old_value"), text(new).alias("new_value")))


def changes(old: DataFrame, new: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Clause rows (keys..., field, type, required, minimum, maximum, format, enum) of two versions -> one row per change.

    A change of scale is critical and hides all others of its field. With keys, say contract_id, many contracts are compared at once.
    """
    o = old.select(*keys, "field", F.struct("type", "required", "minimum", "maximum", "format", "enum").alias("o"))
    n = new.select(*keys, "field", F.struct("type", "required", "minimum", "maximum", "format", "enum").alias("n"))
    both = o.join(n, [*keys, "field"], "full")
    c = F.col
    narrowed = F.concat_ws(">", "o.type", "n.type").isin([">".join(p) for p in NARROWED])
    fraction = F.coalesce(c("o.maximum") <= 1, F.lit(False))
    scale = narrowed & fraction | fraction & F.coalesce(c("n.maximum") > 1, F.lit(False)) | fraction & F.coalesce((c("o.minimum") == 0) & (c("n.minimum") >= 10), F.lit(False))
    here = c("o").isNotNull() & c("n").isNotNull()
    removed = F.array_except(c("o.enum"), c("n.enum"))
    added = F.array_except(c("n.enum"), c("o.enum"))
    joined = lambda a: F.array_join(F.array_sort(a), ",")
    rules = [
        _change(c("o.type") != c("n.type"), "type_changed", "BREAKING", "Readers of the old type can't parse the new one.", c("o.type"), c("n.type")),
        _change(c("o.required") != c("n.required"), "required_changed", F.when(c("n.required"), "BREAKING").otherwise("COMPATIBLE"), F.when(c("n.required"), "Producers that omit the field now fail.").otherwise("A field that may be missing was always present before."), c("o.required"), c("n.required")),
        _change(F.size(removed) > 0, "enum_values_removed", "BREAKING", "Values that consumers know are no longer allowed.", joined(removed)),
        _change(F.size(added) > 0, "enum_values_added", "COMPATIBLE", "Consumers meet values that are new to them.", None, joined(added)),
        _change(c("o.enum").isNotNull() & c("n.enum").isNull(), "enum_removed", "BREAKING", "Consumers can no longer rely on the list of values.", joined(c("o.enum"))),
        _change(c("o.enum").isNull() & c("n.enum").isNotNull(), "enum_added", "BREAKING", "Values outside the new list were fine before.", None, joined(c("n.enum"))),
        _change(~c("o.format").eqNullSafe(c("n.format")), "format_changed", F.when(c("o.format").isNull(), "BREAKING").otherwise("COMPATIBLE"), F.when(c("o.format").isNull(), "A new format rejects values that passed before.").otherwise("A format was dropped or replaced."), c("o.format"), c("n.format")),
    ]
    for bound in ("minimum", "maximum"):
        a, b = c(f"o.{bound}"), c(f"n.{bound}")
        tighter = b > a if bound == "minimum" else b < a
        rules += [
            _change(a.isNull() & b.isNotNull(), f"{bound}_added", "BREAKING", f"A new {bound} rejects data outside it.", None, b),
            _change(a.isNotNull() & b.isNull(), f"{bound}_removed", "COMPATIBLE", f"Dropping the {bound} is backwards-compatible.", a),
            _change(a.isNotNull() & b.isNotNull() & (a != b), f"{bound}_changed", F.when(tighter, "BREAKING").otherwise("COMPATIBLE"), F.when(tighter, f"Narrower {bound}.").otherwise(f"Wider {bound}."), a, b),
        ]
    alone = [
        _change(c("n").isNull(), "field_removed", "BREAKING", "Consumers that read the field fail."),
        _change(c("o").isNull(), "field_added", F.when(c("n.required"), "BREAKING").otherwise("COMPATIBLE"), F.when(c("n.required"), "Producers must now provide the field.").otherwise("Consumers ignore unknown fields.")),
    ]
    critical = F.array(_change(F.lit(True), "scale_mutation", "CRITICAL", "Values change scale without an error.", c("o.maximum"), c("n.maximum")))
    found = F.when(here & scale, critical).when(here, F.array_compact(F.array(*rules))).otherwise(F.array_compact(F.array(*alone)))
    return both.select(*keys, "field", F.explode(found).alias("ch")).select(*keys, "field", "ch.*")


def history(snapshots: DataFrame) -> DataFrame:
    """Snapshots (contract_id, ts, field, type, ...) of all contracts -> the changes between consecutive ones of each: contract_id, old_ts,
    new_ts, field, change_type, .... Jobs don't depend on the number of contracts or snapshots."""
    times = snapshots.select("contract_id", F.col("ts").alias("new_ts")).distinct()
    pairs = times.withColumn("old_ts", F.lag("new_ts").over(Window.partitionBy("contract_id").orderBy("new_ts"))).where("old_ts IS NOT NULL")
    side = lambda ts: snapshots.withColumnRenamed("ts", ts).join(pairs, ["contract_id", ts])
    return changes(side("old_ts"), side("new_ts"), ("contract_id", "old_ts", "new_ts"))


def verdict(rows: DataFrame, *keys: str) -> DataFrame:
    """Changes -> compatibility verdict and counts, per keys."""
    count = lambda k: F.count_if(F.col("classification") == k)
    out = rows.groupBy(*keys).agg(F.count("*").alias("total"), count("CRITICAL").alias("critical"), count("BREAKING").alias("breaking"), count("COMPATIBLE").alias("compatible"))
    said = F.when(F.col("critical") > 0, "CRITICAL").when(F.col("breaking") > 0, "BREAKING").otherwise("COMPATIBLE")
    return out.withColumn("verdict", said).withColumn("requires_version_bump", F.col("critical") + F.col("breaking") > 0)


def checklist(rows: DataFrame) -> DataFrame:
    """Changes -> migration steps (field, step), in no order."""
    step = F.when(F.col("change_type") == "scale_mutation", F.format_string("Stop the release: %s changes scale; ship it as a new field.", "field"))
    step = step.when(F.col("change_type") == "field_removed", F.format_string("Deprecate %s for two sprints before its removal.", "field"))
    step = step.when(F.col("classification") == "BREAKING", F.format_string("Tell every subscriber that reads %s: %s.", "field", "change_type"))
    return rows.select("field", "change_type", step.alias("step")).where("step IS NOT NULL")


def rollback(rows: DataFrame) -> DataFrame:
    """Breaking changes -> what to restore (field, step)."""
    return rows.where("classification = 'BREAKING'").select("field", F.format_string("Restore %s to its previous version (%s).", "field", "change_type").alias("step"))


def snapshot_pairs(snapshots: DataFrame, since: Column | None = None) -> DataFrame:
    """Snapshots (contract_id, ts, ...) -> contract_id, old_ts, new_ts.

    Without a cutoff the two most recent; with one the last at or before it and the newest after it, else the oldest
    and the newest.
    """
    if since is None:
        ranked = snapshots.withColumn("old_ts", F.lag("ts").over(Window.partitionBy("contract_id").orderBy("ts")))
        return ranked.groupBy("contract_id").agg(F.max_by("old_ts", "ts").alias("old_ts"), F.max("ts").alias("new_ts"))
    rows = snapshots.groupBy("contract_id").agg(F.max(F.when(F.col("ts") <= since, F.col("ts"))).alias("before"), F.max(F.when(F.col("ts") > since, F.col("ts"))).alias("after"), F.min("ts").alias("oldest"), F.max("ts").alias("newest"))
    known = F.col("before").isNotNull() & F.col("after").isNotNull()
    return rows.select("contract_id", F.when(known, F.col("before")).otherwise(F.col("oldest")).alias("old_ts"), F.when(known, F.col("after")).otherwise(F.col("newest")).alias("new_ts"))


def parse_since(text: str, now: datetime) -> datetime:
    """'3 days ago' and the like as a time; seven days ago where it can't be read."""
    m = re.match(r"\s*(\d+)\s*(hour|day|week)s?", text or "", re.I)
    return now - (timedelta(**{m[2].lower() + "s": int(m[1])}) if m else timedelta(days=7))
