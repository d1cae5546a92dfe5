"""From nested records to a flat frame with one row per element of the primary array."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The arrays that are exploded, in order of preference, and the prefixes of their columns.
ARRAYS = ("extracted_facts", "nodes", "edges", "events", "items", "records")
PREFIXES = {"extracted_facts": "fact_", "nodes": "node_", "edges": "edge_", "events": "event_", "items": "item_", "records": "record_"}
_NESTED = (T.StructType, T.ArrayType, T.MapType)


def explode_key(df: DataFrame) -> str | None:
    """The primary array: a known one, else the first array of structs whose name has no leading underscore."""
    arrays = {f.name: f.dataType for f in df.schema.fields if isinstance(f.dataType, T.ArrayType)}
    for name in ARRAYS:
        if name in arrays:
            return name
    return next((n for n, t in arrays.items() if not n.startswith("_") and isinstance(t.elementType, T.StructType)), None)


def prefix_of(key: str) -> str:
    return PREFIXES.get(key, key.rstrip("s") + "_")


def flatten(df: DataFrame, key: str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per element (one with nulls for an empty or missing array); scalars only, elements before parents on a clash.

    Columns with a leading underscore go, but for those to keep."""
    key = key or explode_key(df)
    scalar = [f.name for f in df.schema.fields if not isinstance(f.dataType, _NESTED) and (not f.name.startswith("_") or f.name in keep) and f.name != key]
    if key is None:
        return df.select(*scalar)
    prefix, kind = prefix_of(key), df.schema[key].dataType.elementType
    made = {f"{prefix}{f.name}": F.col(f"_e.`{f.name}`") for f in kind.fields if not isinstance(f.dataType, _NESTED)} if isinstance(kind, T.StructType) else {f"{prefix}value": F.col("_e")}
    rows = df.select(*(c for c in scalar if c not in made), F.explode_outer(key).alias("_e"))
    return rows.select(*(c for c in scalar if c not in made), *(c.alias(n) for n, c in made.items()))


def drop_empty_columns(df: DataFrame) -> DataFrame:
    """Without the columns that have no value at all; one aggregation decides."""
    if not df.columns:
        return df
    counts = df.agg(*(F.count(F.col(f"`{c}`")).alias(c) for c in df.columns)).first()
    return df.select(*(F.col(f"`{c}`") for c in df.columns if counts[c]))


_OBJECT = "^OBJECT"
#: Types of a variant's field that become columns, by the name that a variant's schema has for them; numbers of several kinds are doubles.
_SCALARS = {"STRING": "string", "BOOLEAN": "boolean", "BIGINT": "bigint", "DOUBLE": "double", "DATE": "date", "TIMESTAMP": "timestamp"}


def _object_fields(schema: str | None) -> dict[str, str]:
    """Fields of a variant schema such as OBJECT<a: BIGINT, b: VARIANT> that are scalars or of mixed kinds, and their types."""
    if not schema or not schema.startswith("OBJECT<"):
        return {}
    fields, depth, start, body = {}, 0, 0, schema[len("OBJECT<") : -1] + ","
    quoted = False
    for i, c in enumerate(body):
        quoted ^= c == "`"
        depth += 0 if quoted else (c in "<(") - (c in ">)")
        if c == "," and not depth and not quoted:
            name, _, kind = body[start:i].strip().partition(": ")
            fields[name.strip("`")] = kind.strip()
            start = i + 1
    number = lambda k: "double" if k.startswith(("DECIMAL", "FLOAT")) else _SCALARS.get(k)
    return {n: number(k) or "string" for n, k in fields.items() if not k.startswith(("OBJECT", "ARRAY", "VOID"))}


def flatten_variant(df: DataFrame, column: str, key: str | None = None) -> DataFrame:
    """Records of mixed shape, one VARIANT a row -> the flat frame of `flatten`: one row per element of the primary array.

    An element may be an object, whose scalar fields become columns with the array's prefix, or a scalar, which becomes `<prefix>value`,
    whatever stands beside it; arrays and objects inside are null. The schema of all records is merged in one aggregation, so
    fields need to occur in some records only. Fields of several kinds are text.
    """
    is_object = F.schema_of_variant(F.col(column)).rlike(_OBJECT)
    schema = df.agg(F.schema_of_variant_agg(F.when(is_object, F.col(column)))).first()[0]
    raw = schema[len("OBJECT<") : -1] if schema and schema.startswith("OBJECT<") else ""
    arrays = [a for a in ARRAYS if re.search(rf"(?:^|, )`?{a}`?: (?:ARRAY|VARIANT)", raw)]
    key = key or next(iter(arrays), None) or next((m for m in re.findall(r"(?:^|, )`?([^`:,<>]+)`?: ARRAY<OBJECT", raw) if not m.startswith("_")), None)
    own = {n: t for n, t in _object_fields(schema).items() if not n.startswith("_") and n != key}
    get = lambda v, n, t: F.try_variant_get(v, f"$['{n}']", t)
    if key is None:
        return df.select(*(get(F.col(column), n, t).alias(n) for n, t in own.items()))
    prefix = prefix_of(key)
    array = F.try_variant_get(F.col(column), f"$['{key}']", "array<variant>")
    rows = df.select(F.col(column).alias("_v"), F.explode_outer(array).alias("_e"))
    shape = F.schema_of_variant("_e")
    inner = rows.agg(F.schema_of_variant_agg(F.when(shape.rlike(_OBJECT), F.col("_e"))).alias("fields"), F.count_if(~shape.rlike(_OBJECT) & ~shape.startswith("ARRAY") & (shape != "VOID")).alias("scalars")).first()
    made = {f"{prefix}{n}": F.when(shape.rlike(_OBJECT), get(F.col("_e"), n, t)) for n, t in _object_fields(inner.fields).items()}
    if inner.scalars or not made:
        made[f"{prefix}value"] = scalar_or_null(F.col("_e"))
    return rows.select(*(get(F.col("_v"), n, t).alias(n) for n, t in own.items() if n not in made), *(c.alias(n) for n, c in made.items()))


def scalar_or_null(variant: Column, kind: str = "string") -> Column:
    """The value of a variant that is a scalar; objects and arrays are null."""
    shape = F.schema_of_variant(variant)
    return F.when(~shape.startswith("OBJECT") & ~shape.startswith("ARRAY"), F.try_variant_get(variant, "$", kind))


def texts(df: DataFrame, array: str) -> DataFrame:
    """Texts of an array's elements: text, else fact_text; empty ones are left out."""
    fields = df.schema[array].dataType.elementType.names
    found = F.coalesce(*(F.nullif(F.col(f"e.{c}"), F.lit("")) for c in ("text", "fact_text") if c in fields))
    return df.select(F.explode(array).alias("e")).select(found.alias("text")).where("text IS NOT NULL")
