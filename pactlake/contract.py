"""The contract model: clauses, contracts, and the schemas of tabular results."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field
from typing import Any

from pyspark.sql import types as T

UUID_PATTERN = "^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
STATISTICS = ("mean", "stddev", "min", "max", "p25", "p50", "p75", "p95", "p99")


@dataclass(frozen=True)
class Clause:
    """What a contract says about one column."""

    type: str = "string"
    required: bool = False
    minimum: float | None = None
    maximum: float | None = None
    format: str | None = None
    pattern: str | None = None
    enum: tuple[str, ...] | None = None
    description: str | None = None
    baseline_statistics: dict[str, float] | None = None
    distribution_warnings: tuple[dict[str, str], ...] = ()
    llm_annotations: dict[str, str] | None = None

    def as_dict(self) -> dict[str, Any]:
        """The clause as a document, without what is not set."""
        out = {k: v for k, v in asdict(self).items() if v is not None and v != ()}
        return out | ({"enum": list(self.enum)} if self.enum is not None else {}) | ({"distribution_warnings": list(self.distribution_warnings)} if self.distribution_warnings else {})

    @classmethod
    def from_dict(cls, doc: dict[str, Any]) -> Clause:
        known = {k: v for k, v in doc.items() if k in cls.__dataclass_fields__}
        for k in ("enum", "distribution_warnings"):
            if known.get(k) is not None:
                known[k] = tuple(known[k])
        return cls(**known)


@dataclass(frozen=True)
class Contract:
    """A versioned set of clauses with its header, quality text and lineage."""

    id: str
    schema: dict[str, Clause] = field(default_factory=dict)
    version: str = "1.0.0"
    info: dict[str, Any] = field(default_factory=dict)
    servers: dict[str, Any] = field(default_factory=dict)
    terms: dict[str, Any] = field(default_factory=dict)
    quality: dict[str, Any] = field(default_factory=dict)
    lineage: dict[str, Any] = field(default_factory=dict)

    def as_dict(self) -> dict[str, Any]:
        head = {"kind": "DataContract", "apiVersion": "v3.0.0", "id": self.id, "info": {"version": self.version, **self.info}}
        return head | {"servers": self.servers, "terms": self.terms, "schema": {c: k.as_dict() for c, k in self.schema.items()}, "quality": self.quality, "lineage": self.lineage}

    @classmethod
    def from_dict(cls, doc: dict[str, Any]) -> Contract:
        info = dict(doc.get("info") or {})
        return cls(
            id=doc["id"],
            schema={c: Clause.from_dict(k) for c, k in (doc.get("schema") or {}).items()},
            version=str(info.pop("version", "1.0.0")),
            info=info,
            **{k: doc.get(k) or {} for k in ("servers", "terms", "quality", "lineage")},
        )


def inferred_dtype(kind: T.DataType, has_nulls: bool) -> str:
    """The dtype that a data frame of Python would give the column, which contract types are defined on.

    Integers with nulls become floats and booleans with nulls become objects there, so the answer needs the null count.
    """
    if isinstance(kind, T.BooleanType):
        return "object" if has_nulls else "bool"
    if isinstance(kind, T.IntegralType):
        return "float64" if has_nulls else "int64"
    if isinstance(kind, T.FractionalType) and not isinstance(kind, T.DecimalType):
        return "float64"
    return "object"


#: Contract type of a dtype, and the dtypes that a contract type accepts.
CONTRACT_TYPE = {"int64": "integer", "float64": "number", "bool": "boolean", "object": "string"}
ACCEPTED = {"string": ("object",), "number": ("float64", "float32", "int64", "int32"), "integer": ("int64", "int32", "int16", "int8"), "boolean": ("bool",)}


def is_numeric(kind: T.DataType) -> bool:
    return isinstance(kind, T.NumericType)
