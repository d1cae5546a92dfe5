"""Writers: contracts, test files, snapshots, baselines, reports, logs and quarantine."""

from __future__ import annotations

import json
import os
from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pactlake.contract import Contract


def _dump_yaml(doc: dict, path: str) -> str:
    import yaml

    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        yaml.safe_dump(doc, f, sort_keys=False, allow_unicode=True)
    return path


def contract_yaml(contract: Contract, folder: str) -> str:
    return _dump_yaml(contract.as_dict(), os.path.join(folder, f"{contract.id}.yaml"))


def dbt_schema(contract: Contract, folder: str) -> str:
    """A dbt schema file: required as not_null, enums as accepted_values, UUIDs as unique."""
    columns = []
    for name, c in contract.schema.items():
        tests: list = ["not_null"] * c.required + ([{"accepted_values": {"values": list(c.enum)}}] if c.enum else []) + ["unique"] * (c.format == "uuid")
        columns.append({"name": name, **({"description": c.description} if c.description else {}), **({"tests": tests} if tests else {})})
    model = contract.id.replace("-", "_")
    return _dump_yaml({"version": 2, "models": [{"name": model, "columns": columns}]}, os.path.join(folder, f"{contract.id}_dbt.yml"))


def schema_snapshot(contract: Contract, root: str, now: datetime | None = None) -> str:
    now = now or datetime.now(timezone.utc)
    stamp = now.strftime("%Y%m%dT%H%M%SZ")
    doc = {"contract_id": contract.id, "snapshot_version": stamp, "captured_at": now.isoformat(), "schema": {c: k.as_dict() for c, k in contract.schema.items()}}
    return _dump_yaml(doc, os.path.join(root, contract.id, f"{stamp}.yaml"))


def merge_baselines(path: str, new: dict[str, dict], refresh: bool = False) -> dict[str, dict]:
    """A small baseline file, merged: known keys stay unless refreshed."""
    old: dict[str, dict] = {}
    if os.path.exists(path):
        with open(path, encoding="utf-8") as f:
            old = json.load(f)
    merged = {**old, **new} if refresh else {**new, **old}
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path + ".tmp", "w", encoding="utf-8") as f:
        json.dump(merged, f, indent=2)
    os.replace(path + ".tmp", path)
    return merged


def report(results: DataFrame, header: dict, path: str) -> dict:
    """A report document: the header, its counters, and the result rows (as many as there are checks)."""
    from pactlake.operators.checks import counters

    doc = {**header, **counters(results).first().asDict(), "results": [r.asDict(True) for r in results.orderBy("check_order").drop("check_order").collect()]}
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        json.dump(doc, f, indent=2, default=str)
    return doc


def append_log(entries: DataFrame, path: str) -> None:
    """Violation entries appended as JSON Lines."""
    entries.write.mode("append").json(path)


def quarantine(checked: DataFrame, path: str) -> None:
    """Records with issues written with their reason, replacing what was there."""
    from pactlake.operators.prompts import quarantine as bad

    bad(checked).write.mode("overwrite").json(path)


def ai_breaches(outcomes: DataFrame, path: str) -> None:
    """Outcomes (check_name, status, ...) that warn or fail, appended to the log with a severity."""
    from pactlake.operators.prompts import severity

    outcomes.where(F.col("status").isin("WARN", "FAIL")).withColumn("severity", severity(F.col("status"))).write.mode("append").json(path)


def snapshot_table(clauses: DataFrame, ts: str, path: str) -> None:
    """Clause rows (contract_id, field, ...) of versions taken at a time, appended to a table partitioned by contract."""
    clauses.withColumn("ts", F.lit(ts)).write.mode("append").partitionBy("contract_id").parquet(path)


def records(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def centroid_cache(centroid: DataFrame, path: str) -> None:
    """A centroid kept from its first run; later runs leave it as it is."""
    centroid.write.mode("ignore").parquet(path)
