"""Readers of records, reports, contracts, registries, snapshots and commits."""

from __future__ import annotations

import glob
import hashlib
import json
import os
import subprocess
from datetime import datetime, timezone
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pactlake.contract import Contract
from pactlake.sources.gitlog import PUSHDOWN, GitLog


def jsonl(spark: SparkSession, path: str, schema: str | None = None, strict: bool = True) -> DataFrame:
    """Records of a JSON Lines file or folder; blank lines are skipped; a bad line fails, or is skipped if not strict."""
    reader = spark.read.option("mode", "FAILFAST" if strict else "DROPMALFORMED")
    return (reader.schema(schema) if schema else reader).json(path)


#: The column of lines that can't be parsed.
CORRUPT = "_corrupt_record"


def jsonl_kept(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Records of a JSON Lines file or folder, where a line that can't be parsed stays as text in CORRUPT, with nulls beside it.

    Without a schema the column is there only if there are such lines.
    """
    reader = spark.read.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT)
    return (reader.schema(f"{schema}, {CORRUPT} string") if schema else reader).json(path)


def parsed(lines: DataFrame, schema: str, column: str = "value") -> DataFrame:
    """Lines of JSON text -> their fields and CORRUPT, in the pass that reads the lines; blank lines are skipped."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    return lines.where(F.trim(column) != "").select(F.from_json(column, f"{schema}, {CORRUPT} string", options).alias("r")).select("r.*")


def jsonl_variant(spark: SparkSession, path: str) -> DataFrame:
    """Records of unknown or mixed shape, one VARIANT `v` a line."""
    return spark.read.text(path).where(F.trim("value") != "").select(F.parse_json("value").alias("v"))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files -> file_path, line (from 1, blank lines count), value, as reading each file in order would number them.

    Lines are counted by split, a number a split is added up, and each line adds its place in its split: no row leaves its place, and
    files may be cut into splits anywhere.
    """
    from pyspark.sql import Window

    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_block_start").alias("_at"), F.monotonically_increasing_id().alias("_id"))
    splits = raw.groupBy("file_path", "_at").agg(F.count("*").alias("n"), F.min("_id").alias("_first"))
    before = Window.partitionBy("file_path").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    offsets = splits.select("file_path", "_at", "_first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    return raw.join(offsets, ["file_path", "_at"]).select("file_path", (F.col("_before") + F.col("_id") - F.col("_first") + 1).alias("line"), "value")


def json_documents(spark: SparkSession, path: str, schema: str | None = None, pattern: str | None = None) -> DataFrame:
    """Whole-file JSON documents of a folder, with file_name; arrays become rows; unreadable ones are skipped."""
    reader = spark.read.option("multiLine", True).option("mode", "DROPMALFORMED")
    reader = reader.option("pathGlobFilter", pattern) if pattern else reader
    return (reader.schema(schema) if schema else reader).json(path).withColumn("file_name", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1))


def json_or(path: str, default: Any) -> Any:
    """A small JSON document on the driver; the default where the file is missing."""
    if not os.path.exists(path):
        return default
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def contract(path: str) -> Contract:
    import yaml

    with open(path, encoding="utf-8") as f:
        return Contract.from_dict(yaml.safe_load(f))


REGISTRY_DDL = (
    "subscription_id STRING, contract_id STRING, contract_version STRING, subscriber_id STRING, subscriber_team STRING, subscriber_description STRING, "
    "fields_consumed ARRAY<STRING>, breaking_fields ARRAY<STRUCT<field: STRING, reason: STRING>>, validation_mode STRING, tier INT, contact STRING, registered_at STRING"
)


def registry_rows(subscriptions: list[dict]) -> list[dict]:
    """Subscriptions whose breaking fields are all {field, reason}, also those given as bare names."""
    one = lambda b: {"field": b, "reason": ""} if isinstance(b, str) else {"field": b.get("field"), "reason": b.get("reason", "")}
    names = [c.strip().split()[0] for c in REGISTRY_DDL.replace("ARRAY<STRUCT<field: STRING, reason: STRING>>", "X").split(",")]
    return [{n: s.get(n) for n in names} | {"breaking_fields": [one(b) for b in s.get("breaking_fields") or []], "fields_consumed": list(s.get("fields_consumed") or [])} for s in subscriptions]


def registry(spark: SparkSession, path: str) -> DataFrame:
    """The consumer registry; empty where the file is missing."""
    rows: list[dict] = []
    if os.path.exists(path):
        import yaml

        with open(path, encoding="utf-8") as f:
            rows = registry_rows((yaml.safe_load(f) or {}).get("subscriptions") or [])
    return spark.createDataFrame(rows, REGISTRY_DDL)


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


NODE_DDL, EDGE_DDL = "node_id string, type string, label string", "source string, target string, relationship string, confidence double"


def latest_lineage(spark: SparkSession, path: str, schema: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of the latest snapshot by capture time; none where the file is missing."""
    if not exists(spark, path):
        return spark.createDataFrame([], NODE_DDL), spark.createDataFrame([], EDGE_DDL)
    snapshots = jsonl(spark, path, schema, strict=False)
    last = snapshots.orderBy(F.col("captured_at").desc()).limit(1)
    return last.select(F.inline("nodes")), last.select(F.inline("edges"))


def snapshot_paths(root: str, contract_id: str) -> list[str]:
    """Snapshots of a contract by name; where there are none, the legacy v1 and v2 files."""
    found = sorted(glob.glob(os.path.join(root, contract_id, "*.yaml")))
    return found or [p for v in ("v1", "v2") if os.path.exists(p := os.path.join(root, v, f"{contract_id}.json"))]


def snapshot_contracts(root: str) -> list[str]:
    """Contracts with a folder of snapshots, and those with legacy files only."""
    own = {d for d in os.listdir(root) if os.path.isdir(os.path.join(root, d)) and d not in ("v1", "v2", "diffs")}
    return sorted(own | {os.path.splitext(os.path.basename(p))[0] for p in glob.glob(os.path.join(root, "v1", "*.json"))})


def snapshot_time(path: str) -> datetime:
    """When a snapshot was taken, as it says, else when its file was written; times without a zone are UTC."""
    doc = snapshot(path) or {}
    try:
        when = datetime.fromisoformat(str(doc.get("captured_at") or doc.get("snapshot_version") or ""))
    except ValueError:
        return datetime.fromtimestamp(os.stat(path).st_mtime, tz=timezone.utc)
    return when if when.tzinfo else when.replace(tzinfo=timezone.utc)


def snapshot(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        if path.endswith((".yaml", ".yml")):
            import yaml

            return yaml.safe_load(f)
        return json.load(f)


def commits(spark: SparkSession, files: list[str], root: str, days: int = 14, timeout: int = 10) -> DataFrame:
    """Commits of files of a clone within some days, a partition a file, newest first within each (place, seq); none where git fails or takes too long.

    git drops older commits itself where PUSHDOWN is set in the session, else Spark does.
    """
    spark.dataSource.register(GitLog)
    options = {"root": root, "files": json.dumps(files), "timeout": str(timeout), "push": spark.conf.get(PUSHDOWN, "false")}
    return spark.read.format(GitLog.name()).options(**options).load().where(F.col("committed") >= F.expr(f"current_timestamp() - INTERVAL {days} DAYS"))


def head_commit(root: str) -> str | None:
    try:
        return subprocess.run(["git", "rev-parse", "HEAD"], cwd=root, capture_output=True, text=True, timeout=10, check=True).stdout.strip()
    except (OSError, subprocess.SubprocessError):
        return None


def head_hash(spark: SparkSession, path: str, first: int = 65_536) -> str | None:
    """SHA-256 of the first bytes of a file, or of the first file of a folder by name; only these bytes are read. None if there is none."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(where):
        return None
    files = sorted(str(s.getPath()) for s in fs.listStatus(where) if s.isFile() and not s.getPath().getName().startswith(("_", ".")))
    if not files:
        return None
    stream = fs.open(spark._jvm.org.apache.hadoop.fs.Path(files[0]))
    try:
        return hashlib.sha256(bytes(stream.readNBytes(first))).hexdigest()
    finally:
        stream.close()


def file_fingerprint(spark: SparkSession, path: str, first: int = 65_536) -> DataFrame:
    """(path, modificationTime, sha) of a file's first bytes, of which no others are read."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    status = where.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(where)
    rows = [(str(status.getPath()), datetime.fromtimestamp(status.getModificationTime() / 1000, tz=timezone.utc), head_hash(spark, path, first))]
    return spark.createDataFrame(rows, "path string, modificationTime timestamp, sha string")


def records_hash(spark: SparkSession, path: str, first: int = 10) -> str | None:
    """16 hex digits of the SHA-256 of the first records of a JSON Lines file, or of a folder's files by name, as one JSON list with sorted
    keys; no more lines than these are read. None if there is no file or a line isn't JSON."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(where):
        return None
    records: list = []
    for name in sorted(str(s.getPath()) for s in fs.listStatus(where) if s.isFile() and not s.getPath().getName().startswith(("_", "."))):
        lines = spark._jvm.java.io.BufferedReader(spark._jvm.java.io.InputStreamReader(fs.open(spark._jvm.org.apache.hadoop.fs.Path(name)), "UTF-8"))
        try:
            while len(records) < first and (line := lines.readLine()) is not None:
                if line.strip():
                    records.append(json.loads(line))
        except ValueError:
            return None
        finally:
            lines.close()
    return hashlib.sha256(json.dumps(records, sort_keys=True).encode()).hexdigest()[:16] if records else None
