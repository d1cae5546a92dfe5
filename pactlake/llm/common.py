"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: A side of a join is broadcast up to so many rows of a few fixed-width columns (about 64 MB); beyond it Spark shuffles both sides.
BROADCAST_ROWS = 1_000_000


#: Folders of the settled tables of this process that haven't been released.
_SETTLED: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir; in local mode a fresh one where none is set."""
    sc = spark.sparkContext
    if not (path := spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()):
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(path := "file://" + tempfile.mkdtemp(prefix="pactlake-"))
    return path.rstrip("/")


def new_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/pactlake-{what}-{uuid.uuid4().hex}"


def settle(df: DataFrame, what: str = "table") -> DataFrame:
    """Write df into the shared folder and read it again: computed once, lineage cut, sizes known, safe when executors are lost.

    The folder goes when the driver ends, or with `release`."""
    path = new_path(df.sparkSession, what)
    df.write.parquet(path)
    _SETTLED.append(path)
    folder = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settled() -> list[str]:
    """Folders of all settled tables of this process that haven't been released."""
    return list(_SETTLED)


def release(spark: SparkSession, folders: list[str]) -> None:
    """Delete settled tables on which no result depends any more."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for folder in folders:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)
        if folder in _SETTLED:
            _SETTLED.remove(folder)


def join_small(df: DataFrame, small: DataFrame, on, how: str, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Join with a settled table that is broadcast only if its row count is within the limit; else Spark's shuffled join (AQE splits hot keys)."""
    return df.join(F.broadcast(small) if small.limit(limit + 1).count() <= limit else small, on, how)


def local_table(spark: SparkSession, rows: list[tuple], ddl: str) -> DataFrame:
    """Rows that the driver has, as a table that the JVM holds: made from Arrow, so that no Python worker reads it."""
    schema = to_arrow_schema(StructType.fromDDL(ddl))
    columns = list(zip(*rows)) if rows else [[] for _ in schema]
    return spark.createDataFrame(pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema))


def bounded_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Python workers get at most so many rows at a time, so that long texts fit in their memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def text_of(column: str = "text") -> Column:
    """The text; null counts as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def unused(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name = "_" + name
    return name
