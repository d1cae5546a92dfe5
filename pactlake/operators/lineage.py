"""Traversals of a lineage graph held as node and edge tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pactlake.functions.scalar import node_path, normalized
from pactlake.operators.substrings import contains_join

FOLLOWED = ("PRODUCES", "WRITES", "READS", "CONSUMES")


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, the folder that all executors share; in local mode a fresh one where none is set."""
    sc = spark.sparkContext
    if not (path := spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()):
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(path := "file://" + tempfile.mkdtemp(prefix="pactlake-"))
    return path.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """df as a table of the shared folder: made once, safe when executors are lost; it goes when the driver ends."""
    path = f"{shared_dir(df.sparkSession)}/pactlake-lineage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    folder = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def breadth_first(seeds: DataFrame, edges: DataFrame, max_depth: int | None = None, reverse: bool = False, keys: tuple[str, ...] = ()) -> DataFrame:
    """Seeds (keys..., node_id) over edges (source, target) -> (keys..., node_id, depth), the least number of hops; cycles end by the visited set.

    With keys, as many searches as there are different ones advance together: the frontier holds (keys, node), so rounds are as many as
    the deepest search has, whatever the number of searches. Each round joins only the frontier and writes what it adds, so lineage
    stays short on deep graphs.
    """
    a, b = ("target", "source") if reverse else ("source", "target")
    own = [*keys, "node_id"]
    step = edges.select(F.col(a).alias("node_id"), F.col(b).alias("next")).distinct()
    step = written(step.repartition("node_id"))  # made once, not again in each round
    seen = frontier = written(seeds.select(*own).distinct().withColumn("depth", F.lit(0)))
    depth = 0
    while max_depth is None or depth < max_depth:
        depth += 1
        reached = frontier.join(step, "node_id").select(*keys, F.col("next").alias("node_id")).distinct()
        frontier = written(reached.join(seen, own, "left_anti").withColumn("depth", F.lit(depth)))
        if not frontier.limit(1).count():
            break
        seen = seen.unionByName(frontier)
    return seen


def seeds_for(nodes: DataFrame, stem: str, fallback: int = 10) -> DataFrame:
    """Nodes whose id or label contains a file's stem, whatever the case; else the first transformations by id."""
    wanted = F.lit(stem.lower())
    named = nodes.where(F.contains(F.lower("node_id"), wanted) | F.contains(F.lower(F.coalesce("label", F.lit(""))), wanted))
    other = nodes.where(F.col("node_id").startswith("transformation:")).orderBy("node_id").limit(fallback)
    return named.select("node_id") if named.limit(1).count() else other.select("node_id")


def producers(reached: DataFrame, nodes: DataFrame, most: int = 5) -> DataFrame:
    """Reached nodes with a file path, the first per path by depth and id, and of those the first few (a top-k report)."""
    typed = reached.join(nodes.where(F.col("type").isin("MODEL", "FILE", "PIPELINE", "SERVICE")), "node_id").withColumn("file_path", node_path(F.col("node_id"))).where("file_path IS NOT NULL")
    first = typed.withColumn("r", F.row_number().over(Window.partitionBy("file_path").orderBy("depth", "node_id"))).where("r = 1")
    return first.select("file_path", "node_id", "depth").orderBy("depth", "node_id").limit(most)


def upstream_files(nodes: DataFrame, edges: DataFrame, stem: str, max_depth: int = 4, most: int = 5) -> DataFrame:
    followed = edges.where(F.col("relationship").isin(*FOLLOWED))
    return producers(breadth_first(seeds_for(nodes, stem), followed, max_depth, reverse=True), nodes, most)


def _names(nodes: DataFrame) -> DataFrame:
    """(node_id, name): what a node can be found by, its id and its label, in lower case without - and _."""
    return nodes.select("node_id", F.explode(F.array_distinct(F.array(normalized(F.col("node_id")), normalized(F.coalesce("label", F.lit("")))))).alias("name"))


def contamination(targets: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Targets (contract_id, node_id: a subscriber) -> depth: hops downstream from the nodes that the contract's id names, at least 1.

    Only edges along which data flows are followed. A subscriber that is not reached itself has the least depth of the reached nodes
    whose id or label contains its id, else 1; so have all where no node is named like the contract. All contracts are searched at
    once, and names are matched by q-grams.
    """
    contracts = targets.select("contract_id").distinct().withColumn("wanted", normalized(F.col("contract_id")))
    seeds = written(contains_join(contracts, _names(nodes), "wanted", "name").select("contract_id", "node_id").distinct())
    # An end that isn't a target itself, and from which nothing goes on, is on no way to another: most of a graph's nodes.
    flow = edges.where(F.col("relationship").isin(*FOLLOWED)).select("source", "target")
    inner = written(flow.select(F.col("source").alias("target")).distinct().unionByName(targets.select(F.col("node_id").alias("target"))).distinct())
    reached = written(breadth_first(seeds, flow.join(inner, "target", "left_semi"), keys=("contract_id",)))
    exact = written(targets.select("contract_id", "node_id").distinct().join(reached, ["contract_id", "node_id"], "left"))
    searched = seeds.select("contract_id").distinct()  # without seeds nothing is reached
    asked = exact.where("depth IS NULL").join(searched, "contract_id", "left_semi").select("contract_id", F.col("node_id").alias("subscriber"), normalized(F.col("node_id")).alias("wanted"))
    # Names are matched once, not once a contract; a matched end that was left out is as far as the nearest node before it, and one.
    unnamed = flow.select(F.col("target").alias("node_id")).distinct().join(nodes, "node_id", "left_anti").withColumn("name", normalized(F.col("node_id")))
    matched = written(contains_join(asked.select("wanted").distinct(), _names(nodes).unionByName(unnamed), "wanted", "name").select("wanted", "node_id").distinct())
    ends = matched.select("node_id").distinct().join(inner.withColumnRenamed("target", "node_id"), "node_id", "left_anti")
    before = flow.join(ends.withColumnRenamed("node_id", "target"), "target").distinct()
    outer = before.join(reached.withColumnRenamed("node_id", "source"), "source").groupBy("contract_id", F.col("target").alias("node_id")).agg((F.min("depth") + 1).alias("depth"))
    known = reached.join(matched.select("node_id").distinct(), "node_id", "left_semi").select("contract_id", "node_id", "depth").unionByName(outer)
    nearest = matched.join(known, "node_id").groupBy("contract_id", "wanted").agg(F.min("depth").alias("near"))
    partly = asked.join(nearest, ["contract_id", "wanted"]).select("contract_id", F.col("subscriber").alias("node_id"), "near")
    return exact.join(partly, ["contract_id", "node_id"], "left").select("contract_id", "node_id", F.greatest(F.lit(1), F.coalesce("depth", "near", F.lit(1))).alias("depth"))


def with_labels(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    return rows.join(nodes.select("node_id", "label"), "node_id", "left").withColumn("label", F.coalesce("label", "node_id"))
