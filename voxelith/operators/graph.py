"""Fixpoints over tables: each round is written to reliable storage, so lineage stays short and lost executors cost one round."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Doubling reaches over 2 ** ROUNDS steps; what still moves then is a cycle.
ROUNDS = 48


def cut(df: DataFrame) -> DataFrame:
    """Cuts lineage with checkpoint() in the session's checkpoint folder; a temporary one only where none is set."""
    sc = df.sparkSession.sparkContext
    if not (sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()):
        if not re.match(r"local(\[|$)", sc.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="voxelith-"))
    elif not sc.getCheckpointDir():
        sc.setCheckpointDir(sc.getConf().get("spark.checkpoint.dir"))
    return df.checkpoint()


def fixpoint_roots(nodes: DataFrame, key: str, up: str, steps: str) -> DataFrame:
    """Pointer doubling: nodes (key, up, steps) with up = key at roots; up becomes the root and steps the distance. A node above that isn't in the table is a root. A cycle is an error."""
    nodes = cut(nodes.select(key, up, F.col(steps).cast("int").alias(steps)))
    for _ in range(ROUNDS):
        above = nodes.select(F.col(key).alias("_k"), F.col(up).alias("_u"), F.col(steps).alias("_s"))
        new = cut(nodes.join(above, nodes[up] == above["_k"], "left").select(key, F.coalesce("_u", up).alias(up), (F.col(steps) + F.coalesce("_s", F.lit(0))).alias(steps), F.coalesce(F.col("_u") != F.col(up), F.lit(False)).alias("_moved")))
        if new.where("_moved").isEmpty():
            return new.drop("_moved")
        nodes = new.drop("_moved")
    raise ValueError(f"{key} and {up} make a cycle")


def components(edges: DataFrame) -> DataFrame:
    """(node, root), root the smallest node reached over edges (a, b): hook to the smallest neighbour, follow, contract."""
    edges = cut(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    nodes = cut(edges.select("a").union(edges.select("b")).distinct().select(F.col("a").alias("node"), F.col("a").alias("root")))
    while not edges.isEmpty():
        hook = edges.union(edges.select("b", "a")).groupBy("a").agg(F.min("b").alias("p")).select("a", F.least("a", "p").alias("p"))
        flat = fixpoint_roots(hook.withColumn("d", F.lit(0)), "a", "p", "d").select("a", "p")
        nodes = cut(nodes.join(flat, nodes["root"] == flat["a"], "left").select("node", F.coalesce("p", "root").alias("root")))
        x, y = flat.toDF("a", "x"), flat.toDF("b", "y")
        edges = cut(edges.join(x, "a").join(y, "b").where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    return nodes
