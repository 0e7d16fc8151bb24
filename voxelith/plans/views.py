"""Test relations derived from the synthetic tables, as DataFrames and as the same SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SQL = {
    "vox": "SELECT CAST(l_partkey % 32 AS BIGINT) AS x, CAST(l_suppkey % 32 AS BIGINT) AS y, l_linenumber AS z, CAST(max(l_quantity) AS INT) AS v FROM lineitem GROUP BY 1, 2, 3",
    "lab": "SELECT x, y, z, v, CASE WHEN v < 10 THEN 1 ELSE CAST(2 + floor(x / 8) + 4 * floor(y / 8) AS INT) END AS label FROM vox",
    "lab2": "SELECT x, y, z, v, CASE WHEN v < 12 THEN 1 ELSE CAST(2 + floor(((x + 1) % 32) / 8) + 4 * floor(y / 8) AS INT) END AS label FROM vox",
    "cells": "SELECT CAST(t * 10000 + o_custkey * 2 + k + 1 AS BIGINT) AS cell_id, CAST(t AS INT) AS t, o_custkey AS cust, CAST(k AS INT) AS k, CAST(floor(o_totalprice) AS BIGINT) AS volume FROM (SELECT o_custkey, year(o_orderdate) - 1994 AS t, o_totalprice, row_number() OVER (PARTITION BY o_custkey, year(o_orderdate) ORDER BY o_orderkey) AS k FROM orders WHERE o_custkey <= 4998) q WHERE k <= 2",
    "edges": "SELECT p.cell_id AS parent, c.cell_id AS child, c.k AS ord FROM cells p JOIN cells c ON c.t = p.t + 1 AND c.cust = p.cust WHERE p.k = 1",
    "det": "SELECT event_id AS det_id, CAST(day(ts) AS INT) AS frame, CAST(user_id % 16 AS BIGINT) AS x, CAST(floor(value) AS BIGINT) AS y FROM events",
}
NEEDS = {"lab": ("vox",), "lab2": ("vox",), "edges": ("cells",)}


def ctes(*names: str) -> str:
    """WITH clause of the named views and those below them."""
    order: list[str] = []

    def add(n: str) -> None:
        for m in NEEDS.get(n, ()):
            add(m)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    return "WITH RECURSIVE " + ", ".join(f"{n} AS ({SQL[n]})" for n in order)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    from pyspark.sql import functions as F

    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    if name == "vox":
        return read("lineitem").groupBy((F.col("l_partkey") % 32).alias("x"), (F.col("l_suppkey") % 32).alias("y"), F.col("l_linenumber").alias("z")).agg(F.max("l_quantity").cast("int").alias("v"))
    if name in ("lab", "lab2"):
        low, shift = (10, 0) if name == "lab" else (12, 1)
        block = F.expr(f"CAST(2 + ((x + {shift}) % 32) div 8 + 4 * (y div 8) AS INT)")
        return view(spark, sf_dir, "vox").withColumn("label", F.when(F.col("v") < low, F.lit(1)).otherwise(block))
    if name == "cells":
        from pyspark.sql import Window as W

        k = F.row_number().over(W.partitionBy("o_custkey", F.year("o_orderdate")).orderBy("o_orderkey"))
        rows = read("orders").where("o_custkey <= 4998").select("o_custkey", "o_totalprice", (F.year("o_orderdate") - 1994).alias("t"), k.alias("k")).where("k <= 2")
        return rows.select((F.col("t") * 10000 + F.col("o_custkey") * 2 + F.col("k") + 1).cast("long").alias("cell_id"), "t", F.col("o_custkey").alias("cust"), "k", F.floor("o_totalprice").cast("long").alias("volume"))
    if name == "edges":
        cells = view(spark, sf_dir, "cells")
        mother = cells.where("k = 1").select(F.col("cell_id").alias("parent"), (F.col("t") + 1).alias("t"), "cust")
        return mother.join(cells.select("t", "cust", F.col("cell_id").alias("child"), F.col("k").alias("ord")), ["t", "cust"]).select("parent", "child", "ord")
    if name == "det":
        return read("events").select(F.col("event_id").alias("det_id"), F.dayofmonth("ts").alias("frame"), (F.col("user_id") % 16).alias("x"), F.floor("value").cast("long").alias("y"))
    raise KeyError(name)
