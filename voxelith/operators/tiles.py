"""Kernels over images: whole small images, or tiles with a halo where a kernel is local."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelith.functions import kernels as K
from voxelith.operators.graph import components


def to_array(pdf: pd.DataFrame, column: str, fill=0) -> tuple[np.ndarray, np.ndarray]:
    """(dense array, its origin); voxels that the table lacks are ``fill``."""
    at = pdf[["x", "y", "z"]].to_numpy(np.int64)
    lo = at.min(0)
    a = np.full(at.max(0) - lo + 1, fill, pdf[column].to_numpy().dtype if pdf[column].dtype != object else np.float64)
    a[tuple((at - lo).T)] = pdf[column].to_numpy()
    return a, lo


def per_image(img: DataFrame, fn: Callable[[np.ndarray], np.ndarray], by: str, value: str = "v", out: str = "v double", fill=0) -> DataFrame:
    """fn on each image as one array, for kernels that depend on order over all of it. One image a task: an image must fit a task."""
    name, kind = out.split()

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        a, lo = to_array(pdf, value, fill)
        r = fn(a)
        at = pdf[["x", "y", "z"]].to_numpy(np.int64)
        got = pdf[["x", "y", "z"]].copy()
        got.insert(0, by, key[0])
        got[name] = r[tuple((at - lo).T)]
        return got

    kinds = dict(img.dtypes)
    cols = ", ".join(f"{c} {kinds[c]}" for c in (by, "x", "y", "z"))
    return img.select(by, "x", "y", "z", value).groupBy(by).applyInPandas(_plain(run), f"{cols}, {name} {kind}")


def _plain(fn):
    fn.__annotations__ = {}
    return fn


def per_tile(img: DataFrame, fn: Callable[[np.ndarray], np.ndarray], size: int, halo: int, value: str = "v", out: str = "v double", fill=0) -> DataFrame:
    """fn on tiles of ``size`` with ``halo`` voxels around: each voxel goes to its own tile and to those whose halo holds it. Right for kernels that reach no further than the halo."""
    name, kind = out.split()
    spots = F.array(F.lit(0))
    for axis in ("x", "y", "z"):
        spots = spots  # one explode over the up to eight tiles below
    tile = lambda a: F.sequence(F.floor((F.col(a) - halo) / size).cast("long"), F.floor((F.col(a) + halo) / size).cast("long"))
    rows = img.select("x", "y", "z", value).withColumn("_x", F.explode(tile("x"))).withColumn("_y", F.explode(tile("y"))).withColumn("_z", F.explode(tile("z")))

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        a, lo = to_array(pdf, value, fill)
        r = fn(a)
        at = pdf[["x", "y", "z"]].to_numpy(np.int64)
        own = (at // size == np.array(key)).all(1)
        got = pdf.loc[own, ["x", "y", "z"]].copy()
        got[name] = r[tuple((at[own] - lo).T)]
        return got

    kinds = dict(img.dtypes)
    return rows.groupBy("_x", "_y", "_z").applyInPandas(_plain(run), ", ".join(f"{c} {kinds[c]}" for c in ("x", "y", "z")) + f", {name} {kind}")


def gaussian(img: DataFrame, sigma: float, size: int = 64) -> DataFrame:
    return per_tile(img, lambda a: np.round(K.gaussian(a, sigma), 6), size, int(4 * sigma + 0.5) + 1)


def connected_components(fg: DataFrame, conn: int = 26, size: int = 64) -> DataFrame:
    """x, y, z, component (smallest voxel index) of foreground voxels: labels inside tiles, then components of the tiles' labels over their borders. Only voxels on borders meet across tiles."""
    from voxelith.operators.voxel import offsets

    rows = fg.select("x", "y", "z").withColumn("_x", F.expr(f"CAST(floor(x / {size}) AS LONG)")).withColumn("_y", F.expr(f"CAST(floor(y / {size}) AS LONG)")).withColumn("_z", F.expr(f"CAST(floor(z / {size}) AS LONG)"))

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(_on=np.int8(1))
        a, lo = to_array(pdf, "_on")
        at = pdf[["x", "y", "z"]].to_numpy(np.int64)
        lab = K.label(a > 0, conn)[tuple((at - lo).T)]
        index = at[:, 0] + (at[:, 1] << 21) + (at[:, 2] << 42)
        first = pd.Series(index).groupby(lab).transform("min").to_numpy()
        return pd.DataFrame({"x": pdf["x"], "y": pdf["y"], "z": pdf["z"], "local": first})

    kinds = dict(fg.dtypes)
    from voxelith.operators.graph import cut

    local = cut(rows.groupBy("_x", "_y", "_z").applyInPandas(_plain(run), ", ".join(f"{c} {kinds[c]}" for c in ("x", "y", "z")) + ", local long"))
    edge = F.lit(False)
    for a in ("x", "y", "z"):
        edge = edge | F.pmod(F.col(a), F.lit(size)).isin(0, size - 1)
    rim = local.where(edge)
    steps = [o for o in offsets(conn) if o > (0, 0, 0)]
    arr = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(c).alias("c")) for a, b, c in steps])
    out = rim.select("local", "x", "y", "z", F.explode(arr).alias("o")).select(F.col("local").alias("a"), (F.col("x") + F.col("o.a")).alias("x"), (F.col("y") + F.col("o.b")).alias("y"), (F.col("z") + F.col("o.c")).alias("z"))
    links = out.join(rim.select("x", "y", "z", F.col("local").alias("b")), ["x", "y", "z"]).where("a <> b").select("a", "b")
    roots = components(links)
    return local.join(roots, local["local"] == roots["node"], "left").select("x", "y", "z", F.coalesce("root", "local").alias("component"))


def component_sizes(comp: DataFrame, least: int = 1, top: int | None = None) -> DataFrame:
    sizes = comp.groupBy("component").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return sizes.orderBy(F.desc("n"), "component").limit(top) if top else sizes


def hysteresis(img: DataFrame, low: float, high: float, conn: int = 26, least: int = 1, count: int = 1) -> DataFrame:
    """Components of v >= low with at least ``count`` voxels of v >= high."""
    comp = connected_components(img.where(F.col("v") >= low), conn)
    keep = comp.join(img.where(F.col("v") >= low).select("x", "y", "z", "v"), ["x", "y", "z"]).groupBy("component").agg(F.count("*").alias("n"), F.count_if(F.col("v") >= high).alias("strong")).where((F.col("n") >= least) & (F.col("strong") >= count))
    return comp.join(keep.select("component"), "component", "left_semi").select("x", "y", "z", "component")
