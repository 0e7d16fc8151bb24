"""Composed jobs: fusion with cropping, segmentation, one propagation step, and the plans of some queries."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelith.functions import kernels as K
from voxelith.operators import tiles as T
from voxelith.operators import tracks as D
from voxelith.operators import voxel as V
from voxelith.operators.graph import cut
from voxelith.schemas import FRAME, XYZ
from voxelith.sources import images as I


def subtree_sizes(cells: DataFrame, edges: DataFrame) -> DataFrame:
    """Cells at and below each cell, level by level from the bottom: a level's sums go to its mothers."""
    last = cells.agg(F.max("t")).first()[0] or 0
    done = None
    for t in range(last, -1, -1):
        here = cells.where(F.col("t") == t).select("cell_id")
        if done is not None:
            below = edges.join(done.withColumnRenamed("cell_id", "child"), "child").groupBy("parent").agg(F.sum("n").alias("b"))
            level = here.join(below, here["cell_id"] == below["parent"], "left").select("cell_id", (F.lit(1) + F.coalesce("b", F.lit(0))).cast("long").alias("n"))
            done = cut(done.unionByName(level))
        else:
            done = cut(here.withColumn("n", F.lit(1).cast("long")))
    return done


def start_names(cells: DataFrame) -> DataFrame:
    """Names of the first cells of each customer's tree."""
    kids = cells.select("cust", (F.col("t") - 1).alias("t")).distinct()
    roots = cells.where("k = 1").join(kids, ["cust", "t"], "left_semi")
    above = cells.select("cust", (F.col("t") + 1).alias("t")).distinct()
    roots = roots.join(above, ["cust", "t"], "left_anti")
    return roots.select("cell_id", F.concat(F.when(F.col("cust") % 2 == 0, "a").otherwise("b"), F.lit("7."), F.lpad((F.col("cust") % 16 + 1).cast("string"), 4, "0"), F.lit("*")).alias("name"))


def fuse_and_crop(views: list[DataFrame], level: float, margin: int = 40) -> DataFrame:
    """Fused views, cropped to the largest component of the projection above its mean."""
    fused = cut(V.fuse([V.decay_mask(v, level, k % 2 == 1) for k, v in enumerate(views)]))
    mip = fused.groupBy("x", "y").agg(F.max("v").alias("v"))
    mean = mip.agg(F.avg("v").alias("m"))
    fg = mip.crossJoin(F.broadcast(mean)).where("v > m").select("x", "y", F.lit(0).alias("z"))
    comp = T.connected_components(fg, 8)
    best = T.component_sizes(comp, 1, 1)
    box = comp.join(F.broadcast(best.select("component")), "component").agg(*[e.alias(n) for a in ("x", "y") for e, n in ((F.min(a) - margin, f"{a}0"), (F.max(a) + margin, f"{a}1"))])
    return fused.crossJoin(F.broadcast(box)).where("x >= x0 AND x <= x1 AND y >= y0 AND y <= y1").select((F.col("x") - F.greatest("x0", F.lit(0))).alias("x"), (F.col("y") - F.greatest("y0", F.lit(0))).alias("y"), "z", "v")


def mars(img: DataFrame, sigma: float, h_min: float, sigma_ws: float) -> DataFrame:
    """Watershed of the smoothed image from its h-minima. One image a task."""

    def run(a: np.ndarray) -> np.ndarray:
        soft = np.round(K.gaussian(a, sigma)).astype(int)
        seeds = K.hysteresis(K.h_minima(soft, h_min), 1, h_min)
        if seeds.max() < 1:
            return np.ones(a.shape, int)
        return K.watershed(seeds, np.round(K.gaussian(a, sigma_ws)).astype(int))

    return T.per_image(img, run, "image_id", out="label int")


def watershed_query(lab: DataFrame) -> DataFrame:
    rows = lab.withColumn("image_id", F.lit(0)).withColumn("v", (F.col("v") * 1000 + F.when((F.col("x") % 8 == 4) & (F.col("y") % 8 == 4), F.col("label")).otherwise(0)))
    return T.per_image(rows, lambda a: K.watershed(a.astype(int) % 1000, a.astype(int) // 1000), "image_id", out="label int").drop("image_id")


def erode_until(mask: np.ndarray, times: int) -> np.ndarray:
    """Erosion with as many rounds as leave one component."""
    for k in range(times, -1, -1):
        m = mask.astype(np.int8)
        for _ in range(k):
            m = K.erode(m, V.offsets(6), 0)
        if m.any() and (k == 0 or K.label(m > 0, 26).max() == 1):
            return m > 0
    return mask


def propagate_step(img: DataFrame, seg: DataFrame, t: int, t2: int, hs: list[int], thau: int = 25, background: int = 1) -> DataFrame:
    """Segmentation of the next image from that of the last: per cell the h whose minima lie inside it, chosen over a falling sweep, then a watershed. Returns label rows with (parent, child) cell ids; one image pair a task."""
    both = img.join(seg, ["image_id", *XYZ])

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        a, lo = T.to_array(pdf, "v")
        old, _ = T.to_array(pdf, "label")
        sweep: dict[int, list[tuple[int, np.ndarray, list[int]]]] = {}
        for h in hs:
            seeds = K.hysteresis(K.h_minima(a.astype(int), h), 1, h)
            inside: dict[int, list[int]] = {}
            for s in range(1, int(seeds.max()) + 1):
                c = np.unique(old[seeds == s])
                if len(c) == 1:
                    inside.setdefault(int(c[0]), []).append(s)
            for c in np.unique(old):
                sweep.setdefault(int(c), []).append((h, seeds, inside.get(int(c), [])))
        new, label, made = np.zeros(a.shape, int), 2, []
        for c, rows in sorted(sweep.items()):
            n = [len(s) for *_, s in rows]
            wanted = 2 if n.count(2) * sum(k >= 2 for k in n) >= thau and 2 in n else next((k for k in (1, 2, 3) if k in n), 0)
            if c == background:
                new[erode_until(old == c, 1)] = 1
            elif wanted:
                _, seeds, own = rows[n.index(wanted)]
                for s in own[:2]:
                    new[seeds == s] = label
                    made.append((c, label))
                    label += 1
            else:
                new[erode_until(old == c, 1)] = label
                made.append((c, label))
                label += 1
        out = K.watershed(new, a.astype(int))
        parent = {b: c for c, b in made} | {1: background}
        at = pdf[["x", "y", "z"]].to_numpy(np.int64)
        got = out[tuple((at - lo).T)]
        return pd.DataFrame({"x": pdf["x"], "y": pdf["y"], "z": pdf["z"], "label": got.astype("int32"), "parent": [t * FRAME + parent[v] for v in got], "child": t2 * FRAME + got})

    run.__annotations__ = {}
    return both.groupBy("image_id").applyInPandas(run, "x long, y long, z int, label int, parent long, child long")


def match_query(img: DataFrame) -> DataFrame:
    from voxelith.operators.registration import block_match

    img = cut(img)
    m = block_match(img, img.withColumn("x", F.col("x") + 1), "translation", 4, 1, 0.75, 0.75, 3)
    return img.sparkSession.createDataFrame([(i, j, round(float(m[i, j]), 6)) for i in range(4) for j in range(4)], "i int, j int, v double")


def track_query(det: DataFrame) -> DataFrame:
    """Cheapest tracks inside each column of the field."""
    return D.cheapest_tracks_along(det, "x", "y", 2, 5.0)


def inr_round_trip(img: DataFrame) -> DataFrame:
    """Writes the image as an INR file's bytes and reads it again; voxels that the image lacks come back as 0 and are left out."""

    def read(batches):
        for pdf in batches:
            for content in pdf["content"]:
                a = I.read_inr(content).data
                x, y, z = np.nonzero(a)
                yield pd.DataFrame({"x": x, "y": y, "z": z.astype(np.int32), "v": a[x, y, z].astype(float)})

    return I.encode_images(img.withColumn("image_id", F.lit("vox"))).mapInPandas(read, "x long, y long, z int, v double")

