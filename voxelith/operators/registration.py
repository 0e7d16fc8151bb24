"""Block matching: block attributes and the best offset of each block are grouped aggregates; a fit needs a few sums; the loop is on the driver."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voxelith.functions import matrices as M
from voxelith.operators.voxel import resample
from voxelith.schemas import XYZ


def _block(size: int):
    return [F.expr(f"CAST(floor({a} / {size}) AS LONG)").alias(f"b{a}") for a in XYZ]


def block_attributes(img: DataFrame, size: int = 4) -> DataFrame:
    return img.groupBy(*_block(size)).agg(F.count("*").alias("n"), F.round(F.avg("v"), 6).alias("mean"), F.round(F.var_pop("v"), 6).alias("variance"))


def keep_blocks(blocks: DataFrame, fraction: float) -> DataFrame:
    """The given share of blocks with the largest variance."""
    total = blocks.agg(F.count("*").alias("_n"))
    ranked = blocks.crossJoin(F.broadcast(total)).withColumn("_r", F.row_number().over(W.orderBy(F.desc("variance"), "bx", "by", "bz")))
    return ranked.where(F.col("_r") <= F.floor(F.col("_n") * fraction)).drop("_r", "_n")


def pair_blocks(ref: DataFrame, flo: DataFrame, size: int = 4, reach: int = 3, step: int = 1) -> DataFrame:
    """For each block of ref the offset within ``reach`` with the largest squared correlation: bx, by, bz, dx, dy, dz, score. Ties go to the shortest, then first offset."""
    r = F.sequence(F.lit(-reach), F.lit(reach), F.lit(step))
    moved = ref.select(*XYZ, F.col("v").alias("a"), *_block(size)).withColumn("dx", F.explode(r)).withColumn("dy", F.explode(r)).withColumn("dz", F.explode(r))
    at = moved.select(*[(F.col(a) + F.col(f"d{a}")).alias(a) for a in XYZ], "a", *[f"b{a}" for a in XYZ], *[f"d{a}" for a in XYZ])
    both = at.join(flo.select(*XYZ, F.col("v").alias("b")), list(XYZ))
    s = both.groupBy("bx", "by", "bz", "dx", "dy", "dz").agg(F.count("*").alias("n"), *[F.sum(e).alias(k) for k, e in (("sa", F.col("a")), ("sb", F.col("b")), ("saa", F.col("a") * F.col("a")), ("sbb", F.col("b") * F.col("b")), ("sab", F.col("a") * F.col("b")))])
    cov, va, vb = F.col("n") * F.col("sab") - F.col("sa") * F.col("sb"), F.col("n") * F.col("saa") - F.col("sa") * F.col("sa"), F.col("n") * F.col("sbb") - F.col("sb") * F.col("sb")
    score = F.round(F.when((va > 0) & (vb > 0), cov * cov / (va.cast("double") * vb)).otherwise(0.0), 6)
    s = s.where(F.col("n") * 2 >= size**3 // 2).withColumn("score", score).withColumn("far", F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy") + F.col("dz") * F.col("dz"))
    best = s.groupBy("bx", "by", "bz").agg(F.max(F.struct("score", -F.col("far"), -F.col("dx"), -F.col("dy"), -F.col("dz"))).alias("m"))
    return best.select("bx", "by", "bz", (-F.col("m.col3")).alias("dx"), (-F.col("m.col4")).alias("dy"), (-F.col("m.col5")).alias("dz"), F.col("m.score").alias("score"))


def _sums(pairs: DataFrame):
    p, q = ["px", "py", "pz"], ["qx", "qy", "qz"]
    e = [F.sum(F.col("w")).alias("n")] + [F.sum(F.col("w") * F.col(c)).alias(f"s_{c}") for c in p + q] + [F.sum(F.col("w") * F.col(a) * F.col(b)).alias(f"s_{a}{b}") for a in p + q for b in p]
    r = pairs.agg(*e).first()
    get = lambda rows: np.array([r[f"s_{c}"] or 0.0 for c in rows], float)
    return float(r["n"] or 0), get(p), get(q), np.array([[r[f"s_{a}{b}"] or 0.0 for b in p] for a in p], float), np.array([[r[f"s_{a}{b}"] or 0.0 for b in p] for a in q], float)


def fit(pairs: DataFrame, kind: str = "affine", lts: float = 1.0, rounds: int = 100, tolerance: float = 1e-6) -> np.ndarray:
    """(Trimmed) weighted least squares from pairs (px, py, pz, qx, qy, qz, w): the smallest int(lts * n) residuals stay, until the matrix does."""
    pairs = pairs.cache()
    n = pairs.count()
    m = M.from_sums(*_sums(pairs), kind)
    for _ in range(rounds if lts < 1 and n else 0):
        res = F.lit(0.0)
        for k, a in enumerate("xyz"):
            res = res + F.pow(float(m[k, 0]) * F.col("px") + float(m[k, 1]) * F.col("py") + float(m[k, 2]) * F.col("pz") + float(m[k, 3]) - F.col(f"q{a}"), F.lit(2.0))
        kept = pairs.withColumn("_r", res).orderBy("_r", "px", "py", "pz").limit(max(4, int(lts * n)))
        new = M.from_sums(*_sums(kept), kind)
        done = abs(new - m).max() < tolerance
        m = new
        if done:
            break
    pairs.unpersist()
    return m


def block_match(ref: DataFrame, flo: DataFrame, kind: str = "affine", size: int = 4, reach: int = 3, fraction: float = 0.5, lts: float = 0.55, rounds: int = 10, voxel: float = 1.0) -> np.ndarray:
    """Transformation from ref to flo coordinates: resample, pair, fit, compose, until the corners move less than a third of a voxel."""
    dims = [int(x) for x in ref.agg(*[F.max(a) for a in XYZ]).first()]
    total = np.eye(4)
    kept = keep_blocks(block_attributes(ref, size), fraction).select("bx", "by", "bz")
    for _ in range(rounds):
        here = resample(flo, ref, total.ravel().tolist(), nearest=True)
        pairs = pair_blocks(ref, here, size, reach).join(kept, ["bx", "by", "bz"], "left_semi").where("score > 0")
        half = (size - 1) / 2
        pts = pairs.select(*[(F.col(f"b{a}") * size + half).alias(f"p{a}") for a in XYZ], *[(F.col(f"b{a}") * size + half + F.col(f"d{a}")).alias(f"q{a}") for a in XYZ], F.col("score").alias("w"))
        step = fit(pts, kind, lts)
        total = total @ step
        if M.displacement(step, dims) <= voxel / 3:
            break
    return total
