"""Stacks of images, seeds and components, parcels, daughters by distance, contacts, exterior correction and vector fields."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelith.operators.graph import components, cut
from voxelith.operators.voxel import adjacency, label_centroids, offsets, opening, scatter
from voxelith.schemas import XYZ

# --- stacks -------------------------------------------------------------------


def stack_filter(images: DataFrame, how: str = "median") -> DataFrame:
    """Per-voxel statistic over images (x, y, z, v), one row for each image and voxel."""
    fn = {"median": F.expr("percentile(v, 0.5)"), "mean": F.avg("v"), "min": F.min("v"), "max": F.max("v"), "std": F.stddev_pop("v")}[how]
    return images.groupBy(*XYZ).agg(F.round(fn, 6).alias("v"))


def robust_mean(images: DataFrame, trim: float = 0.25) -> DataFrame:
    """Mean of what is left after int(trim * n) values are cut from each end."""
    g = images.groupBy(*XYZ).agg(F.array_sort(F.collect_list(F.col("v").cast("double"))).alias("l"))
    k = F.floor(F.size("l") * trim).cast("int")
    kept = F.slice("l", k + 1, F.size("l") - 2 * k)
    return g.select(*XYZ, F.round(F.aggregate(kept, F.lit(0.0), lambda a, x: a + x) / F.size(kept), 6).alias("v"))


def zero_crossings(img: DataFrame) -> DataFrame:
    """Voxels that are positive with a neighbour of 6 that isn't."""
    base = img.select(*XYZ, "v")
    low = scatter(base, offsets(6), "v", own=False).groupBy(*XYZ).agg(F.min("v").alias("lo"))
    return base.where("v > 0").join(low, list(XYZ)).where("lo <= 0").select(*XYZ)


# --- components and seeds -------------------------------------------------------


def components_4d(fg: DataFrame, conn: int = 26) -> DataFrame:
    """t, x, y, z, component of foreground voxels over space and time: neighbours in space, and the same voxel in the next frame."""
    index = lambda: F.col("x") + F.shiftleft(F.col("y").cast("long"), 16) + F.shiftleft(F.col("z").cast("long"), 32) + F.shiftleft(F.col("t").cast("long"), 48)
    rows = cut(fg.select("t", *XYZ, index().alias("id")))
    steps = [(0, *o) for o in offsets(conn) if o > (0, 0, 0)] + [(1, 0, 0, 0)]
    arr = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip("tabc", s, strict=True)]) for s in steps])
    near = rows.select("id", "t", *XYZ, F.explode(arr).alias("o")).select(F.col("id").alias("a"), (F.col("t") + F.col("o.t")).alias("t"), (F.col("x") + F.col("o.a")).alias("x"), (F.col("y") + F.col("o.b")).alias("y"), (F.col("z") + F.col("o.c")).alias("z"))
    links = near.join(rows.withColumnRenamed("id", "b"), ["t", *XYZ]).select("a", "b")
    roots = components(links)
    return rows.join(roots, rows["id"] == roots["node"], "left").select("t", *XYZ, F.coalesce("root", "id").alias("component"))


def with_seeds(comp: DataFrame, seeds: DataFrame) -> DataFrame:
    """Components (x, y, z, component) that hold a seed voxel."""
    hit = comp.join(seeds.select(*XYZ).distinct(), list(XYZ), "left_semi").select("component").distinct()
    return comp.join(hit, "component", "left_semi").select(*XYZ, "component")


def new_labels(cells: DataFrame, first: int = 2) -> DataFrame:
    """Labels from ``first`` on for the seeds of cells (cell, n) in order of the cell: cell, label of its first seed, n. One row a cell is ordered."""
    from pyspark.sql import Window as W

    before = F.coalesce(F.sum("n").over(W.orderBy("cell").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return cells.select("cell", (F.lit(first) + before).cast("long").alias("label"), "n")


def parcels(mask: DataFrame, seeds: list[tuple[float, float, float]], rounds: int = 10) -> DataFrame:
    """Voxels by nearest centre (the first of equals), centres moved to their voxels' mean, until they stay. The number of centres is a parameter, so they travel as constants."""
    centres = list(seeds)
    while True:
        d = [F.struct((F.pow(F.col("x") - c[0], F.lit(2.0)) + F.pow(F.col("y") - c[1], F.lit(2.0)) + F.pow(F.col("z") - c[2], F.lit(2.0))).alias("d"), F.lit(k + 1).alias("k")) for k, c in enumerate(centres)]
        out = mask.select(*XYZ, F.array_min(F.array(*d))["k"].alias("label"))
        rows = {r["label"]: (r["x"], r["y"], r["z"]) for r in out.groupBy("label").agg(*[F.round(F.avg(a), 9).alias(a) for a in XYZ]).collect()}
        new = [rows.get(k + 1, c) for k, c in enumerate(centres)]
        rounds -= 1
        if new == centres or rounds <= 0:
            return out
        centres = new


# --- daughters and contacts -------------------------------------------------------


def distance(a: str, b: str):
    """Euclidean distance of centroids with prefixes a and b."""
    return F.sqrt(sum((F.pow(F.col(f"{a}c{k}") - F.col(f"{b}c{k}"), F.lit(2.0)) for k in XYZ), F.lit(0.0)))


def by_distance(cells: DataFrame, centroids: DataFrame, pole: tuple[float, float, float]) -> DataFrame:
    """Daughters (parent, label) in order of distance to a point: parent, label, rank, gap (difference of the pair's distances). On a tie the larger label is first."""
    from pyspark.sql import Window as W

    d = F.sqrt(sum((F.pow(F.col(f"c{k}") - float(p), F.lit(2.0)) for k, p in zip(XYZ, pole, strict=True)), F.lit(0.0)))
    rows = cells.join(centroids, "label").withColumn("d", F.round(d, 6))
    w = W.partitionBy("parent")
    return rows.select("parent", "label", F.row_number().over(w.orderBy("d", F.desc("label"))).alias("rank"), F.round(F.max("d").over(w) - F.min("d").over(w), 6).alias("gap"))


def pair_divisions(a: DataFrame, b: DataFrame) -> DataFrame:
    """Nearest pair between the daughters of two divisions (key, label, cx, cy, cz): key, a, b, d. Daughters are two at most on each side."""
    cols = [f"c{k}" for k in XYZ]
    left = a.select("key", F.col("label").alias("a"), *[F.col(c).alias(f"a{c}") for c in cols])
    right = b.select("key", F.col("label").alias("b"), *[F.col(c).alias(f"b{c}") for c in cols])
    near = left.join(right, "key").withColumn("d", F.round(distance("a", "b"), 6))
    return near.groupBy("key").agg(F.min(F.struct("d", "a", "b")).alias("m")).select("key", "m.a", "m.b", "m.d")


def midpoint(a: DataFrame, b: DataFrame) -> DataFrame:
    """Mean of two series of points (t, cx, cy, cz) by time; where one lacks a time the last known point stands in."""
    from pyspark.sql import Window as W

    cols = [f"c{k}" for k in XYZ]
    both = a.unionByName(b).groupBy("t").agg(*[F.avg(c).alias(c) for c in cols])
    w = W.orderBy("t").rowsBetween(W.unboundedPreceding, 0)  # one row a frame
    return both.select("t", *[F.round(F.last(c, ignorenulls=True).over(w), 6).alias(c) for c in cols])


def fusion_target(lab: DataFrame, candidates: DataFrame) -> DataFrame:
    """For pairs (give, get) of allowed targets, the one with the largest contact; a single one needs none."""
    adj = adjacency(lab, 26)
    both = adj.select("a", "b", "n").union(adj.select("b", "a", "n")).toDF("give", "get", "n")
    scored = candidates.select("give", "get").distinct().join(both, ["give", "get"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return scored.groupBy("give").agg(F.max_by("get", F.struct("n", -F.col("get"))).alias("get"), F.max("n").alias("n"))


def exterior_correction(lab: DataFrame, cells: DataFrame, radius: int = 2, background: int = 1) -> DataFrame:
    """Voxels of the given cells outside an opening of the foreground become background."""
    fg = lab.select(*XYZ, (F.col("label") != background).cast("int").alias("v"))
    kept = opening(fg, 6, radius).where("v = 1").select(*XYZ, F.lit(True).alias("_in"))
    marked = lab.join(kept, list(XYZ), "left").join(F.broadcast(cells.select("label", F.lit(True).alias("_c"))), "label", "left")
    return marked.select(*XYZ, F.when(F.col("_c") & F.col("_in").isNull(), F.lit(background)).otherwise(F.col("label")).alias("label"))


def lost_to(before: DataFrame, after: DataFrame, children: DataFrame) -> DataFrame:
    """For each mother (label) the label that took most of the voxels her daughters (mother, child) don't hold now: mother, label, n."""
    met = before.select(*XYZ, F.col("label").alias("mother")).join(after.select(*XYZ, "label"), list(XYZ)).groupBy("mother", "label").agg(F.count("*").alias("n"))
    lost = met.join(children.select("mother", F.col("child").alias("label")), ["mother", "label"], "left_anti")
    return lost.groupBy("mother").agg(F.max_by("label", F.struct("n", -F.col("label"))).alias("label"), F.max("n").alias("n"))


def match_volume(img: DataFrame, volume: int) -> DataFrame:
    """The largest threshold at or above which an image has at least so many voxels."""
    from pyspark.sql import Window as W

    h = img.groupBy("v").agg(F.count("*").alias("n"))
    return h.withColumn("above", F.sum("n").over(W.orderBy(F.desc("v")))).where(F.col("above") >= volume).agg(F.max("v").alias("threshold"))


# --- vector fields -------------------------------------------------------------------


def null_field(template: DataFrame) -> DataFrame:
    return template.select(*XYZ, *[F.lit(0.0).alias(f"d{a}") for a in XYZ])


def random_field(template: DataFrame, top: float = 1.0, seed: int = 0) -> DataFrame:
    """Uniform displacements that depend on the voxel and the seed alone, so a recomputed task gives them again."""
    u = lambda k: (F.pmod(F.xxhash64(*XYZ, F.lit(seed * 3 + k)), F.lit(1 << 40)) / float(1 << 40) * 2 - 1) * top
    return template.select(*XYZ, *[u(k).alias(f"d{a}") for k, a in enumerate(XYZ)])


def apply_field(img: DataFrame, field: DataFrame, value: str = "v") -> DataFrame:
    """Nearest values of img at p + d(p)."""
    at = field.select(*XYZ, *[F.floor(F.col(a) + F.col(f"d{a}") + 0.5).cast("long").alias(f"_{a}") for a in XYZ])
    src = img.select(*[F.col(a).cast("long").alias(f"_{a}") for a in XYZ], value)
    return at.join(src, [f"_{a}" for a in XYZ], "left").select(*XYZ, F.coalesce(value, F.lit(0)).alias(value))


def compose_fields(first: DataFrame, second: DataFrame) -> DataFrame:
    """p to p + second(p) + first at the voxel nearest to that."""
    at = second.select(*XYZ, *[F.col(f"d{a}").alias(f"e{a}") for a in XYZ], *[F.floor(F.col(a) + F.col(f"d{a}") + 0.5).cast("long").alias(f"_{a}") for a in XYZ])
    src = first.select(*[F.col(a).cast("long").alias(f"_{a}") for a in XYZ], *[f"d{a}" for a in XYZ])
    return at.join(src, [f"_{a}" for a in XYZ], "left").select(*XYZ, *[(F.col(f"e{a}") + F.coalesce(f"d{a}", F.lit(0.0))).alias(f"d{a}") for a in XYZ])


def inverse_field(field: DataFrame, rounds: int = 5) -> DataFrame:
    """g with g(p) = -d(p + g(p)), by repeated substitution."""
    out = null_field(field)
    for _ in range(rounds):
        there = compose_fields(field, out).select(*XYZ, *[F.col(f"d{a}").alias(f"s{a}") for a in XYZ])
        out = cut(out.join(there, list(XYZ)).select(*XYZ, *[(F.col(f"d{a}") - F.col(f"s{a}")).alias(f"d{a}") for a in XYZ]))
    return out


def centroids(lab: DataFrame) -> DataFrame:
    return label_centroids(lab)
