"""Voxel algebra, statistics, projections, histograms, windows, neighbourhoods and label operators over voxel rows.

All are plain DataFrame expressions. Image pairs meet in an equi-join on the
coordinates; a neighbourhood is a scatter (each voxel emits to its neighbours)
and one grouped aggregate, which sums map-side, not a self-join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voxelith.schemas import XYZ

# --- elementwise ------------------------------------------------------------


def threshold(img: DataFrame, low, high=None, binary: bool = True, top: int = 255) -> DataFrame:
    """Band threshold: low <= v <= high gives ``top`` (or v), else 0."""
    inside = F.col("v") >= low if high is None else F.col("v").between(low, high)
    return img.withColumn("v", F.when(inside, F.lit(top) if binary else F.col("v")).otherwise(F.lit(0)).cast(img.schema["v"].dataType))


def pair(a: DataFrame, b: DataFrame) -> DataFrame:
    """Voxel-aligned pair (v, w) of two images."""
    return a.select(*XYZ, "v").join(b.select(*XYZ, F.col("v").alias("w")), list(XYZ))


def algebra(a: DataFrame, b: DataFrame, op: str) -> DataFrame:
    ops = {"add": F.col("v") + F.col("w"), "sub": F.col("v") - F.col("w"), "mul": F.col("v") * F.col("w"), "min": F.least("v", "w"), "max": F.greatest("v", "w"), "div": F.when(F.col("w") == 0, 0.0).otherwise(F.col("v") / F.nullif(F.col("w"), F.lit(0))), "and": F.col("v").bitwiseAND(F.col("w")), "or": F.col("v").bitwiseOR(F.col("w")), "xor": F.col("v").bitwiseXOR(F.col("w"))}
    return pair(a, b).select(*XYZ, ops[op].alias("v"))


def mask(img: DataFrame, keep: DataFrame) -> DataFrame:
    """v where the mask has a voxel that isn't 0, else 0."""
    on = keep.where("v <> 0").select(*XYZ, F.lit(True).alias("_on"))
    return img.join(on, list(XYZ), "left").select(*XYZ, F.when(F.col("_on"), F.col("v")).otherwise(F.lit(0)).alias("v"))


def to_u8(img: DataFrame, plane: int, least: int = 0) -> DataFrame:
    """Clip to the 1st and 99th percentile of one plane's values from ``least`` on, and scale to 0..255."""
    cut = img.where((F.col("z") == plane) & (F.col("v") >= least)).agg(F.expr("percentile(v, array(0.01, 0.99))").alias("p")).select(F.col("p")[0].alias("lo"), F.col("p")[1].alias("hi"))
    clipped = F.least(F.greatest(F.col("v").cast("double"), "lo"), "hi")
    scaled = F.when(F.col("hi") > F.col("lo"), F.floor((clipped - F.col("lo")) * 255 / (F.col("hi") - F.col("lo")))).otherwise(F.lit(0))
    return img.crossJoin(F.broadcast(cut)).select(*XYZ, scaled.cast("int").alias("v"))  # cut is one row


def normalise(img: DataFrame, top: int = 255) -> DataFrame:
    """Minimum to 0, maximum to ``top``, rounded."""
    ends = img.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    return img.crossJoin(F.broadcast(ends)).select(*XYZ, F.when(F.col("hi") > F.col("lo"), F.floor((F.col("v") - F.col("lo")) * top / F.nullif(F.col("hi") - F.col("lo"), F.lit(0)) + 0.5)).otherwise(F.lit(0)).cast("int").alias("v"))


def inverse(img: DataFrame) -> DataFrame:
    ends = img.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    return img.crossJoin(F.broadcast(ends)).select(*XYZ, (F.col("hi") + F.col("lo") - F.col("v")).alias("v"))


def flip(img: DataFrame, axis: str, size: int) -> DataFrame:
    return img.withColumn(axis, F.lit(size - 1).cast(img.schema[axis].dataType) - F.col(axis))


def transpose(img: DataFrame, order: tuple[str, str, str]) -> DataFrame:
    return img.select(*[F.col(o).cast("long").alias(n) for n, o in zip(XYZ, order, strict=True)], *[c for c in img.columns if c not in XYZ])


def crop(img: DataFrame, box: dict[str, tuple[int, int]], shift: bool = True) -> DataFrame:
    """Voxels in half-open ranges by axis, moved to the origin."""
    out = img
    for axis, (lo, hi) in box.items():
        out = out.where((F.col(axis) >= lo) & (F.col(axis) < hi))
        if shift:
            out = out.withColumn(axis, F.col(axis) - F.lit(lo).cast(img.schema[axis].dataType))
    return out


def dilate_box(low: Column, high: Column, k: int, top: Column) -> tuple[Column, Column]:
    return F.greatest(low - k, F.lit(0)), F.least(high + k, top)


def grid(spark, nx: int, ny: int, nz: int) -> DataFrame:
    """All coordinates of a volume, made where they're used."""
    n = F.col("id")
    return spark.range(nx * ny * nz).select((n % nx).alias("x"), (F.expr(f"id div {nx}") % ny).alias("y"), F.expr(f"CAST(id div {nx * ny} AS INT)").alias("z"))


def checkerboard(spark, nx: int = 9, ny: int = 8, nz: int = 5, size: int = 10) -> DataFrame:
    parity = F.expr(f"(x div {size} + y div {size} + z div {size}) % 2")
    return grid(spark, nx * size, ny * size, nz * size).withColumn("v", parity.cast("int"))


def downsample(img: DataFrame, step: int) -> DataFrame:
    """Every step-th voxel in x and y."""
    return img.where((F.col("x") % step == 0) & (F.col("y") % step == 0)).select(F.expr(f"x div {step}").alias("x"), F.expr(f"y div {step}").alias("y"), "z", "v")


# --- statistics, projections, histograms -------------------------------------


def stats(img: DataFrame, *by: str) -> DataFrame:
    return img.groupBy(*by).agg(F.count("*").alias("n"), F.min("v").alias("v_min"), F.round(F.avg("v"), 6).alias("v_mean"), F.max("v").alias("v_max"), F.round(F.stddev_pop("v"), 6).alias("v_std"))


def mips(img: DataFrame, how: str = "max") -> DataFrame:
    """The three orthogonal projections in one pass: a null coordinate is the projected one."""
    img.createOrReplaceTempView("_mip")
    return img.sparkSession.sql(f"SELECT x, y, z, {how}(v) AS v FROM _mip GROUP BY GROUPING SETS ((x, y), (x, z), (y, z))")


def first_hit(img: DataFrame, least: int = 0) -> DataFrame:
    return img.where(F.col("v") > least).groupBy("x", "y").agg(F.min("z").alias("z"), F.min_by("v", "z").alias("v"))


def histogram(img: DataFrame, lo: float = 0, width: float = 1) -> DataFrame:
    """bin = int((v - lo) / width + 0.5)."""
    return img.groupBy(F.floor((F.col("v") - lo) / width + 0.5).cast("int").alias("bin")).agg(F.count("*").alias("n"))


def float_histogram(img: DataFrame, bins: int = 256) -> DataFrame:
    """Equal bins between minimum and maximum, the last one closed, with their centres."""
    ends = img.agg(F.min("v").cast("double").alias("lo"), F.max("v").cast("double").alias("hi"))
    b = F.least(F.floor((F.col("v") - F.col("lo")) * bins / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0))), F.lit(bins - 1))
    return img.crossJoin(F.broadcast(ends)).groupBy(F.coalesce(b, F.lit(0)).cast("int").alias("bin"), "lo", "hi").agg(F.count("*").alias("n")).select("bin", F.round(F.col("lo") + (F.col("bin") + 0.5) * (F.col("hi") - F.col("lo")) / bins, 6).alias("centre"), "n")


def joint_histogram(a: DataFrame, b: DataFrame, width: int = 1) -> DataFrame:
    return pair(a, b).groupBy(F.floor(F.col("v") / width).cast("int").alias("bin"), F.floor(F.col("w") / width).cast("int").alias("bin2")).agg(F.count("*").alias("n"))


def difference_histogram(joint: DataFrame) -> DataFrame:
    return joint.groupBy((F.col("bin2") - F.col("bin")).alias("bin")).agg(F.sum("n").alias("n"))


def cumulative(hist: DataFrame) -> DataFrame:
    """Running counts from below and above; a histogram has at most a row for each value."""
    up, down = W.orderBy("bin"), W.orderBy(F.desc("bin"))
    return hist.withColumn("below", F.sum("n").over(up)).withColumn("above", F.sum("n").over(down))


def pdf(hist: DataFrame) -> DataFrame:
    total = hist.agg(F.sum("n").alias("_all"))
    return hist.crossJoin(F.broadcast(total)).select("bin", F.round(F.col("n") / F.col("_all"), 9).alias("p"))


def otsu(hist: DataFrame) -> DataFrame:
    """The bin with the largest between-class variance, the first of equals. hist: (bin, n) of one image."""
    c = cumulative(hist.withColumn("m", F.col("n") * F.col("bin")))
    c = c.withColumn("s1", F.sum("m").over(W.orderBy("bin"))).withColumn("s2", F.sum("m").over(W.orderBy(F.desc("bin"))))
    nxt = W.orderBy("bin")
    c = c.withColumn("w2", F.lead("above").over(nxt)).withColumn("t2", F.lead("s2").over(nxt)).where("w2 IS NOT NULL")
    var = F.col("below") * F.col("w2") * F.pow(F.col("s1") / F.col("below") - F.col("t2") / F.col("w2"), F.lit(2.0))
    best = F.max_by("bin", F.struct(F.round("var", 3), -F.col("bin")))
    return c.withColumn("var", var).agg(best.alias("threshold"), F.round(F.max("var"), 3).alias("variance"))


def correlation(a: DataFrame, b: DataFrame) -> DataFrame:
    """Correlation r and mean squared difference. r is NaN where an image is constant, null where no voxel has both values."""
    v, w = (F.when(F.col("v").isNotNull() & F.col("w").isNotNull(), F.col(c)) for c in ("v", "w"))
    spread = F.stddev_pop(v) * F.stddev_pop(w)
    flat = (F.min(v) == F.max(v)) | (F.min(w) == F.max(w))
    r = F.when(flat, F.lit(float("nan"))).otherwise(F.covar_pop("v", "w") / F.nullif(spread, F.lit(0.0)))
    return pair(a, b).agg(F.round(r, 6).alias("r"), F.round(F.avg(F.pow(F.col("v") - F.col("w"), F.lit(2.0))), 6).alias("ssd"))


# --- windows along an axis ------------------------------------------------------


def moving(img: DataFrame, axis: str, radius: int, how: str) -> DataFrame:
    """Moving statistic over the rows within ``radius`` along an axis (by coordinate, so gaps are gaps)."""
    w = W.partitionBy(*[a for a in XYZ if a != axis]).orderBy(F.col(axis).cast("long")).rangeBetween(-radius, radius)
    fn = {"mean": F.avg, "min": F.min, "max": F.max, "std": F.stddev_pop, "median": lambda c: F.expr(f"percentile({c}, 0.5)"), "sum": F.sum}[how]
    return img.select(*XYZ, fn("v").over(w).alias("v"))


def decay_mask(img: DataFrame, level, reverse: bool = False, speed: float = 5.0) -> DataFrame:
    """Weight 0.1 + exp(-depth * speed / length): depth counts foreground along z, length is the largest depth."""
    order = F.col("z").desc() if reverse else F.col("z")
    depth = img.select(*XYZ, "v", F.sum((F.col("v") > level).cast("int")).over(W.partitionBy("x", "y").orderBy(order)).alias("depth"))
    length = depth.agg(F.max("depth").alias("_len"))
    return depth.crossJoin(F.broadcast(length)).select(*XYZ, "v", (0.1 + F.exp(-F.col("depth") * speed / F.greatest("_len", F.lit(1)))).alias("w"))


def fuse(views: list[DataFrame], exact: bool = True) -> DataFrame:
    """Weighted mean of views (x, y, z, v, w); truncated at the end, or term by term if not ``exact``."""
    every = views[0].select(*XYZ, "v", "w")
    for other in views[1:]:
        every = every.unionByName(other.select(*XYZ, "v", "w"))
    if exact:
        return every.groupBy(*XYZ).agg(F.floor(F.round(F.sum(F.col("v") * F.col("w")) / F.sum("w"), 6)).cast("int").alias("v"))
    total = every.groupBy(*XYZ).agg(F.collect_list(F.struct("v", "w")).alias("l"), F.sum("w").alias("s"))
    return total.select(*XYZ, F.expr("CAST(aggregate(l, 0L, (a, e) -> a + floor(round(e.v * e.w / s, 6))) AS INT)").alias("v"))


# --- neighbourhoods --------------------------------------------------------------


def offsets(conn: int) -> list[tuple[int, int, int]]:
    """Neighbours by connectivity: 4 and 8 in the plane, 10 is 8 with the two along z, 6, 18, 26 in space."""
    out = []
    for dz in (-1, 0, 1):
        for dy in (-1, 0, 1):
            for dx in (-1, 0, 1):
                n = abs(dx) + abs(dy) + abs(dz)
                if n and {4: n == 1 and not dz, 8: not dz, 10: not dz or n == 1, 6: n == 1, 18: n <= 2, 26: True}[conn]:
                    out.append((dx, dy, dz))
    return out


def ball(radius: int) -> list[tuple[int, int, int]]:
    r = range(-radius, radius + 1)
    return [(x, y, z) for z in r for y in r for x in r if 0 < x * x + y * y + z * z <= radius * radius]


def scatter(img: DataFrame, steps: list[tuple[int, int, int]], *values: str, own: bool = True) -> DataFrame:
    """Each voxel's values at each of its neighbours' coordinates."""
    every = [(0, 0, 0), *steps] if own else steps
    arr = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(c).alias("c")) for a, b, c in every])
    return img.select(*XYZ, *values, F.explode(arr).alias("_o")).select((F.col("x") + F.col("_o.a")).alias("x"), (F.col("y") + F.col("_o.b")).alias("y"), (F.col("z") + F.col("_o.c")).alias("z"), *values)


def neighbourhood(img: DataFrame, steps: list[tuple[int, int, int]], agg: Column, name: str = "v") -> DataFrame:
    """agg over each voxel's own and neighbouring v, for the image's own voxels."""
    marks = scatter(img, steps, "v").withColumn("_own", F.lit(0)).unionByName(img.select(*XYZ, F.lit(None).cast(img.schema["v"].dataType).alias("v"), F.lit(1).alias("_own")))
    return marks.groupBy(*XYZ).agg(agg.alias(name), F.max("_own").alias("_own")).where("_own = 1").drop("_own")


def dilate(img: DataFrame, conn: int = 6, times: int = 1) -> DataFrame:
    for _ in range(times):
        img = neighbourhood(img, offsets(conn), F.max("v"))
    return img


def erode(img: DataFrame, conn: int = 6, times: int = 1) -> DataFrame:
    for _ in range(times):
        img = neighbourhood(img, offsets(conn), F.min("v"))
    return img


def opening(img: DataFrame, conn: int = 6, times: int = 1) -> DataFrame:
    return dilate(erode(img, conn, times), conn, times)


def closing(img: DataFrame, conn: int = 6, times: int = 1) -> DataFrame:
    return erode(dilate(img, conn, times), conn, times)


def local_filter(img: DataFrame, steps: list[tuple[int, int, int]], how: str) -> DataFrame:
    fn = {"mean": F.avg("v"), "median": F.expr("percentile(v, 0.5)"), "std": F.stddev_pop("v"), "min": F.min("v"), "max": F.max("v")}[how]
    return neighbourhood(img, steps, F.round(fn, 6))


def gradient(img: DataFrame) -> DataFrame:
    """Norm of central differences; a missing neighbour counts as the voxel itself."""
    base = img.select(*XYZ, "v")
    sides = scatter(base, [(-1, 0, 0), (1, 0, 0), (0, -1, 0), (0, 1, 0), (0, 0, -1), (0, 0, 1)], "v", own=False)
    arr = [F.struct(F.lit(k).alias("k"), F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(c).alias("c")) for k, (a, b, c) in enumerate([(0, 0, 0), (-1, 0, 0), (1, 0, 0), (0, -1, 0), (0, 1, 0), (0, 0, -1), (0, 0, 1)])]
    sides = base.select(*XYZ, "v", F.explode(F.array(*arr)).alias("o")).select((F.col("x") + F.col("o.a")).alias("x"), (F.col("y") + F.col("o.b")).alias("y"), (F.col("z") + F.col("o.c")).alias("z"), "v", "o.k")
    g = sides.groupBy(*XYZ).agg(*[F.max(F.when(F.col("k") == k, F.col("v"))).alias(f"n{k}") for k in range(7)]).where("n0 IS NOT NULL")
    # the neighbour that emitted with -1 lies on the high side
    part = lambda hi, lo: F.pow((F.coalesce(hi, "n0") - F.coalesce(lo, "n0")) / 2.0, F.lit(2.0))
    return g.select(*XYZ, F.round(F.sqrt(part("n1", "n2") + part("n3", "n4") + part("n5", "n6")), 6).alias("v"))


# --- labels ------------------------------------------------------------------------


def label_volumes(lab: DataFrame) -> DataFrame:
    return lab.groupBy("label").agg(F.count("*").alias("volume"))


def label_boxes(lab: DataFrame) -> DataFrame:
    """Half-open bounding boxes."""
    return lab.groupBy("label").agg(*[e for a in XYZ for e in (F.min(a).alias(f"{a}0"), (F.max(a) + 1).alias(f"{a}1"))])


def label_centroids(lab: DataFrame) -> DataFrame:
    return lab.groupBy("label").agg(*[F.round(F.avg(a), 6).alias(f"c{a}") for a in XYZ], F.count("*").alias("volume"))


def label_stats(lab: DataFrame) -> DataFrame:
    return stats(lab, "label")


def relabel(lab: DataFrame, table: DataFrame) -> DataFrame:
    """table: (label, new_label); labels that it lacks stay."""
    return lab.join(table, "label", "left").withColumn("label", F.coalesce("new_label", "label")).drop("new_label")


def relabel_by_size(lab: DataFrame, background: int = 1) -> DataFrame:
    """Labels 1.. by decreasing volume, then by label. One row a label is ordered, not the voxels."""
    order = label_volumes(lab.where(F.col("label") != background)).select("label", F.row_number().over(W.orderBy(F.desc("volume"), "label")).alias("new_label"))
    return relabel(lab.where(F.col("label") != background), order)


def overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """Voxels in common by pair of labels."""
    return a.select(*XYZ, F.col("label").alias("a")).join(b.select(*XYZ, F.col("label").alias("b")), list(XYZ)).groupBy("a", "b").agg(F.count("*").alias("n"))


def dice(a: DataFrame, b: DataFrame) -> DataFrame:
    va, vb = label_volumes(a).select(F.col("label").alias("a"), F.col("volume").alias("va")), label_volumes(b).select(F.col("label").alias("b"), F.col("volume").alias("vb"))
    return overlap(a, b).join(va, "a").join(vb, "b").select("a", "b", "n", F.round(2.0 * F.col("n") / (F.col("va") + F.col("vb")), 6).alias("dice"))


def adjacency(lab: DataFrame, conn: int = 6) -> DataFrame:
    """Pairs of touching labels a < b with the number of touching voxel pairs."""
    half = [o for o in offsets(conn) if o > (0, 0, 0)]
    other = lab.select(*XYZ, F.col("label").alias("b"))
    met = scatter(lab.select(*XYZ, F.col("label").alias("a")), half, "a", own=False).join(other, list(XYZ)).where("a <> b")
    return met.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.count("*").alias("n"))


def dominant_neighbour(lab: DataFrame, conn: int = 6, background: int = 1) -> DataFrame:
    """For each label the neighbour, background left out, with the largest contact; the smaller label of equals."""
    adj = adjacency(lab, conn)
    both = adj.select("a", "b", "n").union(adj.select("b", "a", "n")).toDF("label", "other", "n").where((F.col("label") != background) & (F.col("other") != background))
    return both.groupBy("label").agg(F.max_by("other", F.struct("n", -F.col("other"))).alias("other"), F.max("n").alias("n"))


def borders(lab: DataFrame, conn: int = 6, junction: int = 2) -> DataFrame:
    """Voxels with at least ``junction`` labels among their own and their neighbours'."""
    img = lab.select(*XYZ, F.col("label").alias("v"))
    seen = neighbourhood(img, offsets(conn), F.count_distinct("v"), "labels")
    return seen.where(F.col("labels") >= junction)


def contained_seeds(seeds: DataFrame, cells: DataFrame) -> DataFrame:
    """Seeds (label, not 0) that lie in exactly one cell: seed, cell, volume."""
    met = seeds.where("label <> 0").select(*XYZ, F.col("label").alias("seed")).join(cells.select(*XYZ, F.col("label").alias("cell")), list(XYZ))
    return met.groupBy("seed").agg(F.min("cell").alias("cell"), F.max("cell").alias("_hi"), F.count("*").alias("volume")).where("cell = _hi").drop("_hi")


def insert_on_background(a: DataFrame, b: DataFrame, background: int = 1) -> DataFrame:
    """Labels of b where a is background."""
    return a.select(*XYZ, F.col("label").alias("_a")).join(b.select(*XYZ, F.col("label").alias("_b")), list(XYZ)).select(*XYZ, F.when(F.col("_a") == background, F.col("_b")).otherwise(F.col("_a")).alias("label"))


def extract_under(lab: DataFrame, img: DataFrame) -> DataFrame:
    """For each label the mask value under it, 255 where there are several."""
    met = lab.select(*XYZ, "label").join(img.where("v <> 0").select(*XYZ, F.col("v").alias("m")), list(XYZ))
    return met.groupBy("label").agg(F.when(F.min("m") == F.max("m"), F.min("m")).otherwise(F.lit(255)).alias("m"))


# --- resampling ----------------------------------------------------------------------


def _point(m: list[float], row: int) -> Column:
    a, b, c, d = m[4 * row : 4 * row + 4]
    return F.col("x") * float(a) + F.col("y") * float(b) + F.col("z") * float(c) + float(d)


def resample(img: DataFrame, template: DataFrame, matrix: list[float], nearest: bool = True, value: str = "v") -> DataFrame:
    """Values of img at matrix * p for every voxel p of template (the transformation goes from result to input)."""
    at = template.select(*XYZ, *[_point(matrix, k).alias(f"_{a}") for k, a in enumerate(XYZ)])
    if nearest:
        near = at.select(*XYZ, *[F.floor(F.col(f"_{a}") + 0.5).cast("long").alias(f"_{a}") for a in XYZ])
        src = img.select(*[F.col(a).cast("long").alias(f"_{a}") for a in XYZ], value)
        return near.join(src, [f"_{a}" for a in XYZ], "left").select(*XYZ, F.coalesce(value, F.lit(0)).alias(value))
    corner = F.array(*[F.struct(F.lit(i & 1).alias("i"), F.lit(i >> 1 & 1).alias("j"), F.lit(i >> 2).alias("k")) for i in range(8)])
    c = at.select("*", F.explode(corner).alias("c"))
    weight = F.lit(1.0)
    cols = []
    for a, n in zip(XYZ, "ijk", strict=True):
        low = F.floor(F.col(f"_{a}"))
        part = F.col(f"_{a}") - low
        weight = weight * F.when(F.col(f"c.{n}") == 1, part).otherwise(1 - part)
        cols.append((low + F.col(f"c.{n}")).cast("long").alias(f"q{a}"))
    src = img.select(*[F.col(a).cast("long").alias(f"q{a}") for a in XYZ], value)
    return c.select(*XYZ, *cols, weight.alias("_w")).where("_w > 0").join(src, [f"q{a}" for a in XYZ], "left").groupBy(*XYZ).agg(F.round(F.sum(F.coalesce(F.col(value), F.lit(0)) * F.col("_w")), 6).alias(value))
