"""Detections and tracks."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


#: Ids of one place that stand together in a row at most; of a bucket that go with one part of the others.
CHUNK = 4096
#: Ids of one place in a row of the join of places: all pairs of two rows are in memory at once.
PIECE = 64


def _near_places(here: DataFrame, there: DataFrame, reach: float, depth: int, crowd: DataFrame | None = None) -> DataFrame:
    """Pairs of places (frame, x, y, and what else they have) with 1 <= dt <= depth frames and distance <= reach: an equi-join on frame and square buckets of four times ``reach``. A place of ``here`` goes to the buckets that it reaches. Columns of ``there`` have a 2 at the end. crowd: the points of ``there``, if what leaves is large: the rows of ``here`` that meet a crowded bucket are dealt over several keys, and the keys over many tasks, as Spark sees only what goes in."""
    side = 4 * reach
    b = lambda c: F.floor(c / side).cast("long")
    at, keys = {"_f": F.col("frame"), "_bx": b(F.col("x")), "_by": b(F.col("y"))}, ["_f", "_bx", "_by"]
    here = here.withColumn("dt", F.explode(F.sequence(F.lit(1), F.lit(depth)))).withColumn("_f", F.col("frame") + F.col("dt"))
    for a in ("x", "y"):
        # the next buckets where a bucket may be missed by rounding: the distance is tested all the same
        here = here.withColumn(f"_b{a}", F.explode(F.sequence(b(F.col(a) - 1.001 * reach), b(F.col(a) + 1.001 * reach))))
    there = there.withColumns(at).select(*[F.col(c).alias(f"{c}2") for c in there.columns], *keys)
    if crowd is not None:
        parts = F.broadcast(crowd.withColumns(at).groupBy(*keys).count().where(F.col("count") > CHUNK).select(*keys, F.ceil(F.col("count") / CHUNK).alias("_n")))
        n = F.coalesce("_n", F.lit(1))
        here = here.join(parts, keys, "left").withColumn("_s", F.pmod(F.xxhash64("ids"), n)).drop("_n")
        there = there.join(parts, keys, "left").withColumn("_s", F.explode(F.sequence(F.lit(0), n - 1))).drop("_n")
        spark, keys = crowd.sparkSession, [*keys, "_s"]
        tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 16 * spark.sparkContext.defaultParallelism)
        here, there = here.repartition(tasks, *keys), there.repartition(tasks, *keys)
    d2 = (F.col("x") - F.col("x2")) * (F.col("x") - F.col("x2")) + (F.col("y") - F.col("y2")) * (F.col("y") - F.col("y2"))
    return here.join(there, keys).withColumn("d2", d2).where(F.col("d2") <= reach * reach).drop(*keys)


def neighbours(det: DataFrame, reach: float, depth: int = 1) -> DataFrame:
    """Pairs (det_id, other, dt, d2) with 1 <= dt <= depth frames and distance <= reach. Places are joined, with the ids of each in rows of PIECE at most; pairs of ids are made only as they leave."""
    place = ["frame", "x", "y"]
    det = det.select("det_id", *place).dropna(subset=place)
    crowded = det.groupBy(*place).count().where(F.col("count") > CHUNK).select(*place, F.ceil(F.col("count") / CHUNK).alias("_n"))
    chunks = det.join(F.broadcast(crowded), place, "left").withColumn("_k", F.when(F.col("_n").isNull(), 0).otherwise(F.pmod(F.xxhash64("det_id"), F.coalesce("_n", F.lit(1)))))
    ids = F.transform(F.collect_list(F.struct("det_id")), lambda d: d["det_id"])  # keeps nulls
    chunks = chunks.groupBy(*place, "_k").agg(ids.alias("ids")).drop("_k")
    cut = F.transform(F.sequence(F.lit(0), F.floor((F.size("ids") - 1) / PIECE).cast("int")), lambda i: F.slice("ids", i * PIECE + 1, PIECE))
    pieces = chunks.withColumn("ids", F.explode(cut))
    pairs = _near_places(pieces, pieces, reach, depth, det).select("ids", "ids2", "dt", "d2")
    return pairs.select(F.explode("ids").alias("det_id"), "ids2", "dt", "d2").select("det_id", F.explode("ids2").alias("other"), "dt", "d2")


def link_nearest(det: DataFrame, reach: float, depth: int = 1) -> DataFrame:
    """Mutually nearest links: each detection's best later one (nearest in frames, then distance, then id), kept where it's also that one's best earlier one. Of the detections at one place only the first id can be the best, so places are joined."""
    place = ["frame", "x", "y"]
    det = det.select("det_id", *place).dropna(subset=place)
    firsts = det.groupBy(*place).agg(F.min("det_id").alias("first"))
    n = _near_places(firsts, firsts, reach, depth)
    # places are few, so both ways read one table of the nearest: by distance, then by id with nulls last
    best = lambda at, other: n.groupBy(*at).agg(F.min(F.struct("dt", "d2", F.col(other).isNull().alias("none"), F.col(other).alias("id"))).alias("m"))
    after = det.join(best(place, "first2"), place).groupBy("det_id").agg(F.min("m").alias("m")).select("det_id", F.col("m.id").alias("other"))
    back = best([f"{c}2" for c in place], "first").toDF(*place, "m")
    before = det.join(back, place).groupBy("det_id").agg(F.min("m").alias("m")).select(F.col("det_id").alias("other"), F.col("m.id").alias("det_id"))
    return after.join(before, ["det_id", "other"]).select("det_id", "other")


def chain(det: DataFrame, reach: float, depth: int = 1) -> DataFrame:
    """track_id (first detection), seq, det_id. Only linked detections go through the fixpoint."""
    from voxelith.operators.graph import cut, fixpoint_roots

    links = cut(link_nearest(det, reach, depth).select(F.col("other").alias("det_id"), F.col("det_id").alias("up")))
    found = fixpoint_roots(links.withColumn("seq", F.lit(1)), "det_id", "up", "seq")
    return det.select("det_id").join(found, "det_id", "left").select(F.coalesce("up", "det_id").alias("track_id"), F.coalesce("seq", F.lit(0)).alias("seq"), "det_id")


def properties(points: DataFrame, *by: str) -> DataFrame:
    """Lifetime, fly distance and path length of tracks (by, frame, x, y); of one frame's points the first id counts in order."""
    w = W.partitionBy(*by).orderBy("frame", "det_id")
    step = F.sqrt(F.pow(F.col("x") - F.lag("x").over(w), F.lit(2.0)) + F.pow(F.col("y") - F.lag("y").over(w), F.lit(2.0)))
    rows = points.withColumn("_step", step)
    ends = lambda f, c: f(c, F.struct("frame", "det_id"))
    g = rows.groupBy(*by).agg(F.count("*").alias("n"), (F.max("frame") - F.min("frame") + 1).alias("lifetime"), F.round(F.coalesce(F.sum("_step"), F.lit(0.0)), 4).alias("path"), ends(F.min_by, "x").alias("x0"), ends(F.min_by, "y").alias("y0"), ends(F.max_by, "x").alias("x1"), ends(F.max_by, "y").alias("y1"))
    fly = F.sqrt(F.pow(F.col("x1") - F.col("x0"), F.lit(2.0)) + F.pow(F.col("y1") - F.col("y0"), F.lit(2.0)))
    return g.select(*by, "n", "lifetime", "path", F.round(fly, 4).alias("fly"))


def colocalisation(a: DataFrame, b: DataFrame, reach: int) -> DataFrame:
    """Pairs (a, b, frame) of two series within reach in one frame."""
    bucket = lambda c: F.floor(F.col(c) / reach).cast("long")
    shift = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    left = a.select(F.col("det_id").alias("a"), "frame", "x", "y", F.explode(shift).alias("s")).withColumn("bx", bucket("x") + F.col("s.i")).withColumn("by", bucket("y") + F.col("s.j"))
    right = b.select(F.col("det_id").alias("b"), "frame", F.col("x").alias("x2"), F.col("y").alias("y2"), bucket("x").alias("bx"), bucket("y").alias("by"))
    return left.join(right, ["frame", "bx", "by"]).where((F.col("x") - F.col("x2")) * (F.col("x") - F.col("x2")) + (F.col("y") - F.col("y2")) * (F.col("y") - F.col("y2")) <= reach * reach).select("a", "b", "frame")


def segment_cost(links: DataFrame, img: DataFrame, samples: int = 5) -> DataFrame:
    """Mean image value along segments (link_id, x, y, x2, y2): nearest voxel at evenly spaced points; outside counts as 0."""
    k = F.explode(F.sequence(F.lit(0), F.lit(samples - 1))).alias("k")
    p = links.select("link_id", "x", "y", "x2", "y2", k).select("link_id", *[F.floor(F.col(a) + (F.col(f"{a}2") - F.col(a)) * F.col("k") / (samples - 1) + 0.5).cast("long").alias(a) for a in ("x", "y")])
    return p.join(img.groupBy("x", "y").agg(F.max("v").alias("v")), ["x", "y"], "left").groupBy("link_id").agg(F.round(F.avg(F.coalesce("v", F.lit(0))), 6).alias("mean"))


def peel(into: list[list[tuple[int, float]]], frames: list, queues: list[list], least: int = 2, most: int | None = None) -> list[list]:
    """Repeated cheapest path in one graph: the ids of each path, those of under ``least`` left out.

    Nodes are numbers; a node stands for the ids of its queue (ascending), which have the same links, and a path takes the first. into: (node before, cost) of each node; frames: the time of each. Ties go to the path's begin, else to the smallest id before; of path ends to the smallest id. Taking a path makes others dearer only, so just the nodes that were best reached over it are looked at again.
    """
    n = len(queues)
    out: list[list[int]] = [[] for _ in range(n)]
    for b, links in enumerate(into):
        for a in {a for a, _ in links}:
            out[a].append(b)
    at, cost, via = [0] * n, [0.0] * n, [-1] * n

    def look(b: int) -> None:
        best, first, node = 0.0, None, -1
        for a, c in into[b]:
            if at[a] < len(queues[a]):
                v = cost[a] + c
                if v < best or v == best and node >= 0 and queues[a][at[a]] < first:
                    best, first, node = v, queues[a][at[a]], a
        cost[b], via[b] = best, node

    for b in sorted(range(n), key=frames.__getitem__):
        look(b)
    ends = [(cost[k], queues[k][0], k) for k in range(n) if cost[k] < 0]
    heapq.heapify(ends)
    tracks: list[list] = []
    while ends and (most is None or len(tracks) < most):
        c, first, k = heapq.heappop(ends)
        if at[k] >= len(queues[k]) or queues[k][at[k]] != first or cost[k] != c:
            continue  # taken or dearer meanwhile; it was put in again then
        path = []
        while k >= 0:
            path.append(k)
            k = via[k]
        if len(path) >= least:
            tracks.append([queues[k][at[k]] for k in reversed(path)])
        todo: list = []
        waiting: set[int] = set()
        for k in path:
            at[k] += 1
            if at[k] < len(queues[k]) and cost[k] < 0:
                heapq.heappush(ends, (cost[k], queues[k][at[k]], k))
        for k in path:
            for b in out[k]:
                if via[b] == k and b not in waiting:
                    waiting.add(b)
                    heapq.heappush(todo, (frames[b], b))
        while todo:
            _, b = heapq.heappop(todo)
            if at[b] >= len(queues[b]):
                continue
            old = cost[b]
            look(b)
            if cost[b] != old:
                if cost[b] < 0:
                    heapq.heappush(ends, (cost[b], queues[b][at[b]], b))
                for d in out[b]:
                    if via[d] == b and d not in waiting:
                        waiting.add(d)
                        heapq.heappush(todo, (frames[d], d))
    return tracks


def _track_rows(key, by: str, tracks: list[list]) -> pd.DataFrame:
    rows = [(key[0], t, k, n) for t, ids in enumerate(tracks) for k, n in enumerate(ids)]
    return pd.DataFrame(rows, columns=[by, "track", "seq", "det_id"]).astype({"track": "int64", "seq": "int64", "det_id": "int64"})


def cheapest_tracks(links: DataFrame, by: str, least: int = 2, most: int | None = None) -> DataFrame:
    """Repeated cheapest path in each group's graph (by, frame, a, frame2, b, cost): paths with cost under 0 are taken out one by one until there is none, or ``most`` are found. One group a task."""

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        frame = dict(zip(pdf["a"], pdf["frame"], strict=True)) | dict(zip(pdf["b"], pdf["frame2"], strict=True))
        ids = sorted(frame)
        place = {n: k for k, n in enumerate(ids)}
        into: list[list[tuple[int, float]]] = [[] for _ in ids]
        for a, b, c in zip(pdf["a"], pdf["b"], pdf["cost"], strict=True):
            into[place[b]].append((place[a], c))
        return _track_rows(key, by, peel(into, [frame[n] for n in ids], [[n] for n in ids], least, most))

    run.__annotations__ = {}
    return links.groupBy(by).applyInPandas(run, f"{by} {dict(links.dtypes)[by]}, track long, seq long, det_id long")


def cheapest_tracks_along(det: DataFrame, by: str, along: str, reach: float, gain: float, least: int = 2, most: int | None = None) -> DataFrame:
    """cheapest_tracks of detections (det_id, frame, by, along) in groups of equal ``by``, with links to the next frame within reach along the other axis and squared distance - gain as cost. Links are between places and are found in the group's task, so there are no rows of links; the tracks are the same."""

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        groups = [(p, sorted(set(ids.tolist()))) for p, ids in pdf.groupby(["frame", along])["det_id"]]
        places, queues = [p for p, _ in groups], [ids for _, ids in groups]
        into: list[list[tuple[int, float]]] = [[] for _ in places]
        frames, at = np.array([p[0] for p in places]), np.array([p[1] for p in places])
        bounds = {f: (int(np.searchsorted(frames, f)), int(np.searchsorted(frames, f, "right"))) for f in np.unique(frames)}
        for f, (low, high) in bounds.items():
            before = bounds.get(f - 1)
            if before is None:
                continue
            own = at[before[0] : before[1]]
            lows, highs = np.searchsorted(own, at[low:high] - 1.001 * reach), np.searchsorted(own, at[low:high] + 1.001 * reach, "right")
            for b in range(low, high):
                for a in range(before[0] + int(lows[b - low]), before[0] + int(highs[b - low])):
                    d2 = (at[a] - at[b]) * (at[a] - at[b])
                    if d2 <= reach * reach:
                        into[b].append((a, float(d2 - gain)))
        return _track_rows(key, by, peel(into, frames.tolist(), queues, least, most))

    run.__annotations__ = {}
    rows = det.select("det_id", "frame", by, along).dropna()
    return rows.groupBy(by).applyInPandas(run, f"{by} {dict(det.dtypes)[by]}, track long, seq long, det_id long")


def weibull3(values: np.ndarray, n: int = 200) -> tuple[float, float, float]:
    """Shape, scale and weighted squared error of one Weibull distribution fitted on the cumulative by least squares over its linear form."""
    x = np.sort(values[values > 0])
    p = (np.arange(1, len(x) + 1) - 0.3) / (len(x) + 0.4)
    a, b = np.polyfit(np.log(x), np.log(-np.log(1 - p)), 1)
    scale = float(np.exp(-b / a))
    return float(a), scale, float(((1 - np.exp(-((x / scale) ** a)) - p) ** 2).mean())
