"""Registered queries over the test relations, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voxelith.functions import kernels as K
from voxelith.functions import matrices as M
from voxelith.operators import lineage as L
from voxelith.operators import registration as R
from voxelith.operators import stacks as S
from voxelith.operators import tiles as T
from voxelith.operators import tracks as D
from voxelith.operators import voxel as V
from voxelith.plans import pipeline as P
from voxelith.plans.views import ctes, view
from voxelith.schemas import XYZ

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, needs: str, build: Callable[..., DataFrame], sql: str | None = None) -> None:
    """Registers build(*views); sql comes after the views' CTEs."""
    names = needs.split()
    QUERIES[name] = lambda spark, sf_dir: build(*[view(spark, sf_dir, n) for n in names])
    if sql:
        ORACLES[name] = f"{ctes(*names)} {sql}" if not sql.startswith(",") else f"{ctes(*names)}{sql}"


N6 = "(VALUES (0,0,0),(1,0,0),(-1,0,0),(0,1,0),(0,-1,0),(0,0,1),(0,0,-1)) o(dx,dy,dz)"


def _spread(src: str, agg: str, steps: str = N6, value: str = "v") -> str:
    return f"SELECT p.x, p.y, p.z, {agg} AS v FROM {src} p, {steps} JOIN {src} q ON q.x = p.x + dx AND q.y = p.y + dy AND q.z = p.z + dz GROUP BY 1, 2, 3"


# --- voxel algebra
query("label_volumes", "lab", V.label_volumes, "SELECT label, count(*) AS volume FROM lab GROUP BY label")
query("threshold", "vox", lambda a: V.threshold(a, 25), "SELECT x, y, z, CASE WHEN v >= 25 THEN 255 ELSE 0 END AS v FROM vox")
query("threshold_band_grey", "vox", lambda a: V.threshold(a, 10, 30, False), "SELECT x, y, z, CASE WHEN v BETWEEN 10 AND 30 THEN v ELSE 0 END AS v FROM vox")
_other = lambda a: V.flip(a, "x", 32)
_osql = "(SELECT 31 - x AS x, y, z, v FROM vox)"
for _op, _e in {"add": "a.v + b.v", "sub": "a.v - b.v", "min": "least(a.v, b.v)", "max": "greatest(a.v, b.v)", "mul": "a.v * b.v", "and": "a.v & b.v", "or": "a.v | b.v", "xor": "xor(a.v, b.v)"}.items():
    query(f"image_{_op}", "vox", lambda a, op=_op: V.algebra(a, _other(a), op), f"SELECT a.x, a.y, a.z, {_e} AS v FROM vox a JOIN {_osql} b ON a.x = b.x AND a.y = b.y AND a.z = b.z")
query("image_divide", "vox", lambda a: V.algebra(a, _other(a), "div").withColumn("v", F.round("v", 6)), f"SELECT a.x, a.y, a.z, round(CASE WHEN b.v = 0 THEN 0 ELSE a.v / b.v END, 6) AS v FROM vox a JOIN {_osql} b ON a.x = b.x AND a.y = b.y AND a.z = b.z")
query("image_mask", "vox", lambda a: V.mask(a, V.threshold(_other(a), 25)), f"SELECT a.x, a.y, a.z, CASE WHEN b.v >= 25 THEN a.v ELSE 0 END AS v FROM vox a LEFT JOIN {_osql} b ON a.x = b.x AND a.y = b.y AND a.z = b.z")
query("to_u8", "vox", lambda a: V.to_u8(a, 2), ", c AS (SELECT quantile_cont(v, 0.01) AS lo, quantile_cont(v, 0.99) AS hi FROM vox WHERE z = 2) SELECT x, y, z, CAST(floor((least(greatest(CAST(v AS DOUBLE), lo), hi) - lo) * 255 / (hi - lo)) AS INT) AS v FROM vox, c")
query("normalise", "vox", V.normalise, ", c AS (SELECT min(v) AS lo, max(v) AS hi FROM vox) SELECT x, y, z, CAST(floor((v - lo) * 255 / (hi - lo) + 0.5) AS INT) AS v FROM vox, c")
query("inverse_image", "vox", V.inverse, ", c AS (SELECT min(v) + max(v) AS s FROM vox) SELECT x, y, z, s - v AS v FROM vox, c")
query("flip_x", "vox", _other, "SELECT 31 - x AS x, y, z, v FROM vox")
query("transpose", "vox", lambda a: V.transpose(a, ("y", "z", "x")), "SELECT y AS x, CAST(z AS BIGINT) AS y, x AS z, v FROM vox")
query("crop_box", "vox", lambda a: V.crop(a, {"x": (4, 20), "y": (2, 30), "z": (1, 5)}), "SELECT x - 4 AS x, y - 2 AS y, CAST(z - 1 AS INT) AS z, v FROM vox WHERE x BETWEEN 4 AND 19 AND y BETWEEN 2 AND 29 AND z BETWEEN 1 AND 4")
query("downsample", "vox", lambda a: V.downsample(a, 2), "SELECT x // 2 AS x, y // 2 AS y, z, v FROM vox WHERE x % 2 = 0 AND y % 2 = 0")
query("relabel_lut", "lab", lambda a: V.relabel(a.select(*XYZ, "label"), a.select("label").where("label % 2 = 0").distinct().withColumn("new_label", (F.col("label") + 100).cast("int"))), "SELECT x, y, z, CASE WHEN label % 2 = 0 THEN label + 100 ELSE label END AS label FROM lab")
query("relabel_by_size", "lab", lambda a: V.relabel_by_size(a).select(*XYZ, "label"), ", s AS (SELECT label, row_number() OVER (ORDER BY count(*) DESC, label) AS k FROM lab WHERE label <> 1 GROUP BY label) SELECT x, y, z, CAST(k AS INT) AS label FROM lab JOIN s USING (label)")
query("cell_id_codec", "cells", lambda c: L.decode(c).withColumn("again", L.encode(F.col("t"), F.col("nu"))), "SELECT cell_id, CAST(cell_id // 10000 AS INT) AS t, CAST(cell_id % 10000 AS INT) AS nu, cell_id AS again FROM cells")
QUERIES["checkerboard"] = lambda spark, d: V.checkerboard(spark, 3, 3, 2, 4)
ORACLES["checkerboard"] = "SELECT i % 12 AS x, i // 12 % 12 AS y, CAST(i // 144 AS INT) AS z, CAST((i % 12 // 4 + i // 12 % 12 // 4 + i // 144 // 4) % 2 AS INT) AS v FROM range(1152) r(i)"

# --- aggregates
query("image_stats", "vox", V.stats, "SELECT count(*) AS n, min(v) AS v_min, round(avg(v), 6) AS v_mean, max(v) AS v_max, round(stddev_pop(v), 6) AS v_std FROM vox")
query("label_stats", "lab", V.label_stats, "SELECT label, count(*) AS n, min(v) AS v_min, round(avg(v), 6) AS v_mean, max(v) AS v_max, round(stddev_pop(v), 6) AS v_std FROM lab GROUP BY label")
query("label_boxes", "lab", V.label_boxes, "SELECT label, min(x) AS x0, max(x) + 1 AS x1, min(y) AS y0, max(y) + 1 AS y1, min(z) AS z0, max(z) + 1 AS z1 FROM lab GROUP BY label")
query("label_boxes_dilated", "lab", lambda a: V.label_boxes(a).select("label", *[c.alias(n) for ax in XYZ for c, n in zip(V.dilate_box(F.col(f"{ax}0"), F.col(f"{ax}1"), 2, F.lit(32)), (f"{ax}0", f"{ax}1"), strict=True)]), "SELECT label, greatest(min(x) - 2, 0) AS x0, least(max(x) + 3, 32) AS x1, greatest(min(y) - 2, 0) AS y0, least(max(y) + 3, 32) AS y1, greatest(min(z) - 2, 0) AS z0, least(max(z) + 3, 32) AS z1 FROM lab GROUP BY label")
query("label_centroids", "lab", V.label_centroids, "SELECT label, round(avg(x), 6) AS cx, round(avg(y), 6) AS cy, round(avg(z), 6) AS cz, count(*) AS volume FROM lab GROUP BY label")
query("n_labels", "lab", lambda a: a.agg(F.count_distinct("label").alias("n"), F.max("label").alias("top")), "SELECT count(DISTINCT label) AS n, max(label) AS top FROM lab")
query("bounding_box", "vox", lambda a: a.where("v > 40").agg(*[e for ax in XYZ for e in (F.min(ax).alias(f"{ax}0"), F.max(ax).alias(f"{ax}1"))]), "SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, min(z) AS z0, max(z) AS z1 FROM vox WHERE v > 40")
for _how in ("max", "min"):
    query(f"mips_{_how}", "vox", lambda a, how=_how: V.mips(a, how), f"SELECT x, y, z, {_how}(v) AS v FROM vox GROUP BY GROUPING SETS ((x, y), (x, z), (y, z))")
query("first_hit", "vox", lambda a: V.first_hit(a, 30), "SELECT x, y, min(z) AS z, arg_min(v, z) AS v FROM vox WHERE v > 30 GROUP BY 1, 2")
query("histogram", "vox", lambda a: V.histogram(a, 1, 2), "SELECT CAST(floor((v - 1) / 2 + 0.5) AS INT) AS bin, count(*) AS n FROM vox GROUP BY 1")
query("float_histogram", "vox", lambda a: V.float_histogram(a, 16), ", c AS (SELECT CAST(min(v) AS DOUBLE) AS lo, CAST(max(v) AS DOUBLE) AS hi FROM vox) SELECT CAST(least(floor((v - lo) * 16 / (hi - lo)), 15) AS INT) AS bin, round(any_value(lo) + (least(floor((v - lo) * 16 / (hi - lo)), 15) + 0.5) * (any_value(hi) - any_value(lo)) / 16, 6) AS centre, count(*) AS n FROM vox, c GROUP BY least(floor((v - lo) * 16 / (hi - lo)), 15)")
query("joint_histogram", "vox", lambda a: V.joint_histogram(a, _other(a), 5), f"SELECT CAST(floor(a.v / 5) AS INT) AS bin, CAST(floor(b.v / 5) AS INT) AS bin2, count(*) AS n FROM vox a JOIN {_osql} b ON a.x = b.x AND a.y = b.y AND a.z = b.z GROUP BY 1, 2")
query("difference_histogram", "vox", lambda a: V.difference_histogram(V.joint_histogram(a, _other(a))), f"SELECT b.v - a.v AS bin, count(*) AS n FROM vox a JOIN {_osql} b ON a.x = b.x AND a.y = b.y AND a.z = b.z GROUP BY 1")
query("masked_histogram", "lab", lambda a: V.histogram(a.where("label = 6")), "SELECT v AS bin, count(*) AS n FROM lab WHERE label = 6 GROUP BY 1")
query("cumulative_histogram", "vox", lambda a: V.cumulative(V.histogram(a)), ", h AS (SELECT v AS bin, count(*) AS n FROM vox GROUP BY 1) SELECT bin, n, CAST(sum(n) OVER (ORDER BY bin) AS BIGINT) AS below, CAST(sum(n) OVER (ORDER BY bin DESC) AS BIGINT) AS above FROM h")
query("pdf_histogram", "vox", lambda a: V.pdf(V.histogram(a)), "SELECT v AS bin, round(count(*) / (SELECT count(*) FROM vox), 9) AS p FROM vox GROUP BY 1")
query("otsu_threshold", "vox", lambda a: V.otsu(V.histogram(a)), """, h AS (SELECT v AS bin, count(*) AS n FROM vox GROUP BY 1), c AS (SELECT a.bin, (SELECT sum(n) FROM h WHERE bin <= a.bin) AS w1, (SELECT sum(n) FROM h WHERE bin > a.bin) AS w2, (SELECT sum(n * bin) FROM h WHERE bin <= a.bin) AS s1, (SELECT sum(n * bin) FROM h WHERE bin > a.bin) AS s2 FROM h a),
 e AS (SELECT bin, round(CAST(w1 AS DOUBLE) * w2 * pow(s1 / w1 - s2 / w2, 2), 3) AS var FROM c WHERE w2 IS NOT NULL) SELECT min(bin) AS threshold, max(var) AS variance FROM e WHERE var = (SELECT max(var) FROM e)""")
query("image_correlation", "vox", lambda a: V.correlation(a, _other(a)), f"SELECT round(corr(a.v, b.v), 6) AS r, round(avg((a.v - b.v) * (a.v - b.v)), 6) AS ssd FROM vox a JOIN {_osql} b ON a.x = b.x AND a.y = b.y AND a.z = b.z")

# --- windows
for _how, _f in {"mean": "round(avg(v) OVER w, 6)", "min": "min(v) OVER w", "max": "max(v) OVER w", "median": "quantile_cont(v, 0.5) OVER w"}.items():
    query(f"moving_{_how}", "vox", lambda a, how=_how: V.moving(a, "x", 2, how).withColumn("v", F.round("v", 6) if how == "mean" else F.col("v")), f"SELECT x, y, z, {_f} AS v FROM vox WINDOW w AS (PARTITION BY y, z ORDER BY x RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING)")
query("decay_mask", "vox", lambda a: V.decay_mask(a, 25).select(*XYZ, F.round("w", 6).alias("w")), ", d AS (SELECT x, y, z, sum(CASE WHEN v > 25 THEN 1 ELSE 0 END) OVER (PARTITION BY x, y ORDER BY z) AS k FROM vox) SELECT x, y, z, round(0.1 + exp(-k * 5.0 / (SELECT max(k) FROM d)), 6) AS w FROM d")
_fused = ", d AS (SELECT x, y, z, v, sum(CASE WHEN v > 25 THEN 1 ELSE 0 END) OVER (PARTITION BY x, y ORDER BY z) AS k, sum(CASE WHEN v > 25 THEN 1 ELSE 0 END) OVER (PARTITION BY x, y ORDER BY z DESC) AS k2 FROM vox), w AS (SELECT x, y, z, v, 0.1 + exp(-k * 5.0 / (SELECT max(k) FROM d)) AS a FROM d UNION ALL SELECT 31 - x, y, z, v, 0.1 + exp(-k2 * 5.0 / (SELECT max(k2) FROM d)) FROM d)"
query("weighted_fusion", "vox", lambda a: V.fuse([V.decay_mask(a, 25), _other(V.decay_mask(a, 25, True))]), f"{_fused} SELECT x, y, z, CAST(floor(round(sum(v * a) / sum(a), 6)) AS INT) AS v FROM w GROUP BY 1, 2, 3")
query("weighted_fusion_truncated", "vox", lambda a: V.fuse([V.decay_mask(a, 25), _other(V.decay_mask(a, 25, True))], False), f"{_fused}, s AS (SELECT x, y, z, sum(a) AS s FROM w GROUP BY 1, 2, 3) SELECT w.x, w.y, w.z, CAST(sum(floor(round(v * a / s, 6))) AS INT) AS v FROM w JOIN s USING (x, y, z) GROUP BY 1, 2, 3")

# --- neighbourhoods and labels
query("dilation_6", "vox", V.dilate, _spread("vox", "max(q.v)"))
query("erosion_6", "vox", V.erode, _spread("vox", "min(q.v)"))
_n26 = "(SELECT a.i - 1 AS dx, b.i - 1 AS dy, c.i - 1 AS dz FROM range(3) a(i), range(3) b(i), range(3) c(i)) o"
query("dilation_26", "vox", lambda a: V.dilate(a, 26), _spread("vox", "max(q.v)", _n26))
query("opening_6", "vox", V.opening, f", e AS ({_spread('vox', 'min(q.v)')}) {_spread('e', 'max(q.v)')}")
query("closing_6", "vox", V.closing, f", e AS ({_spread('vox', 'max(q.v)')}) {_spread('e', 'min(q.v)')}")
query("mean_filter_26", "vox", lambda a: V.local_filter(a, V.offsets(26), "mean"), _spread("vox", "round(avg(q.v), 6)", _n26))
query("median_filter_26", "vox", lambda a: V.local_filter(a, V.offsets(26), "median"), _spread("vox", "round(quantile_cont(q.v, 0.5), 6)", _n26))
query("stddev_filter_26", "vox", lambda a: V.local_filter(a, V.offsets(26), "std"), _spread("vox", "round(stddev_pop(q.v), 6)", _n26))
query("gradient_norm", "vox", V.gradient, "SELECT p.x, p.y, p.z, round(sqrt(pow((coalesce(a.v, p.v) - coalesce(b.v, p.v)) / 2.0, 2) + pow((coalesce(c.v, p.v) - coalesce(d.v, p.v)) / 2.0, 2) + pow((coalesce(e.v, p.v) - coalesce(f.v, p.v)) / 2.0, 2)), 6) AS v FROM vox p LEFT JOIN vox a ON a.x = p.x + 1 AND a.y = p.y AND a.z = p.z LEFT JOIN vox b ON b.x = p.x - 1 AND b.y = p.y AND b.z = p.z LEFT JOIN vox c ON c.x = p.x AND c.y = p.y + 1 AND c.z = p.z LEFT JOIN vox d ON d.x = p.x AND d.y = p.y - 1 AND d.z = p.z LEFT JOIN vox e ON e.x = p.x AND e.y = p.y AND e.z = p.z + 1 LEFT JOIN vox f ON f.x = p.x AND f.y = p.y AND f.z = p.z - 1")
query("label_borders", "lab", V.borders, f"SELECT p.x, p.y, p.z, count(DISTINCT q.label) AS labels FROM lab p, {N6} JOIN lab q ON q.x = p.x + dx AND q.y = p.y + dy AND q.z = p.z + dz GROUP BY 1, 2, 3 HAVING count(DISTINCT q.label) >= 2")
query("label_junctions", "lab", lambda a: V.borders(a, 6, 3), f"SELECT p.x, p.y, p.z, count(DISTINCT q.label) AS labels FROM lab p, {N6} JOIN lab q ON q.x = p.x + dx AND q.y = p.y + dy AND q.z = p.z + dz GROUP BY 1, 2, 3 HAVING count(DISTINCT q.label) >= 3")
_adj = "adj AS (SELECT least(p.label, q.label) AS a, greatest(p.label, q.label) AS b, count(*) AS n FROM lab p, (VALUES (1,0,0),(0,1,0),(0,0,1)) o(dx,dy,dz) JOIN lab q ON q.x = p.x + dx AND q.y = p.y + dy AND q.z = p.z + dz WHERE p.label <> q.label GROUP BY 1, 2)"
query("label_adjacency", "lab", V.adjacency, f", {_adj} SELECT * FROM adj")
query("dominant_neighbour", "lab", V.dominant_neighbour, f", {_adj}, t AS (SELECT a AS label, b AS other, n FROM adj UNION ALL SELECT b, a, n FROM adj) SELECT label, other, n FROM t WHERE label <> 1 AND other <> 1 QUALIFY row_number() OVER (PARTITION BY label ORDER BY n DESC, other) = 1")
query("seed_containment", "lab lab2", lambda a, b: V.contained_seeds(b.where("label > 1 AND (label % 2 = 0 OR (x + 1) % 8 BETWEEN 2 AND 5)"), a), "SELECT b.label AS seed, min(a.label) AS cell, count(*) AS volume FROM lab2 b JOIN lab a ON a.x = b.x AND a.y = b.y AND a.z = b.z WHERE b.label > 1 AND (b.label % 2 = 0 OR (b.x + 1) % 8 BETWEEN 2 AND 5) GROUP BY 1 HAVING min(a.label) = max(a.label)")
query("label_overlap", "lab lab2", V.overlap, "SELECT a.label AS a, b.label AS b, count(*) AS n FROM lab a JOIN lab2 b ON a.x = b.x AND a.y = b.y AND a.z = b.z GROUP BY 1, 2")
query("dice", "lab lab2", V.dice, ", o AS (SELECT a.label AS a, b.label AS b, count(*) AS n FROM lab a JOIN lab2 b ON a.x = b.x AND a.y = b.y AND a.z = b.z GROUP BY 1, 2) SELECT a, b, n, round(2.0 * n / ((SELECT count(*) FROM lab WHERE label = a) + (SELECT count(*) FROM lab2 WHERE label = b)), 6) AS dice FROM o")
query("insert_on_background", "lab lab2", V.insert_on_background, "SELECT a.x, a.y, a.z, CASE WHEN a.label = 1 THEN b.label ELSE a.label END AS label FROM lab a JOIN lab2 b ON a.x = b.x AND a.y = b.y AND a.z = b.z")
query("extract_under_mask", "lab", lambda a: V.extract_under(a, a.select(*XYZ, F.when(F.col("v") > 45, (F.col("x") % 3).cast("int")).otherwise(0).alias("v"))), ", m AS (SELECT label, CASE WHEN v > 45 THEN CAST(x % 3 AS INT) ELSE 0 END AS m FROM lab) SELECT label, CASE WHEN min(m) = max(m) THEN min(m) ELSE 255 END AS m FROM m WHERE m <> 0 GROUP BY 1")
query("image_setop", "lab lab2", lambda a, b: a.where("label <> 1").select(*XYZ).exceptAll(b.where("label <> 1").select(*XYZ)), "SELECT x, y, z FROM lab WHERE label <> 1 EXCEPT SELECT x, y, z FROM lab2 WHERE label <> 1")
query("resample_nearest", "vox", lambda a: V.resample(a, a, [1, 0, 0, 2, 0, 1, 0, -1, 0, 0, 1, 0]), "SELECT p.x, p.y, p.z, coalesce(q.v, 0) AS v FROM vox p LEFT JOIN vox q ON q.x = p.x + 2 AND q.y = p.y - 1 AND q.z = p.z")
query("resample_linear", "vox", lambda a: V.resample(a, a, [1, 0, 0, 0.5, 0, 1, 0, 0.25, 0, 0, 1, 0], False), "SELECT p.x, p.y, p.z, round(0.375 * coalesce(a.v, 0) + 0.375 * coalesce(b.v, 0) + 0.125 * coalesce(c.v, 0) + 0.125 * coalesce(d.v, 0), 6) AS v FROM vox p LEFT JOIN vox a ON a.x = p.x AND a.y = p.y AND a.z = p.z LEFT JOIN vox b ON b.x = p.x + 1 AND b.y = p.y AND b.z = p.z LEFT JOIN vox c ON c.x = p.x AND c.y = p.y + 1 AND c.z = p.z LEFT JOIN vox d ON d.x = p.x + 1 AND d.y = p.y + 1 AND d.z = p.z")

# --- lineage
query("inverse_tree", "edges", lambda e: e.select("child", "parent"), "SELECT child, parent FROM edges")
query("lineage_leaves", "edges", L.leaves, "SELECT child AS cell_id FROM edges EXCEPT SELECT parent FROM edges")
query("lineage_roots", "edges", L.roots, "SELECT parent AS cell_id FROM edges EXCEPT SELECT child FROM edges")
query("lineage_before", "edges", lambda e: L.before(e, 2), "SELECT parent, child, ord FROM edges WHERE parent // 10000 < 2")
query("out_degrees", "edges", lambda e: L.degrees(e).select("parent", "n_children", F.array_join("children", ",").alias("children")), "SELECT parent, CAST(count(*) AS INT) AS n_children, string_agg(CAST(child AS VARCHAR), ',' ORDER BY ord) AS children FROM edges GROUP BY 1")
query("sisters", "edges", L.sisters, "SELECT a.child AS cell_id, b.child AS sister FROM edges a JOIN edges b USING (parent) WHERE a.child <> b.child")
_chain = ", n AS (SELECT parent FROM edges GROUP BY 1 HAVING count(*) = 1), single AS (SELECT child, parent FROM edges JOIN n USING (parent)), r(cell_id, chain_id, place) AS (SELECT cell_id, cell_id, 0 FROM cells WHERE cell_id NOT IN (SELECT child FROM single) UNION ALL SELECT s.child, r.chain_id, r.place + 1 FROM r JOIN single s ON s.parent = r.cell_id)"
query("undivided_chains", "edges cells", lambda e, c: L.chains(e, c).select("cell_id", "chain_id", "place"), f"{_chain} SELECT cell_id, chain_id, place FROM r")
query("chain_volume_series", "edges cells", L.chain_volumes, f"{_chain} SELECT chain_id, place, cell_id, CAST(coalesce(lag(volume) OVER (PARTITION BY chain_id ORDER BY place), volume) AS BIGINT) AS series, CAST(count(*) OVER (PARTITION BY chain_id) AS INT) AS length FROM r JOIN cells USING (cell_id)")
query("sister_correlation", "edges cells", L.sister_correlation, f"{_chain}, s AS (SELECT chain_id, place, coalesce(lag(volume) OVER (PARTITION BY chain_id ORDER BY place), volume) AS series, count(*) OVER (PARTITION BY chain_id) AS length FROM r JOIN cells USING (cell_id)), p AS (SELECT a.child AS cell_id, b.child AS sister FROM edges a JOIN edges b USING (parent) WHERE a.child < b.child) SELECT cell_id, sister, CAST(count(*) AS INT) AS n, CASE WHEN stddev_samp(a.series) * stddev_samp(b.series) = 0 THEN NULL ELSE round(covar_samp(a.series, b.series) / (stddev_samp(a.series) * stddev_samp(b.series)), 6) END AS r FROM p JOIN s a ON a.chain_id = cell_id JOIN s b ON b.chain_id = sister AND a.place = b.place WHERE a.place < least(a.length, b.length) - 1 GROUP BY 1, 2")
query("branches_to_delete", "edges cells", lambda e, c: L.branches_to_delete(e, c, 50_000, 4, 3).select("chain_id", "leaf", "length"), f"{_chain}, s AS (SELECT chain_id, place, cell_id, coalesce(lag(volume) OVER (PARTITION BY chain_id ORDER BY place), volume) AS series, count(*) OVER (PARTITION BY chain_id) AS length FROM r JOIN cells USING (cell_id)), p AS (SELECT a.child AS cell_id, b.child AS sister FROM edges a JOIN edges b USING (parent) WHERE a.child <> b.child), q AS (SELECT p.cell_id AS chain_id, CASE WHEN stddev_samp(a.series) * stddev_samp(b.series) = 0 THEN NULL ELSE round(covar_samp(a.series, b.series) / (stddev_samp(a.series) * stddev_samp(b.series)), 6) END AS r FROM p JOIN s a ON a.chain_id = p.cell_id JOIN s b ON b.chain_id = sister AND a.place = b.place WHERE a.place < least(a.length, b.length) - 1 GROUP BY 1) SELECT e.chain_id, e.cell_id AS leaf, CAST(length AS INT) AS length FROM s e JOIN cells USING (cell_id) LEFT JOIN q ON q.chain_id = e.chain_id WHERE place = length - 1 AND e.cell_id IN (SELECT child FROM edges) AND e.cell_id NOT IN (SELECT parent FROM edges) AND (t < 4 OR volume < 50000) AND (length < 3 OR r < -0.9)")
query("volume_audit", "edges cells", L.volume_audit, ", s AS (SELECT parent, CAST(sum(volume) AS BIGINT) AS daughters FROM edges JOIN cells ON child = cell_id GROUP BY 1) SELECT parent, volume, daughters, round(1 - volume / daughters, 6) AS ratio, CASE WHEN 1 - volume / daughters > 0.1 THEN 'bigger' WHEN 1 - volume / daughters < -0.5 THEN 'to_look_at' WHEN 1 - volume / daughters < -0.1 THEN 'lower' ELSE 'conserved' END AS verdict FROM s JOIN cells ON parent = cell_id")
query("fuse_targets", "edges", lambda e: L.fuse_targets(e.groupBy("child").agg(F.min("parent").alias("get")).withColumnRenamed("child", "give")), ", m AS (SELECT child AS give, min(parent) AS get FROM edges GROUP BY 1), r(give, get, steps) AS (SELECT give, get, 1 FROM m UNION ALL SELECT r.give, m.get, r.steps + 1 FROM r JOIN m ON m.give = r.get) SELECT give, arg_max(get, steps) AS get, CAST(max(steps) AS INT) AS steps FROM r GROUP BY 1")
query("fused_volumes", "cells edges", lambda c, e: L.apply_fusion(c, e, L.sisters(e).where("cell_id > sister").toDF("give", "get"))[0], ", m AS (SELECT a.child AS give, min(b.child) AS get FROM edges a JOIN edges b USING (parent) WHERE a.child > b.child GROUP BY 1) SELECT coalesce(get, cell_id) AS cell_id, CAST(sum(volume) AS BIGINT) AS volume FROM cells LEFT JOIN m ON give = cell_id GROUP BY 1")
query("subtree_sizes", "cells edges", lambda c, e: P.subtree_sizes(c, e), ", r(anc, cell_id) AS (SELECT cell_id, cell_id FROM cells UNION ALL SELECT r.anc, e.child FROM r JOIN edges e ON e.parent = r.cell_id) SELECT anc AS cell_id, count(*) AS n FROM r GROUP BY 1")
query("choose_h", "vox", lambda a: L.choose_h(a.select(F.col("x").alias("cell"), (18 - 2 * F.col("z")).alias("h"), (F.col("v") % 4).alias("n")), 25), ", s AS (SELECT x AS cell, CAST(18 - 2 * z AS INT) AS h, v % 4 AS n FROM vox), g AS (SELECT cell, count(*) FILTER (n = 2) * count(*) FILTER (n >= 2) AS score, max(h) FILTER (n = 1) AS h1, max(h) FILTER (n = 2) AS h2, max(h) FILTER (n = 3) AS h3 FROM s GROUP BY 1) SELECT cell, score, CASE WHEN score >= 25 AND h2 IS NOT NULL THEN 2 WHEN h1 IS NOT NULL THEN 1 WHEN h2 IS NOT NULL THEN 2 WHEN h3 IS NOT NULL THEN 3 ELSE 0 END AS seeds, CASE WHEN score >= 25 AND h2 IS NOT NULL THEN h2 ELSE coalesce(h1, h2, h3, 0) END AS h FROM g")
query("name_propagation", "edges cells", lambda e, c: L.name_propagation(e, P.start_names(c), e.select("child", F.col("ord").alias("rank")).limit(0)).select("cell_id", "name"), ", n AS (SELECT parent, count(*) AS k FROM edges GROUP BY 1), r(cell_id, a, gen, num) AS (SELECT cell_id, CASE WHEN cust % 2 = 0 THEN 'a' ELSE 'b' END, 7, CAST(cust % 16 + 1 AS INT) FROM cells WHERE cell_id IN (SELECT parent FROM edges) AND cell_id NOT IN (SELECT child FROM edges) UNION ALL SELECT e.child, r.a, CASE WHEN n.k > 1 THEN gen + 1 ELSE gen END, CASE WHEN n.k > 1 THEN 2 * num - 2 + e.ord ELSE num END FROM r JOIN edges e ON e.parent = r.cell_id JOIN n ON n.parent = r.cell_id) SELECT cell_id, a || gen || '.' || lpad(CAST(num AS VARCHAR), 4, '0') || '*' AS name FROM r")
_names = lambda e, c: L.name_propagation(e, P.start_names(c), e.select("child", F.col("ord").alias("rank")).limit(0))


def _fates(table: dict) -> str:
    rows = ", ".join(f"('{n}', '{f}')" for f, (names, _) in table.items() for n in names)
    short = lambda a, gen, num: f"{a} || {gen} || '.' || lpad(CAST({num} AS VARCHAR), 4, '0')"
    gen, num = "CASE WHEN n.k > 1 THEN gen + 1 ELSE gen END", "CASE WHEN n.k > 1 THEN 2 * num - 2 + e.ord ELSE num END"
    return (
        f", n AS (SELECT parent, count(*) AS k FROM edges GROUP BY 1), f(short, fate) AS (VALUES {rows}), s AS (SELECT cell_id, CASE WHEN cust % 2 = 0 THEN 'a' ELSE 'b' END AS a, 7 AS gen, CAST(cust % 16 + 1 AS INT) AS num FROM cells WHERE cell_id IN (SELECT parent FROM edges) AND cell_id NOT IN (SELECT child FROM edges)), "
        f"r(cell_id, a, gen, num, fate) AS (SELECT cell_id, a, gen, num, fate FROM s LEFT JOIN f ON short = {short('a', 'gen', 'num')} UNION ALL SELECT e.child, r.a, {gen}, {num}, coalesce(r.fate, f.fate) FROM r JOIN edges e ON e.parent = r.cell_id JOIN n ON n.parent = r.cell_id LEFT JOIN f ON short = {short('r.a', '(' + gen + ')', '(' + num + ')')}) SELECT cell_id, fate FROM r WHERE fate IS NOT NULL"
    )


query("fate_map", "edges cells", lambda e, c: L.fate_map(e, _names(e, c)), _fates(L.FATES))
query("fate_map_fine", "edges cells", lambda e, c: L.fate_map(e, _names(e, c), L.FINE_FATES), _fates(L.FINE_FATES))
query("format_names", "edges cells", lambda e, c: _names(e, c).select("cell_id", L.pad_name(F.regexp_replace("name", r"\.0*", ".")).alias("name")), ORACLES["name_propagation"].replace("lpad(CAST(num AS VARCHAR), 4, '0')", "right('00' || num, 3)").removeprefix(ctes("edges", "cells")))
query("times_named", "cells", lambda c: c.select("t").distinct().select("t", L.times_named(F.lit("d_t$A_t$B.inr"), "$A", F.col("t"), "$B", F.col("t") + 1).alias("name")), "SELECT DISTINCT t, 'd_t' || right('00' || t, 3) || '_t' || right('00' || (t + 1), 3) || '.inr' AS name FROM cells")
query("tlp_rows", "edges cells", L.tlp_rows, """SELECT 1 AS part, cell_id, CAST(0 AS BIGINT) AS other, '(nodes ' || cell_id || ')' AS line FROM cells UNION ALL SELECT 2, parent, child, '(edge ' || parent || ' ' || child || ')' FROM edges UNION ALL SELECT 3, cell_id, 0, '(node ' || cell_id || ' "' || cell_id || '")' FROM cells""")
query("time_named", "cells", lambda c: c.select("t").distinct().select("t", L.time_named(F.lit("Fused_t$TIME.inr"), F.col("t")).alias("name")), "SELECT DISTINCT t, 'Fused_t' || right('00' || t, 3) || '.inr' AS name FROM cells")

# --- components, reconstruction, kernels
_index = "x + (y << 21) + (CAST(z AS BIGINT) << 42)"


def _components(fg: str, steps: str) -> str:
    """CTE cc (x, y, z, root): the smallest index of each foreground voxel's component; rounds hand smaller roots to neighbours."""
    return f"fg AS ({fg}), cc(x, y, z, root) USING KEY (x, y, z) AS (SELECT x, y, z, {_index} FROM fg UNION SELECT q.x, q.y, q.z, min(p.root) FROM cc p, {steps} JOIN recurring.cc q ON q.x = p.x + dx AND q.y = p.y + dy AND q.z = p.z + dz WHERE p.root < q.root GROUP BY 1, 2, 3)"


_one = lambda a: a.withColumn("image_id", F.lit(0))
_grid = "grid AS (SELECT CAST(a.i AS BIGINT) AS x, CAST(b.i AS BIGINT) AS y, CAST(c.i AS INT) AS z, coalesce(v, 0) AS v FROM range((SELECT min(x) FROM vox), (SELECT max(x) + 1 FROM vox)) a(i), range((SELECT min(y) FROM vox), (SELECT max(y) + 1 FROM vox)) b(i), range(CAST((SELECT min(z) FROM vox) AS BIGINT), CAST((SELECT max(z) + 1 FROM vox) AS BIGINT)) c(i) LEFT JOIN vox ON x = a.i AND y = b.i AND z = c.i)"


def _convolved(orders: tuple[int, int, int], name: str, sigma: float = 1.0) -> str:
    """CTEs of the grid convolved along x, y and z with gaussian derivatives; borders repeat the edge."""
    out, src = [], "grid"
    for axis, order in zip(XYZ, orders, strict=True):
        w = K.gaussian_weights(sigma, order)
        rows = ", ".join(f"({k - len(w) // 2}, {x!r}::DOUBLE)" for k, x in enumerate(w[::-1].tolist()))
        at = " AND ".join(f"q.{a} = " + (f"least(greatest(p.{a} + o, (SELECT min({a}) FROM grid)), (SELECT max({a}) FROM grid))" if a == axis else f"p.{a}") for a in XYZ)
        out.append(f"{name}{axis} AS (SELECT p.x, p.y, p.z, sum(w * q.v) AS v FROM {src} p, (VALUES {rows}) k(o, w) JOIN {src} q ON {at} GROUP BY 1, 2, 3)")
        src = f"{name}{axis}"
    return ", ".join(out)


def _derived(order: int, value: str) -> str:
    axes = [tuple(order * (k == a) for k in range(3)) for a in range(3)]
    return f", {_grid}, {', '.join(_convolved(o, n) for o, n in zip(axes, ('ga', 'gb', 'gc'), strict=True))} SELECT x, y, z, round({value}, 6) AS v FROM gaz JOIN gbz USING (x, y, z) JOIN gcz USING (x, y, z) JOIN vox USING (x, y, z)"


def _reconstructed(img: str) -> str:
    return f", {_grid}, img AS (SELECT x, y, z, {img} AS v FROM grid), r(x, y, z, v, j) USING KEY (x, y, z) AS (SELECT x, y, z, v, greatest(0, v - 4) FROM img UNION SELECT q.x, q.y, q.z, q.v, least(q.v, max(p.j)) FROM r p, {_n26} JOIN recurring.r q ON q.x = p.x + dx AND q.y = p.y + dy AND q.z = p.z + dz WHERE least(q.v, p.j) > q.j GROUP BY 1, 2, 3, 4) SELECT x, y, z, CAST(r.v - r.j AS INT) AS v FROM r JOIN vox USING (x, y, z)"


query("connected_components_6", "vox", lambda a: T.connected_components(a.where("v >= 40"), 6, 16), f", {_components('SELECT x, y, z FROM vox WHERE v >= 40', N6)} SELECT x, y, z, root AS component FROM cc")
query("connected_components_26", "vox", lambda a: T.connected_components(a.where("v >= 49"), 26, 16), f", {_components('SELECT x, y, z FROM vox WHERE v >= 49', _n26)} SELECT x, y, z, root AS component FROM cc")
query("largest_components", "vox", lambda a: T.component_sizes(T.connected_components(a.where("v >= 49"), 26, 16), 2, 10), f", {_components('SELECT x, y, z FROM vox WHERE v >= 49', _n26)} SELECT root AS component, count(*) AS n FROM cc GROUP BY 1 HAVING count(*) >= 2 ORDER BY n DESC, component LIMIT 10")
query("hysteresis", "vox", lambda a: T.hysteresis(a, 49, 50, 26), f", {_components('SELECT x, y, z FROM vox WHERE v >= 49', _n26)} SELECT x, y, z, root AS component FROM cc WHERE root IN (SELECT root FROM cc JOIN vox USING (x, y, z) WHERE v >= 50)")
query("h_maxima", "vox", lambda a: T.per_image(_one(a), lambda b: K.h_maxima(b.astype(int), 4), "image_id", out="v int").drop("image_id"), _reconstructed("v"))
query("h_minima", "vox", lambda a: T.per_image(_one(a), lambda b: K.h_minima(b.astype(int), 4), "image_id", out="v int").drop("image_id"), _reconstructed("(SELECT max(v) FROM grid) - v"))
query("chamfer_distance", "vox", lambda a: T.per_image(_one(a), lambda b: np.round(K.chamfer(b >= 50), 6), "image_id").drop("image_id"), f", {_grid}, cc(x, y, z, d) USING KEY (x, y, z) AS (SELECT x, y, z, CASE WHEN v >= 50 THEN 0.0::DOUBLE ELSE 1e9 END FROM grid UNION SELECT q.x, q.y, q.z, min(p.d + sqrt(dx * dx + dy * dy + dz * dz)) FROM cc p, {_n26} JOIN recurring.cc q ON q.x = p.x + dx AND q.y = p.y + dy AND q.z = p.z + dz WHERE p.d < 1e9 AND p.d + sqrt(dx * dx + dy * dy + dz * dz) < q.d - 1e-9 GROUP BY 1, 2, 3) SELECT x, y, z, round(cc.d, 6) AS v FROM cc JOIN vox USING (x, y, z)")
query("influence_zones", "lab", lambda a: T.per_image(_one(a.withColumn("v", F.when(F.col("label") == 1, 0).otherwise(F.col("label")))), K.skiz, "image_id", out="v int").drop("image_id"), f", vox2 AS (SELECT x, y, z, CASE WHEN label = 1 THEN 0 ELSE label END AS v FROM lab), {_grid.replace('FROM vox', 'FROM vox2').replace('JOIN vox ', 'JOIN vox2 ')}, s(x, y, z, m) USING KEY (x, y, z) AS (SELECT x, y, z, CASE WHEN v > 0 THEN {{'d': 0.0::DOUBLE, 'l': v}} ELSE {{'d': 1e18::DOUBLE, 'l': 0}} END FROM grid UNION SELECT q.x, q.y, q.z, min({{'d': round(p.m.d + sqrt(dx * dx + dy * dy + dz * dz), 9), 'l': p.m.l}}) FROM s p, {_n26} JOIN recurring.s q ON q.x = p.x + dx AND q.y = p.y + dy AND q.z = p.z + dz WHERE p.m.d < 1e18 AND {{'d': round(p.m.d + sqrt(dx * dx + dy * dy + dz * dz), 9), 'l': p.m.l}} < q.m GROUP BY 1, 2, 3) SELECT x, y, z, CAST(s.m.l AS INT) AS v FROM s JOIN vox2 USING (x, y, z)")
query("watershed", "lab", lambda a: P.watershed_query(a), None)
query("gaussian_filter", "vox", lambda a: T.gaussian(a, 1.0, 16), f", {_grid}, {_convolved((0, 0, 0), 'a')} SELECT x, y, z, round(az.v, 6) AS v FROM az JOIN vox USING (x, y, z)")
query("gradient_modulus", "vox", lambda a: T.per_tile(a, lambda b: np.round(K.gradient_modulus(b, 1.0), 6), 16, 5), _derived(1, "sqrt(gaz.v * gaz.v + gbz.v * gbz.v + gcz.v * gcz.v)"))
query("laplacian", "vox", lambda a: T.per_tile(a, lambda b: np.round(K.laplacian(b, 1.0), 6), 16, 5), _derived(2, "gaz.v + gbz.v + gcz.v"))
query("fill_holes", "vox", lambda a: T.per_image(_one(a), lambda b: K.fill_holes(b >= 12).astype(int), "image_id", out="v int").drop("image_id"), f", {_grid}, bg AS (SELECT x, y, z FROM grid WHERE v < 12), o(x, y, z) AS (SELECT x, y, z FROM bg WHERE " + " OR ".join(f"{a} IN ((SELECT min({a}) FROM grid), (SELECT max({a}) FROM grid))" for a in XYZ) + f" UNION SELECT q.x, q.y, q.z FROM o AS p, {N6.replace('o(', 'k(')} JOIN bg q ON q.x = p.x + dx AND q.y = p.y + dy AND q.z = p.z + dz) SELECT x, y, z, CAST((x, y, z) NOT IN (SELECT (x, y, z) FROM o) AS INT) AS v FROM vox")
query("thinning", "vox", lambda a: T.per_image(_one(a), lambda b: K.thin(b >= 12).astype(int), "image_id", out="v int").drop("image_id"), None)
query("geodesic_snake", "vox", lambda a: T.per_image(_one(a), lambda b: K.geodesic_snake(b >= 45, K.edge_stop(b), 10, 1), "image_id", out="v int").drop("image_id"), None)
query("region_snake", "vox", lambda a: T.per_image(_one(a), lambda b: K.region_snake(b >= 45, b.astype(float), 5), "image_id", out="v int").drop("image_id"), None)

# --- registration
query("block_attributes", "vox", R.block_attributes, "SELECT CAST(floor(x / 4) AS BIGINT) AS bx, CAST(floor(y / 4) AS BIGINT) AS by, CAST(floor(z / 4) AS BIGINT) AS bz, count(*) AS n, round(avg(v), 6) AS mean, round(var_pop(v), 6) AS variance FROM vox GROUP BY 1, 2, 3")
query("block_pairs", "vox", lambda a: R.pair_blocks(a, a.withColumn("x", F.col("x") + 1), 4, 1), ", m AS (SELECT x // 4 AS bx, y // 4 AS b2, z // 4 AS bz, x + i.d AS x, y + j.d AS y, z + k.d AS z, v AS a, i.d AS dx, j.d AS dy, k.d AS dz FROM vox, (VALUES (-1), (0), (1)) i(d), (VALUES (-1), (0), (1)) j(d), (VALUES (-1), (0), (1)) k(d)), s AS (SELECT bx, b2, bz, dx, dy, dz, count(*) AS n, CAST(sum(a) AS BIGINT) AS sa, CAST(sum(b.v) AS BIGINT) AS sb, CAST(sum(a * a) AS BIGINT) AS saa, CAST(sum(b.v * b.v) AS BIGINT) AS sbb, CAST(sum(a * b.v) AS BIGINT) AS sab FROM m JOIN (SELECT x + 1 AS x, y, z, v FROM vox) b USING (x, y, z) GROUP BY ALL), c AS (SELECT *, CASE WHEN n * saa > sa * sa AND n * sbb > sb * sb THEN round((n * sab - sa * sb) * (n * sab - sa * sb) / (CAST(n * saa - sa * sa AS DOUBLE) * (n * sbb - sb * sb)), 6) ELSE 0.0 END AS score FROM s WHERE n * 2 >= 32) SELECT bx, b2 AS by, CAST(bz AS BIGINT) AS bz, dx, dy, dz, score FROM c QUALIFY row_number() OVER (PARTITION BY bx, b2, bz ORDER BY score DESC, dx * dx + dy * dy + dz * dz, dx, dy, dz) = 1")
query("block_match", "vox", lambda a: P.match_query(a), None)

# --- detections and tracks
_nb = ", n AS (SELECT a.det_id, b.det_id AS other, 1 AS dt, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) AS d2 FROM det a JOIN det b ON b.frame = a.frame + 1 WHERE (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 9)"
query("detection_neighbours", "det", lambda d: D.neighbours(d, 3), f"{_nb} SELECT * FROM n")
query("nearest_links", "det", lambda d: D.link_nearest(d, 3), f"{_nb}, a AS (SELECT det_id, other FROM n QUALIFY row_number() OVER (PARTITION BY det_id ORDER BY dt, d2, other) = 1), b AS (SELECT det_id, other FROM n QUALIFY row_number() OVER (PARTITION BY other ORDER BY dt, d2, det_id) = 1) SELECT det_id, other FROM a JOIN b USING (det_id, other)")
query("tracks", "det", lambda d: D.chain(d, 3), f"{_nb}, a AS (SELECT det_id, other FROM n QUALIFY row_number() OVER (PARTITION BY det_id ORDER BY dt, d2, other) = 1), b AS (SELECT det_id, other FROM n QUALIFY row_number() OVER (PARTITION BY other ORDER BY dt, d2, det_id) = 1), l AS (SELECT det_id, other FROM a JOIN b USING (det_id, other)), r(det_id, track_id, seq) AS (SELECT det_id, det_id, 0 FROM det WHERE det_id NOT IN (SELECT other FROM l) UNION ALL SELECT l.other, r.track_id, r.seq + 1 FROM r JOIN l ON l.det_id = r.det_id) SELECT track_id, seq, det_id FROM r")
query("track_properties", "det", lambda d: D.properties(d.withColumn("track", F.col("x")), "track"), ", s AS (SELECT *, x AS track, sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2)) AS step, row_number() OVER w AS i, count(*) OVER (PARTITION BY x) AS k FROM det WINDOW w AS (PARTITION BY x ORDER BY frame, det_id)) SELECT track, count(*) AS n, CAST(max(frame) - min(frame) + 1 AS INT) AS lifetime, round(coalesce(sum(step), 0), 4) AS path, round(CAST(abs(max(CASE WHEN i = k THEN y END) - max(CASE WHEN i = 1 THEN y END)) AS DOUBLE), 4) AS fly FROM s GROUP BY 1")
query("colocalisation", "det", lambda d: D.colocalisation(d.where("det_id % 2 = 0"), d.where("det_id % 2 = 1"), 2), "SELECT a.det_id AS a, b.det_id AS b, a.frame FROM det a JOIN det b ON a.frame = b.frame WHERE a.det_id % 2 = 0 AND b.det_id % 2 = 1 AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 4")
query("cheapest_tracks", "det", lambda d: P.track_query(d), None)

# --- pipelines
query("fusion_crop", "vox", lambda a: P.fuse_and_crop([a, V.flip(a, "x", 32)], 25, 2), None)
query("mars_segmentation", "vox", lambda a: P.mars(_one(a), 0.6, 4, 0.8).drop("image_id"), None)
query("segmentation_step", "vox lab", lambda a, b: P.propagate_step(_one(a), _one(b.select(*XYZ, "label")), 1, 2, [8, 6, 4]).select("parent", "child"), None)
QUERIES["inr_round_trip"] = lambda spark, d: P.inr_round_trip(view(spark, d, "vox"))
ORACLES["inr_round_trip"] = f"{ctes('vox')} SELECT x, y, z, CAST(v AS DOUBLE) AS v FROM vox"
QUERIES["rotation_matrix"] = lambda spark, d: spark.createDataFrame([(a, i, j, round(float(M.rotation(a, 90)[i, j]), 9) + 0.0) for a in "XYZ" for i in range(4) for j in range(4)], "axis string, i int, j int, v double")

ORACLES["rotation_matrix"] = "SELECT axis, i, j, CAST(CASE WHEN i = 3 OR j = 3 OR i = k OR j = k THEN CAST(i = j AS INT) WHEN i = j THEN 0 WHEN (k + 1) % 3 = i THEN -1 ELSE 1 END AS DOUBLE) AS v FROM (VALUES ('X', 0), ('Y', 1), ('Z', 2)) a(axis, k), (SELECT CAST(i AS INT) AS i FROM range(4) r(i)), (SELECT CAST(j AS INT) AS j FROM range(4) r(j))"

# --- stacks, daughters, contacts, fields
_two = lambda a: a.unionByName(_other(a)).unionByName(V.flip(a, "y", 32))
_tsql = "(SELECT x, y, z, v FROM vox UNION ALL SELECT 31 - x, y, z, v FROM vox UNION ALL SELECT x, 31 - y, z, v FROM vox)"
query("stack_median", "vox", lambda a: S.stack_filter(_two(a)), f"SELECT x, y, z, round(quantile_cont(v, 0.5), 6) AS v FROM {_tsql} GROUP BY 1, 2, 3")
query("stack_robust_mean", "vox", lambda a: S.robust_mean(_two(a), 0.34), f"SELECT x, y, z, round(CASE WHEN count(*) = 3 THEN list_sort(list(v))[2] ELSE avg(v) END, 6) AS v FROM {_tsql} GROUP BY 1, 2, 3")
query("zero_crossings", "vox", lambda a: S.zero_crossings(a.withColumn("v", F.col("v") - 25)), f"SELECT DISTINCT p.x, p.y, p.z FROM vox p, {N6} JOIN vox q ON q.x = p.x + dx AND q.y = p.y + dy AND q.z = p.z + dz WHERE p.v > 25 AND q.v <= 25")
query("components_4d", "vox", lambda a: S.components_4d(a.where("v >= 49").withColumn("t", F.lit(0)).unionByName(_other(a).where("v >= 49").withColumn("t", F.lit(1))), 6), ", fg AS (SELECT 0 AS t, x, y, z FROM vox WHERE v >= 49 UNION ALL SELECT 1, 31 - x, y, z FROM vox WHERE v >= 49), cc(t, x, y, z, root) USING KEY (t, x, y, z) AS (SELECT t, x, y, z, x + (y << 16) + (CAST(z AS BIGINT) << 32) + (CAST(t AS BIGINT) << 48) FROM fg UNION SELECT q.t, q.x, q.y, q.z, min(p.root) FROM cc p, (VALUES (0,1,0,0),(0,-1,0,0),(0,0,1,0),(0,0,-1,0),(0,0,0,1),(0,0,0,-1),(1,0,0,0),(-1,0,0,0)) o(dt,dx,dy,dz) JOIN recurring.cc q ON q.t = p.t + dt AND q.x = p.x + dx AND q.y = p.y + dy AND q.z = p.z + dz WHERE p.root < q.root GROUP BY 1, 2, 3, 4) SELECT t, x, y, z, root AS component FROM cc")
query("components_with_seeds", "vox", lambda a: S.with_seeds(T.connected_components(a.where("v >= 49"), 6, 16), a.where("v = 50 AND x < 8")), f", {_components('SELECT x, y, z FROM vox WHERE v >= 49', N6)} SELECT x, y, z, root AS component FROM cc WHERE root IN (SELECT root FROM cc JOIN vox USING (x, y, z) WHERE v = 50 AND x < 8)")
query("new_labels", "lab", lambda a: S.new_labels(a.groupBy("label").agg((F.count("*") % 3).alias("n")).withColumnRenamed("label", "cell")), ", c AS (SELECT label AS cell, count(*) % 3 AS n FROM lab GROUP BY 1) SELECT cell, CAST(2 + coalesce(sum(n) OVER (ORDER BY cell ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS label, n FROM c")
query("parcels", "vox", lambda a: S.parcels(a.where("v > 5"), [(4, 4, 2), (20, 8, 3), (10, 28, 5), (28, 28, 4)]), None)
query("daughters_by_distance", "lab", lambda a: S.by_distance(a.where("label > 1").select((F.expr("label div 2")).alias("parent"), "label").distinct(), S.centroids(a), (0, 0, 0)), ", c AS (SELECT label, label // 2 AS parent, round(sqrt(pow(round(avg(x), 6), 2) + pow(round(avg(y), 6), 2) + pow(round(avg(z), 6), 2)), 6) AS d FROM lab WHERE label > 1 GROUP BY 1) SELECT CAST(parent AS BIGINT) AS parent, label, CAST(row_number() OVER (PARTITION BY parent ORDER BY d, label DESC) AS INT) AS rank, round(max(d) OVER (PARTITION BY parent) - min(d) OVER (PARTITION BY parent), 6) AS gap FROM c")
query("fusion_targets_by_contact", "lab", lambda a: S.fusion_target(a, a.where("label > 3").select(F.col("label").alias("give"), (F.col("label") - 1).alias("get")).distinct().unionByName(a.where("label > 5").select(F.col("label").alias("give"), (F.col("label") - 4).alias("get")).distinct())), f", o AS (SELECT * FROM {_n26} WHERE (dx, dy, dz) > (0, 0, 0)), adj AS (SELECT least(p.label, q.label) AS a, greatest(p.label, q.label) AS b, count(*) AS n FROM lab p, o JOIN lab q ON q.x = p.x + dx AND q.y = p.y + dy AND q.z = p.z + dz WHERE p.label <> q.label GROUP BY 1, 2), c AS (SELECT DISTINCT label AS give, label - 1 AS get FROM lab WHERE label > 3 UNION SELECT label, label - 4 FROM lab WHERE label > 5) SELECT give, get, coalesce(n, 0) AS n FROM c LEFT JOIN adj ON a = least(give, get) AND b = greatest(give, get) QUALIFY row_number() OVER (PARTITION BY give ORDER BY coalesce(n, 0) DESC, get) = 1")
query("exterior_correction", "lab", lambda a: S.exterior_correction(a, a.where("label % 2 = 0").select("label").distinct(), 1), f", fg AS (SELECT x, y, z, CASE WHEN label <> 1 THEN 1 ELSE 0 END AS v FROM lab), e AS ({_spread('fg', 'min(q.v)')}), o AS ({_spread('e', 'max(q.v)')}) SELECT x, y, z, CASE WHEN label % 2 = 0 AND o.v = 0 THEN 1 ELSE label END AS label FROM lab JOIN o USING (x, y, z)")
query("lost_to", "lab lab2", lambda a, b: S.lost_to(a, b, a.select(F.col("label").alias("mother"), F.col("label").alias("child")).distinct()), ", m AS (SELECT a.label AS mother, b.label AS label, count(*) AS n FROM lab a JOIN lab2 b USING (x, y, z) WHERE a.label <> b.label GROUP BY 1, 2) SELECT mother, label, n FROM m QUALIFY row_number() OVER (PARTITION BY mother ORDER BY n DESC, label) = 1")
query("match_volume", "vox", lambda a: S.match_volume(a, 2000), ", h AS (SELECT v, sum(count(*)) OVER (ORDER BY v DESC) AS above FROM vox GROUP BY v) SELECT max(v) AS threshold FROM h WHERE above >= 2000")
query("field_resample", "vox", lambda a: S.apply_field(a, a.select(*XYZ, F.lit(1.2).alias("dx"), F.lit(-0.6).alias("dy"), F.lit(0.0).alias("dz"))), "SELECT p.x, p.y, p.z, coalesce(q.v, 0) AS v FROM vox p LEFT JOIN vox q ON q.x = p.x + 1 AND q.y = p.y - 1 AND q.z = p.z")
QUERIES["field_inverse"] = lambda spark, d: S.inverse_field(V.grid(spark, 32, 32, 7).select(*XYZ, F.lit(1.0).alias("dx"), F.lit(0.0).alias("dy"), F.lit(0.0).alias("dz")), 2).where("x >= 4 AND x < 28").withColumns({f"d{a}": F.col(f"d{a}") + 0.0 for a in XYZ})
ORACLES["field_inverse"] = "SELECT i % 32 AS x, i // 32 % 32 AS y, CAST(i // 1024 AS INT) AS z, CAST(-1.0 AS DOUBLE) AS dx, CAST(0.0 AS DOUBLE) AS dy, CAST(0.0 AS DOUBLE) AS dz FROM range(7168) r(i) WHERE i % 32 BETWEEN 4 AND 27"
