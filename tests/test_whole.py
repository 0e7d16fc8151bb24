"""Queries give results for the whole of their tables."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelith.functions import kernels as K
from voxelith.operators import tracks as D
from voxelith.operators import voxel as V
from voxelith.plans import pipeline as P
from voxelith.plans.queries import QUERIES
from voxelith.plans.views import view

SF = "/root/testdata/sf0.001"


def test_cheapest_tracks_leave_no_path_under_zero(spark):
    rng = np.random.default_rng(2)
    rows = [(k, int(f), int(x), int(y)) for k, (f, x, y) in enumerate(zip(rng.integers(1, 31, 160), rng.integers(0, 2, 160), rng.integers(0, 9, 160), strict=True))]
    got = P.track_query(spark.createDataFrame(rows, "det_id long, frame int, x long, y long")).collect()
    found = 0
    for x in (0, 1):
        own = {d: (f, y) for d, f, c, y in rows if c == x}
        cost = {(a, b): (own[a][1] - own[b][1]) ** 2 - 5 for a in own for b in own if own[b][0] == own[a][0] + 1 and (own[a][1] - own[b][1]) ** 2 <= 4}
        alive = set(own)

        def cheapest(alive, cost):
            def go(n):
                return min([0, *(c + go(b) for (a, b), c in cost.items() if a == n and b in alive)])

            return min(go(n) for n in alive)

        tracks = {}
        for r in sorted((r for r in got if r.x == x), key=lambda r: (r.track, r.seq)):
            tracks.setdefault(r.track, []).append(r.det_id)
        for k in range(len(tracks)):
            t = tracks[k]
            assert set(t) <= alive and sum(cost[p] for p in zip(t, t[1:], strict=False)) == cheapest(alive, cost)
            alive -= set(t)
        assert cheapest(alive, cost) == 0
        found += len(tracks)
        assert len(tracks) > 3 and max(own[d][0] for t in tracks.values() for d in t) > 12
    assert found == len({(r.x, r.track) for r in got})


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_thinning_covers_the_view(spark):
    vox = view(spark, SF, "vox").toPandas()
    a = np.zeros((32, 32, vox["z"].max() + 1), bool)
    a[vox["x"], vox["y"], vox["z"]] = vox["v"] >= 12
    want = K.thin(a)
    got = QUERIES["thinning"](spark, SF).toPandas()
    assert len(got) == len(vox) and (got["v"] == want[got["x"], got["y"], got["z"]]).all()


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_thinning_of_a_crop_by_brute_force(spark):
    vox = view(spark, SF, "vox").where("x < 12 AND y < 12").toPandas()
    a = np.zeros((12, 12, vox["z"].max() + 1), bool)
    a[vox["x"], vox["y"], vox["z"]] = vox["v"] >= 12
    t = K.thin(a)

    def parts(m):
        left, n = set(map(tuple, np.argwhere(m).tolist())), 0
        while left:
            n, todo = n + 1, [left.pop()]
            while todo:
                p = todo.pop()
                near = {q for q in left if max(abs(i - j) for i, j in zip(p, q, strict=True)) == 1}
                left -= near
                todo += near
        return n

    assert not (t & ~a).any() and 0 < t.sum() < a.sum() and parts(t) == parts(a)


def _detections(rng, n, crowd):
    """(det_id, frame, x, y): n of them at few places, and ``crowd`` more at one place in each of two frames."""
    rows = [(int(f), int(x), int(y)) for f, x, y in zip(rng.integers(1, 6, n), rng.integers(0, 16, n), rng.integers(-20, 20, n), strict=True)]
    rows += [(f, 3, 30) for f in (2, 3) for _ in range(crowd)]
    ids = rng.permutation(len(rows)).tolist()
    return [(d, *r) for d, r in zip(ids, rows, strict=True)]


def _pairs(rows, reach):
    return [(a, b, (x - x2) ** 2 + (y - y2) ** 2) for a, f, x, y in rows for b, f2, x2, y2 in rows if f2 == f + 1 and (x - x2) ** 2 + (y - y2) ** 2 <= reach * reach]


def _nearest(rows, reach):
    best, back = {}, {}
    for a, b, d in _pairs(rows, reach):
        best[a] = min(best.get(a, (d, b)), (d, b))
        back[b] = min(back.get(b, (d, a)), (d, a))
    return {(a, b) for a, (_, b) in best.items() if back[b][1] == a}


def _rows_joined(df, name="Join"):
    """Rows that the joins of the collected query gave at most."""
    found = 0
    todo = [df._jdf.queryExecution().executedPlan()]
    while todo:
        p = todo.pop()
        if "AdaptiveSparkPlan" in p.nodeName():
            todo.append(p.executedPlan())
        elif "QueryStage" in p.nodeName():
            todo.append(p.plan())
        kids = p.children()
        todo += [kids.apply(k) for k in range(kids.size())]
        if name in p.nodeName() and p.metrics().contains("numOutputRows"):
            found = max(found, p.metrics().apply("numOutputRows").value())
    return found


def test_links_of_crowds_make_no_pairs_of_ids(spark):
    rows = _detections(np.random.default_rng(5), 300, 200)
    got = D.link_nearest(spark.createDataFrame(rows, "det_id long, frame int, x long, y long"), 3)
    found = [(r.det_id, r.other) for r in got.collect()]
    assert len(found) == len(set(found)) > 50 and set(found) == _nearest(rows, 3)
    assert _rows_joined(got) < 10_000  # the crowds alone have 40,000 pairs


def test_tracks_of_unlinked_detections_skip_the_fixpoint(spark, monkeypatch):
    from voxelith.operators import graph

    rows = _detections(np.random.default_rng(6), 200, 200)
    sizes, real = [], graph.fixpoint_roots
    monkeypatch.setattr(graph, "fixpoint_roots", lambda nodes, *a: sizes.append(nodes.count()) or real(nodes, *a))
    got = {r.det_id: (r.track_id, r.seq) for r in D.chain(spark.createDataFrame(rows, "det_id long, frame int, x long, y long"), 3).collect()}
    up = {b: a for a, b in _nearest(rows, 3)}
    for d, *_ in rows:
        root, n = d, 0
        while root in up:
            root, n = up[root], n + 1
        assert got[d] == (root, n)
    assert len(got) == len(rows) and sizes == [len(up)]


def test_neighbours_of_crowds_are_made_last(spark, monkeypatch):
    monkeypatch.setattr(D, "CHUNK", 64, raising=False)
    rows = _detections(np.random.default_rng(7), 200, 150)
    det = spark.createDataFrame([*rows, (9999, None, 1, 1), (9998, 1, None, 1)], "det_id long, frame int, x long, y long")
    got = D.neighbours(det, 3)
    found = [tuple(r) for r in got.collect()]
    want = [(a, b, 1, d) for a, b, d in _pairs(rows, 3)]
    assert len(want) > 22_500 and sorted(found) == sorted(want)
    assert _rows_joined(got) < 5_000  # places and chunks, not ids
    flat = det.withColumn("x", det["x"] * 0.1).withColumn("y", det["y"] / 7.0)
    assert D.neighbours(flat, 0.35, 2).count() == sum(
        1 for _, f, x, y in rows for _, f2, x2, y2 in rows if 1 <= f2 - f <= 2 and (x * 0.1 - x2 * 0.1) * (x * 0.1 - x2 * 0.1) + (y / 7.0 - y2 / 7.0) * (y / 7.0 - y2 / 7.0) <= 0.35 * 0.35
    )


def test_neighbours_of_a_crowd_leave_bit_by_bit(spark):
    det = spark.range(3000).selectExpr("nullif(id, 7) AS det_id", "CAST(id % 2 AS INT) AS frame", "id * 0 AS x", "id * 0 AS y")
    got = D.neighbours(det, 3)
    one = got.limit(1)
    assert len(one.collect()) == 1 and 0 < _rows_joined(one, "Generate") < 100_000  # not all pairs of the place
    n = got.agg(F.count("*"), F.count("det_id"), F.countDistinct("det_id"), F.countDistinct("other"), F.countDistinct("det_id", "other")).first()
    assert tuple(n) == (1500 * 1500, 1500 * 1500, 1500, 1499, 1500 * 1499)


def test_neighbours_in_one_bucket_are_dealt_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(D, "CHUNK", 64)
    monkeypatch.setattr(D, "PIECE", 8, raising=False)
    rows = [(k, k % 2, k // 2 % 3, k // 6 % 3) for k in range(1200)]
    got = D.neighbours(spark.createDataFrame(rows, "det_id long, frame int, x long, y long"), 2)
    want = [(a, b, 1, d) for a, b, d in _pairs(rows, 2)]
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)
    shares = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(shares) == len(want) and max(shares) < len(want) / 2


def test_correlation_of_a_constant_image(spark):
    grid = [(x, y, 1) for x in range(4) for y in range(4)]
    image = lambda f: spark.createDataFrame([(*p, f(*p)) for p in grid], "x long, y long, z int, v int")
    flat, slope = image(lambda *p: 50), image(lambda x, y, z: 3 * x + y * y)
    for a, b in ((flat, flat), (flat, slope), (slope, flat)):
        r = V.correlation(a, b).first()
        assert np.isnan(r.r) and r.ssd == round(np.mean([(p.v - q.v) ** 2 for p, q in zip(a.orderBy("x", "y").collect(), b.orderBy("x", "y").collect(), strict=True)]), 6)
    other = image(lambda x, y, z: x * y)
    want = np.corrcoef([3 * x + y * y for x, y, _ in grid], [x * y for x, y, _ in grid])[0, 1]
    assert V.correlation(slope, other).first().r == round(want, 6)
    assert V.correlation(flat, flat.where("x < 0")).first().r is None


def test_cheapest_tracks_of_crowds(spark):
    from time import process_time

    rng = np.random.default_rng(8)
    rows = [(k, int(f), 0, int(y)) for k, (f, y) in enumerate(zip(rng.permutation(np.repeat(np.arange(1, 7), 30)), rng.integers(0, 7, 180), strict=True))]
    into, alive = {d: [] for d, *_ in rows}, {d for d, *_ in rows}
    for a, b, d2 in _pairs(rows, 2):
        into[b].append((a, d2 - 5.0))
    order = sorted((f, d) for d, f, *_ in rows)
    want = []
    while True:  # all is found anew for each path
        best = {}
        for _, n in order:
            if n in alive:
                best[n] = min([(0.0, -1), *((best[a][0] + c, a) for a, c in into[n] if a in alive)])
        if not best or min(best.values())[0] >= 0:
            break
        path, n = [], min(best, key=lambda n: (best[n][0], n))
        while n != -1:
            path.insert(0, n)
            n = best[n][1]
        alive -= set(path)
        want += [(0, len({t for _, t, *_ in want}), k, n) for k, n in enumerate(path)]
    got = P.track_query(spark.createDataFrame(rows, "det_id long, frame int, x long, y long"))
    assert sorted(map(tuple, got.collect())) == want and len(want) > 100
    links = spark.createDataFrame([(0, rows[a][1], a, rows[b][1], b, d2 - 5.0) for a, b, d2 in _pairs(rows, 2)], "x long, frame int, a long, frame2 int, b long, cost double")
    assert sorted(map(tuple, D.cheapest_tracks(links, "x").collect())) == want
    queues = [[10_000 * k + i for i in range(10_000)] for k in range(3)]
    began = process_time()
    tracks = D.peel([[], [(0, -1.0)], [(1, -1.0), (0, -1.0)]], [1, 2, 3], queues)
    assert tracks == [[i, 10_000 + i, 20_000 + i] for i in range(10_000)] and process_time() - began < 20
