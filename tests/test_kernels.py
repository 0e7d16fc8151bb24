import numpy as np

from voxelith.functions import kernels as K
from voxelith.functions import matrices as M
from voxelith.operators.voxel import ball, offsets


def line(*v):
    return np.array(v).reshape(-1, 1, 1)


def test_h_maxima_fixture():
    assert K.h_maxima(line(0, 5, 3, 6, 0), 2).ravel().tolist() == [0, 2, 0, 2, 0]


def test_hysteresis_fixture():
    assert (K.hysteresis(line(1, 0, 3, 1, 0), 1, 3) > 0).ravel().tolist() == [False, False, True, True, False]


def test_label_counts_are_stable_under_flips():
    rng = np.random.default_rng(0)
    for conn in (6, 18, 26):
        m = rng.random((7, 8, 5)) < 0.3
        assert K.label(m, conn).max() == K.label(m[::-1, :, ::-1], conn).max()
        assert ((K.label(m, conn) > 0) == m).all()
    assert K.label(np.ones((2, 2, 2), bool)).max() == 1


def test_watershed_keeps_markers_and_labels_all():
    rng = np.random.default_rng(1)
    img, seeds = rng.integers(0, 20, (8, 8, 4)), np.zeros((8, 8, 4), int)
    seeds[1, 1, 1], seeds[6, 6, 2], seeds[1, 6, 0] = 2, 3, 5
    for policy in ("min", "first", "most"):
        out = K.watershed(seeds, img, policy)
        assert set(np.unique(out)) == {2, 3, 5} and (out[seeds > 0] == seeds[seeds > 0]).all()


def test_morphology_order_and_idempotence():
    a = np.random.default_rng(2).integers(0, 9, (6, 6, 6))
    s = offsets(6)
    d, e = K.dilate(a, s), K.erode(a, s)
    assert (e <= a).all() and (a <= d).all()
    o = K.dilate(e, s)
    assert (K.dilate(K.erode(o, s), s) == o).all()
    assert len(offsets(26)) == 26 and len(offsets(18)) == 18 and len(offsets(10)) == 10 and len(ball(1)) == 6


def test_gaussian_keeps_constants_and_slopes():
    assert np.allclose(K.gaussian(np.full((6, 6, 6), 3.0), 1.0), 3)
    x = np.arange(30.0)[:, None, None] * np.ones((1, 3, 3))
    assert np.allclose(K.gradient_modulus(x, 1.0)[8:-8], 1)


def test_fill_holes_and_thinning():
    m = np.ones((5, 5, 5), bool)
    m[2, 2, 2] = False
    assert K.fill_holes(m).all()
    bar = np.zeros((9, 3, 3), bool)
    bar[:] = True
    t = K.thin(bar)
    assert t.sum() < 27 and K.label(t).max() == 1


def test_chamfer_and_zones():
    fg = np.zeros((5, 1, 1), bool)
    fg[0] = True
    assert K.chamfer(fg).ravel().tolist() == [0, 1, 2, 3, 4]
    lab = np.zeros((5, 1, 1), int)
    lab[0], lab[4] = 7, 3
    assert K.skiz(lab).ravel().tolist() == [7, 7, 3, 3, 3]


def test_snakes_stay_binary():
    img = np.random.default_rng(3).random((8, 8, 8))
    u = img > 0.7
    assert set(np.unique(K.geodesic_snake(u, K.edge_stop(img), 3))) <= {0, 1}
    assert set(np.unique(K.region_snake(u, img, 3))) <= {0, 1}


def test_matrices():
    y = M.rotation("Y", 90)
    assert np.allclose(y[:3, :3], [[0, 0, 1], [0, 1, 0], [-1, 0, 0]])
    m = M.rotation("Z", 30, (0, 0, 0), (10, 10, 10))
    assert np.allclose(m @ M.inverse(m), np.eye(4)) and np.allclose(m @ [5, 5, 5, 1], [5, 5, 5, 1])
    p = np.random.default_rng(4).random((20, 3))
    q = p @ m[:3, :3].T + m[:3, 3]
    for kind in ("rigid", "affine"):
        assert np.allclose(M.from_sums(20, p.sum(0), q.sum(0), p.T @ p, q.T @ p, kind), m, atol=1e-6)
    assert np.allclose(M.parse(M.render(m)), m)
