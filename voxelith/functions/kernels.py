"""Array kernels for what depends on order: they run on one tile or image at a time inside grouped-map functions."""

from __future__ import annotations

from collections import defaultdict

import numpy as np

from voxelith.operators.voxel import offsets


def _pad(a: np.ndarray, value, k: int = 1) -> np.ndarray:
    return np.pad(a, k, constant_values=value)


def _shift(a: np.ndarray, o: tuple[int, int, int], fill) -> np.ndarray:
    """a at p + o."""
    p = _pad(a, fill)
    return p[1 + o[0] : 1 + o[0] + a.shape[0], 1 + o[1] : 1 + o[1] + a.shape[1], 1 + o[2] : 1 + o[2] + a.shape[2]]


def dilate(a: np.ndarray, steps, low=None) -> np.ndarray:
    low = (np.iinfo(a.dtype).min if a.dtype.kind in "iu" else -np.inf) if low is None else low
    out = a.copy()
    for o in steps:
        np.maximum(out, _shift(a, o, low), out=out)
    return out


def erode(a: np.ndarray, steps, high=None) -> np.ndarray:
    high = (np.iinfo(a.dtype).max if a.dtype.kind in "iu" else np.inf) if high is None else high
    out = a.copy()
    for o in steps:
        np.minimum(out, _shift(a, o, high), out=out)
    return out


def label(fg: np.ndarray, conn: int = 26) -> np.ndarray:
    """Components of a mask, 1.. in scan order of their first voxel (x fastest); each voxel takes the smallest index around it and follows it."""
    idx = np.arange(1, fg.size + 1).reshape(fg.shape, order="F")
    lab = np.where(fg, idx, 0)
    big = fg.size + 2
    steps = offsets(conn)
    flat_fg = fg.ravel(order="F")
    while True:
        near = np.where(fg, lab, big)
        for o in steps:
            near = np.minimum(near, np.where(fg, _shift(np.where(fg, lab, big), o, big), big))
        flat = np.where(fg, near, 0).ravel(order="F")
        jump = np.concatenate([[0], flat])
        flat = np.where(flat_fg, jump[jump[flat]], 0)
        new = flat.reshape(fg.shape, order="F")
        if (new == lab).all():
            break
        lab = new
    _, inv = np.unique(lab, return_inverse=True)
    return inv.reshape(fg.shape) + (0 if (~fg).any() else 1)


def h_maxima(img: np.ndarray, h: float) -> np.ndarray:
    """img - reconstruction of max(0, img - h) under img, over 26 neighbours."""
    j = np.maximum(0, img - h)
    steps = offsets(26)
    while True:
        new = np.minimum(img, dilate(j, steps))
        if (new == j).all():
            return img - j
        j = new


def h_minima(img: np.ndarray, h: float) -> np.ndarray:
    return h_maxima(img.max() - img, h)


def hysteresis(img: np.ndarray, low: float, high: float, conn: int = 26, least: int = 1, count: int = 1) -> np.ndarray:
    lab = label(img >= low, conn)
    n = int(lab.max())
    size, strong = np.bincount(lab.ravel(), minlength=n + 1), np.bincount(lab.ravel(), (img >= high).ravel(), n + 1)
    keep = (size >= least) & (strong >= count)
    keep[0] = False
    new = np.zeros(n + 1, int)
    new[keep] = np.arange(1, keep.sum() + 1)
    return new[lab]


def watershed(seeds: np.ndarray, img: np.ndarray, policy: str = "min") -> np.ndarray:
    """Flooding from markers, lowest level first; a level's points are decided from the labels before any of them is written.

    policy: of different labels around a point, ``first`` the one that queued it, ``min`` the smallest, ``most`` the commonest (then smallest).
    """
    lab, level = seeds.astype(np.int64).copy(), img.astype(np.int64)
    six = ((1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1))
    shape, queues, queued = lab.shape, defaultdict(list), lab > 0

    def push(p, by) -> None:
        for o in six:
            q = (p[0] + o[0], p[1] + o[1], p[2] + o[2])
            if all(0 <= q[k] < shape[k] for k in range(3)) and not queued[q]:
                queued[q] = True
                queues[int(level[q])].append((q, by))

    for p in sorted(map(tuple, np.argwhere(lab > 0).tolist()), key=lambda p: p[::-1]):
        push(p, int(lab[p]))
    while queues:
        now = min(queues)
        decided = []
        for p, by in queues.pop(now):
            near = [int(lab[q]) for o in six if all(0 <= (q := (p[0] + o[0], p[1] + o[1], p[2] + o[2]))[k] < shape[k] for k in range(3)) and lab[q] > 0]
            if policy == "first":
                got = by
            elif policy == "most":
                got = min(set(near), key=lambda v: (-near.count(v), v))
            else:
                got = min(near)
            decided.append((p, got))
        for p, v in decided:
            lab[p] = v
        for p, v in decided:
            push(p, v)
    return lab


def gaussian_weights(sigma: float, order: int = 0, reach: float = 4.0) -> np.ndarray:
    r = max(1, int(reach * sigma + 0.5))
    x = np.arange(-r, r + 1)
    g = np.exp(-0.5 * (x / sigma) ** 2)
    g /= g.sum()
    if order == 1:
        d = -x * g
        return d / -(d * x).sum()
    if order == 2:
        d = (x * x / sigma**2 - 1) * g
        d -= d.mean()
        return d / (0.5 * (d * x * x).sum())
    return g


def convolve_axis(a: np.ndarray, w: np.ndarray, axis: int) -> np.ndarray:
    """Correlation with the flipped mask along one axis; borders repeat the edge."""
    r = len(w) // 2
    p = np.pad(a.astype(np.float64), [(r, r) if k == axis else (0, 0) for k in range(a.ndim)], mode="edge")
    out = np.zeros(a.shape)
    for i, c in enumerate(w[::-1]):
        out += c * np.take(p, range(i, i + a.shape[axis]), axis)
    return out


def gaussian(a: np.ndarray, sigma: float, orders: tuple[int, int, int] = (0, 0, 0)) -> np.ndarray:
    out = a.astype(np.float64)
    for axis in range(3):
        if a.shape[axis] > 1:
            out = convolve_axis(out, gaussian_weights(sigma, orders[axis]), axis)
        elif orders[axis]:
            out = np.zeros(a.shape)
    return out


def gradient_modulus(a: np.ndarray, sigma: float = 1.0) -> np.ndarray:
    return np.sqrt(sum(gaussian(a, sigma, o) ** 2 for o in ((1, 0, 0), (0, 1, 0), (0, 0, 1))))


def laplacian(a: np.ndarray, sigma: float = 1.0) -> np.ndarray:
    return sum(gaussian(a, sigma, o) for o in ((2, 0, 0), (0, 2, 0), (0, 0, 2)))


def fill_holes(mask: np.ndarray, conn: int = 6) -> np.ndarray:
    p = label(_pad(~mask, True), conn)
    return ~(p == p[0, 0, 0])[1:-1, 1:-1, 1:-1]


CHAMFER = {(1, 0, 0): 1.0, (1, 1, 0): 2**0.5, (1, 1, 1): 3**0.5}


def chamfer(fg: np.ndarray) -> np.ndarray:
    """Distance to the foreground by relaxation over the 26 neighbours with their euclidean lengths."""
    d = np.where(fg, 0.0, np.inf)
    steps = [(o, (o[0] ** 2 + o[1] ** 2 + o[2] ** 2) ** 0.5) for o in offsets(26)]
    while True:
        new = d
        for o, w in steps:
            new = np.minimum(new, _shift(d, o, np.inf) + w)
        if (new == d).all():
            return d
        d = new


def skiz(labels: np.ndarray, mask: np.ndarray | None = None) -> np.ndarray:
    """Nearest label by chamfer distance (smaller label of equals), inside a mask."""
    inside = np.ones(labels.shape, bool) if mask is None else mask
    d = np.where((labels > 0) & inside, 0.0, 1e18)
    lab = np.where(d == 0, labels, 0).astype(np.int64)
    big = np.iinfo(np.int64).max
    while True:
        nd, nl = d, np.where(lab > 0, lab, big)
        for o in offsets(26):
            w = (o[0] ** 2 + o[1] ** 2 + o[2] ** 2) ** 0.5
            sd, sl = _shift(d, o, 1e18) + w, _shift(np.where(lab > 0, lab, big), o, big)
            better = inside & ((sd < nd - 1e-9) | ((abs(sd - nd) <= 1e-9) & (sl < nl)))
            nd, nl = np.where(better, sd, nd), np.where(better, sl, nl)
        nl = np.where(nl == big, 0, nl)
        if (nl == lab).all() and (nd == d).all():
            return lab
        d, lab = nd, nl


def is_simple(n: np.ndarray) -> bool:
    """26/6 simple point of a 3x3x3 neighbourhood: one foreground 26-component beside the centre, one background 6-component (within 18) that touches it."""
    fg = n.astype(bool).copy()
    fg[1, 1, 1] = False
    if label(fg, 26).max() != 1:
        return False
    near = np.add.outer(np.add.outer(abs(np.arange(-1, 2)), abs(np.arange(-1, 2))), abs(np.arange(-1, 2)))
    bg = ~n.astype(bool) & (near <= 2) & (near > 0)
    lab = label(bg, 6)
    touching = {int(lab[p]) for p in ((0, 1, 1), (2, 1, 1), (1, 0, 1), (1, 2, 1), (1, 1, 0), (1, 1, 2)) if lab[p] and bg[p]}
    return len(touching) == 1


def thin(mask: np.ndarray) -> np.ndarray:
    """Removes simple points that aren't ends, by distance to the background, then scan order, until none is left."""
    m = _pad(mask.astype(bool), False)
    dist = chamfer(~m)
    while True:
        gone = False
        for p in sorted(map(tuple, np.argwhere(m).tolist()), key=lambda p: (dist[p], p[::-1])):
            box = m[p[0] - 1 : p[0] + 2, p[1] - 1 : p[1] + 2, p[2] - 1 : p[2] + 2]
            if box.sum() > 2 and is_simple(box):
                m[p] = False
                gone = True
        if not gone:
            return m[1:-1, 1:-1, 1:-1]


_PLANES = [[o for o in offsets(26) if np.dot(o, n) == 0] for n in ((1, 0, 0), (0, 1, 0), (0, 0, 1), (1, 1, 0), (1, -1, 0), (1, 0, 1), (1, 0, -1), (0, 1, 1), (0, 1, -1))]


def sup_inf(u: np.ndarray) -> np.ndarray:
    return np.max([erode(u, p, 1) for p in _PLANES], axis=0)


def inf_sup(u: np.ndarray) -> np.ndarray:
    return np.min([dilate(u, p, 0) for p in _PLANES], axis=0)


def smooth(u: np.ndarray, times: int, first: int = 0) -> np.ndarray:
    """Curvature flow: the two compositions take turns, from the one that ``first`` names."""
    for k in range(times):
        u = inf_sup(sup_inf(u)) if (first + k) % 2 else sup_inf(inf_sup(u))
    return u


def edge_stop(img: np.ndarray, alpha: float = 100.0, sigma: float = 1.0) -> np.ndarray:
    return 1 / np.sqrt(1 + alpha * gradient_modulus(img, sigma))


def geodesic_snake(u: np.ndarray, g: np.ndarray, steps: int, smoothing: int = 3, level: float = 1.0, balloon: float = 1.0, least: int = 0) -> np.ndarray:
    """Morphological geodesic active contour; stops when fewer than ``least`` voxels differ from either of the last two states."""
    u, past = (u > 0).astype(np.int8), []
    dg = np.gradient(g)
    for k in range(steps):
        new = u
        if balloon:
            moved = dilate(u, offsets(26), 0) if balloon > 0 else erode(u, offsets(26), 1)
            new = np.where(g > level / abs(balloon), moved, u)
        du = np.gradient(new.astype(np.float64))
        pull = sum(a * b for a, b in zip(dg, du, strict=True))
        new = np.where(pull > 0, 1, np.where(pull < 0, 0, new)).astype(np.int8)
        new = smooth(new, smoothing, k * smoothing)
        past = [*past, u][-2:]
        u = new
        if least and any((u != p).sum() < least for p in past):
            break
    return u


def region_snake(u: np.ndarray, img: np.ndarray, steps: int, smoothing: int = 1, inner: float = 1.0, outer: float = 1.0) -> np.ndarray:
    """Morphological active contour without edges."""
    u = (u > 0).astype(np.int8)
    for k in range(steps):
        c1 = img[u > 0].mean() if (u > 0).any() else 0.0
        c0 = img[u == 0].mean() if (u == 0).any() else 0.0
        du = np.gradient(u.astype(np.float64))
        force = np.sqrt(sum(d * d for d in du)) * (inner * (img - c1) ** 2 - outer * (img - c0) ** 2)
        u = np.where(force < 0, 1, np.where(force > 0, 0, u)).astype(np.int8)
        u = smooth(u, smoothing, k * smoothing)
    return u
