"""4x4 transformations as numpy arrays: they map result coordinates to input coordinates."""

from __future__ import annotations

import numpy as np


def rotation(axis: str, degrees: float, low=None, high=None) -> np.ndarray:
    """Rotation about an axis, around the centre of a box if one is given."""
    c, s = np.cos(np.radians(degrees)), np.sin(np.radians(degrees))
    m = np.eye(4)
    i, j = {"X": (1, 2), "Y": (2, 0), "Z": (0, 1)}[axis.upper()]
    m[i, i] = m[j, j] = c
    m[i, j], m[j, i] = -s, s
    if low is None:
        return m
    centre = np.eye(4)
    centre[:3, 3] = (np.asarray(low, float) + np.asarray(high, float)) / 2
    return centre @ m @ np.linalg.inv(centre)


def compose(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a @ b


def inverse(m: np.ndarray) -> np.ndarray:
    return np.linalg.inv(m)


def to_voxel_units(m: np.ndarray, voxel_in, voxel_out) -> np.ndarray:
    return np.diag([*(1 / np.asarray(voxel_in, float)), 1]) @ m @ np.diag([*np.asarray(voxel_out, float), 1])


def average(mats: list[np.ndarray], kind: str = "affine") -> np.ndarray:
    """Mean matrix; for ``rigid`` its rotation is the nearest one."""
    m = np.mean(mats, axis=0)
    if kind == "rigid":
        u, _, v = np.linalg.svd(m[:3, :3])
        m[:3, :3] = u @ np.diag([1, 1, np.sign(np.linalg.det(u @ v))]) @ v
    return m


def from_sums(n: float, sp: np.ndarray, sq: np.ndarray, spp: np.ndarray, sqp: np.ndarray, kind: str = "affine") -> np.ndarray:
    """Best transformation of points p to q from their sums: n, sum p, sum q, sum p p^T, sum q p^T."""
    mp, mq = sp / n, sq / n
    cpp, cqp = spp / n - np.outer(mp, mp), sqp / n - np.outer(mq, mp)
    m = np.eye(4)
    if kind == "translation":
        r = np.eye(3)
    elif kind == "rigid":
        u, _, v = np.linalg.svd(cqp)
        r = u @ np.diag([1, 1, np.sign(np.linalg.det(u @ v)) or 1]) @ v
    else:
        r = cqp @ np.linalg.pinv(cpp)
    m[:3, :3], m[:3, 3] = r, mq - r @ mp
    return m


def displacement(m: np.ndarray, dims) -> float:
    """Root mean square displacement of the eight corners."""
    c = np.array([[x, y, z, 1] for x in (0, dims[0]) for y in (0, dims[1]) for z in (0, dims[2])], float)
    return float(np.sqrt((((c @ m.T) - c)[:, :3] ** 2).sum(1).mean()))


def parse(text: str) -> np.ndarray:
    rows = [[float(x) for x in line.split()] for line in text.splitlines() if line.strip() and line.strip()[0] in "-+.0123456789"]
    return np.array(rows[-4:])


def render(m: np.ndarray) -> str:
    return "\n".join(" ".join(f"{x:.12g}" for x in r) for r in np.asarray(m)) + "\n"
