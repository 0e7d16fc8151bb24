import pickle

import numpy as np
import pytest

from voxelith.sources import images as I
from voxelith.sources import tables as T


@pytest.mark.parametrize("kind", ["u1", "u2", "u4", "u8", "f4", "f8"])
def test_inr_round_trip(kind):
    a = np.random.default_rng(0).integers(0, 200, (5, 4, 3)).astype(kind)
    for gz in (False, True):
        i = I.read_inr(I.write_inr(I.Image(a, (0.5, 0.5, 2.0), {"k": "v"}), gz))
        assert (i.data == a).all() and i.voxel == (0.5, 0.5, 2.0) and i.info["k"] == "v" and i.data.dtype == a.dtype
    v = np.zeros((3, 2, 2, 2), kind)
    assert I.read_inr(I.write_inr(I.Image(v))).data.shape == (3, 2, 2, 2)


def test_tif_and_npy_round_trip():
    a = np.random.default_rng(1).integers(0, 60000, (5, 4, 3)).astype("u2")
    i = I.read_tif(I.write_tif(I.Image(a, (0.5, 0.25, 2.0))))
    assert (i.data == a).all() and np.allclose(i.voxel, (0.5, 0.25, 2.0))
    assert (I.read_npy(I.write_npy(I.Image(a))).data == a).all()
    with pytest.raises(ValueError):
        I.decode("x.unknown", b"")


def test_read_voxels(spark, tmp_path):
    a = np.zeros((3, 2, 2), "u2")
    a[1, 1, 0], a[2, 0, 1] = 7, 9
    for t in (1, 2):
        (tmp_path / f"img_t{t:03d}.inr").write_bytes(I.write_inr(I.Image(a)))
    rows = {(r.t, r.x, r.y, r.z): r.v for r in I.read_voxels(spark, str(tmp_path), 0).collect()}
    assert rows == {(t, x, y, z): v for t in (1, 2) for x, y, z, v in ((1, 1, 0, 7.0), (2, 0, 1, 9.0))}
    s = I.series(spark, str(tmp_path)).first()
    assert (s.begin, s.end, s.complete) == (1, 2, True)
    assert I.read_metadata(spark, str(tmp_path)).first().xdim == 3


def test_lineage_file(spark, tmp_path):
    d = {"lin_tree": {40002: [50002, 50003], 50002: [60002]}, "volumes_information": {40002: 10, 50002: 6, 60002: 5}}
    (tmp_path / "l.pkl").write_bytes(pickle.dumps(d, 2))
    edges, props = T.read_lineage(spark, str(tmp_path / "l.pkl"), 5)
    assert {(r.parent, r.child, r.ord) for r in edges.collect()} == {(40002, 50002, 1), (40002, 50003, 2)}
    assert {r.cell_id for r in props.collect()} == {40002, 50002}
    (tmp_path / "bad.pkl").write_bytes(b"cos\nsystem\n(S'true'\ntR.")
    with pytest.raises(Exception, match="allowed"):
        T.read_lineage(spark, str(tmp_path / "bad.pkl"))[0].collect()


def test_texts(spark, tmp_path):
    (tmp_path / "m.trsf").write_text("1 0 0 2\n0 1 0 3\n0 0 1 4\n0 0 0 1\n")
    assert T.read_trsf(spark, str(tmp_path / "m.trsf")).first().mat[3] == 2.0
    (tmp_path / "d_007.txt").write_text("1\t2\t0\t3\t4\t0.5\t1\t1\t0.1\t0.2\n".replace("\t0.1", "\t9"))
    assert T.read_detections(spark, str(tmp_path / "d_007.txt")).first().frame == 7
    assert T.read_structuring_element("XDIM 3\nYDIM 1\nZDIM 1\n1 +1 1\n") == [(-1, 0, 0), (0, 0, 0), (1, 0, 0)]
