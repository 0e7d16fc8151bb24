"""Image files as rows. Bytes come through Spark's binaryFile source, so any file system that Spark reads will do."""

from __future__ import annotations

import gzip
import io
import re
import struct
import zipfile
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_INR = {("unsigned fixed", 8): "u1", ("unsigned fixed", 16): "u2", ("unsigned fixed", 32): "u4", ("unsigned fixed", 64): "u8", ("signed fixed", 8): "i1", ("signed fixed", 16): "i2", ("signed fixed", 32): "i4", ("float", 32): "f4", ("float", 64): "f8"}


@dataclass
class Image:
    """data is (x, y, z), or (v, x, y, z) for vectors."""

    data: np.ndarray
    voxel: tuple[float, float, float] = (1.0, 1.0, 1.0)
    info: dict[str, str] = field(default_factory=dict)

    def real_shape(self) -> tuple[float, ...]:
        return tuple(n * v for n, v in zip(self.data.shape[-3:], self.voxel, strict=True))

    def is_2d(self) -> bool:
        return self.data.ndim == 2 or self.data.shape[-1] == 1


def read_inr(content: bytes) -> Image:
    raw = gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content
    end = raw.index(b"##}")
    end += raw[end:].index(b"\n") + 1
    head = dict(line.split("=", 1) for line in raw[:end].decode("latin-1").splitlines() if "=" in line)
    dims = [int(head.get(k, 1)) for k in ("XDIM", "YDIM", "ZDIM", "VDIM")]
    kind = _INR[head["TYPE"].strip(), int(head["PIXSIZE"].split()[0])]
    order = ">" if head.get("CPU", "pc").strip() in ("sun", "sgi") else "<"
    n = int(np.prod(dims))
    a = np.frombuffer(raw, order + kind, n, end).astype(kind)
    shape = dims[:3] if dims[3] == 1 else [dims[3], *dims[:3]]
    known = {"XDIM", "YDIM", "ZDIM", "VDIM", "TYPE", "PIXSIZE", "CPU", "SCALE", "VX", "VY", "VZ"}
    return Image(a.reshape(shape, order="F"), tuple(float(head.get(k, 1)) for k in ("VX", "VY", "VZ")), {k: v for k, v in head.items() if k not in known})


def write_inr(img: Image, compress: bool = False) -> bytes:
    a = img.data
    v, dims = (1, a.shape) if a.ndim == 3 else (a.shape[0], a.shape[1:])
    kind = next(k for k, t in _INR.items() if np.dtype(t) == a.dtype)
    if kind[0] == "signed fixed":
        raise ValueError("signed images have no INR writer")
    lines = ["#INRIMAGE-4#{", *(f"{k}={n}" for k, n in zip(("XDIM", "YDIM", "ZDIM"), dims, strict=True)), f"VDIM={v}", f"TYPE={kind[0]}", f"PIXSIZE={kind[1]} bits", "SCALE=2**0", "CPU=decm", *(f"{k}={x:g}" for k, x in zip(("VX", "VY", "VZ"), img.voxel, strict=True)), *(f"{k}={x}" for k, x in sorted(img.info.items()))]
    head = "\n".join(lines) + "\n"
    pad = -(len(head) + 4) % 256
    out = (head + "\n" * pad + "##}\n").encode("latin-1") + a.astype(a.dtype.newbyteorder("<")).tobytes(order="F")
    return gzip.compress(out) if compress else out


_TYPES = {1: "B", 2: "c", 3: "H", 4: "I", 5: "II", 11: "f", 12: "d"}


def _lzw(data: bytes) -> bytes:
    out, table, bits, at, prev = bytearray(), [], 9, 0, None
    total = 8 * len(data)
    big = int.from_bytes(data, "big")
    while at + bits <= total:
        code = big >> (total - at - bits) & ((1 << bits) - 1)
        at += bits
        if code == 257:
            break
        if code == 256:
            table, bits, prev = [bytes([i]) for i in range(256)] + [b"", b""], 9, None
            continue
        entry = table[code] if code < len(table) else prev + prev[:1]
        out += entry
        if prev is not None:
            table.append(prev + entry[:1])
            bits = 9 if len(table) < 511 else 10 if len(table) < 1023 else 11 if len(table) < 2047 else 12
        prev = entry
    return bytes(out)


def read_tif(content: bytes, channel: int = 0) -> Image:
    """Multi-page greyscale TIFF, uncompressed or LZW. The spacing text is parsed, never evaluated."""
    e = "<" if content[:2] == b"II" else ">"
    at, pages, voxel = struct.unpack_from(e + "I", content, 4)[0], [], [1.0, 1.0, 1.0]
    while at:
        (n,) = struct.unpack_from(e + "H", content, at)
        tags = {}
        for k in range(n):
            tag, kind, count, _ = struct.unpack_from(e + "HHII", content, at + 2 + 12 * k)
            size = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 11: 4, 12: 8}.get(kind, 1) * count
            where = at + 10 + 12 * k if size <= 4 else struct.unpack_from(e + "I", content, at + 10 + 12 * k)[0]
            if kind == 2:
                tags[tag] = content[where : where + count].rstrip(b"\0").decode("latin-1")
            elif kind == 5:
                x = struct.unpack_from(e + "II" * count, content, where)
                tags[tag] = [x[2 * i] / max(x[2 * i + 1], 1) for i in range(count)]
            else:
                tags[tag] = list(struct.unpack_from(e + _TYPES.get(kind, "B") * count, content, where))
        at = struct.unpack_from(e + "I", content, at + 2 + 12 * n)[0]
        bits = tags.get(258, [8])[0]
        kind = {1: "u", 2: "i", 3: "f"}[tags.get(339, [1])[0]] + str(bits // 8)
        strips = [content[o : o + c] for o, c in zip(tags[273], tags[279], strict=True)]
        if tags.get(259, [1])[0] == 5:
            strips = [_lzw(s) for s in strips]
        w, h, spp = tags[256][0], tags[257][0], tags.get(277, [1])[0]
        page = np.frombuffer(b"".join(strips), e + kind, w * h * spp).reshape(h, w, spp)[..., min(channel, spp - 1)]
        pages.append(page.T.astype(kind))
        for k, tag in enumerate((282, 283)):
            if tags.get(tag, [0])[0]:
                voxel[k] = 1 / tags[tag][0]
        m = re.search(r"spacing=([0-9.eE+-]+)", str(tags.get(270, "")))
        if m:
            voxel[2] = float(m[1])
    return Image(np.stack(pages, -1), tuple(voxel))


def write_tif(img: Image) -> bytes:
    """Uncompressed pages, little-endian, with resolutions and spacing."""
    a = img.data if img.data.ndim == 3 else img.data[..., None]
    out = bytearray(b"II*\0\0\0\0\0")
    last = 4
    about = f"spacing={img.voxel[2]:g}".encode() + b"\0"
    for z in range(a.shape[2]):
        page = np.ascontiguousarray(a[:, :, z].T).astype(a.dtype.newbyteorder("<")).tobytes()
        data, text = len(out), len(out) + len(page)
        out += page + about + b"\0" * (len(about) % 2)
        res = len(out)
        for v in img.voxel[:2]:
            out += struct.pack("<II", round(1e6 / v), 1_000_000)
        kind = {"u": 1, "i": 2, "f": 3}[a.dtype.kind]
        tags = [(256, 4, 1, a.shape[0]), (257, 4, 1, a.shape[1]), (258, 3, 1, a.dtype.itemsize * 8), (259, 3, 1, 1), (262, 3, 1, 1), (270, 2, len(about), text), (273, 4, 1, data), (277, 3, 1, 1), (278, 4, 1, a.shape[1]), (279, 4, 1, len(page)), (282, 5, 1, res), (283, 5, 1, res + 8), (339, 3, 1, kind)]
        struct.pack_into("<I", out, last, len(out))
        out += struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHII", *t) for t in tags)
        last = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


def read_npy(content: bytes) -> Image:
    a = np.load(io.BytesIO(content), allow_pickle=False)
    if hasattr(a, "files"):
        a = a[a.files[0]]
    return Image(a if a.ndim >= 3 else a[..., None])


def write_npy(img: Image) -> bytes:
    out = io.BytesIO()
    np.save(out, img.data, allow_pickle=False)
    return out.getvalue()


def read_pnm(content: bytes) -> Image:
    m = re.match(rb"(P[56])\s(?:#[^\n]*\n)*(\d+)\s+(\d+)\s+(\d+)\s", content)
    w, h, top, c = int(m[2]), int(m[3]), int(m[4]), 3 if m[1] == b"P6" else 1
    a = np.frombuffer(content, ">u2" if top > 255 else "u1", w * h * c, m.end()).reshape(h, w, c)
    return Image(a[..., 0].T[..., None].astype("u2" if top > 255 else "u1"))


def read_h5(content: bytes) -> Image:
    """Needs h5py."""
    import h5py

    with h5py.File(io.BytesIO(content)) as f:
        return Image(np.asarray(f["Data"]).transpose(2, 1, 0))


READERS = {".inr": read_inr, ".inr.gz": read_inr, ".tif": read_tif, ".tiff": read_tif, ".npy": read_npy, ".npz": read_npy, ".pgm": read_pnm, ".ppm": read_pnm, ".h5": read_h5, ".hdf5": read_h5}


def decode(path: str, content: bytes) -> Image:
    """By extension; a zip holds one image."""
    if path.endswith(".zip"):
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            name = z.namelist()[0]
            return decode(name, z.read(name))
    for ext in sorted(READERS, key=len, reverse=True):
        if path.lower().endswith(ext):
            return READERS[ext](content)
    raise ValueError(f"no reader for {path}")


VOXELS = "image_id string, t int, x long, y long, z int, v double"


def read_voxels(spark: SparkSession, path: str, background=None, per: int = 200_000) -> DataFrame:
    """Voxel rows of all images of a path; t from the last three digits in the name. background: a value whose voxels are left out."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches):
        for pdf in batches:
            for p, content in zip(pdf["path"], pdf["content"], strict=True):
                name = p.rsplit("/", 1)[-1]
                a = decode(name, content).data
                m = re.findall(r"\d{3}", name)
                keep = np.flatnonzero(a.ravel(order="F") != background) if background is not None else np.arange(a.size)
                for i in range(0, len(keep), per):
                    k = keep[i : i + per]
                    x, y, z = np.unravel_index(k, a.shape, order="F")
                    yield pd.DataFrame({"image_id": name, "t": np.int32(m[-1] if m else 0), "x": x, "y": y, "z": z.astype(np.int32), "v": a[x, y, z].astype(float)})

    return files.mapInPandas(run, VOXELS)


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    from voxelith.schemas import IMAGES

    def run(batches):
        for pdf in batches:
            rows = []
            for p, content in zip(pdf["path"], pdf["content"], strict=True):
                i = decode(p, content)
                x, y, z = i.data.shape[-3:]
                rows.append((p.rsplit("/", 1)[-1], p, x, y, z, 1 if i.data.ndim == 3 else i.data.shape[0], str(i.data.dtype), *i.voxel, i.info))
            yield pd.DataFrame(rows, columns=[c.split(" ")[0] for c in IMAGES.split(", ")])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, IMAGES)


def encode_images(voxels: DataFrame, ext: str = ".inr", dtype: str = "u2") -> DataFrame:
    """image_id and the bytes of its file, one image a task."""
    write = {".inr": write_inr, ".inr.gz": lambda i: write_inr(i, True), ".tif": write_tif, ".npy": write_npy}[ext]

    def run(key, pdf):
        at = pdf[["x", "y", "z"]].to_numpy(np.int64)
        a = np.zeros(at.max(0) + 1, dtype)
        a[tuple(at.T)] = pdf["v"].to_numpy()
        return pd.DataFrame({"image_id": [key[0]], "content": [write(Image(a))]})

    return voxels.groupBy("image_id").applyInPandas(run, "image_id string, content binary")


def series(spark: SparkSession, path: str) -> DataFrame:
    """One row a folder pattern: first and last time, extension, and whether the series is complete and its names are alike."""
    names = spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"))
    parts = names.select("name", F.regexp_extract("name", r"^(.*?)(\d{3})(\.[A-Za-z0-9.]+)$", 1).alias("stem"), F.regexp_extract("name", r"^(.*?)(\d{3})(\.[A-Za-z0-9.]+)$", 2).cast("int").alias("t"), F.regexp_extract("name", r"^(.*?)(\d{3})(\.[A-Za-z0-9.]+)$", 3).alias("ext"))
    return parts.groupBy("stem", "ext").agg(F.min("t").alias("begin"), F.max("t").alias("end"), F.count("*").alias("n")).withColumn("complete", F.col("end") - F.col("begin") + 1 == F.col("n"))
