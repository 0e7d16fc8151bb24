"""Detections, transformations, lineage files and text sinks."""

from __future__ import annotations

import io
import pickle
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelith.functions import matrices
from voxelith.schemas import DETECTIONS, FRAME


def read_detections(spark: SparkSession, path: str) -> DataFrame:
    """Ten tab-separated columns; the frame is the last three digits in the file's name."""
    rows = spark.read.csv(path, sep="\t", schema=DETECTIONS, comment="#")
    return rows.withColumn("frame", F.regexp_extract(F.col("_metadata.file_name"), r"(\d{3})\D*$", 1).try_cast("int"))


def write_detections(det: DataFrame, path: str) -> None:
    det.select(*[c.split(" ")[0] for c in DETECTIONS.split(", ")]).write.csv(path, sep="\t")


def read_trsf(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("trsf_id"), "value")

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"trsf_id": pdf["trsf_id"], "mat": [matrices.parse(t).ravel().tolist() for t in pdf["value"]]})

    return files.mapInPandas(run, "trsf_id string, mat array<double>")


class _Plain(pickle.Unpickler):
    """Loads containers and numbers only."""

    def find_class(self, module: str, name: str) -> Any:
        if (module, name) in {("numpy", "dtype"), ("numpy.core.multiarray", "scalar"), ("numpy._core.multiarray", "scalar")}:
            import numpy as np

            return np.dtype if name == "dtype" else np.core.multiarray.scalar
        raise pickle.UnpicklingError(f"{module}.{name} isn't allowed")


def read_lineage(spark: SparkSession, path: str, t: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(edges, properties (cell_id, name, value)) of a lineage file; t: mothers before t, other properties up to t."""
    files = spark.read.format("binaryFile").load(path).select("content")

    def run(batches):
        for pdf in batches:
            for content in pdf["content"]:
                d = _Plain(io.BytesIO(content), encoding="latin1").load()
                rows = [("lin_tree", int(m), k, str(int(c))) for m, cs in d.get("lin_tree", {}).items() for k, c in enumerate(cs, 1)]
                rows += [(p, int(c), 0, str(v)) for p, x in d.items() if p != "lin_tree" and isinstance(x, dict) for c, v in x.items()]
                yield pd.DataFrame(rows, columns=["property", "cell_id", "ord", "value"])

    rows = files.mapInPandas(run, "property string, cell_id long, ord int, value string")
    edges = rows.where("property = 'lin_tree'").select(F.col("cell_id").alias("parent"), F.col("value").cast("long").alias("child"), "ord")
    props = rows.where("property <> 'lin_tree'").select("cell_id", F.col("property").alias("name"), "value")
    if t is not None:
        edges, props = edges.where(F.expr(f"parent div {FRAME} < {t}")), props.where(F.expr(f"cell_id div {FRAME} < {t + 1}"))
    return edges, props


def write_lineage(edges: DataFrame, cells: DataFrame, path: str) -> None:
    """Two Parquet tables."""
    edges.write.parquet(f"{path}/edges")
    cells.write.parquet(f"{path}/cells")


def write_tlp(edges: DataFrame, cells: DataFrame, path: str) -> None:
    from voxelith.operators.lineage import tlp_rows

    tlp_rows(edges, cells).orderBy("part", "cell_id", "other").select("line").write.text(path)


def write_histogram(hist: DataFrame, path: str) -> None:
    hist.orderBy("bin").select(F.format_string("%d %d", "bin", "n").alias("line")).write.text(path)


def read_structuring_element(text: str) -> list[tuple[int, int, int]]:
    """Offsets of a structuring element: XDIM/YDIM/ZDIM, then a grid with + (in) or - (out) at the centre and other numbers elsewhere."""
    dims, cells = {}, []
    for line in text.splitlines():
        line = line.split("#")[0].strip()
        if "=" in line or line.upper().startswith(("XDIM", "YDIM", "ZDIM")):
            k, v = line.replace("=", " ").split()[:2]
            dims[k.upper()] = int(v)
        elif line:
            cells += line.split()
    nx, ny = dims.get("XDIM", 1), dims.get("YDIM", 1)
    at = [(i % nx, i // nx % ny, i // (nx * ny)) for i in range(len(cells))]
    c = next((p for p, s in zip(at, cells, strict=True) if s[0] in "+-"), at[len(at) // 2])
    return [(x - c[0], y - c[1], z - c[2]) for (x, y, z), s in zip(at, cells, strict=True) if s not in ("-",) and s.strip("+-") != "0" and s != "0"]
