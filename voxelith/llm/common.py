"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where none is set and all run in one process (tests)."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("voxelith.shared.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="voxelith-")
        spark.conf.set("voxelith.shared.dir", found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


#: Folders that this process has written, by application.
_WRITTEN: dict[str, list[str]] = {}


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Writes a table into the shared folder and reads it again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    _WRITTEN[spark.sparkContext.applicationId].remove(path)


def discard(*tables: DataFrame) -> None:
    """Deletes written tables that nothing reads any more."""
    for t in tables:
        _delete(t.sparkSession, t.written_to)


def written(spark: SparkSession) -> list[str]:
    """The folders of the tables that this application has written and not deleted."""
    return list(_WRITTEN.get(spark.sparkContext.applicationId, []))


def release(paths: list[str], kept: DataFrame) -> None:
    """Deletes the written tables at ``paths``, but for those that ``kept`` reads."""
    read = {part for f in kept.inputFiles() for part in f.split("/")} if paths else set()
    for path in set(paths) & set(written(kept.sparkSession)):
        if path.rsplit("/", 1)[1] not in read:
            _delete(kept.sparkSession, path)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def lower_ascii(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def lean(fn: Callable, keeps: bool = False) -> Callable:
    """A function over Arrow batches that gives freed memory back to the system when it ends: workers are used again by later stages. What other work has left in the worker (tables of words) goes first, unless ``keeps``."""

    def run(batches):
        import ctypes

        import pyarrow as pa

        from .words import forget

        if not keeps:
            forget()
        yield from fn(batches)
        pa.default_memory_pool().release_unused()
        if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
            libc.malloc_trim(0)

    return run


def small_batches(spark: SparkSession, size: int) -> None:
    """From now on, Arrow batches of this session that go to workers end at ``size`` bytes, or at less if the session says so."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    try:
        now = spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch()
    except Exception:  # a Spark without that limit
        return
    if now <= 0 or now > size:
        spark.conf.set(name, str(size))


def arrow_map(df: DataFrame, fn: Callable, schema: str) -> DataFrame:
    """mapInArrow over whole record batches."""
    return df.mapInArrow(fn, schema)
