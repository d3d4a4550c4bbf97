"""Sinks and the cache of results: tables, mappings, GIFTI arrays, read-through with eviction by age."""

from __future__ import annotations

import base64
import hashlib
import io
import json
import os
import struct
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortix.shared import placed

from .arrays import GIFTI_TYPES

# The frame of a GIFTI file.
GIFTI_HEAD = '<?xml version="1.0" encoding="UTF-8"?>\n<GIFTI Version="1.0" NumberOfDataArrays="{count}">\n'
GIFTI_ARRAY = '<DataArray Intent="{intent}" DataType="{kind}" ArrayIndexingOrder="RowMajorOrder" Dimensionality="{n}" {dims} Encoding="Base64Binary" Endian="LittleEndian">\n<Data>{data}</Data>\n</DataArray>\n'
GIFTI_TAIL = "</GIFTI>\n"


def write_tsv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("sep", "\t").csv(path)


def read_tsv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A written table, its columns in the order asked for."""
    return spark.read.option("header", True).option("sep", "\t").csv(path).select(columns)


def write_mapping(mapping: DataFrame, path: str) -> None:
    mapping.select("key", "value").write.mode("overwrite").csv(path)


def gifti_array(data: np.ndarray, intent: str, kind: str) -> str:
    x = np.ascontiguousarray(data, dtype="<" + GIFTI_TYPES[kind])
    dims = " ".join(f'Dim{i}="{n}"' for i, n in enumerate(x.shape))
    return GIFTI_ARRAY.format(intent=intent, kind=kind, n=x.ndim, dims=dims, data=base64.b64encode(x.tobytes()).decode())


def gifti(data: np.ndarray | list[np.ndarray], intent: str = "NIFTI_INTENT_NONE") -> bytes:
    """A GIFTI file of one array of floats, or of several."""
    arrays = data if isinstance(data, list) else [data]
    return (GIFTI_HEAD.format(count=len(arrays)) + "".join(gifti_array(x, intent, "NIFTI_TYPE_FLOAT32") for x in arrays) + GIFTI_TAIL).encode()


def gifti_surface(xyz: np.ndarray, triangles: np.ndarray) -> bytes:
    """A GIFTI surface: coordinates and corners."""
    points = gifti_array(xyz, "NIFTI_INTENT_POINTSET", "NIFTI_TYPE_FLOAT32")
    return (GIFTI_HEAD.format(count=2) + points + gifti_array(triangles, "NIFTI_INTENT_TRIANGLE", "NIFTI_TYPE_INT32") + GIFTI_TAIL).encode()


def npy(data: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, data, allow_pickle=False)
    return out.getvalue()


def nifti(data: np.ndarray) -> bytes:
    """A NIfTI-1 file of doubles: the header of 348 bytes, four more, and the voxels, the first place fastest."""
    x = np.asarray(data, dtype="<f8")
    header = bytearray(352)
    struct.pack_into("<i", header, 0, 348)
    struct.pack_into("<8h", header, 40, x.ndim, *x.shape, *[1] * (7 - x.ndim))
    struct.pack_into("<2h", header, 70, 64, 64)
    struct.pack_into("<3f", header, 108, 352.0, 1.0, 0.0)
    header[344:348] = b"n+1\0"
    return bytes(header) + x.tobytes(order="F")


def curv(data: np.ndarray) -> bytes:
    """A FreeSurfer file of one value for each vertex."""
    x = np.asarray(data, dtype=">f4")
    return b"\xff\xff\xff" + struct.pack(">3i", len(x), 0, 1) + x.tobytes()


def write_file(spark: SparkSession, path: str, raw: bytes) -> None:
    """One small file, through Hadoop, wherever path lies."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where, True)
    out.write(bytearray(raw))
    out.close()


def file_facts(spark: SparkSession | None, path: str) -> list | None:
    """Size and time of change of a file, in any store that Spark reads where a session is given; None if there is none."""
    if spark is None:
        return [(s := os.stat(path)).st_size, int(s.st_mtime)] if os.path.exists(path) else None
    if "/" not in path:
        return None
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(where):
        return None
    s = store.getFileStatus(where)
    return [s.getLen(), s.getModificationTime() // 1000]


def cache_key(arguments: dict, use_base_name: bool = False, spark: SparkSession | None = None) -> str:
    """A hash of arguments: lists in any order are the same, files count with size and time of change (and by name alone if asked for)."""

    def plain(x):
        if isinstance(x, dict):
            return {k: plain(v) for k, v in sorted(x.items())}
        if isinstance(x, (list, tuple, set)):
            return sorted((plain(v) for v in x), key=repr)
        if isinstance(x, str) and (facts := file_facts(spark, x)):
            return [os.path.basename(x) if use_base_name else x, *facts]
        return x

    return hashlib.sha256(json.dumps(plain(arguments), sort_keys=True, default=str).encode()).hexdigest()


def read_through(spark: SparkSession, folder: str, arguments: dict, compute: Callable[[], DataFrame]) -> DataFrame:
    """The table under the arguments' key in folder; computed and written there first if it isn't complete."""
    path = f"{folder.rstrip('/')}/{cache_key(arguments, spark=spark)}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS")
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        compute().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def evicted(entries: DataFrame, limit: float) -> DataFrame:
    """Entries (name, size, time) to delete, oldest first, until the rest is limit or less: those whose size with all newer ones exceeds it.

    Ties in time go by name. Ranges of time are summed side by side, and each adds the sizes of the newer ranges."""
    newest = placed(entries, F.desc("time"), F.desc("name"))
    sums = newest.groupBy("_part").agg(F.sum("size").alias("_s"))
    before = sums.select("_part", (F.sum("_s").over(Window.orderBy("_part")) - F.col("_s")).alias("_before"))
    inside = F.sum("size").over(Window.partitionBy("_part").orderBy("place"))
    out = newest.join(F.broadcast(before), "_part").withColumn("_total", inside + F.col("_before"))
    return out.where(F.col("_total") > limit).select(*entries.columns)


def evict(spark: SparkSession, folder: str, limit: float) -> list[str]:
    """Deletes the oldest tables of a cache folder until the rest has limit bytes or less; the names of those deleted."""
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    store = where.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [(s.getPath().getName(), store.getContentSummary(s.getPath()).getLength(), s.getModificationTime()) for s in store.listStatus(where)] if store.exists(where) else []
    entries = spark.createDataFrame(found, "name string, size long, time long")
    names = sorted(r["name"] for r in evicted(entries, limit).collect())  # of one folder's listing
    for name in names:
        store.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/{name}"), True)
    return names
