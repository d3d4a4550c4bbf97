"""Scans: array files (npy, NIfTI-1, FreeSurfer curv, GIFTI), CSV covariates, text mappings, subject lists, catalogs of reference files."""

from __future__ import annotations

import base64
import gzip
import io
import re
import struct
import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortix.operators.tabular import SENTINELS, filter_events

# The data types of NIfTI-1 headers by code.
NIFTI_TYPES = {2: "u1", 4: "i2", 8: "i4", 16: "f4", 64: "f8", 256: "i1", 512: "u2", 768: "u4", 1024: "i8", 1280: "u8"}
# The data types of GIFTI arrays.
GIFTI_TYPES = {"NIFTI_TYPE_UINT8": "u1", "NIFTI_TYPE_INT32": "i4", "NIFTI_TYPE_FLOAT32": "f4", "NIFTI_TYPE_FLOAT64": "f8"}
# Suffixes of FreeSurfer per-vertex files.
CURV_SUFFIXES = ("area", "curv", "sulc", "thickness")

#: More decoders by suffix: register(".ext", bytes -> array).
_more: dict[str, Callable[[bytes], np.ndarray]] = {}


def register(suffix: str, decode: Callable[[bytes], np.ndarray]) -> None:
    _more[suffix] = decode


def decode_npy(raw: bytes) -> np.ndarray:
    return np.load(io.BytesIO(raw), allow_pickle=False)


def decode_nifti(raw: bytes) -> np.ndarray:
    """Voxels of a NIfTI-1 file, gzipped or not, scaled by its slope and intercept."""
    raw = gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw
    order = "<" if struct.unpack("<i", raw[:4])[0] == 348 else ">"
    dim = struct.unpack(order + "8h", raw[40:56])
    kind = struct.unpack(order + "h", raw[70:72])[0]
    offset, slope, inter = struct.unpack(order + "3f", raw[108:120])
    shape = dim[1 : 1 + dim[0]]
    data = np.frombuffer(raw, dtype=order + NIFTI_TYPES[kind], count=int(np.prod(shape)), offset=int(offset)).reshape(shape, order="F")
    return data * slope + inter if slope not in (0, 1) or inter else data


def decode_curv(raw: bytes) -> np.ndarray:
    """Values of the newer FreeSurfer curv format: 3 bytes of ones, counts, big-endian floats."""
    if raw[:3] != b"\xff\xff\xff":
        raise ValueError("not a curv file of the newer format")
    n = struct.unpack(">i", raw[3:7])[0]
    return np.frombuffer(raw, dtype=">f4", count=n, offset=15)


def decode_gifti(raw: bytes) -> np.ndarray:
    """All data arrays of a GIFTI file, one in a column."""
    out = []
    for tag, body in re.findall(r"<DataArray\b(.*?)>(.*?)</DataArray>", raw.decode("utf-8"), re.S):
        has = dict(re.findall(r'(\w+)="([^"]*)"', tag))
        data = re.search(r"<Data>(.*?)</Data>", body, re.S)[1].strip()
        shape = [int(has[f"Dim{i}"]) for i in range(int(has["Dimensionality"]))]
        kind = GIFTI_TYPES[has["DataType"]]
        if has["Encoding"] == "ASCII":
            x = np.array(data.split(), dtype=kind)
        else:
            b = base64.b64decode(data)
            x = np.frombuffer(zlib.decompress(b) if has["Encoding"].startswith("GZip") else b, dtype=("<" if has["Endian"].startswith("Little") else ">") + kind)
        out.append(x.reshape(shape, order="F" if has.get("ArrayIndexingOrder") == "ColumnMajorOrder" else "C"))
    return np.squeeze(np.stack(out, axis=-1))


def decode(path: str, raw: bytes) -> np.ndarray:
    """The array in a file of any known kind, by suffix, without dimensions of one."""
    for suffix, f in _more.items():
        if path.endswith(suffix):
            return np.squeeze(f(raw))
    if path.endswith((".npy",)):
        return np.squeeze(decode_npy(raw))
    if path.endswith(".npz"):
        with np.load(io.BytesIO(raw), allow_pickle=False) as z:
            return np.squeeze(z[z.files[0]])
    if path.endswith((".nii", ".nii.gz")):
        return np.squeeze(decode_nifti(raw))
    if path.endswith((".gii",)):
        return decode_gifti(raw)
    if path.endswith(CURV_SUFFIXES):
        return np.squeeze(decode_curv(raw))
    raise RuntimeError(f"unknown kind of file: {path}")


def load_arrays(spark: SparkSession, paths: str | list[str], subject: str = r"([^/]+)\.[^/]*$", start: int = 0, stop: int | None = None) -> DataFrame:
    """(subject, path, data): each file decoded in its task and flattened, a slice of it if asked for. subject: pattern of the id in the path."""
    return decode_files(spark.read.format("binaryFile").load(paths), subject, start, stop)


def decode_files(files: DataFrame, subject: str = r"([^/]+)\.[^/]*$", start: int = 0, stop: int | None = None) -> DataFrame:
    """(subject, path, data) of files (path, content), wherever they come from."""

    def decoded(batches):
        for b in batches:
            data = [np.asarray(decode(p, bytes(raw)), dtype=float).ravel()[start:stop].tolist() for p, raw in zip(b["path"], b["content"])]
            yield pd.DataFrame({"subject": b["subject"], "path": b["path"], "data": data})

    rows = files.select(F.regexp_extract("path", subject, 1).alias("subject"), "path", "content")
    return rows.mapInPandas(decoded, "subject string, path string, data array<double>")


def read_csv(spark: SparkSession, path: str, columns: list[str], events: str | list[str] | None = "baseline_year_1_arm_1", subject: str = "src_subject_id", event: str = "eventname", drop_missing: bool = False, sep: str = ",") -> DataFrame:
    """Covariates by name: only these columns are read; `C(x)` is x; codes of missing values and blanks are null; numbers where all values are."""
    names = [c[2:-1] if c.startswith("C(") and c.endswith(")") else c for c in columns]
    want = [subject, *([event] if events is not None or event in names else []), *[c for c in names if c != event]]
    df = spark.read.option("header", True).option("sep", sep).option("nullValue", "").csv(path).select(*dict.fromkeys(want))
    df = df.select(*[F.when(~F.col(c).isin(*SENTINELS, "NA", "NaN", "nan", ""), F.col(c)).alias(c) for c in df.columns])
    text = df.agg(*[F.count_if(F.col(c).isNotNull() & F.expr(f"try_cast(`{c}` AS double)").isNull()).alias(c) for c in names if c in df.columns and c not in (subject, event)]).first().asDict()
    df = df.select(*[F.col(c).cast("double").alias(c) if text.get(c) == 0 else F.col(c) for c in df.columns])
    df = filter_events(df, events, event)
    return df.dropna() if drop_missing else df


def read_mapping(spark: SparkSession, path: str) -> DataFrame:
    """(key, value): the first two comma fields of each line."""
    parts = F.split("value", ",")
    return spark.read.text(path).where(F.size(parts) > 1).select(F.trim(F.get(parts, 0)).alias("key"), F.trim(F.get(parts, 1)).alias("value"))


def read_subjects(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).where(F.trim("value") != "").select(F.trim("value").alias("subject"))


def catalog_lookup(files: DataFrame, keys: list[str], tokens: list[str]) -> DataFrame:
    """(path): of the files (path) whose name holds a key and a hemisphere token, that of the first key, first token and shortest name.

    One file is kept by an aggregate with partial results, whatever the number of files."""
    spark = files.sparkSession
    order = spark.createDataFrame([(i, k, j, t) for i, k in enumerate(keys) for j, t in enumerate(tokens)], "ki int, key string, ti int, token string")
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    hits = files.select("path", name.alias("name")).join(F.broadcast(order), F.col("name").contains(F.col("key")) & F.col("name").contains(F.col("token")))
    best = hits.agg(F.min(F.struct("ki", "ti", F.char_length("name").alias("n"), "name", "path")).alias("b"))
    return best.where("b is not null").select("b.path")


def space_options(folders: DataFrame, reserved: list[str]) -> DataFrame:
    """(name) of reference folders that are spaces: none that start with `_`, none of the reserved."""
    return folders.where(~F.col("name").startswith("_") & ~F.col("name").isin(reserved))


def decode_surface(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(coordinates, triangles) of a GIFTI surface or a FreeSurfer geometry file."""
    if raw[:3] == b"\xff\xff\xfe":  # FreeSurfer triangles: two text lines, counts, big-endian coordinates and corners
        at = raw.index(b"\n\n") + 2
        nv, nt = struct.unpack(">2i", raw[at : at + 8])
        xyz = np.frombuffer(raw, ">f4", 3 * nv, at + 8).reshape(nv, 3)
        return xyz, np.frombuffer(raw, ">i4", 3 * nt, at + 8 + 12 * nv).reshape(nt, 3)
    text = raw.decode("utf-8")
    parts = re.findall(r"<DataArray\b.*?</DataArray>", text, re.S)
    points = next(p for p in parts if "POINTSET" in p)
    corners = next(p for p in parts if "TRIANGLE" in p)
    return decode_gifti(points.encode()), decode_gifti(corners.encode())


def load_surface(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(vertices, triangles) of one surface file: (vertex, x, y, z) and (tri, a, b, c)."""
    return surface_frames(spark, bytes(spark.read.format("binaryFile").load(path).select("content").first()[0]))


def surface_frames(spark: SparkSession, raw: bytes) -> tuple[DataFrame, DataFrame]:
    """(vertices, triangles) of the bytes of a surface file."""
    xyz, tri = decode_surface(raw)
    vertices = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(xyz.tolist())], "vertex long, x double, y double, z double")
    return vertices, spark.createDataFrame([(i, *map(int, r)) for i, r in enumerate(tri.tolist())], "tri long, a long, b long, c long")


def both_hemispheres(left: DataFrame, right: DataFrame) -> DataFrame:
    """(subject, feat, v): features of the left side, then those of the right, of each subject."""
    size = left.agg((F.max("feat") + 1).alias("_n"))
    moved = right.crossJoin(F.broadcast(size)).select("subject", (F.col("feat") + F.col("_n")).alias("feat"), "v")
    return left.select("subject", "feat", "v").unionByName(moved)
