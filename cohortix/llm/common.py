"""Helpers that several operators share: table reading, durable cut of lineage, byte views of Arrow text, word hashes."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MASK = (1 << 64) - 1
#: Odd multiplier of the polynomial word hash, and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)
#: Bytes hashed at once; bounds the working memory to about 40 bytes for each.
BLOCK = 1 << 18


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or one of our own in local mode where that is unset."""
    context = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not path:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="checkpoints-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(path)
    return path


def small_batches(spark: SparkSession, most: str = "4m") -> None:
    """From now on at most so many bytes go to a Python worker at once: its memory is bounded also where texts are long."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", most)


def durable(df: DataFrame) -> DataFrame:
    """The rows of df, written to the shared folder: later plans read them from there, also after executors are lost."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def compact(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """durable(df), read in parts of about so many rows where that makes fewer: a small table needs few tasks and files."""
    out = durable(df)
    return out.coalesce(max(1, -(-out.count() // rows)))


def stored(df: DataFrame) -> tuple[DataFrame, str]:
    """The rows of df as a Parquet table in the shared folder, and its path; compressed, and read by column. See discard()."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a stored table that no plan needs any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def free_name(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have, in any case of letters."""
    taken, out = {c.lower() for c in df.columns}, f"_{name}"
    while out.lower() in taken:
        out = f"_{out}"
    return out


def release_memory() -> None:
    """Gives what a Python worker has freed back to the system; workers stay idle between tasks beside those that work."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        return


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string array, without copying, and the offset of each text; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, dtype=kind, count=len(texts) + texts.offset + 1)[texts.offset :].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    raw = raw[at[0] : at[-1]]
    return raw, at - at[0]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def byte_classes(word_bytes: str) -> np.ndarray:
    """256 entries: 0 for a separator, else the byte with A-Z lower-cased. word_bytes: 'nonspace' or 'alphanumeric'."""
    b = np.arange(256)
    low = np.where((b >= 65) & (b <= 90), b + 32, b).astype(np.uint8)
    if word_bytes == "nonspace":
        word = ~((b == 32) | ((b >= 9) & (b <= 13)))
    elif word_bytes == "alphanumeric":
        word = ((b >= 48) & (b <= 57)) | ((low >= 97) & (low <= 122)) | (b >= 128)
    else:
        raise ValueError(f"unknown word class {word_bytes!r}")
    return low, word


def words_of(raw: np.ndarray, at: np.ndarray, classes: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end, first): a 64-bit hash and the byte span of every word, and where the words of each text begin.

    Words never cross texts. The hash is a polynomial in the bytes, scrambled; equal words have equal hashes."""
    low, word = classes
    inside = word[raw]
    edge = np.zeros(len(raw) + 1, dtype=bool)
    edge[at] = True
    before = np.zeros(len(raw), dtype=bool)
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.zeros(len(raw), dtype=bool)
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    first = np.searchsorted(starts, at)
    out = np.empty(len(starts), dtype=np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + BLOCK, "right")))
        s, e = starts[i:j] - starts[i], ends[i:j] - starts[i]
        n = int(e[-1])
        power, inverse = powers(n + 1)
        total = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum((low[raw[starts[i] : starts[i] + n]].astype(np.uint64) + np.uint64(1)) * power[:n], out=total[1:])
        out[i:j] = mix((total[e] - total[s]) * inverse[s])
        i = j
    return out, starts, ends, first


_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of BASE and of its inverse, kept for up to one block."""
    if len(_powers.get("up", ())) < n:
        up, down = np.full(n, BASE, dtype=np.uint64), np.full(n, BASE_INVERSE, dtype=np.uint64)
        up[0] = down[0] = 1
        up, down = np.cumprod(up), np.cumprod(down)
        if n > BLOCK + 1:
            return up, down
        _powers.update(up=up, down=down)
    return _powers["up"][:n], _powers["down"][:n]


def shingles_of(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of size words; fewer words make one run, none make none."""
    if not len(words):
        return words
    k = min(size, len(words))
    n = len(words) - k + 1
    total = np.full(n, k, dtype=np.uint64)
    for i in range(k):
        total = mix(total ^ words[i : i + n]) + np.uint64(i)
    return total


def slices(at: np.ndarray, most: int = BLOCK) -> list[tuple[int, int]]:
    """Cuts a batch of texts into runs of about most bytes, each of one text at least."""
    out, i, n = [], 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, "right")) - 1)
        out.append((i, min(j, n)))
        i = j
    return out


def spread_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """An equi-join whose hot keys Spark's adaptive execution can split.

    It splits a hot partition only where both sides are shuffled for the join itself. Where right comes from an aggregate
    by the same keys Spark would keep that aggregate's partitioning; a further key, a hash of the others, makes it shuffle."""
    extra = F.xxhash64(*keys, F.lit(1))
    return left.withColumn("_spread", extra).join(right.withColumn("_spread", extra), [*keys, "_spread"], how).drop("_spread")


def numbered(rows: DataFrame, by: list[str]) -> DataFrame:
    """rows, distinct by the columns by, with id: their place in that order, from 0. Written to the shared folder.

    Ranges of the order are numbered side by side; the driver gets one count for each."""
    spark = rows.sparkSession
    ranged = durable(rows.repartitionByRange(*by).withColumn("_part", F.spark_partition_id()))
    total, before = 0, []
    for r in sorted(ranged.groupBy("_part").agg(F.count("*").alias("n")).collect()):
        before.append((r["_part"], total))
        total += r["n"]
    offsets = F.broadcast(spark.createDataFrame(before, "_part int, _before bigint"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*by)) - 1 + F.col("_before")
    return durable(ranged.join(offsets, "_part").withColumn("id", place.cast("long")).drop("_part", "_before"))
