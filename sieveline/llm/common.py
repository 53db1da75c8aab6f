"""What the operators share: tables, scratch space on shared storage, Arrow columns."""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names. Where none is named, a temporary one, but
    only in a local session: a cluster's executors would each write to a disk of their own."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = spark.conf.get("sieveline.scratch", None)
        if not named:
            named = "file://" + tempfile.mkdtemp(prefix="sieveline-")
            spark.conf.set("sieveline.scratch", named)
    return named.rstrip("/")


def stored(df: DataFrame, what: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: the lineage ends there,
    and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/sieveline/{what}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    _LEFT.setdefault(spark.sparkContext.applicationId, []).append(out)
    return out


_LEFT: dict[str, list[DataFrame]] = {}  # by application, tables that still lie there


def clear(spark: SparkSession) -> int:
    """Deletes every table of this application that stored() made and that still lies there,
    such as those a returned DataFrame reads; says how many."""
    left = _LEFT.pop(spark.sparkContext.applicationId, [])
    drop_stored(*left)
    return len(left)


def drop_stored(*frames: DataFrame) -> None:
    """Deletes tables made by stored() that no later plan reads."""
    for df in frames:
        left = _LEFT.get(df.sparkSession.sparkContext.applicationId, [])
        left[:] = [x for x in left if x is not df]
        path = df._stored_at
        jvm = df.sparkSession._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def give_back() -> None:
    """Memory that Python and Arrow have freed goes back to the system. Workers live on
    from task to task, and what one stage has freed may lie in pieces of no use to the
    next."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not the GNU library
        pass


def lean(fn):
    """A function of batches that gives memory back when a task ends."""

    @functools.wraps(fn)
    def run(batches):
        try:
            yield from fn(batches)
        finally:
            give_back()

    return run


def free_name(df: DataFrame, name: str) -> str:
    """name, lengthened until df has no column of it; names differ in more than case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def own_columns(df: DataFrame) -> list:
    """df's columns, whatever stands in their names."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def crc32_of(col) -> "F.Column":
    """CRC-32 of a value's text."""
    return F.crc32(F.encode(col.cast("string"), "UTF-8"))


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its n + 1 offsets; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offs, data = column.buffers()
    at = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if offs is not None and len(column) else np.zeros(len(column) + 1, np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and len(at) else np.zeros(0, np.uint8)
    return raw, at - at[0]


def pieces(offsets: np.ndarray, most: int):
    """Row ranges [a, b) of at most `most` bytes each; a longer row stands alone."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1
        b = min(max(b, a + 1), n)
        yield a, b
        a = b


def splitmix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, elementwise."""
    with np.errstate(over="ignore"):
        x = x + np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_WEIGHTS = {"w": splitmix(np.arange(1 << 12, dtype=np.uint64))}


def _weights(n: int) -> np.ndarray:
    if n > len(_WEIGHTS["w"]):
        if n > 1 << 20:
            return splitmix(np.arange(n, dtype=np.uint64))
        _WEIGHTS["w"] = splitmix(np.arange(1 << (n - 1).bit_length(), dtype=np.uint64))
    return _WEIGHTS["w"]


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit multilinear hashes of the byte strings data[starts:ends], which are
    ascending, disjoint and not empty."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lens = ends - starts
    total = int(lens.sum())
    first = np.zeros(len(starts), np.int64)
    np.cumsum(lens[:-1], out=first[1:])
    rel = np.arange(total, dtype=np.int64) - np.repeat(first, lens)
    at = rel + np.repeat(starts, lens)
    with np.errstate(over="ignore"):
        part = (data[at].astype(np.uint64) + np.uint64(1)) * _weights(int(lens.max()))[rel]
        return splitmix(np.add.reduceat(part, first) + lens.astype(np.uint64))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row numbers of the words [^\\x20\\x09-\\x0D]+ of each row."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    ink = ~SEPARATOR[data]
    begins, closes = ink.copy(), ink.copy()
    begins[1:] &= ~ink[:-1]
    closes[:-1] &= ~ink[1:]
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < n)]
    begins[cut] |= ink[cut]
    closes[cut - 1] |= ink[cut - 1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(closes) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1
