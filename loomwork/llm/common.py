"""Helpers that the text operators share: tables in the cluster's shared folder, sizes from plans, word arrays."""

from __future__ import annotations

import ctypes
import os
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of documents whose crc32 of the id, modulo this, is 0 are held out of training.
FOLDS = 5
#: Rows of an Arrow batch.
ROWS_AT_ONCE = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below spark.checkpoint.dir, removed when the session's JVM ends.

    Where that setting is missing a local folder is made and set, but only for a master on one machine (tests); on a
    cluster executors would write to their own disks, so that raises.
    """
    top = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        top = "file://" + tempfile.mkdtemp(prefix="loomwork-")
        spark.conf.set("spark.checkpoint.dir", top)
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{top.rstrip('/')}/loomwork-{uuid.uuid4().hex}-{name}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    return path.toString()


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back: lineage ends there, and a lost executor costs no rerun."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession, path: str) -> None:
    """Deletes what was written at path, which nothing reads any more."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def arrow_map(df: DataFrame, run, schema) -> DataFrame:
    """df.mapInArrow(run, schema) in batches of ROWS_AT_ONCE rows where the session has Spark's default of 10,000, which texts of some
    KB make large in the JVM and in Python at once. At its end a task gives free memory back, which its reused worker would keep."""
    conf = df.sparkSession.conf
    if conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000") == "10000":
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS_AT_ONCE))

    def tidied(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return df.mapInArrow(tidied, schema)


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def plan_bytes(df: DataFrame) -> int:
    """The optimizer's estimate of df's size: for a scan the bytes of its files. No job runs."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def parts_for(df: DataFrame, mb: float, text_col: str) -> int:
    """So many parts that each has about mb megabytes of df's files; it follows the input without bound. Where the optimizer
    knows no size (rows from the driver, its default is the largest number), half the texts' characters count."""
    size = plan_bytes(df)
    if size >= 1 << 60:
        size = (df.agg(F.sum(F.length(text_col))).first()[0] or 0) // 2
    return max(8, int(-(-size // int(mb * 1e6))))


def held_out(doc_id="doc_id"):
    """crc32 of the id's decimal text, modulo FOLDS, is 0. False for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % FOLDS == 0, F.lit(False))


def share_of(*cols: str):
    """A number from 0 up to 1 that a hash of the columns fixes: the rows below x are a sample of that share."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 11) / F.lit(float(1 << 53))


def free_name(name: str, taken: list[str]) -> str:
    """name, with underscores after it until no taken column has it; case does not count."""
    have = {t.lower() for t in taken}
    while name.lower() in have:
        name += "_"
    return name


# ---------------------------------------------------------------- words as numpy arrays

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_M1, _M2, _M3 = (np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x9E3779B97F4A7C15))
_MASK = np.array([0] + [(1 << (8 * k)) - 1 for k in range(1, 8)] + [0xFFFFFFFFFFFFFFFF], dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit numbers that spreads every bit (the finalizer of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x = x ^ (x >> np.uint64(27))
    x = x * _M2
    return x ^ (x >> np.uint64(31))


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """An Arrow string column as its bytes and n+1 offsets; null reads as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_string())
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[ends[0] : ends[-1]], ends - ends[0]


def words_of(raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes other than [\\x20\\x09-\\x0D], and the index of the
    first word of each text (n+1 numbers). A word never spans two texts."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(ends), np.int64)
    word = ~_SPACE[raw]
    begins = word.copy()
    begins[1:] &= ~word[:-1]
    inner = ends[1:-1]
    inner = inner[inner < len(raw)]
    begins[inner] = word[inner]
    stops = word.copy()
    stops[:-1] &= ~word[1:]
    inner = inner[inner > 0] - 1
    stops[inner] = word[inner]
    starts, last = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    return starts, last, np.searchsorted(starts, ends)


def hash_words(raw: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes, eight bytes at a step, all words at once."""
    size = (stops - starts).astype(np.int64)
    h = mix(size.astype(np.uint64) * _M3)
    if not len(starts):
        return h
    padded = np.zeros(len(raw) + 8, np.uint8)
    padded[: len(raw)] = raw
    eight = np.ndarray((len(raw) + 1,), "<u8", buffer=padded, strides=(1,))
    long = np.flatnonzero(size > 256)  # rare: word by word, so that one giant word costs no pass for each eight bytes
    if len(long):
        import xxhash

        for i in long.tolist():
            h[i] = xxhash.xxh3_64_intdigest(raw[starts[i] : stops[i]].tobytes())
    todo = np.flatnonzero(size <= 256) if len(long) else np.arange(len(starts))
    at, left = starts[todo], size[todo]
    while len(todo):
        h[todo] = mix((h[todo] ^ (eight[at] & _MASK[np.minimum(left, 8)])) * _M3)
        more = left > 8
        todo, at, left = todo[more], at[more] + 8, left[more] - 8
    return h


def gram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each k words in a row: one for each start at which k words are left in the array."""
    n = max(0, len(h) - k + 1)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = out * _M3 + h[j : j + n]
    return mix(out)


def sized(table: pa.Table, column: str, most: int = 4_000_000):
    """Slices of a table with about most bytes of text each (one row at least), so that arrays stay small."""
    c = table.column(column)
    size = np.zeros(len(c), np.int64)
    done = 0
    for chunk in c.chunks:
        raw, ends = utf8(chunk)
        size[done : done + len(chunk)] = np.diff(ends)
        done += len(chunk)
    total = np.cumsum(size)
    at = 0
    while at < len(c):
        base = total[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(total, base + most, side="right")))
        yield table.slice(at, to - at)
        at = to


def one_thread() -> None:
    """Each task has one core; libraries that start threads of their own are told so."""
    os.environ["RAYON_NUM_THREADS"] = "1"
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
