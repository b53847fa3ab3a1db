"""Helpers shared by the corpus operators."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

U64 = np.uint64


def table(spark: SparkSession, sf_dir: str, name: str, spread: bool = False) -> DataFrame:
    """A table; with `spread` dealt evenly to all cores if its scan has fewer parts than those (a single small file)."""
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return rows.repartition(cores) if spread and rows._jdf.queryExecution().toRdd().getNumPartitions() < cores else rows


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see: spark.checkpoint.dir, or a temporary one where that is unset and all runs on this machine (local tests)."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="strandloom-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        at = f"file://{folder}"
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def stored(df: DataFrame, label: str) -> DataFrame:
    """`df` written as Parquet to the shared folder and read back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/strandloom/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    _written.append(path)
    return out


_written: list[str] = []  # paths of what `stored` wrote, in that order


def written_so_far() -> int:
    return len(_written)


def drop_since(spark: SparkSession, mark: int, keep: DataFrame) -> None:
    """Removes the tables stored since `mark = written_so_far()` but for `keep`, which no longer needs them."""
    for path in _written[mark:]:
        if path != keep._stored_at:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    _written[mark:] = [keep._stored_at]


def drop_stored(df: DataFrame) -> None:
    """Removes what `stored` wrote, once nothing reads it any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._stored_at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (murmur3's)."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U64(33))
    x = x * U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U64(33))


class Memo(dict):
    """A cache for one function, of `most` keys at most: once half of that is new, what was kept before goes, but for keys used since. Values aren't None."""

    def __init__(self, make, most: int = 1_000_000):
        super().__init__()
        self.make, self.half, self.old = make, max(1, most // 2), {}

    def __missing__(self, key):
        value = self.old.pop(key, None)
        if value is None:
            value = self.make(key)
        if len(self) >= self.half:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value

    def empty(self) -> None:
        self.clear()
        self.old.clear()


def tidied(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], caches: Callable[[], list[Memo]] = list) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """`run`, after which a worker's caches are emptied and its free memory goes back to the system: workers are used again by later stages, and an executor's memory is shared with them."""

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            for cache in caches():
                cache.empty()
            pa.default_memory_pool().release_unused()
            if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
                libc.malloc_trim(0)

    return tidy


def split_runs(keys: np.ndarray) -> list[tuple[int, int, int]]:
    """(key, from, to) of each run of equal neighbours."""
    if not len(keys):
        return []
    cut = np.flatnonzero(keys[1:] != keys[:-1]) + 1
    lo, hi = np.concatenate([[0], cut]), np.concatenate([cut, [len(keys)]])
    return list(zip(keys[lo].tolist(), lo.tolist(), hi.tolist(), strict=True))
