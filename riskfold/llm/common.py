"""Shared helpers of the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import math
import os
import pathlib
import tempfile
import time
import zipfile

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize

#: A word: a run of anything but blank, tab, newline, vertical tab, form feed, return.
words_re = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_shipped: set[str] = set()


def ship_code(spark: SparkSession) -> None:
    """Give the executors this package, once per application: Python tasks
    import it wherever they run, whatever their working folder."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    package = pathlib.Path(__file__).resolve().parents[1]
    target = os.path.join(tempfile.mkdtemp(prefix="riskfold-code-"), f"{package.name}.zip")
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    spark.sparkContext.addPyFile(target)
    _shipped.add(app)


class Scratch:
    """Tables written to the shared folder that one operator call needs only
    until it has written its next one; ``free`` deletes them there."""

    def __init__(self) -> None:
        self.paths: list[str] = []

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        out = materialize(df, name)
        self.paths += [f.rsplit("/", 1)[0] for f in out.inputFiles()[:1]]
        return out

    def free(self, spark: SparkSession) -> None:
        drop_tables(spark, self.paths)
        self.paths = []


def drop_tables(spark: SparkSession, paths: list[str]) -> None:
    jvm = spark._jvm
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextlib.contextmanager
def settings(spark: SparkSession, values: dict[str, str]):
    """Session settings that hold for the actions inside only."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def tidy(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of steps whose results are written: it
    does so once the driver has collected their plans as garbage."""
    for _ in range(2):        # the driver's Python lets go of plans first, then the JVM
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.2)


def release() -> None:
    """Give freed memory of this Python worker back to the system: a worker lives on
    after its task, beside those of the next stages."""
    import pyarrow as pa

    _powers.cache_clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):      # other C libraries give memory back themselves
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def releasing(run):
    """The batch function ``run``, which releases memory at its task's end."""
    @functools.wraps(run)
    def wrapped(batches):
        yield from run(batches)
        release()
    return wrapped


# ---------------------------------------------------------------- byte work

_WS = np.zeros(256, bool)
_WS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))


@functools.lru_cache(1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    def run(b):
        x = np.full(n + 1, b, np.uint64)
        x[0] = 1
        return np.multiply.accumulate(x)
    return run(_BASE), run(_INV)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of the rolling-hash base and of its inverse (mod 2^64)."""
    size = 1 << max(21, n.bit_length())
    return _powers(size)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (multiply, shift, xor)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def text_chunks(column, most: int = 1 << 20):
    """Runs of whole texts of an Arrow string column as (first row, bytes,
    offsets); a run has at most ``most`` bytes unless one text is longer.
    Null texts are empty."""
    import pyarrow as pa

    if column.null_count:
        column = column.fill_null("")
    if pa.types.is_large_string(column.type):
        kind = np.int64
    else:
        kind = np.int32
    bufs = column.buffers()
    n = len(column)
    if n == 0:
        return
    off = np.frombuffer(bufs[1], kind, n + 1, column.offset * np.dtype(kind).itemsize)
    off = off.astype(np.int64)
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None and bufs[2].size else np.zeros(0, np.uint8)
    a = 0
    while a < n:
        b = int(np.searchsorted(off, off[a] + most, "right")) - 1
        b = min(n, max(b, a + 1))
        yield a, data[off[a]:off[b]], off[a:b + 1] - off[a]
        a = b


def word_table(data: np.ndarray, off: np.ndarray, lower: bool = True):
    """Words of the texts: (start, end, row, 64-bit hash), by position."""
    n = len(data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, z, z.astype(np.uint64)
    word = ~_WS[data]
    first = word.copy()
    first[1:] &= ~word[:-1]
    cut = off[1:-1]
    cut = cut[(cut > 0) & (cut < n)]
    first[cut] = word[cut]              # a word never runs from one text into the next
    starts = np.flatnonzero(first)
    last = word.copy()
    last[:-1] &= ~word[1:]
    last[cut - 1] = word[cut - 1]
    ends = np.flatnonzero(last) + 1
    rows = np.searchsorted(off, starts, "right") - 1
    up, down = powers(n)
    v = (_LOWER[data] if lower else data.astype(np.uint64)) + np.uint64(1)
    v *= up[:n]
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(v, out=total[1:])
    h = (total[ends] - total[starts]) * down[starts]
    h = mix64(h + (ends - starts).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
    return starts, ends, rows, h


def long_of(u: np.ndarray) -> np.ndarray:
    return u.view(np.int64)


def text_of(col: str = "text"):
    return F.coalesce(F.col(col).cast("string"), F.lit(""))
