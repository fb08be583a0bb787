"""Shared pieces: shared-folder tables, Arrow text slicing, vectorised word hashing, packed blobs."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Text bytes that one vectorised step works on; larger single texts are taken whole.
SLICE_BYTES = 1_500_000
#: Arrow bytes that travel to a Python worker at once.
BATCH_BYTES = 8_000_000

U64 = np.uint64


# ---------------------------------------------------------------- shared folder

#: Folders of applications that have no shared one.
_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder all machines see: ``spark.checkpoint.dir``; an own one only where it is unset and all runs on one machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        app = spark.sparkContext.applicationId
        _own[app] = root = _own.get(app) or "file://" + tempfile.mkdtemp(prefix="quillscan-")
    return root.rstrip("/")


def fresh_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str, options: dict[str, int] | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, tag)
    df.write.options(compression="zstd", **(options or {})).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(df: DataFrame) -> None:
    """Delete the files of a table made by :func:`written` once nothing needs it."""
    spark = df.sparkSession
    for parent in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        jvm = spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(parent)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def tune(spark: SparkSession, batch_bytes: int = BATCH_BYTES) -> None:
    """Small Arrow batches, so that a worker holds little text at a time, whatever the length of the rows."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(batch_bytes))


# ---------------------------------------------------------------- worker memory

#: What a reused Python worker keeps between tasks, by owner: functions that let go of it.
CACHES: dict[str, list[Callable[[], None]]] = {}
_owner: list[str] = [""]


def claim(owner: str) -> None:
    """Called where a task starts: another operator's caches in this worker go."""
    if _owner[0] != owner:
        for name, drops in CACHES.items():
            if name != owner:
                for drop in drops:
                    drop()
        trim()
        _owner[0] = owner


def trim() -> None:
    """Hand freed memory back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


# ---------------------------------------------------------------- Arrow slices


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def slices(batches: Iterator[pa.RecordBatch], text: str, limit: int = SLICE_BYTES, owner: str = "words") -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each piece holds about ``limit`` bytes of column ``text``."""
    claim(owner)
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        lens = np.asarray(pc.fill_null(pc.binary_length(column(batch, text)), 0), dtype=np.int64)
        group = np.cumsum(lens) // limit
        cuts = np.concatenate(([0], np.flatnonzero(np.diff(group)) + 1, [n]))
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            if hi > lo:
                yield batch.slice(int(lo), int(hi - lo))
    trim()


def filled(text: pa.Array) -> pa.Array:
    """Large strings without nulls, so that offsets never overflow."""
    return pc.fill_null(text.cast(pa.large_string()), "")


def raw(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts in a row and the n+1 offsets into them; null counts as empty."""
    arr = filled(text)
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    offs = np.frombuffer(arr.buffers()[1], dtype=np.int64)[arr.offset : arr.offset + len(arr) + 1]
    data = arr.buffers()[2]
    buf = np.frombuffer(data, dtype=np.uint8)[offs[0] : offs[-1]] if data is not None and len(data) else np.zeros(0, np.uint8)
    return buf, (offs - offs[0]).astype(np.int64)


# ---------------------------------------------------------------- words

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def words(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word ``[^\\x20\\x09-\\x0D]+`` and, per text, the first word's number (n+1 values)."""
    if not len(buf):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offs), np.int64)
    solid = ~_SPACE[buf]
    prev = np.empty_like(solid)
    prev[0] = False
    prev[1:] = solid[:-1]
    inner = offs[1:-1][offs[1:-1] < len(buf)]
    prev[inner] = False
    starts = np.flatnonzero(solid & ~prev)
    nxt = np.empty_like(solid)
    nxt[-1] = False
    nxt[:-1] = solid[1:]
    nxt[inner[inner > 0] - 1] = False
    ends = np.flatnonzero(solid & ~nxt) + 1
    return starts, ends, np.searchsorted(starts, offs)


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (public splitmix64 constants); spreads every input bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _odd(seed: int, n: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 2**63, n, dtype=np.uint64) * U64(2) + U64(1)


_TABLE = np.random.default_rng(7).integers(0, 2**64 - 1, 256, dtype=np.uint64)
_TABLE_LOWER = _TABLE[_LOWER]
_P = U64(0x9E3779B97F4A7C15)
_P_INV = U64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_MULT = _odd(11, 64)
_powers: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_P, _P_INV)):
            p = np.full(n, base, dtype=U64)
            p[0] = 1
            _powers[k] = np.cumprod(p, dtype=U64)
    return _powers[0], _powers[1]


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """64-bit hash of each word's bytes: a rolling polynomial over random byte values, then finalised."""
    if not len(starts):
        return np.zeros(0, U64)
    fwd, inv = _power(len(buf) + 1)
    table = _TABLE_LOWER if lower else _TABLE
    acc = np.empty(len(buf) + 1, dtype=U64)
    acc[0] = 0
    np.cumsum(table[buf] * fwd[: len(buf)], out=acc[1:])
    out = (acc[ends] - acc[starts]) * inv[starts]
    if len(_powers[0]) > 8 * SLICE_BYTES:  # one huge text must not pin its tables
        _powers[:] = [np.ones(1, U64), np.ones(1, U64)]
    return mix(out ^ (ends - starts).astype(U64))


def window_hashes(h: np.ndarray, width: int, seed: int = 0) -> np.ndarray:
    """Hash of each run of ``width`` consecutive word hashes (len(h)-width+1 of them, across texts too)."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, U64)
    mult = _odd(100 + seed, width)
    out = np.full(n, U64(width), dtype=U64)
    for j in range(width):
        out += h[j : j + n] * mult[j]
    return mix(out)


def ragged(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Concatenated ranges [s, s+l)."""
    total = int(lens.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lens)
    return np.repeat(starts - (ends - lens), lens) + np.arange(total, dtype=np.int64)
