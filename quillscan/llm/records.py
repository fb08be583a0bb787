"""Token ids as length-delimited binary records with a separate offset index.

A data file is a row of frames::

    length   u64   bytes of the payload
    check    u32   masked crc32 of the eight length bytes
    payload        doc_id i64, flags u8 (1: doc_id is null), width u8 (2 or 4), then the ids
    check    u32   masked crc32 of the payload

All numbers are little-endian.  Ids take two bytes where the vocabulary allows it.
A mask (rotate right by 15, add a constant) keeps a checksum of data that holds
checksums from being degenerate.  The index file beside a data file has one u64
frame offset per record and a last one for the end, so that a reader can fetch
records in any order.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column, fresh_path, partitions, slices
from .tokenizing import TOKEN_SLICE, encoder

_MASK = 0xA282EAD8
_HEAD = struct.Struct("<qBB")
_FLUSH = 4_000_000
_MANIFEST = "data string, index string, first_id long, n_records long, n_ids long"


class CorruptRecord(ValueError):
    pass


def _payload(key: int | None, width: int, ids: bytes) -> bytes:
    return _HEAD.pack(key or 0, key is None, width) + ids


def _parse(payload: memoryview) -> tuple[int | None, np.ndarray]:
    key, null, width = _HEAD.unpack_from(payload)
    return None if null else key, np.frombuffer(payload, dtype=f"<u{width}", offset=_HEAD.size).astype("<u4")


def masked_crc(data: bytes | memoryview) -> int:
    c = zlib.crc32(data)
    return (((c >> 15) | (c << 17)) + _MASK) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    size = struct.pack("<Q", len(payload))
    return b"".join((size, struct.pack("<I", masked_crc(size)), payload, struct.pack("<I", masked_crc(payload))))


def unframe(data: memoryview, at: int) -> tuple[memoryview, int]:
    """The payload at ``at`` and where the next frame begins; raises on any damage."""
    if at + 12 > len(data):
        raise CorruptRecord("a frame's head is cut off")
    size, check = struct.unpack_from("<QI", data, at)
    if masked_crc(data[at : at + 8]) != check:
        raise CorruptRecord("a frame's length fails its checksum")
    end = at + 12 + size
    if end + 4 > len(data):
        raise CorruptRecord("a frame's payload is cut off")
    payload = data[at + 12 : end]
    if masked_crc(payload) != struct.unpack_from("<I", data, end)[0]:
        raise CorruptRecord("a frame's payload fails its checksum")
    return payload, end + 4


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def write_records(docs: DataFrame, tokenizer: str, folder: str | None = None, end_id: int | None = 0, shards: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write every text's ids (plus ``end_id``) in ascending id order; return the manifest, one row per shard.

    Texts are range-partitioned by id and sorted inside each shard, then tokenised
    and streamed to the shard's file.  A file's name is new for each task attempt and
    only names that successful attempts return enter the manifest, so lost executors
    and repeated attempts leave no wrong data behind.  Manifest rows come in shard
    order (nulls first, as ids).  Null text: empty; null ids sort first; rows that
    share an id all stay, in arbitrary order among themselves; an empty table gives an
    empty manifest.
    """
    spark = docs.sparkSession
    folder = folder or fresh_path(spark, "records")
    shards = shards or partitions(spark)
    fs, path = _open(folder)
    fs.create_dir(path, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, "ids")
        name = f"{folder}/{uuid.uuid4().hex}"
        out = None
        offsets, at, n_ids, first = [0], 0, 0, None
        for part in slices(batches, "text", TOKEN_SLICE, "tokens"):
            ids, ends = enc.encode(column(part, "text"))
            wide = len(ids) > 0 and int(ids.max()) > 0xFFFF or (end_id or 0) > 0xFFFF
            ids = ids.astype("<u4" if wide else "<u2")
            tail = b"" if end_id is None else np.asarray([end_id], dtype=ids.dtype).tobytes()
            chunk: list[bytes] = []
            keys = column(part, "doc_id").to_pylist()
            for k, key in enumerate(keys):
                rec = frame(_payload(key, ids.itemsize, ids[ends[k] : ends[k + 1]].tobytes() + tail))
                chunk.append(rec)
                at += len(rec)
                offsets.append(at)
            n_ids += len(ids) + (len(keys) if tail else 0)
            if out is None:
                fs, path = _open(f"{name}.rec")
                out, first = fs.open_output_stream(path), keys[0]
            out.write(b"".join(chunk))
        if out is not None:
            out.close()
            fs, path = _open(f"{name}.idx")
            with fs.open_output_stream(path) as index:
                index.write(np.asarray(offsets, dtype="<u8").tobytes())
            yield pa.RecordBatch.from_pylist(
                [{"data": f"{name}.rec", "index": f"{name}.idx", "first_id": first, "n_records": len(offsets) - 1, "n_ids": n_ids}],
                schema=pa.schema([("data", pa.string()), ("index", pa.string()), ("first_id", pa.int64()), ("n_records", pa.int64()), ("n_ids", pa.int64())]),
            )

    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    found = rows.repartitionByRange(shards, "doc_id").sortWithinPartitions("doc_id").mapInArrow(run, _MANIFEST).collect()  # a row per shard
    found.sort(key=lambda r: (r.first_id is not None, r.first_id or 0))
    base, out = 0, []
    for k, r in enumerate(found):
        out.append((k, r["data"], r["index"], r.n_records, r.n_ids, base))
        base += r.n_ids
    return spark.createDataFrame(out, "shard int, data string, index string, n_records long, n_ids long, base long")


def read_records(spark: SparkSession, manifest: DataFrame, with_ids: bool = False) -> DataFrame:
    """Read shards back, checking every frame: ``doc_id, start, n_tokens, ids_crc32`` (and ``ids``).

    ``start`` is the number of ids before the record in the whole data set;
    ``ids_crc32`` is the unsigned crc32 of the ids as little-endian unsigned 32-bit
    integers.  A file is streamed in pieces, never held whole.
    """
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in (r for b in batches for r in b.to_pylist()):
            fs, path = _open(shard["index"])
            with fs.open_input_stream(path) as f:
                index = np.frombuffer(f.read(), dtype="<u8").astype(np.int64)
            if len(index) != shard["n_records"] + 1:
                raise CorruptRecord(f"{path} has {len(index) - 1} offsets for {shard['n_records']} records")
            fs, path = _open(shard["data"])
            start, k = shard["base"], 0
            with fs.open_input_file(path) as f:
                while k < shard["n_records"]:
                    last = max(k + 1, int(np.searchsorted(index, index[k] + _FLUSH, "right")) - 1)
                    f.seek(int(index[k]))
                    data, at = memoryview(f.read(int(index[last] - index[k]))), 0
                    rows: list[list] = [[] for _ in names]
                    for _ in range(k, last):
                        payload, at = unframe(data, at)
                        key, ids = _parse(payload)
                        for to, v in zip(rows, (key, start, len(ids), zlib.crc32(ids), ids.astype(np.int32)), strict=False):
                            to.append(v)
                        start += len(ids)
                    k = last
                    yield pa.RecordBatch.from_arrays([pa.array(v, pa.list_(pa.int32()) if n == "ids" else pa.int64()) for n, v in zip(names, rows, strict=True)], names=names)
            if start != shard["base"] + shard["n_ids"]:
                raise CorruptRecord(f"{path} holds {start - shard['base']} ids instead of {shard['n_ids']}")

    n = max(1, manifest.count())
    return manifest.repartitionByRange(n, "shard").mapInArrow(run, schema)


def read_at(manifest_row: dict, numbers: list[int]) -> list[np.ndarray]:
    """Ids of the given record numbers of one shard, in the order asked: a shuffled read through the index."""
    fs, path = _open(manifest_row["index"])
    with fs.open_input_stream(path) as f:
        index = np.frombuffer(f.read(), dtype="<u8").astype(np.int64)
    out = []
    fs, path = _open(manifest_row["data"])
    with fs.open_input_file(path) as f:
        for n in numbers:
            f.seek(int(index[n]))
            payload, _ = unframe(memoryview(f.read(int(index[n + 1] - index[n]))), 0)
            out.append(_parse(payload)[1].astype(np.int64))
    return out
