"""Importance resampling towards a target distribution, over a persisted sparse count matrix.

A text's features are its runs of one to three words; a feature's bucket is its CRC-32
modulo the number of buckets.  The document-by-bucket counts are written once as CSR
blocks, a row of the table per block of documents.  Its column sums, with those of the
target texts, give each bucket's gain; a product of every block with the gains gives
each document's weight.  Gumbel noise from the id's hash makes the draw; ranks come from
ranges of the sorted scores and the rows in the ranges before.

CRC-32 is linear over bits: the checksum of joined words follows from those of the words
by table look-ups, so features are never spelled out, but for words of more than
``_LONG`` bytes.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from .common import claim, column, partitions, raw, slices, written

BUCKETS = 10_000
NGRAM = 3
SEED = 42
#: Documents of fewer words are not drawn; of the others this share in percent is.
LEAST_WORDS, PERCENT = 20, 5
#: Words whose features are counted at once.
_WORDS = 1 << 17
_LONG = 64
#: Counts that a row of the written matrix holds; a document has at most one a bucket.
_CELL = 1 << 15
#: Bytes of a row group of the written matrix: a reader decodes one at once, however many rows a batch may have.
_GROUP_BYTES = 8 << 20
U32 = np.uint32

_WORD = np.zeros(256, bool)
_WORD[0x30:0x3A] = _WORD[0x61:0x7B] = _WORD[0x80:] = True


# ---------------------------------------------------------------- checksums


def _crc_table() -> np.ndarray:
    """Register after one byte, from a register of 0."""
    value = np.arange(256, dtype=U32)
    for _ in range(8):
        value = np.where(value & 1, (value >> U32(1)) ^ U32(0xEDB88320), value >> U32(1))
    return value


_ONE = _crc_table()
#: Bytes that two joined words of at most _LONG bytes and their space can have.
_SPAN = 2 * _LONG + 2
#: _AFTER[k, b]: register after byte b and k zero bytes.
_AFTER = np.empty((_SPAN, 256), U32)
_AFTER[0] = _ONE
for _k in range(1, _SPAN):
    _AFTER[_k] = (_AFTER[_k - 1] >> U32(8)) ^ _ONE[_AFTER[_k - 1] & U32(255)]
#: _SHIFT[j, k, b]: what byte j of a register that holds b contributes after k zero bytes.
_SHIFT = np.empty((4, _SPAN, 256), U32)
for _j in range(4):
    _SHIFT[_j, 0] = np.arange(256, dtype=U32) << U32(8 * _j)
    for _k in range(1, _SPAN):
        _SHIFT[_j, _k] = (_SHIFT[_j, _k - 1] >> U32(8)) ^ _ONE[_SHIFT[_j, _k - 1] & U32(255)]


def _shifted(register: np.ndarray, zeros: np.ndarray) -> np.ndarray:
    """Registers after so many zero bytes."""
    out = _SHIFT[0, zeros, register & U32(255)]
    for j in (1, 2, 3):
        out ^= _SHIFT[j, zeros, (register >> U32(8 * j)) & U32(255)]
    return out


def _finish(register: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC-32 of messages whose register, started with 0, is known: the usual start and end values are added."""
    start = np.full(1, 0xFFFFFFFF, U32)
    of_length = np.empty(3 * _LONG + 4, U32)  # by length of up to three words
    state = start
    for k in range(len(of_length)):
        of_length[k] = state[0]
        state = (state >> U32(8)) ^ _ONE[state & U32(255)]
    return register ^ of_length[length] ^ U32(0xFFFFFFFF)


def feature_buckets(text: np.ndarray, starts: np.ndarray, ends: np.ndarray, doc: np.ndarray, first: int, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Document and bucket of every feature that begins with one of the first ``first`` words.

    ``text`` holds lower-cased bytes, ``doc`` the document of each word; words after the
    first ones only lengthen features.
    """
    size = ends - starts
    short = size <= _LONG
    at = np.where(short, starts, 0)
    length = np.where(short, size, 1)
    total = int(length.sum())
    begin = np.cumsum(length) - length
    which = np.repeat(np.arange(len(at)), length)
    inner = np.arange(total) - begin[which]
    word = np.bitwise_xor.reduceat(_AFTER[(length[which] - 1 - inner), text[at[which] + inner]], begin) if total else np.zeros(0, U32)
    docs, found = [], []
    register, span, plain = word, length, short
    for n in range(1, NGRAM + 1):
        if n > 1:  # one more word: the register so far, a space, the word
            more = word[n - 1 :]
            register = _shifted(register[:-1], length[n - 1 :] + 1) ^ _AFTER[length[n - 1 :], 32] ^ more
            span = span[:-1] + 1 + length[n - 1 :]
            plain = plain[:-1] & short[n - 1 :]
        k = min(first, len(register))
        same = doc[:k] == doc[n - 1 : n - 1 + k]
        easy = same & plain[:k]
        docs.append(doc[:k][easy])
        found.append(_finish(register[:k][easy], span[:k][easy]).astype(np.int64) % buckets)
        for w in np.flatnonzero(same & ~plain[:k]).tolist():
            spelled = b" ".join(text[starts[v] : ends[v]].tobytes() for v in range(w, w + n))
            docs.append(doc[w : w + 1])
            found.append(np.asarray([zlib.crc32(spelled) % buckets], np.int64))
    return np.concatenate(docs), np.concatenate(found)


def _words(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, start and end of each word, and the number of each text's first word."""
    lower = buf + np.where((buf >= 65) & (buf <= 90), 32, 0).astype(np.uint8)
    solid = np.zeros(len(buf) + 2, bool)
    solid[1:-1] = _WORD[lower]
    begins, stops = solid[1:-1] & ~solid[:-2], solid[1:-1] & ~solid[2:]
    inner = offs[1:-1]
    inner = inner[(inner > 0) & (inner < len(buf))]
    begins[inner] = solid[1:-1][inner]  # texts are apart
    stops[inner - 1] = solid[1:-1][inner - 1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    return lower, starts, ends, np.searchsorted(starts, offs)


def count_matrix(buf: np.ndarray, offs: np.ndarray, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of each text; the CSR row pointers, buckets (ascending in a row) and counts."""
    n = len(offs) - 1
    lower, starts, ends, first = _words(buf, offs)
    doc = np.repeat(np.arange(n), np.diff(first))
    keys, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for lo in range(0, len(starts), _WORDS):
        hi = min(len(starts), lo + _WORDS)
        far = min(len(starts), hi + NGRAM - 1)
        row, bucket = feature_buckets(lower, starts[lo:far], ends[lo:far], doc[lo:far], hi - lo, buckets)
        key, c = _runs(np.sort(row * buckets + bucket))
        keys.append(key)
        counts.append(c)
    key, count = np.concatenate(keys), np.concatenate(counts)
    if len(keys) > 2:  # a text over several steps has a bucket more than once
        order = np.argsort(key, kind="stable")
        key, count = _runs(key[order], count[order])
    return np.diff(first), np.searchsorted(key, np.arange(n + 1) * buckets), key % buckets, count


def _runs(key: np.ndarray, count: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct sorted keys and how often each occurs, or the sum of its counts."""
    if not len(key):
        return key, np.zeros(0, np.int64)
    begin = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    return key[begin], np.diff(np.append(begin, len(key))) if count is None else np.add.reduceat(count, begin)


# ---------------------------------------------------------------- the persisted matrix

_BLOCK = StructType([StructField(c, t) for c, t in (("rows", LongType()), ("ids", BinaryType()), ("no_id", BinaryType()), ("words", BinaryType()), ("pointers", BinaryType()), ("gaps", BinaryType()), ("counts", BinaryType()))])


def csr_blocks(docs: DataFrame, id_col: str | None = "doc_id", text_col: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """The count matrix of all rows as a written table, a row per block of documents.

    Buckets are stored as gaps of 16 bits inside a document.  Null texts are rows
    without features; null ids are marked.  A block ends before it holds more than
    ``_CELL`` counts (a larger document is one by itself), and row groups are small, so
    what writers and readers hold at a time does not depend on the size of the table.
    """
    if buckets > 1 << 16:
        raise ValueError("at most 65,536 buckets")
    id_ = docs[id_col].cast("long") if id_col else F.lit(None).cast("long")
    rows = docs.select(id_.alias("id"), docs[text_col].cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", owner="importance"):
            words, pointers, bucket, count = count_matrix(*raw(column(part, "text")), buckets)
            gaps = np.diff(bucket, prepend=0)
            begin = pointers[:-1][np.diff(pointers) > 0]
            gaps[begin] = bucket[begin]
            ids = column(part, "id")
            number, none, gaps, count = np.asarray(ids.fill_null(0), np.int64), np.asarray(ids.is_null()), gaps.astype(np.uint16), count.astype(np.uint32)
            for a, b in _blocks(pointers, _CELL):
                lo, hi = pointers[a], pointers[b]
                cols = [number[a:b], none[a:b], words[a:b].astype(np.int64), (pointers[a : b + 1] - lo).astype(np.int64), gaps[lo:hi], count[lo:hi]]
                yield pa.RecordBatch.from_arrays([pa.array([b - a]), *(pa.array([np.ascontiguousarray(c).tobytes()], pa.binary()) for c in cols)], names=_BLOCK.fieldNames())

    return written(rows.mapInArrow(run, _BLOCK), "csr", {"parquet.block.size": _GROUP_BYTES, "parquet.block.size.row.check.min": 10, "parquet.page.size.row.check.min": 10})


def _blocks(pointers: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Ranges of rows with at most ``most`` counts and rows each, or of one row."""
    out, a, n = [], 0, len(pointers) - 1
    while a < n:
        b = min(n, a + most, max(a + 1, int(np.searchsorted(pointers, pointers[a] + most, "right")) - 1))
        out.append((a, b))
        a = b
    return out


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Ids, null marks, words, pointers, buckets and counts of each block."""
    claim("importance")
    for part in batches:
        for k in range(part.num_rows):
            ids, none, words, pointers, gaps, counts = (
                np.frombuffer(column(part, c)[k].as_py(), t) for c, t in (("ids", np.int64), ("no_id", bool), ("words", np.int64), ("pointers", np.int64), ("gaps", np.uint16), ("counts", np.uint32))
            )
            upto = np.cumsum(gaps, dtype=np.int64)
            before = np.where(pointers[:-1] > 0, upto[pointers[:-1] - 1], 0) if len(upto) else np.zeros(len(ids), np.int64)
            yield ids, none, words, pointers, upto - np.repeat(before, np.diff(pointers)), counts


def column_sums(blocks: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How often each bucket occurs in the whole matrix: sums per task, then by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for *_, bucket, count in _unpacked(batches):
            total += np.bincount(bucket, count, buckets).astype(np.int64)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in blocks.mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # a row per bucket
        out[r.bucket] = r.n
    return out


def gains(raw_counts: np.ndarray, target_counts: np.ndarray) -> np.ndarray:
    """Thousandths of the logarithm of each bucket's smoothed share of the target to that of all documents, rounded down."""
    k = len(raw_counts)
    s_all, t_all = float(raw_counts.sum() + k), float(target_counts.sum() + k)
    return np.asarray([math.floor(1000 * math.log((float(t + 1) * s_all) / (float(s + 1) * t_all))) for s, t in zip(raw_counts.tolist(), target_counts.tolist(), strict=True)], np.int64)


def _gumbel(seed: int, id_: int | None) -> int:
    h = int(hashlib.sha256(f"{seed}:{'' if id_ is None else id_}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weights(blocks: DataFrame, gain: np.ndarray, seed: int = SEED) -> DataFrame:
    """The matrix times the gains: id, words, features, weight and score of each document."""
    held = blocks.sparkSession.sparkContext.broadcast(gain)  # a number per bucket

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, none, words, pointers, bucket, count in _unpacked(batches):
            count = count.astype(np.int64)
            upto = np.concatenate(([0], np.cumsum(held.value[bucket] * count)))
            features = np.concatenate(([0], np.cumsum(count)))
            weight = upto[pointers[1:]] - upto[pointers[:-1]]
            noise = np.asarray([_gumbel(seed, None if x else i) for i, x in zip(ids.tolist(), none.tolist(), strict=True)], np.int64)
            cols = [pa.array(ids, mask=none), *(pa.array(c) for c in (words, features[pointers[1:]] - features[pointers[:-1]], weight, weight + noise))]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_words", "n_features", "weight", "score"])

    return blocks.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long, score long")


def ranked(scored: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """``scored`` with the rank of the drawn documents: highest scores first, ties to the smaller id (null last).

    Equal rows are counted before they are sorted, and get consecutive ranks.  Rows are
    dealt by range of the score; how many there are in the ranges before (a number per
    range at the driver) and the order inside a range give the rank.
    """
    spark = scored.sparkSession
    cols = ["doc_id", "n_features", "weight", "score"]
    able = F.coalesce(F.col("n_words") >= least_words, F.lit(False))
    groups = scored.filter(able).groupBy(*cols).agg(F.count("*").alias("_n"))
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_features"), F.asc("weight")]
    dealt = written(groups.repartitionByRange(partitions(spark), *order).withColumn("_range", F.spark_partition_id()), "ranges")
    sizes = {r["_range"]: r["n"] for r in dealt.groupBy("_range").agg(F.sum("_n").alias("n")).collect()}
    draw = percent * sum(sizes.values()) // 100
    before, ahead = {}, 0
    for k in sorted(sizes):
        before[k], ahead = ahead, ahead + sizes[k]
    open_ = [k for k in before if before[k] < draw]
    none = F.lit(None).cast("long").alias("rank")
    rest = scored.filter(~able).select(*cols, none)
    sorted_in = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    base = spark.createDataFrame([(k, before[k]) for k in open_], "_range int, _before long")
    top = dealt.join(F.broadcast(base), "_range").withColumn("_at", F.col("_before") + F.coalesce(F.sum("_n").over(sorted_in), F.lit(0)))
    place = F.explode(F.sequence(F.lit(1), F.col("_n").cast("int"))).alias("_k")
    top = top.select(*cols, "_at", place).withColumn("rank", F.when(F.col("_at") + F.col("_k") <= draw, F.col("_at") + F.col("_k")))
    low = dealt.join(F.broadcast(base), "_range", "left_anti").select(*cols, place)
    return top.select(*cols, "rank").unionByName(low.select(*cols, none)).unionByName(rest)


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", buckets: int = BUCKETS, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every row of ``docs``; undrawn rows have no rank.

    Words are runs of ASCII letters and digits (A-Z lower-cased) and of all characters
    beyond ASCII.  Null and wordless texts have no features, weight 0, and are never drawn.
    A repeated id draws with the same noise, a null id with that of an empty one.  An empty ``docs`` gives no rows; an
    empty ``target`` gives gains from the smoothing alone.  Other columns are not read.
    """
    blocks = csr_blocks(docs, id_col, text_col, buckets)
    gain = gains(column_sums(blocks, buckets), column_sums(csr_blocks(target, None, target_col, buckets), buckets))
    return ranked(written(weights(blocks, gain, seed), "weights"), percent, least_words)
