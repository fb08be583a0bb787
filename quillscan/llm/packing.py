"""Packing documents into fixed-length sequences as a cutting-stock problem.

Every document is cut into pieces of at most ``capacity`` tokens.  Piece lengths are
rounded up to ``capacity / CLASSES`` tokens; the histogram of these classes (at most
``CLASSES`` numbers, whatever the input's size) is the demand of a cutting-stock
linear program.  Columns are patterns (how many pieces of each class share one
sequence); a knapsack dynamic program over the dual prices proposes the next column
until none improves.  Pattern counts are rounded down, what is left over is packed
best-fit, and the pieces, ranked inside their class, are assigned to patterns by
arithmetic on their rank.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import column, slices, written
from .tokenizing import TOKEN_SLICE, encoder

CAPACITY = 2048
CLASSES = 128
#: Column generation ends when the program is proven to be within this share of its optimum.
GAP = 0.001


def pieces_of(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int | None = 1, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, slice_bytes: int = TOKEN_SLICE) -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens`` (and ``ids``) of each piece of each document.

    Null text: empty, so just the end id.  A document without any id (empty, no end
    id) has no piece.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, "ids")
        for part in slices(batches, "text", slice_bytes, "tokens"):
            ids, ends = enc.encode(column(part, "text"))
            tail = np.zeros(0, "<u4") if end_id is None else np.asarray([end_id], "<u4")
            ids = ids.astype("<u4")
            rows: list[list] = [[] for _ in range(6)]
            for k, key in enumerate(column(part, "doc_id").to_pylist()):
                own = np.concatenate((ids[ends[k] : ends[k + 1]], tail))
                for at in range(0, len(own), capacity):
                    piece = own[at : at + capacity]
                    for to, v in zip(rows, (key, at, len(piece), zlib.crc32(piece), len(own), piece.astype(np.int32) if with_ids else None), strict=True):
                        to.append(v)
            arrays = [pa.array(v, pa.int64()) for v in rows[:5]] + ([pa.array(rows[5], pa.list_(pa.int32()))] if with_ids else [])
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"][: len(arrays)])

    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + (", ids array<int>" if with_ids else ""))


def _price(value: np.ndarray, weight: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """The most valuable pattern of weight at most ``room`` (unbounded knapsack)."""
    best = np.zeros(room + 1)
    take = np.full(room + 1, -1)
    order = np.argsort(weight)
    value, weight = value[order], weight[order]
    for c in range(1, room + 1):
        n = int(np.searchsorted(weight, c, "right"))
        best[c] = best[c - 1]
        if n:
            got = best[c - weight[:n]] + value[:n]
            k = int(np.argmax(got))
            if got[k] > best[c] + 1e-12:
                best[c], take[c] = got[k], k
    pattern = np.zeros(len(value))
    c = room
    while c > 0:
        if take[c] < 0:
            c -= 1
        else:
            pattern[order[take[c]]] += 1
            c -= weight[take[c]]
    return float(best[room]), pattern


def cutting_stock(weight: np.ndarray, demand: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Integer patterns (rows), how often each is used, and the linear program's lower bound.

    Revised simplex over the patterns found so far, one column at a time; the
    patterns used cover the demand exactly.
    """
    m = len(weight)
    if not m:
        return np.zeros((0, 0), int), np.zeros(0, int), 0.0
    basis = np.diag((room // weight).astype(float))
    inverse = np.diag(1.0 / np.diag(basis))
    x = inverse @ demand
    bound = 0.0
    for step in range(20 * m + 200):
        duals = inverse.sum(axis=0)
        gain, column_ = _price(duals, weight, room)
        bound = max(bound, float(duals @ demand) / max(gain, 1.0))  # scaled duals are feasible
        if gain <= 1 + 1e-9 or x.sum() <= bound * (1 + GAP) or np.ceil(bound - 1e-6) >= x.sum():
            break
        way = inverse @ column_
        usable = way > 1e-10
        ratio = np.where(usable, x / np.where(usable, way, 1), np.inf)
        out = int(np.argmin(ratio))
        basis[:, out] = column_
        row = inverse[out] / way[out]
        inverse = inverse - np.outer(way, row)
        inverse[out] = row
        if step % 50 == 49:  # a Newton step against rounding errors (einsum: no threaded BLAS in the driver)
            inverse = np.einsum("ij,jk->ik", inverse, 2 * np.eye(m) - np.einsum("ij,jk->ik", basis, inverse))
        x = np.maximum(inverse @ demand, 0)
    whole = np.floor(x + 1e-7).astype(int)
    patterns, counts = [basis[:, p].astype(int) for p in range(m) if whole[p]], [int(c) for c in whole if c]
    rest = demand.astype(int).copy()
    for p, c in zip(patterns, counts, strict=True):  # a pattern may cover more than is there
        rest -= p * c
    for p in range(len(patterns)):
        while (rest < 0).any() and counts[p] and (patterns[p][rest < 0] > 0).any():
            counts[p] -= 1
            rest += patterns[p]
    order = np.argsort(-weight)
    while rest.sum():  # at most about one sequence per class is left
        left, pattern = room, np.zeros(m, int)
        for k in order:
            n = min(int(rest[k]), left // int(weight[k]))
            pattern[k] += n
            left -= n * int(weight[k])
        often = int(min(rest[k] // pattern[k] for k in range(m) if pattern[k]))
        patterns.append(pattern)
        counts.append(often)
        rest -= pattern * often
    used = [k for k, c in enumerate(counts) if c]
    return np.asarray([patterns[k] for k in used]).reshape(-1, m), np.asarray([counts[k] for k in used]), bound


def pack(pieces: DataFrame, capacity: int = CAPACITY, classes: int = CLASSES) -> DataFrame:
    """``pieces`` with ``sequence_id`` (from 0, gapless) and ``offset`` (gapless from 0 in each sequence).

    ``pieces`` is read several times, so hand over a written table.  Ranking is two
    level: pieces are ranked inside (class, salt) and shifted by a prefix sum over the
    few (class, salt) counts, so a length that a third of all pieces share is spread
    over at least 64 groups.  Ties rank arbitrarily; rows that agree in all columns
    are interchangeable.  An empty table gives an empty one.
    """
    spark = pieces.sparkSession
    width = -(-capacity // classes)
    cls = F.ceil(F.col("length") / F.lit(width)).cast("int")
    hist = {r.cls: r.n for r in pieces.groupBy(cls.alias("cls")).agg(F.count("*").alias("n")).collect()}  # at most `classes` rows
    weight = np.asarray(sorted(hist), dtype=np.int64)
    demand = np.asarray([hist[w] for w in weight], dtype=float)
    patterns, counts, _ = cutting_stock(weight, demand, capacity // width)
    rows, used, base = [], dict.fromkeys(range(len(weight)), 0), 0
    for p, c in zip(patterns, counts, strict=True):
        slot = 0
        for k in np.flatnonzero(p):
            a = int(p[k])
            rows.append((int(weight[k]), used[k], used[k] + a * int(c), a, base, slot))
            used[k] += a * int(c)
            slot += a
        base += int(c)
    plan = spark.createDataFrame(rows, "p_cls int, p_lo long, p_hi long, p_each long, p_base long, p_slot long")
    salts = int(max(64, min(4096, max(hist.values(), default=0) // 100_000)))
    salted = pieces.withColumns({"_cls": cls, "_salt": F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(salts)).cast("int")})
    sizes = salted.groupBy("_cls", "_salt").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("_cls").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    shift = sizes.select("_cls", "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    inside = Window.partitionBy("_cls", "_salt").orderBy(F.desc("length"), "doc_id", "start", "ids_crc32")
    ranked = salted.withColumn("_rn", F.row_number().over(inside)).join(shift, ["_cls", "_salt"]).withColumn("_rank", F.col("_rn") - 1 + F.col("_shift"))
    # the plan has at most a few rows per class and pattern, both bounded by `classes`
    placed = ranked.join(F.broadcast(plan), (F.col("_cls") == F.col("p_cls")) & (F.col("_rank") >= F.col("p_lo")) & (F.col("_rank") < F.col("p_hi")))
    nth = F.col("_rank") - F.col("p_lo")
    placed = placed.withColumns({"sequence_id": F.col("p_base") + F.floor(nth / F.col("p_each")), "_slot": F.col("p_slot") + nth % F.col("p_each")})
    earlier = Window.partitionBy("sequence_id").orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    return placed.select(*pieces.columns, "sequence_id", F.coalesce(F.sum("length").over(earlier), F.lit(0)).alias("offset"))


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int | None = 1, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text", slice_bytes: int = TOKEN_SLICE) -> DataFrame:
    """Cut, count and pack all rows of ``docs``; see :func:`pieces_of` and :func:`pack`.

    Only ``id_col`` and ``text_col`` are read, so other columns cannot clash.  Repeated
    rows are packed as often as they occur.  A worker holds about ``slice_bytes`` of text
    at a time; the result does not depend on it.
    """
    return pack(written(pieces_of(docs, tokenizer, capacity, end_id, id_col, text_col, with_ids, slice_bytes), "pieces"), capacity)


def sequences(packed: DataFrame, capacity: int = CAPACITY, pad_id: int = 0) -> DataFrame:
    """``sequence_id, ids`` padded to ``capacity``; needs pieces packed with their ids (a sequence is a bounded group)."""
    got = packed.groupBy("sequence_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda s: s["ids"])).alias("ids"))
    return got.withColumn("ids", F.concat("ids", F.array_repeat(F.lit(pad_id), F.lit(capacity) - F.size("ids"))))
