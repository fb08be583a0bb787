"""Substring deduplication with super-k-mer partitioning.

A window is ``WINDOW`` consecutive words.  Its minimiser is the least hash of the runs
of ``SEED`` words inside it, so equal windows have equal minimisers.  Consecutive
windows that share a minimiser form a super-k-mer, which travels as one packed string
(its words, one space between) to the minimiser's bucket.  There all windows of all
super-k-mers are sorted; in each run of equal windows the first occurrence stays and
every later one covers its words.

Before the shuffle, equal super-k-mers of a map slice are merged: the first travels,
the others are covered already.  So a passage that a third of all documents hold
reaches its bucket once per slice, not once per document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blobs
from .common import U64, claim, column, partitions, ragged, raw, slices, window_hashes, word_hashes, words, written

WINDOW = 20
SEED = 4
#: A super-k-mer holds at most this many windows.
SPAN = 64
#: Input bytes per bucket.
BUCKET_BYTES = 3_000_000
#: Text bytes hashed at a time inside a bucket.
HASH_BYTES = 1_000_000


def _window_min(h: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values."""
    out, have = h, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def super_kmers(buf: np.ndarray, offs: np.ndarray, window: int = WINDOW, seed: int = SEED) -> dict[str, np.ndarray]:
    """Super-k-mers of many texts: text number, first word in the text, windows, minimiser, first and last word here."""
    starts, ends, first = words(buf, offs)
    empty = np.zeros(0, np.int64)
    if len(starts) < window:
        return {"text": empty, "at": empty, "windows": empty, "key": np.zeros(0, U64), "word": empty, "starts": starts, "ends": ends, "first": first, "hash": np.zeros(0, U64)}
    h = word_hashes(buf, starts, ends)
    least = _window_min(window_hashes(h, seed), window - seed + 1)  # one per window start, across texts too
    text_of = np.repeat(np.arange(len(offs) - 1), np.diff(first))
    begin = np.arange(len(least))
    inside = text_of[begin] == text_of[begin + window - 1]
    begin = begin[inside]
    key, text = least[begin], text_of[begin]
    if not len(begin):
        return super_kmers(buf[:0], np.zeros(len(offs), np.int64), window, seed) | {"starts": starts, "ends": ends, "first": first, "hash": h}
    new = np.ones(len(begin), bool)
    new[1:] = (key[1:] != key[:-1]) | (begin[1:] != begin[:-1] + 1) | (text[1:] != text[:-1])
    run = np.flatnonzero(new)
    length = np.diff(np.append(run, len(begin)))
    if (length > SPAN).any():  # a run longer than a span is cut, at multiples of the span
        parts = -(-length // SPAN)
        nth = ragged(np.zeros(len(run), np.int64), parts)
        run, length = np.repeat(run, parts) + nth * SPAN, np.minimum(SPAN, np.repeat(length, parts) - nth * SPAN)
    return {"text": text[run], "at": begin[run] - first[text[run]], "windows": length, "key": key[run], "word": begin[run], "starts": starts, "ends": ends, "first": first, "hash": h}


def _split(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Blobs for the buckets, and cover intervals (bucket -1) that the slice itself settles."""
    for part in slices(batches, "text"):
        buf, offs = raw(column(part, "text"))
        ids = np.asarray(column(part, "doc_id").to_numpy(zero_copy_only=False), dtype=np.int64)
        row = np.asarray(column(part, "row").to_numpy(zero_copy_only=False), dtype=np.int64)
        s = super_kmers(buf, offs)
        if not len(s["word"]):
            continue
        # canonical text: solid words with one space between, with its own word offsets
        n_words = len(s["starts"])
        size = s["ends"] - s["starts"]
        at = np.zeros(n_words + 1, np.int64)
        np.cumsum(size + 1, out=at[1:])
        canon = np.full(int(at[-1]), 32, np.uint8)
        canon[ragged(at[:-1], size)] = buf[ragged(s["starts"], size)]
        lo, count = s["word"], s["windows"]
        hi = lo + count + WINDOW - 1
        # equal super-k-mers: same number of words and same hash of all words, earliest (doc, row, word) first
        total = np.concatenate(([U64(0)], np.cumsum(s["hash"] * (np.arange(n_words, dtype=U64) * U64(2) + U64(1)), dtype=U64)))
        plain = np.concatenate(([U64(0)], np.cumsum(s["hash"], dtype=U64)))
        same = (total[hi] - total[lo]) - (plain[hi] - plain[lo]) * (lo.astype(U64) * U64(2))  # weights 1, 3, 5 ... from its own start
        order = np.lexsort((s["at"], row[s["text"]], ids[s["text"]], count, s["key"], plain[hi] - plain[lo], same))
        a, b = order[:-1], order[1:]
        repeat = np.zeros(len(order), bool)
        repeat[1:] = (same[a] == same[b]) & (count[a] == count[b]) & (s["key"][a] == s["key"][b]) & ((plain[hi] - plain[lo])[a] == (plain[hi] - plain[lo])[b])
        gone = order[repeat]
        keep = np.sort(order[~repeat])
        out_bucket: list[int] = []
        out_blob: list[bytes] = []
        if len(gone):
            t = s["text"][gone]
            out_bucket.append(-1)
            out_blob.append(blobs.pack([ids[t], row[t], s["at"][gone], s["at"][gone] + (hi - lo)[gone]]))
        target = (s["key"][keep] >> U64(8)) % U64(buckets)
        by = np.argsort(target, kind="stable")
        keep, target = keep[by], target[by].astype(np.int64)
        cut = np.flatnonzero(np.diff(target)) + 1
        for group in np.split(keep, cut):
            t = s["text"][group]
            length = at[hi[group]] - 1 - at[lo[group]]
            text = canon[ragged(at[lo[group]], length)]
            out_bucket.append(int((s["key"][group[0]] >> U64(8)) % U64(buckets)))
            out_blob.append(blobs.pack([ids[t], row[t], s["at"][group].astype(np.int32), length.astype(np.int32), text]))
        yield pa.RecordBatch.from_arrays([pa.array(out_bucket, pa.int32()), pa.array(out_blob, pa.binary())], names=["bucket", "blob"])


def _pieces(offs: np.ndarray, limit: int) -> list[tuple[int, int]]:
    """Ranges of items of about ``limit`` bytes each."""
    cut = np.concatenate(([0], np.flatnonzero(np.diff(offs[1:] // limit)) + 1, [len(offs) - 1])) if len(offs) > 1 else np.zeros(1, int)
    return [(int(a), int(b)) for a, b in zip(cut[:-1], cut[1:], strict=True) if b > a]


def _count(table: pa.Table) -> pa.Table:
    """Sort all windows of one bucket; give the word intervals that later occurrences cover."""
    claim("words")
    schema = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64())])
    got = [blobs.unpack(b.as_py()) for b in table.column("blob")]
    if not got:
        return schema.empty_table()
    if table.column("bucket")[0].as_py() == -1:
        return _table(*(np.concatenate([g[k] for g in got]) for k in range(4)), schema)
    ids, rows, at, length = (np.concatenate([g[k] for g in got]) for k in range(4))
    one, two, of, start, seen = [], [], [], [], 0
    for g in got:  # hashes are made blob by blob, so that only windows of the whole bucket are held
        offs = np.concatenate(([0], np.cumsum(g[3].astype(np.int64))))
        for lo, hi in _pieces(offs, HASH_BYTES):
            text = g[4][offs[lo] : offs[hi]]
            starts, ends, first = words(text, offs[lo : hi + 1] - offs[lo])
            h = word_hashes(text, starts, ends)
            n = np.diff(first) - WINDOW + 1  # windows of each super-k-mer
            begin = ragged(first[:-1], n)
            here = np.repeat(np.arange(len(n)), n)
            of.append((here + seen + lo).astype(np.int32))
            start.append((g[2][lo:hi][here] + begin - first[:-1][here]).astype(np.int32))
            one.append(window_hashes(h, WINDOW, 1)[begin])
            two.append(window_hashes(h, WINDOW, 2)[begin])
        seen += len(g[3])
    one, two, of, start = (np.concatenate(x) for x in (one, two, of, start))
    del got
    order = np.lexsort((start, rows[of], ids[of], two, one))
    later = np.zeros(len(order), bool)
    a, b = order[:-1], order[1:]
    later[1:] = (one[a] == one[b]) & (two[a] == two[b])
    hit = np.sort(order[later])
    if not len(hit):
        return schema.empty_table()
    # consecutive covered windows of one super-k-mer make one interval
    new = np.ones(len(hit), bool)
    new[1:] = (np.diff(hit) != 1) | (of[hit][1:] != of[hit][:-1])
    lo = hit[new]
    hi = hit[np.append(np.flatnonzero(new)[1:] - 1, len(hit) - 1)]
    return _table(ids[of[lo]], rows[of[lo]], start[lo], start[hi] + WINDOW, schema)


def _table(ids: np.ndarray, rows: np.ndarray, lo: np.ndarray, hi: np.ndarray, schema: pa.Schema) -> pa.Table:
    """Merge touching intervals of the same text before they travel."""
    order = np.lexsort((hi, lo, rows, ids))
    ids, rows, lo, hi = (x[order].astype(np.int64) for x in (ids, rows, lo, hi))
    group = np.concatenate(([0], np.cumsum((ids[1:] != ids[:-1]) | (rows[1:] != rows[:-1]))))
    big = int(hi.max()) + 1
    reach = np.maximum.accumulate(hi + group * big) - group * big  # furthest end so far in the group
    new = np.ones(len(ids), bool)
    new[1:] = (group[1:] != group[:-1]) | (lo[1:] > reach[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:] - 1, len(ids) - 1)
    return pa.Table.from_arrays([pa.array(ids[first]), pa.array(rows[first]), pa.array(lo[first]), pa.array(reach[last])], schema=schema)


def covered_intervals(docs: DataFrame) -> DataFrame:
    """``doc_id, row, lo, hi``: word intervals that later windows cover (they may overlap across buckets).

    ``docs`` has ``doc_id`` and ``row`` (long, not null; order of occurrence) and ``text``.
    """
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(partitions(spark), -(-size // BUCKET_BYTES))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _split(batches, buckets)

    packed = docs.mapInArrow(split, "bucket int, blob binary")
    # intervals that a slice settled itself (bucket -1) are spread instead of meeting in one task
    spread = F.when(F.col("bucket") < 0, F.pmod(F.xxhash64("blob"), F.lit(buckets)).cast("int")).otherwise(F.lit(-1))
    return packed.withColumn("part", spread).groupBy("bucket", "part").applyInArrow(_count, "doc_id long, row long, lo long, hi long")


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` (and ``kept_text``) of every row of ``docs``.

    A word goes if a window of its row covers it whose word sequence starts earlier
    too: in a row with a smaller id, or earlier in the same row.  Null text: no words.
    Texts shorter than a window keep all words.  Rows that repeat an id count as
    further occurrences after the first of them in the order they are read; null ids sort
    before all others and keep their null.  Other columns are never read.
    """
    clean = docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    repeated = clean.groupBy("doc_id").agg(F.count("*").alias("n")).filter((F.col("n") > 1) | F.col("doc_id").isNull()).limit(1).count()
    if repeated:  # only then rows of one id need an order: that of a written table, so no id's rows meet in one task
        clean = written(clean.withColumn("row", F.monotonically_increasing_id()), "rows")
    else:
        clean = clean.withColumn("row", F.lit(1).cast("long"))
    null_id = -(2**63)
    keyed = clean.withColumn("doc_id", F.coalesce("doc_id", F.lit(null_id)))
    spans = covered_intervals(keyed).groupBy("doc_id", "row").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    joined = keyed.join(spans, ["doc_id", "row"], "left").select("doc_id", "text", F.col("spans.lo").alias("lo"), F.col("spans.hi").alias("hi"))
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + (", kept_text string" if with_text else "")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            buf, offs = raw(column(part, "text"))
            starts, ends, first = words(buf, offs)
            n = np.diff(first)
            removed, digests, texts = [], [], []
            los, his = column(part, "lo").to_pylist(), column(part, "hi").to_pylist()
            data = buf.tobytes()
            for k in range(len(n)):
                keep = np.ones(int(n[k]), bool)
                for lo, hi in zip(los[k] or (), his[k] or (), strict=True):
                    keep[lo:hi] = False
                at = np.flatnonzero(keep) + first[k]
                # runs of kept words are split and joined at C speed
                kept = b" ".join(data[s:e] for s, e in zip(starts[at].tolist(), ends[at].tolist(), strict=True)) if los[k] else b" ".join(data[offs[k] : offs[k + 1]].split())
                removed.append(int(n[k]) - len(at))
                digests.append(hashlib.sha256(kept).hexdigest())
                if with_text:
                    texts.append(kept.decode())
            arrays = [column(part, "doc_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests)] + ([pa.array(texts)] if with_text else [])
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"][: len(arrays)])

    out = joined.mapInArrow(cut, schema)
    return out.withColumn("doc_id", F.nullif(F.col("doc_id"), F.lit(null_id)))
