"""Near-duplicate components by an n-gram Jaccard join with parity sketches.

A document's set holds the hashes of its distinct word shingles.  Two sets of sizes
a and b link when their Jaccard similarity is at least 0.8, so their symmetric
difference is at most (a + b) / 9.

* Size bands: the larger set of a pair lies in one band; sets that are large enough
  to be its partner take part in that band too.
* Parity sketch: for a band, hash space is cut into K blocks and each block keeps the
  XOR of its tokens' hashes.  One token changes one block, so the number of blocks
  that differ is at most the symmetric difference k.  With K = k + 1 + e blocks, two
  linked sets agree in at least 1 + e of them, thus in a non-empty one unless both
  have more than e empty blocks; such sets emit their empty blocks as well.
* Equal blocks meet by a pigeonhole join; equal sets are merged before it.
* A bit sketch (one flipped bit per token, folded to a common size) whose Hamming
  distance also bounds the symmetric difference from below refutes most candidates;
  the rest is verified on the sets themselves.

Not all pairs of a group are formed.  First each group's members are compared with its
first member only; then only members that the verified links leave in different
components are compared with each other, and only pairs that the bit sketch cannot
refute leave the task.  So no link between different components is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blobs
from .common import U64, claim, column, mix, partitions, ragged, raw, remove, slices, window_hashes, word_hashes, words, written
from .components import components

SHINGLE = 5
#: Input bytes per bucket of the pigeonhole join; members of one comparison cell.
BUCKET_BYTES, CELL = 16_000_000, 1_000


def shingle_sets(buf: np.ndarray, offs: np.ndarray, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, one text after the other, and offsets."""
    starts, ends, first = words(buf, offs)
    h = word_hashes(buf, starts, ends, lower=True)
    n = np.diff(first)
    size = np.where(n >= width, n - width + 1, (n > 0).astype(n.dtype))
    cut = np.concatenate(([0], np.cumsum(size)))
    out = np.zeros(int(cut[-1]), U64)
    long_ = n >= width
    if long_.any():
        out[ragged(cut[:-1][long_], size[long_])] = window_hashes(h, width)[ragged(first[:-1][long_], size[long_])]
    for k in np.flatnonzero((n > 0) & ~long_):
        out[cut[k]] = window_hashes(h[first[k] : first[k + 1]], int(n[k]), seed=50 + int(n[k]))[0]
    new = np.ones(len(out), bool)
    for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        out[a:b].sort()
    new[1:] = out[1:] != out[:-1]
    new[cut[:-1][size > 0]] = True
    kept = np.concatenate(([0], np.cumsum(new)))[cut]
    return out[new], kept


def _sum_by(values: np.ndarray, cut: np.ndarray) -> np.ndarray:
    total = np.concatenate(([U64(0)], np.cumsum(values, dtype=U64)))
    return total[cut[1:]] - total[cut[:-1]]


def prints(sets: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit fingerprints of each set."""
    return _sum_by(mix(sets + U64(1)), cut), _sum_by(mix(sets ^ U64(0x5851F42D4C957F2D)), cut)


def _edges_of_bands(limit: int) -> np.ndarray:
    edges = [1]
    while edges[-1] <= limit:
        edges.append(max(edges[-1] + 1, -(-edges[-1] * 3 // 2)))
    return np.asarray(edges, dtype=np.int64)


def block_keys(sets: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pigeonhole keys of all sets: (64-bit key, number of the set)."""
    n = np.diff(cut)
    if not len(sets):
        return np.zeros(0, U64), np.zeros(0, np.int64)
    edges = _edges_of_bands(int(n.max()) * 2)
    band = np.searchsorted(edges, n, "right") - 1
    keys, owner = [], []
    for role in (0, 1):
        own = np.flatnonzero((n > 0) & ((10 * n >= 8 * edges[band + 1]) if role else (n > 0)))
        if not len(own):
            continue
        j = band[own] + role
        k = 2 * (edges[j + 1] - 1) // 9
        slack = np.where(k > 0, -(-(k + 1) // 5), 0)
        blocks = k + 1 + slack
        size = n[own]
        h = sets[ragged(cut[:-1][own], size)]
        at = np.repeat(np.arange(len(own)), size)
        block = ((h >> U64(32)) * blocks[at].astype(U64)) >> U64(32)  # sorted hashes: blocks are contiguous
        new = np.ones(len(h), bool)
        new[1:] = (block[1:] != block[:-1]) | (at[1:] != at[:-1])
        begin = np.flatnonzero(new)
        word = np.bitwise_xor.reduceat(mix(h), begin)
        tag = mix((j[at[begin]].astype(U64) << U64(40)) ^ block[begin])
        keys.append(mix(word ^ tag))
        owner.append(own[at[begin]])
        filled = np.bincount(at[begin], minlength=len(own))
        for i in np.flatnonzero(blocks - filled > slack):  # too many empty blocks: they count as well
            there = np.zeros(int(blocks[i]), bool)
            there[block[begin[at[begin] == i]].astype(np.int64)] = True
            gone = np.flatnonzero(~there).astype(U64)
            keys.append(mix(mix((U64(j[i]) << U64(40)) ^ gone) + U64(0xE)))
            owner.append(np.full(len(gone), own[i]))
    return np.concatenate(keys), np.concatenate(owner)


def bit_sketch(h: np.ndarray) -> bytes:
    """One bit per token is flipped in a sketch of at least two bits per token (a power of two)."""
    bits = 64
    while bits < 2 * len(h):
        bits *= 2
    parity = np.bincount((mix(h ^ U64(0xA5)) & U64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(parity.astype(np.uint8)).tobytes()


def _fold(sketch: np.ndarray, size: int) -> np.ndarray:
    while sketch.shape[-1] > size:
        half = sketch.shape[-1] // 2
        sketch = sketch[..., :half] ^ sketch[..., half:]
    return sketch


def may_link(na: int, nb: int, a: bytes, b: bytes) -> bool:
    """False only if the sizes or the bit sketches prove that the sets do not link."""
    if 10 * min(na, nb) < 8 * max(na, nb):
        return False
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    size = min(len(x), len(y))
    return 9 * int(np.bitwise_count(_fold(x, size) ^ _fold(y, size)).sum()) <= na + nb


# ---------------------------------------------------------------- steps on executors


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, "text"):
        sets, cut = shingle_sets(*raw(column(part, "text")))
        one, two = prints(sets, cut)
        yield pa.RecordBatch.from_arrays([column(part, "doc_id"), pa.array(np.diff(cut), pa.int64()), pa.array(one.view(np.int64)), pa.array(two.view(np.int64))], names=["doc_id", "n_shingles", "one", "two"])


def _keys(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, "text"):
        ids = column(part, "doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
        sets, cut = shingle_sets(*raw(column(part, "text")))
        one, two = prints(sets, cut)
        # of equal sets in a slice only the one with the least id goes on
        order = np.lexsort((ids, two, one))
        first = np.ones(len(order), bool)
        first[1:] = (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])
        keep = np.sort(order[first & (np.diff(cut)[order] > 0)])
        if not len(keep):
            continue
        size = np.diff(cut)[keep]
        sets = sets[ragged(cut[:-1][keep], size)]
        key, owner = block_keys(sets, np.concatenate(([0], np.cumsum(size))))
        bucket = (key % U64(buckets)).astype(np.int64)
        key = key // U64(buckets)
        order = np.lexsort((owner, bucket))
        bucket, key, owner = bucket[order], key[order], owner[order]
        cuts = np.concatenate(([0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]))
        rows, packed = [], []
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            who, at = np.unique(owner[lo:hi], return_inverse=True)
            k = key[lo:hi]
            packed.append(blobs.pack([k.astype(np.uint32), (k >> U64(32)).astype(np.uint16), at.astype(np.uint32), ids[keep[who]], one[keep[who]]]))
            rows.append(int(bucket[lo]))
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int32()), pa.array(packed, pa.binary())], names=["bucket", "blob"])


_GROUPS = pa.schema([("sign", pa.int64()), ("members", pa.list_(pa.int64()))])


def _meet(table: pa.Table) -> pa.Table:
    """Members (least id of each different set) of every key of one bucket that at least two different sets have."""
    claim("words")
    key, doc, tag = [], [], []
    for b in table.column("blob"):
        low, high, at, ids, one = blobs.unpack(b.as_py())
        key.append(low.astype(U64) | (high.astype(U64) << U64(32)))
        doc.append(ids[at])
        tag.append(one[at])
    key, doc, tag = np.concatenate(key), np.concatenate(doc), np.concatenate(tag)
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    shared = np.zeros(len(order), bool)
    shared[1:] |= same
    shared[:-1] |= same
    order = order[shared]
    order = order[np.lexsort((doc[order], tag[order], key[order]))]
    key, doc, tag = key[order], doc[order], tag[order]
    if not len(key):
        return _GROUPS.empty_table()
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (tag[1:] != tag[:-1])
    key, doc = key[new], doc[new]
    order = np.lexsort((doc, key))
    key, doc = key[order], doc[order]
    cut = np.concatenate(([0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]))
    size = np.diff(cut)
    nth = np.arange(len(key)) - np.repeat(cut[:-1], size)
    sign = _sum_by(mix(mix(doc.view(U64)) + nth.astype(U64)), cut)
    use = np.flatnonzero(size > 1)
    _, pick = np.unique(sign[use], return_index=True)  # the same members again and again: once is enough
    use = use[pick]
    values = doc[ragged(cut[:-1][use], size[use])]
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(size[use]))), pa.int32()), pa.array(values))
    return pa.Table.from_arrays([pa.array(sign[use].view(np.int64)), lists], schema=_GROUPS)


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, "text"):
        sets, cut = shingle_sets(*raw(column(part, "text")))
        lists = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(sets.view(np.int64)))
        yield pa.RecordBatch.from_arrays([column(part, "doc_id"), pa.array(np.diff(cut), pa.int64()), pa.array([bit_sketch(sets[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary()), lists], names=["doc_id", "n", "sketch", "tokens"])


def _unrefuted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        cols = [column(b, c).to_pylist() for c in ("a", "b", "na", "nb", "sa", "sb")]
        keep = [may_link(na, nb, sa, sb) for _, _, na, nb, sa, sb in zip(*cols, strict=True)]
        yield pa.RecordBatch.from_arrays([column(b, "a"), column(b, "b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))


_PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _across(table: pa.Table) -> pa.Table:
    """Pairs of one cell in different components that sizes and bit sketches cannot refute."""
    claim("words")
    doc, comp, n = (table.column(c).to_numpy() for c in ("doc", "comp", "n"))
    side = table.column("side").to_numpy()
    sketch = table.column("sketch").to_pylist()
    big = max(len(x) for x in sketch)
    # all sketches at every power of two they can be folded to, by size
    out_a: list[np.ndarray] = []
    out_b: list[np.ndarray] = []
    sizes = np.asarray([len(x) for x in sketch])
    for size in sorted(set(sizes.tolist())):
        if size > big:
            break
        at = np.flatnonzero(sizes >= size)
        folded = np.stack([_fold(np.frombuffer(sketch[i], np.uint8), size) for i in at])
        words_ = folded.view(np.uint64)
        for p, i in enumerate(at):
            # the pair's common size is `size`: one of both has it
            q = np.arange(p + 1, len(at))
            j = at[q]
            ok = (comp[j] != comp[i]) & ((sizes[j] == size) | (sizes[i] == size)) & (10 * np.minimum(n[i], n[j]) >= 8 * np.maximum(n[i], n[j])) & ((side[i] == 0) | (side[j] == 0)) & ((side[i] != side[j]) | (side.max() == 0))
            q, j = q[ok], j[ok]
            if len(q):
                far = np.bitwise_count(words_[q] ^ words_[p]).sum(axis=1)
                j = j[9 * far.astype(np.int64) <= n[j] + n[i]]
                out_a.append(np.minimum(doc[i], doc[j]))
                out_b.append(np.maximum(doc[i], doc[j]))
    if not out_a:
        return _PAIRS.empty_table()
    return pa.Table.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in (out_a, out_b)], schema=_PAIRS)


# ---------------------------------------------------------------- the operator


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of ``a, b`` whose sets link."""
    short = sets.select("doc_id", "n", "sketch")
    left = short.select(F.col("doc_id").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa"))
    right = short.select(F.col("doc_id").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb"))
    open_ = written(pairs.join(left, "a").join(right, "b").select("a", "b", "na", "nb", "sa", "sb").mapInArrow(_unrefuted, "a long, b long").distinct(), "open")
    ta = sets.select(F.col("doc_id").alias("a"), F.col("tokens").alias("ta"))
    tb = sets.select(F.col("doc_id").alias("b"), F.col("tokens").alias("tb"))
    common = F.size(F.array_intersect("ta", "tb"))
    return open_.join(ta, "a").join(tb, "b").filter(100 * common >= 80 * (F.size("ta") + F.size("tb") - common)).select("a", "b").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row of ``docs``.

    ``component_id`` is the least id reachable over links.  A-Z are lower-cased; fewer
    words than a shingle has form one shingle; null, empty and blank texts have none,
    link with nothing and are their own component.  Rows with a null id take no part
    (their component is null).  Rows that share an id count as one vertex.  Equal sets
    are recognised by two 64-bit fingerprints.  Other columns are never read.
    """
    spark = docs.sparkSession
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(partitions(spark), -(-total // BUCKET_BYTES))
    known = rows.filter("doc_id IS NOT NULL")
    table = written(rows.mapInArrow(_fingerprints, "doc_id long, n_shingles long, one long, two long"), "prints")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _keys(batches, buckets)

    met = known.mapInArrow(split, "bucket int, blob binary").groupBy("bucket").applyInArrow(_meet, "sign long, members array<long>")
    groups = written(met.dropDuplicates(["sign"]), "groups")
    involved = groups.select(F.explode("members").alias("doc_id")).distinct()
    sets = written(known.join(involved, "doc_id").select("doc_id", "text").mapInArrow(_describe, "doc_id long, n long, sketch binary, tokens array<long>"), "sets")
    star = groups.select(F.element_at("members", 1).alias("a"), F.explode(F.slice("members", F.lit(2), F.size("members"))).alias("b")).distinct()
    links = written(_verified(star, sets), "links")
    comps = written(components(links), "comps")
    # second round: members of one group that are still in different components
    of = comps.select(F.col("v").alias("doc"), "root")
    member = groups.select("sign", F.size("members").alias("of"), F.explode("members").alias("doc")).join(of, "doc", "left").select("sign", "of", "doc", F.coalesce("root", "doc").alias("comp"))
    split_up = member.groupBy("sign").agg(F.min("comp").alias("least"), F.max("comp").alias("most")).filter("least < most").select("sign")
    chunks = F.ceil(F.col("of") / CELL).cast("int")
    cells = (
        member.join(split_up, "sign")
        .withColumn("own", F.pmod(F.xxhash64("doc"), chunks).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), chunks - 1)))
        .select("sign", "doc", "comp", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), F.when(F.col("own") <= F.col("other"), 0).otherwise(1).alias("side"))
        .join(sets.select(F.col("doc_id").alias("doc"), "n", "sketch"), "doc")
    )
    rest = cells.groupBy("sign", "x", "y").applyInArrow(_across, "a long, b long").distinct()
    rest = written(rest.join(star.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti"), "rest")
    more = _verified(rest, sets) if rest.limit(1).count() else links.limit(0)
    final = written(components(links.unionByName(more)), "comps")
    for t in (groups, sets, links, comps, rest):
        remove(t)
    # rows of equal sets share their least id; a vertex's root is the least of its component
    classes = table.filter("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("n_shingles", "one", "two").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("last")).join(final.withColumnRenamed("v", "rep"), "rep", "left")
    special = classes.filter("last > rep OR root IS NOT NULL").select("n_shingles", "one", "two", F.coalesce("root", "rep").alias("found"))
    joined = table.join(special, ["n_shingles", "one", "two"], "left")
    return joined.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("found", "doc_id")).alias("component_id"))
