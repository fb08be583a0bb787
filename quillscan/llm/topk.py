"""Exact top-k inner-product search with an impact-ordered, score-at-a-time index.

Components are integers.  For a shard of vectors, each dimension has its postings
sorted by component value and cut into segments of equal quantised value.  For a
query, a segment's impact is the largest product it can contribute, quantised; segments
are opened in waves of descending impact (measured from the least product that the
dimension can give, so that impacts are not negative), and only the postings of opened
segments are multiplied and added to their vectors' accumulators.  A vector's
accumulator plus the largest impact still closed for each of its unseen dimensions
bounds its score; processing stops only when few vectors can still reach the k-th best
*proven* score, and every vector that can is rescored exactly.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ragged

#: Vectors per shard and queries per block: the most that one task holds of each side.
SHARD_ROWS, BLOCK_ROWS = 2_500, 20_000
#: Component values per quantisation step; impacts of a query are quantised to so many levels.
STEP, LEVELS = 16, 256
#: Share of a shard's postings in the first and in later waves, and vectors that may stay open for rescoring.
FIRST, WAVE, OPEN = 0.6, 0.2, 1 / 6


class ImpactIndex:
    """Postings of one shard: per dimension the vector numbers by descending value, cut into segments of one quantised value."""

    def __init__(self, vectors: np.ndarray, step: int = STEP):
        self.vectors = vectors
        n, dims = vectors.shape
        order = np.argsort(-vectors, axis=0, kind="stable").T
        self.values = np.ascontiguousarray(np.take_along_axis(vectors.T, order, axis=1), dtype=np.float64)  # dims x n, descending
        self.postings = order.ravel()
        level = np.floor_divide(self.values, step)
        new = np.ones((dims, n), dtype=bool)
        new[:, 1:] = level[:, 1:] != level[:, :-1]
        self.start = np.flatnonzero(new.ravel())
        self.size = np.diff(np.append(self.start, dims * n))
        self.dim = self.start // n
        flat = self.values.ravel()
        self.head = flat[self.start]  # a segment's largest value
        self.tail = flat[self.start + self.size - 1]  # and its smallest
        self.opened = 0  # postings multiplied so far, over all searches

    def search(self, query: np.ndarray, k: int, skip: np.ndarray | None = None) -> np.ndarray:
        """Numbers of every vector that can be among the k best (a superset, proven); ``skip``: numbers that are no candidates."""
        n, dims = self.vectors.shape
        q = query.astype(np.float64)
        least = np.minimum(self.values[:, 0] * q, self.values[:, -1] * q)  # the least product of each dimension
        of = q[self.dim]
        impact = np.maximum(self.head * of, self.tail * of) - least[self.dim]
        slack = dims * float(np.abs(impact).max(initial=0.0)) * dims * 2.0**-50  # rounding of doubles
        quantum = max(float(impact.max(initial=0.0)) / LEVELS, 1e-300)
        rank = np.argsort(-np.ceil(impact / quantum), kind="stable")
        top = np.maximum.accumulate(impact[rank][::-1])[::-1]  # the largest impact from each place on
        done = np.cumsum(self.size[rank])
        score, seen = np.zeros(n), np.zeros(n)
        flat = self.values.ravel()
        begin = 0
        while begin < len(rank):
            end = max(begin + 1, int(np.searchsorted(done, (done[begin - 1] + WAVE * done[-1]) if begin else FIRST * done[-1])))
            wave = rank[begin:end]
            size = self.size[wave]
            at = ragged(self.start[wave], size)
            numbers = self.postings.take(at)
            score += np.bincount(numbers, flat.take(at) * np.repeat(of[wave], size) - np.repeat(least[self.dim[wave]], size), n)
            seen += np.bincount(numbers, minlength=n)
            self.opened += len(at)
            begin = end
            closed = float(top[end]) if end < len(rank) else 0.0
            proven = score.copy()
            if skip is not None:
                proven[skip] = -np.inf
            kth = np.partition(proven, n - k)[n - k] if n > k else -np.inf
            possible = np.flatnonzero(score + (dims - seen) * closed >= kth - slack)
            if len(possible) <= max(4 * k, n * OPEN):
                return possible
        return possible


def topk_inner_product(rows: DataFrame, k: int, query_every: int, id_col: str = "vec_id", vec_col: str = "embedding", scale: float = 256.0) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k best candidates of each row whose id is divisible by ``query_every``.

    The score is the inner product of floor(scale * x); ties go to the smaller id.  A
    row is no candidate of queries with its own id.  Rows with a null id or a vector
    that is null, empty or holds null or non-finite components take no part, nor do
    vectors of another length than the query's.  Repeated ids stay separate
    candidates; query rows of one id share a ranking.  Vectors whose scores may leave
    64 bits raise an OverflowError.  Other columns are never read; an empty table gives
    an empty result.

    Vectors go to shards and queries to blocks by hash, and each (shard, block) cell is
    one bounded task: its vectors are indexed, its queries searched, and only k rows a
    query leave it.  The stated query set against all rows is thus done in blocks.
    """
    spark = rows.sparkSession
    vec = F.col("_vec")
    clean = (
        rows.select(rows[id_col].cast("long").alias("_id"), rows[vec_col].cast("array<double>").alias("_vec"))
        .filter(F.col("_id").isNotNull() & (F.size(vec) > 0))
        .filter(F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))))
        .select("_id", F.transform(vec, lambda x: F.floor(x * scale)).alias("_vec"))
    )
    n = clean.count()
    shards, blocks = max(4, -(-n // SHARD_ROWS)), max(1, -(-n // (query_every * BLOCK_ROWS)))
    h = F.xxhash64("_id", "_vec")  # rows of one id are spread too
    data = clean.select("_id", "_vec", F.size("_vec").alias("_dims"), F.pmod(h, F.lit(shards)).cast("int").alias("_shard"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_block"))
    queries = clean.filter(F.col("_id") % query_every == 0).select(
        F.col("_id").alias("_qid"), F.col("_vec").alias("_qvec"), F.size("_vec").alias("_dims"), F.pmod(F.xxhash64("_id"), F.lit(blocks)).cast("int").alias("_block"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("_shard")
    ).distinct()

    def cell(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(left) and len(right):
            left = left.sort_values("_id")
            ids = left["_id"].to_numpy()
            vectors = np.stack(left["_vec"].to_numpy()).astype(np.int64)
            asked = np.stack(right["_qvec"].to_numpy()).astype(np.int64)
            if max(abs(int(vectors.min())), int(vectors.max())) * max(abs(int(asked.min())), int(asked.max())) * vectors.shape[1] >= 2**63:
                raise OverflowError("scores of these vectors do not fit 64 bits")
            index = ImpactIndex(vectors)
            for qid, q in zip(right["_qid"], right["_qvec"], strict=True):
                q = np.asarray(q, dtype=np.int64)
                own = np.flatnonzero(ids == qid)
                can = index.search(q, k, own)
                can = can[ids[can] != qid]
                score = vectors[can] @ q
                top = np.lexsort((ids[can], -score))[:k]
                out.extend((int(qid), int(ids[can[t]]), int(score[t])) for t in top)
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype("int64")

    keys = ["_shard", "_block", "_dims"]
    found = data.groupBy(*keys).cogroup(queries.groupBy(*keys)).applyInPandas(cell, "query_id long, vec_id long, score long")
    from pyspark.sql import Window

    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
