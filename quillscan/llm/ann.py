"""Approximate nearest neighbours with a hierarchical k-means tree and best-bin-first search.

The tree is fitted on a bounded hash sample; every vector is then assigned to a leaf.
A query walks the tree through a priority queue that always opens the most promising
node next (the upper bound of the inner product inside it), and so ranks the leaves.
How many leaves are visited is calibrated: exact neighbours of a bounded sample of
queries are found by brute force over all rows, and visits are widened until the
wanted share of them lies in visited leaves.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: Rows the tree is fitted on, queries it is calibrated on, recall to reach there.
SAMPLE_ROWS, CALIBRATION, RECALL = 20_000, 200, 0.96
#: Most components of the sample, whatever the vectors' length.
SAMPLE_VALUES = 4_000_000
BRANCH, LEAF_ROWS = 8, 600
#: Most vectors and queries of one search cell.
CELL_ROWS, CELL_QUERIES = 2_000, 4_000


class Tree:
    """Nodes hold a centroid and a radius; leaves are numbered from 0."""

    def __init__(self, vectors: np.ndarray, leaf_share: float, branch: int = BRANCH, seed: int = 0):
        self.centre: list[np.ndarray] = []
        self.radius: list[float] = []
        self.children: list[list[int]] = []
        self.leaf: list[int] = []
        self.leaves = 0
        self._grow(vectors, max(leaf_share * len(vectors), 2.0), branch, np.random.default_rng(seed))

    def _grow(self, x: np.ndarray, size: float, branch: int, rng: np.random.Generator) -> int:
        node = len(self.centre)
        centre = x.mean(axis=0) if len(x) else np.zeros(x.shape[1])
        self.centre.append(centre)
        self.radius.append(float(np.sqrt(((x - centre) ** 2).sum(axis=1).max())) if len(x) else 0.0)
        self.children.append([])
        self.leaf.append(-1)
        want = min(branch, int(np.ceil(len(x) / size)))
        if want > 1 and len(groups := _kmeans(x, want, rng)) > 1:
            self.children[node] = [self._grow(x[g], size, branch, rng) for g in groups]
        else:
            self.leaf[node] = self.leaves
            self.leaves += 1
        return node

    def assign(self, x: np.ndarray) -> np.ndarray:
        """Leaf of each vector: down the tree to the nearest child."""
        out = np.zeros(len(x), np.int64)
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            kids = self.children[node]
            if not kids:
                out[rows] = self.leaf[node]
                continue
            near = np.argmin(_distances(x[rows], np.stack([self.centre[k] for k in kids])), axis=1)
            todo += [(k, rows[near == i]) for i, k in enumerate(kids) if (near == i).any()]
        return out

    def visits(self, q: np.ndarray, most: int, sizes: np.ndarray | None = None, rows: int = 0) -> list[int]:
        """The first ``most`` leaves, best bin first; more of them until their ``sizes`` sum to ``rows``."""
        norm = float(np.sqrt(np.einsum("i,i->", q, q)))
        out: list[int] = []
        heap = [(0.0, 0)]
        held = 0
        while heap and (len(out) < most or held < rows):
            _, node = heapq.heappop(heap)
            kids = self.children[node]
            if not kids:
                out.append(self.leaf[node])
                held += int(sizes[self.leaf[node]]) if sizes is not None else 0
            for k in kids:
                heapq.heappush(heap, (-(float(np.einsum("i,i->", q, self.centre[k])) + 0.25 * norm * self.radius[k]), k))
        return out


def _distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", centres, centres)[None, :] - 2 * np.einsum("ij,kj->ik", x, centres, optimize=False)


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> list[np.ndarray]:
    centres = x[rng.choice(len(x), k, replace=False)]
    near = np.zeros(len(x), int)
    for _ in range(rounds):
        near = np.argmin(_distances(x, centres), axis=1)
        for i in range(k):
            if (near == i).any():
                centres[i] = x[near == i].mean(axis=0)
    return [np.flatnonzero(near == i) for i in range(k) if (near == i).any()]


def clean_vectors(rows: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``_id, _vec``: rows with an id whose vector is neither null, empty, zero nor holds null or non-finite components."""
    vec = F.col("_vec")
    return (
        rows.select(rows[id_col].cast("long").alias("_id"), rows[vec_col].cast("array<double>").alias("_vec"))
        .filter(F.col("_id").isNotNull() & (F.size(vec) > 0))
        .filter(F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(vec, lambda x: x != 0))
    )


def _stack(vectors: pd.Series) -> np.ndarray:
    return np.stack(vectors.to_numpy()).astype(np.float64)


def _search_cell(ids: np.ndarray, x: np.ndarray, qids: np.ndarray, q: np.ndarray, k: int) -> pd.DataFrame:
    """Per query the k best of one cell: a rough product finds all that may be among them, exact scores decide.

    Exact scores are summed in one fixed order, so they do not depend on the cell.
    """
    rough = np.where(qids[:, None] == ids[None, :], -np.inf, q @ x.T)
    n = len(ids)
    least = np.partition(rough, n - k, axis=1)[:, n - k] if n > k else np.full(len(qids), -np.inf)
    # rounding of both products, relative to the lengths of both vectors
    slack = 1e-13 * x.shape[1] * np.sqrt(np.einsum("ij,ij->i", q, q)) * np.sqrt(np.einsum("ij,ij->i", x, x).max())
    row, col = np.nonzero((rough >= (least - slack)[:, None]) & (qids[:, None] != ids[None, :]))
    score = np.add.reduce(x[col] * q[row], axis=1)
    order = np.lexsort((ids[col], -score, row))
    row, col, score = row[order], col[order], score[order]
    first = np.searchsorted(row, np.arange(len(qids)))
    keep = np.arange(len(row)) - first[row] < k
    row, col, score = row[keep], col[keep], score[keep]
    cut = np.searchsorted(row, np.arange(1, len(qids)))
    return pd.DataFrame({"query_id": qids, "ids": [a.tolist() for a in np.split(ids[col], cut)], "scores": [a.tolist() for a in np.split(score, cut)]})


def nearest(rows: DataFrame, k: int, query: Column, id_col: str = "vec_id", vec_col: str = "embedding", recall: float = RECALL) -> DataFrame:
    """``query_id, rank, vec_id, score``: about the ``k`` rows of largest inner product for each row that meets ``query``.

    ``query`` is a condition on the column ``_id``.  Scores are computed in double
    precision on the original vectors; ties go to the smaller id; a row is no candidate
    of queries with its own id, and rows of one id ask once with each of their vectors.
    Rows with a null id and null, empty, zero or non-finite vectors take no part.
    Vectors are searched among those of their own length, each length by a tree of its
    own.  Large leaves are cut into cells of bounded size, so a leaf that holds a third of
    all rows is many tasks.  A query goes on to further leaves until they hold ``k`` rows
    of other ids, so it gets fewer than ``k`` only where there are fewer.  Other columns
    are never read; an empty table gives an empty result.
    """
    spark = rows.sparkSession
    clean = clean_vectors(rows, id_col, vec_col).withColumn("_dims", F.size("_vec"))
    lengths = clean.groupBy("_dims").count().collect()  # a row per length of vector
    if not lengths:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    found = [_nearest(clean.filter(F.col("_dims") == r["_dims"]).select("_id", "_vec"), k, query, r["_dims"], r["count"], recall) for r in lengths]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _nearest(clean: DataFrame, k: int, query: Column, dims: int, n: int, recall: float) -> DataFrame:
    spark = clean.sparkSession
    clean = written(clean.withColumn("_n", F.monotonically_increasing_id()), "vectors")
    order = F.pmod(F.xxhash64("_n"), F.lit(1_000_000_007))
    most = max(1_000, min(SAMPLE_ROWS, SAMPLE_VALUES // dims))
    share = int(1_000_000_007 * min(1.0, most / n))
    picked = clean.filter(order <= share).select("_vec").limit(2 * most).toArrow()["_vec"].combine_chunks()
    sample = picked.flatten().to_numpy().reshape(-1, dims) if len(picked) else np.zeros((0, dims))
    tree = Tree(sample, LEAF_ROWS / n)
    held = spark.sparkContext.broadcast(tree)  # bounded by the sample: at most its centroids

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                yield pdf.assign(_leaf=held.value.assign(_stack(pdf["_vec"])))

    leaves = written(clean.mapInPandas(assign, "_id long, _vec array<double>, _n long, _leaf long"), "leaves")
    queries = clean.filter(query).select("_id", "_vec").distinct()
    visits = _calibrate(leaves, queries, tree, k, recall)

    per_leaf = {r["_leaf"]: r["count"] for r in leaves.groupBy("_leaf").count().collect()}  # a row per leaf of the tree
    sizes = spark.sparkContext.broadcast(np.asarray([per_leaf.get(i, 0) for i in range(tree.leaves)]))

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                ranked = [held.value.visits(v, visits, sizes.value, k + own) for v, own in zip(_stack(pdf["_vec"]), pdf["_own"], strict=True)]
                yield pd.DataFrame({"_qid": pdf["_id"], "_qvec": pdf["_vec"], "_leaves": ranked})

    cells = spark.createDataFrame([(int(a), int(-(-b // CELL_ROWS))) for a, b in per_leaf.items()], "_leaf long, _chunks int")
    blocks = max(1, -(-queries.count() // CELL_QUERIES))
    data = leaves.join(F.broadcast(cells), "_leaf").select("_leaf", F.pmod(F.xxhash64("_n"), F.col("_chunks")).cast("int").alias("_chunk"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_block"), "_id", "_vec")
    own = queries.join(clean.filter(query).groupBy("_id").agg(F.count("*").alias("_own")), "_id")  # rows that share a query's id are no candidates
    asked = (
        own.mapInPandas(walk, "_qid long, _qvec array<double>, _leaves array<long>")
        .select("_qid", "_qvec", F.explode("_leaves").alias("_leaf"))
        .join(F.broadcast(cells), "_leaf")
        .select("_leaf", F.explode(F.sequence(F.lit(0), F.col("_chunks") - 1)).alias("_chunk"), F.pmod(F.xxhash64("_qid", "_qvec"), F.lit(blocks)).cast("int").alias("_block"), "_qid", "_qvec", F.xxhash64("_qvec").alias("_ask"))
    )

    def cell(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):  # empty columns need their types: a list is an object
            return pd.DataFrame({c: pd.Series([], dtype=t) for c, t in (("query_id", "int64"), ("ask", "int64"), ("ids", object), ("scores", object))})
        return _search_cell(left["_id"].to_numpy(), _stack(left["_vec"]), right["_qid"].to_numpy(), _stack(right["_qvec"]), k).assign(ask=right["_ask"].to_numpy())

    keys = ["_leaf", "_chunk", "_block"]
    found = data.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInPandas(cell, "query_id long, ask long, ids array<long>, scores array<double>")
    # each cell gives a query at most k candidates, in one row: best k of their union
    pair = F.arrays_zip("ids", "scores")
    merged = found.withColumn("p", F.transform(pair, lambda p: F.struct((-p["scores"]).alias("m"), p["ids"].alias("v"))))
    merged = merged.groupBy("query_id", "ask").agg(F.slice(F.array_sort(F.flatten(F.collect_list("p"))), 1, k).alias("top"))
    return merged.select("query_id", F.posexplode("top").alias("pos", "t")).select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("t.v").alias("vec_id"), (-F.col("t.m")).alias("score"))


def _calibrate(leaves: DataFrame, queries: DataFrame, tree: Tree, k: int, recall: float) -> int:
    """The least number of leaves whose visit finds ``recall`` of the exact neighbours of a bounded query sample."""
    spark = leaves.sparkSession
    picked = queries.orderBy(F.xxhash64("_id"), "_id").limit(CALIBRATION).collect()
    if not picked:
        return 1
    ids = np.asarray([r["_id"] for r in picked])
    qs = np.asarray([r["_vec"] for r in picked], dtype=np.float64)
    held = spark.sparkContext.broadcast((ids, qs))

    def brute(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, q = held.value
        for pdf in batches:
            if not len(pdf):
                continue
            vec, leaf = pdf["_id"].to_numpy(), pdf["_leaf"].to_numpy()
            score = q @ _stack(pdf["_vec"]).T
            for i in range(len(own)):
                s = np.where(vec == own[i], -np.inf, score[i])
                top = np.argpartition(-s, min(k, len(s)) - 1)[:k]
                top = top[np.isfinite(s[top])]
                yield pd.DataFrame({"q": [i], "score": [s[top].tolist()], "leaf": [leaf[top].tolist()]})

    true = leaves.mapInPandas(brute, "q int, score array<double>, leaf array<long>").withColumn("p", F.arrays_zip("score", "leaf"))
    true = true.groupBy("q").agg(F.slice(F.sort_array(F.flatten(F.collect_list("p")), asc=False), 1, k).alias("t")).collect()  # a row per sampled query
    place = []
    for r in true:
        rank = {leaf: j + 1 for j, leaf in enumerate(tree.visits(qs[r.q], tree.leaves))}
        place += [rank[t["leaf"]] for t in r.t]
    if not place:
        return 1
    return int(np.sort(place)[min(len(place) - 1, int(np.ceil(recall * len(place))) - 1)])
