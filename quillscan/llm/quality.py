"""Document quality from a linear-chain conditional random field over lines.

Each non-blank line of a text is a node with the labels bad and good.  A node's potentials
come from features of its own line and of the lines before and behind it, cut into bins;
edges tie the labels of neighbouring lines.  Lines learn from the labels of their
documents.  Forward-backward gives each line's probability of being good; the mean over
lines, weighted by length and calibrated on the training documents, is the document's
score.

Forward and backward messages of all lines of a slice are prefix products of 2 x 2
matrices (a scan by doubling), so a text of a million lines takes twenty steps and needs
no loop over its lines.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import column, raw, slices, window_hashes, word_hashes, words

#: The bounded training sample: documents per label, each of at most so many bytes; a document is used whole.
TRAIN_DOCS, TRAIN_DOC_BYTES = 500, 20_000
BINS = 8
STEPS, RATE, PENALTY = 150, 0.1, 1e-3
THRESHOLD = 0.3
U64 = np.uint64

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[b for b in range(33, 127) if not chr(b).isalnum()]] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[0x30:0x3A] = True
_UPPER = np.zeros(256, bool)
_UPPER[0x41:0x5B] = True
_ALPHA = np.zeros(256, bool)
_ALPHA[0x61:0x7B] = _ALPHA[0x41:0x5B] = _ALPHA[0x80:] = True
_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True

FEATURES = ("length", "symbols", "digits", "capitals", "wide", "symbol pairs", "bare words", "word length", "same as before", "distinct", "seen in text", "seen pairs", "word ends", "ends")


# ---------------------------------------------------------------- lines and their features


def lines(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text of every line that is not blank."""
    cut = np.unique(np.concatenate((offs[:-1], np.flatnonzero(buf == 10) + 1)))
    cut = cut[cut < len(buf)]
    ends = np.append(cut[1:], len(buf))
    solid = np.concatenate(([0], np.cumsum(~_BLANK[buf])))
    keep = solid[ends] > solid[cut]
    cut, ends = cut[keep], ends[keep]
    return cut, ends, np.searchsorted(offs, cut, "right") - 1


def _seen(text: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which hashes stand earlier in the same text."""
    key = h ^ (text.astype(U64) + U64(1)) * U64(0x9E3779B97F4A7C15)
    order = np.argsort(key, kind="stable")
    out = np.zeros(len(h), bool)
    out[order[1:]] = key[order[1:]] == key[order[:-1]]
    return out


def line_features(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of every non-blank line (a row each), the line's length in bytes and its text."""
    at, end, doc = lines(buf, offs)
    n = len(at)
    if not n:
        return np.zeros((0, len(FEATURES))), np.zeros(0, np.int64), doc
    size = (end - at).astype(np.float64)

    def share(mask: np.ndarray) -> np.ndarray:
        c = np.concatenate(([0], np.cumsum(mask)))
        return c[end] - c[at]

    symbol = _SYMBOL[buf]
    double = symbol.copy()
    double[1:] &= symbol[:-1]
    double[0] = False
    letters = share(_ALPHA[buf])
    starts, ends, _ = words(buf, offs)
    h = word_hashes(buf, starts, ends)
    line = np.searchsorted(at, starts, "right") - 1
    text = doc[line]
    count = np.bincount(line, minlength=n).astype(np.float64)

    def mean(mask: np.ndarray) -> np.ndarray:
        return np.bincount(line[: len(mask)], mask, n) / np.maximum(count, 1)

    alpha = np.concatenate(([0], np.cumsum(_ALPHA[buf] | _DIGIT[buf])))
    bare = alpha[ends] == alpha[starts]
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (text[1:] == text[:-1])
    inside = line.astype(np.int64)
    pair = window_hashes(h, 2)
    pair_same_text = text[: len(pair)] == text[1:]
    columns = [
        np.log2(size),
        share(symbol) / size,
        share(_DIGIT[buf]) / size,
        share(_UPPER[buf]) / np.maximum(letters, 1),
        share(buf >= 0x80) / size,
        share(double) / np.maximum(count, 1),
        mean(bare),
        np.bincount(line, ends - starts, n) / np.maximum(count, 1),
        mean(same),
        1 - mean(_seen(inside, h)),
        mean(_seen(text, h)),
        mean(_seen(text[: len(pair)], pair) & pair_same_text),
        mean(symbol[np.maximum(ends - 1, 0)]),
        symbol[np.maximum(ends[np.minimum(np.searchsorted(line, np.arange(n), "right") - 1, len(ends) - 1)] - 1, 0)].astype(np.float64),
    ]
    return np.column_stack(columns), size.astype(np.int64), doc


# ---------------------------------------------------------------- the chain


def _scan(m: np.ndarray, longest: int) -> np.ndarray:
    """Prefix products of n 2 x 2 matrices (n, 2, 2), scaled; matrices of rank one begin new chains."""
    step = 1
    while step < longest:
        left, right = m[:-step], m[step:]
        nxt = np.einsum("nij,njk->nik", left, right)
        nxt /= nxt.max(axis=(1, 2), keepdims=True)
        m = np.concatenate((m[:step], nxt))
        step *= 2
    return m


def marginals(unary: np.ndarray, edge: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probability of good for each line, and of both labels for each pair of neighbours in a text (n-1 rows, 0 between texts).

    ``unary`` holds each line's score for good over bad, ``edge`` the 2 x 2 scores of neighbours.
    """
    n = len(unary)
    if not n:
        return np.zeros(0), np.zeros((0, 2, 2))
    u = np.exp(np.column_stack((np.minimum(0, -unary), np.minimum(0, unary))))
    t = np.exp(edge - edge.max())
    new = np.concatenate(([True], doc[1:] != doc[:-1]))
    run = np.flatnonzero(new)
    longest = int(np.diff(np.append(run, n)).max())
    m = t[None] * u[:, None, :]
    m[new] = u[new][:, None, :]
    alpha = _scan(m, longest)[:, 0]
    alpha /= alpha.sum(axis=1, keepdims=True)
    back = np.ones((n, 2, 2))
    back[:-1] = t[None] * u[1:, None, :]
    back[np.append(run[1:] - 1, n - 1)] = 1.0
    beta = _scan(back[::-1].transpose(0, 2, 1), longest)[::-1].transpose(0, 2, 1)[:, :, 0]
    beta /= beta.sum(axis=1, keepdims=True)
    p = alpha * beta
    pair = alpha[:-1, :, None] * t[None] * (u[1:] * beta[1:])[:, None, :]
    pair /= pair.sum(axis=(1, 2), keepdims=True)
    pair[new[1:]] = 0
    return p[:, 1] / p.sum(axis=1), pair


@dataclass
class Model:
    """Bin edges, potentials by role (own, line before, line behind), feature and bin, edge scores, calibration."""

    cuts: list[np.ndarray]
    table: np.ndarray
    bias: float
    edge: np.ndarray
    slope: np.ndarray
    base: float

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(c, x[:, k], "right") for k, c in enumerate(self.cuts)]) if len(x) else np.zeros((0, len(self.cuts)), np.int64)

    def unary(self, bins: np.ndarray, doc: np.ndarray) -> np.ndarray:
        by_role = self.table[:, np.arange(bins.shape[1]), bins].sum(axis=2)
        out = by_role[0] + self.bias
        same = doc[1:] == doc[:-1]
        out[1:] += np.where(same, by_role[1][:-1], 0)
        out[:-1] += np.where(same, by_role[2][1:], 0)
        return out

    def summary(self, p: np.ndarray, size: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
        """Per text: 1 and the logit of the length-weighted mean of p."""
        total = np.maximum(np.bincount(doc, size, n), 1)
        mean = np.clip(np.bincount(doc, size * p, n) / total, 1e-4, 1 - 1e-4)
        return np.column_stack((np.ones(n), np.log(mean / (1 - mean))))

    def scores(self, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
        n = len(offs) - 1
        x, size, doc = line_features(buf, offs)
        out = np.full(n, self.base)
        if len(x) and self.slope[1]:  # trained
            p, _ = marginals(self.unary(self.bins(x), doc), self.edge, doc)
            z = self.summary(p, size, doc, n) @ self.slope
            has = np.bincount(doc, minlength=n) > 0
            out[has] = (1 / (1 + np.exp(-z)))[has]
        return out


def learn(texts: list[str], labels: list[int], weight: dict[int, float]) -> Model:
    """Fit by gradient steps (Adam) on the chain's weighted log-likelihood, then calibrate on the document scores.

    ``weight`` makes up for how much of each label the sample holds.  Without both
    labels every text scores the share of good ones (1 without labels).
    """
    cuts = [np.zeros(0)] * len(FEATURES)
    total = sum(weight[y] for y in labels)
    base = sum(weight[y] for y in labels if y) / total if total else 1.0
    model = Model(cuts, np.zeros((3, len(FEATURES), BINS)), 0.0, np.zeros((2, 2)), np.asarray([np.log(max(base, 1e-6) / max(1 - base, 1e-6)), 0.0]), base)
    data = [t.encode() for t in texts]
    x, size, doc = line_features(np.frombuffer(b"".join(data), np.uint8), np.concatenate(([0], np.cumsum([len(d) for d in data]))).astype(np.int64))
    if len(set(labels)) < 2 or not len(x):
        return model
    model.cuts = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1])) for k in range(x.shape[1])]
    bins = model.bins(x)
    y = np.asarray(labels)[doc]
    per_doc = np.asarray([weight[v] for v in labels])
    per_doc = per_doc / per_doc.sum()
    w = (per_doc / np.maximum(np.bincount(doc, size, len(labels)), 1))[doc] * size  # lines by length
    same = (doc[1:] == doc[:-1]).astype(np.float64)
    we = np.minimum(w[1:], w[:-1]) * same
    seen_pair = np.zeros((2, 2))
    np.add.at(seen_pair, (y[:-1], y[1:]), we)
    theta = [model.table, np.zeros(1), model.edge]
    m1, m2 = [np.zeros_like(v) for v in theta], [np.zeros_like(v) for v in theta]
    feature = np.arange(x.shape[1])
    for step in range(1, STEPS + 1):
        model.table, model.bias, model.edge = theta[0], float(theta[1][0]), theta[2]
        p, pair = marginals(model.unary(bins, doc), model.edge, doc)
        g = w * (y - p)
        grad = np.zeros_like(model.table)
        before, behind = np.append(g[1:] * same, 0), np.concatenate(([0], g[:-1] * same))
        for role, of in enumerate((g, before, behind)):
            for k in feature:
                grad[role, k] = np.bincount(bins[:, k], of, BINS)
        for k, (v, d) in enumerate(zip(theta, (grad - PENALTY * theta[0], np.asarray([g.sum()]), seen_pair - np.einsum("n,nij->ij", we, pair) - PENALTY * theta[2]), strict=True)):
            m1[k] = 0.9 * m1[k] + 0.1 * d
            m2[k] = 0.99 * m2[k] + 0.01 * d * d
            theta[k] = v + RATE * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.99**step)) + 1e-6)
    model.table, model.bias, model.edge = theta[0], float(theta[1][0]), theta[2]
    p, _ = marginals(model.unary(bins, doc), model.edge, doc)
    z = model.summary(p, size, doc, len(labels))
    labels_ = np.asarray(labels, dtype=np.float64)
    slope = np.asarray([0.0, 1.0])
    for _ in range(50):  # Newton's steps of a logistic regression with a small penalty
        q = 1 / (1 + np.exp(-z @ slope))
        grad = z.T @ (per_doc * (labels_ - q)) - 1e-3 * (slope - [0.0, 1.0])
        hess = (z * (per_doc * q * (1 - q))[:, None]).T @ z + 1e-3 * np.eye(2)
        slope = slope + np.linalg.solve(hess, grad)
    model.slope = slope
    return model


# ---------------------------------------------------------------- Spark


def held_out(id_: Column) -> Column:
    return F.coalesce(F.crc32(id_.cast("string")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """Fit on a bounded hash sample of the labelled documents that are not held out.

    Per label (0 and 1; others do not count) at most ``TRAIN_DOCS`` documents of at most
    ``TRAIN_DOC_BYTES`` bytes are used, whole.  Rows with a null id or text do not train.
    Ids that repeat, in either table, pair as a join does and are cut by the same bound.
    """
    marks = labels.select(labels[id_col].cast("long").alias("id"), labels[label_col].cast("long").alias("y")).filter("y IN (0, 1) AND id IS NOT NULL").distinct()
    marks = marks.filter(~held_out(F.col("id")))
    rows = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text")).filter("id IS NOT NULL AND text IS NOT NULL").filter(F.octet_length("text") <= TRAIN_DOC_BYTES)
    ids = rows.select("id").distinct()
    share = marks.join(ids, "id").withColumn("h", F.xxhash64(F.lit("quality"), "id"))
    texts, known, weight = [], [], {}
    counted = {r.y: r.n for r in share.groupBy("y").agg(F.count("*").alias("n")).collect()}
    for y in (0, 1):
        if y not in counted:
            continue
        some = share.filter(F.col("y") == y).orderBy("h", "id").limit(TRAIN_DOCS).select("id")
        picked = rows.join(F.broadcast(some), "id").orderBy(F.xxhash64(F.lit("quality"), "id"), "id", "text").limit(TRAIN_DOCS).collect()
        texts += [r.text for r in picked]
        known += [y] * len(picked)
        weight[y] = counted[y] / max(1, len(picked))
    return learn(texts, known, weight)


def score(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with the quality of every whole text, from 0 to 1.

    Texts without a visible character, nulls too, score the share of good documents in training.  Rows, ties and
    all other columns pass through; a name in ``score_col`` that ``docs`` has already is an error.
    """
    if score_col in docs.columns:
        raise ValueError(f"column exists already: {score_col}")
    held = docs.sparkSession.sparkContext.broadcast(model)  # a few hundred numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text_col, owner="quality"):
            out = held.value.scores(*raw(column(part, text_col)))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out)], names=[*part.schema.names, score_col])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(score_col, DoubleType())]))
