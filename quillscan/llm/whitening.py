"""Embedding whitening with exact integer covariances (digit-slice GEMM).

A vector entry ``c`` becomes the integer ``x = floor(1024 * c) + 100000``.  Three passes over
the table give, per vector length, the exact sums of ``x``, the exact products of the
centred integers, and the covariance of what comes out.  For the products each task
splits centred integers into signed limbs of 20 bits: a float64 BLAS product of limbs
over 4,096 rows stays below 2^53, so it is exact.  The limbs' products are put together
as Python's big integers, travel as base-2^36 digits in long columns, and are added
by Spark.  Only the d x d sums reach the driver, which makes big integers of them, divides
once and decomposes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DecimalType, DoubleType, LongType, StructField, StructType

from .common import claim, column

SCALE, SHIFT = 1024, 100_000
#: Larger entries count as this much; floats beyond it are far outside any embedding.
LARGEST = 2**61
#: Rows and bits of one exact product: ROWS * 2^(2 * BITS - 2) is below 2^53.
ROWS, BITS = 4096, 20
#: Digits that sums travel in; a long holds the sum of 2^26 tasks' digits.
DIGIT_BITS, DIGITS = 36, 6
_SUMS = "size int, i int, j int, " + ", ".join(f"d{k} long" for k in range(DIGITS))


# ---------------------------------------------------------------- exact products


def limbs(y: np.ndarray) -> list[np.ndarray]:
    """Signed limbs of ``BITS`` bits, lowest first, as float64; as many as the largest entry needs."""
    out, half = [], 1 << (BITS - 1)
    while y.any():
        low = ((y + half) & ((1 << BITS) - 1)) - half
        out.append(low.astype(np.float64))
        y = (y - low) >> BITS
    return out


class Gram:
    """Exact ``Y'Y`` of all integer rows added."""

    def __init__(self, d: int):
        self.whole = np.zeros((d, d), dtype=object)
        self._open: dict[int, np.ndarray] = {}
        self._steps = 0

    def add(self, y: np.ndarray) -> None:
        for lo in range(0, len(y), ROWS):
            part = limbs(y[lo : lo + ROWS])
            for p, a in enumerate(part):
                for q in range(p, len(part)):
                    prod = a.T @ part[q]
                    prod = prod if p == q else prod + prod.T
                    at = self._open.setdefault(p + q, np.zeros(prod.shape, np.int64))
                    at += prod.astype(np.int64)
            self._steps += 1
            if self._steps == 128:  # below 2^63: 128 products of less than 2^51, four or fewer a step
                self._fold()

    def _fold(self) -> None:
        for s, m in self._open.items():
            self.whole += m.astype(object) << (BITS * s)
        self._open, self._steps = {}, 0

    def result(self) -> np.ndarray:
        self._fold()
        return self.whole


def digits(values: np.ndarray) -> list[np.ndarray]:
    """Big integers as ``DIGITS`` columns of base 2^``DIGIT_BITS``; the last one carries the sign."""
    out = []
    for _ in range(DIGITS - 1):
        out.append((values & ((1 << DIGIT_BITS) - 1)).astype(np.int64))
        values = values >> DIGIT_BITS
    return [*out, values.astype(np.int64)]


def undigits(row) -> int:
    return sum(int(row[f"d{k}"]) << (DIGIT_BITS * k) for k in range(DIGITS))


# ---------------------------------------------------------------- vectors in workers


def integers(values: np.ndarray) -> np.ndarray:
    """``floor(1024 * c)`` as int64, without the constant shift."""
    with np.errstate(over="ignore"):
        return np.clip(np.floor(values.astype(np.float64) * SCALE), -LARGEST, LARGEST - SHIFT).astype(np.int64)


def usable(vectors: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All entries in a row, the n+1 offsets, and which vectors are not null, not empty and finite throughout."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    valid = np.asarray(vectors.is_valid())
    offs = np.concatenate(([0], np.cumsum(np.where(valid, np.asarray(vectors.value_lengths().fill_null(0), np.int64), 0))))
    flat = vectors.flatten()
    good = np.asarray(flat.is_valid())
    values = np.asarray(flat.cast(pa.float64()).fill_null(0.0))
    bad = np.concatenate(([0], np.cumsum(~(good & np.isfinite(values)))))
    return values, offs, valid & (np.diff(offs) > 0) & (np.diff(bad[offs]) == 0)


def matrices(part: pa.RecordBatch, vec_col: str, most: int = 1 << 20) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Per vector length: which rows have it and their integers, at most about ``most`` entries at once."""
    values, offs, ok = usable(column(part, vec_col))
    length = np.diff(offs)
    for d in np.unique(length[ok]).tolist():
        rows = np.flatnonzero(ok & (length == d))
        step = max(1, most // d)
        for lo in range(0, len(rows), step):
            at = rows[lo : lo + step]
            yield d, at, integers(values[offs[:-1][at][:, None] + np.arange(d)])


def _emit(size: int, i: np.ndarray, j: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
    n = len(values)
    cols = [np.full(n, size, np.int32), i.astype(np.int32), j.astype(np.int32), *digits(values)]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["size", "i", "j", *(f"d{k}" for k in range(DIGITS))])


def _summed(rows: DataFrame) -> dict[int, dict[tuple[int, int], int]]:
    """Spark adds the digits; big integers per vector length and place."""
    total = rows.groupBy("size", "i", "j").agg(*(F.sum(f"d{k}").alias(f"d{k}") for k in range(DIGITS)))
    out: dict[int, dict[tuple[int, int], int]] = {}
    for r in total.collect():  # d^2 / 2 rows a length
        out.setdefault(r["size"], {})[r["i"], r["j"]] = undigits(r)
    return out


# ---------------------------------------------------------------- the model


@dataclass
class Whitening:
    """What one vector length is whitened by: exact ``n``, sums ``S`` of ``x``, components and their eigenvalues."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float = 0.0

    @property
    def centre(self) -> np.ndarray:
        """The integers nearest the means of ``x - 100000``."""
        return np.asarray([(2 * (s - self.n * SHIFT) + self.n) // (2 * self.n) for s in self.sums], dtype=np.int64)

    @property
    def rest(self) -> list[int]:
        """``n`` times what the centre lacks to the mean."""
        return [s - self.n * SHIFT - self.n * int(m) for s, m in zip(self.sums, self.centre, strict=True)]

    def whiten(self, y: np.ndarray) -> np.ndarray:
        """Rows of centred integers (``x - 100000 - centre``) on the components, divided by the deviations."""
        shift = np.asarray([float(Fraction(r, self.n)) for r in self.rest])
        return (y - shift) @ self.vectors / np.sqrt(self.values)

    def deviations(self, y: np.ndarray) -> list[int]:
        """The exact sum over dimensions of ``(n * x - S)^2`` of each row."""
        most, rest, d = int(np.abs(y).max(initial=0)), self.rest, y.shape[1]
        wide = max(most, 1) * max(most, max(map(abs, rest)), 1) * d >= 2**62
        z, r = (y.astype(object), np.asarray(rest, dtype=object)) if wide else (y, np.asarray(rest, dtype=np.int64))
        own, cross, fixed = (z * z).sum(axis=1), (z * r).sum(axis=1), sum(v * v for v in rest)
        return [self.n * self.n * int(a) - 2 * self.n * int(b) + fixed for a, b in zip(own.tolist(), cross.tolist(), strict=True)]


def decompose(n: int, sums: list[int], products: np.ndarray, components: int) -> Whitening:
    """Eigenvectors of the covariance ``products / n^3``, where ``products`` is the exact Gram of ``n * x - S``.

    Eigenvalues that double precision cannot tell from 0 have no component.  The entry of a
    vector that is largest in absolute value is positive.
    """
    d = len(sums)
    scale = max(max(abs(v) for v in products.ravel().tolist()), 1)
    v = np.asarray([[float(Fraction(e, scale)) for e in row] for row in products.tolist()])
    unit = float(Fraction(scale, n**3))
    e, u = np.linalg.eigh(v)
    e, u = e[::-1] * unit, u[:, ::-1]
    real = e > max(e[0], 0) * d * 2.0**-50
    e, u = e[real][:components], u[:, real][:, :components]
    if u.size:
        u = u * np.sign(u[np.abs(u).argmax(axis=0), np.arange(u.shape[1])])
    trace = float(Fraction(sum(products[k, k] for k in range(d)), n**3))
    return Whitening(n, sums, e, u, trace)


def fit(df: DataFrame, vec_col: str = "embedding", components: int = 8) -> dict[int, Whitening]:
    """The whitening of each vector length, fitted on all usable rows of ``df``.

    Rows whose vector is null, empty or holds null or non-finite entries take no part.
    Vectors of another length are whitened by themselves.  What passes through the driver
    is d^2 / 2 sums per length, whatever the number of rows.  An empty table gives ``{}``.
    """
    only = df.select(df[vec_col].alias("v"))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("whitening")
        total: dict[int, list] = {}
        for part in batches:
            for d, _, y in matrices(part, "v"):
                at = total.setdefault(d, [0, np.zeros(d, dtype=object)])
                at[0] += len(y)
                at[1] += sum(  # sums of limbs stay below 2^53
                    (l.sum(axis=0).astype(np.int64).astype(object) << (BITS * k) for k, l in enumerate(limbs(y))),
                    np.zeros(d, dtype=object),
                )
        for d, (n, s) in total.items():
            yield _emit(d, np.arange(-1, d), np.full(d + 1, -1), np.concatenate((np.asarray([n], dtype=object), s)))

    found = {}
    for d, at in _summed(only.mapInArrow(sums, _SUMS)).items():
        n = at[-1, -1]
        found[d] = Whitening(n, [at[i, -1] + n * SHIFT for i in range(d)], np.zeros(0), np.zeros((d, 0)), 0.0)
    if not found:
        return {}
    held = df.sparkSession.sparkContext.broadcast(found)  # d sums per length

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("whitening")
        total: dict[int, Gram] = {}
        centre = {d: w.centre for d, w in held.value.items()}
        for part in batches:
            for d, _, y in matrices(part, "v"):
                total.setdefault(d, Gram(d)).add(y - centre[d])
        for d, g in total.items():
            i, j = np.triu_indices(d)
            yield _emit(d, i, j, g.result()[i, j])

    out = {}
    for d, at in _summed(only.mapInArrow(products, _SUMS)).items():
        n, sums_, rest = found[d].n, found[d].sums, found[d].rest
        gram = np.empty((d, d), dtype=object)
        for (i, j), v in at.items():  # the Gram of n * x - S from that of the centred integers
            gram[i, j] = gram[j, i] = n * (n * v - rest[i] * rest[j])
        out[d] = decompose(n, sums_, gram, components)
    return _with_error(only, out)


def _with_error(vectors: DataFrame, models: dict[int, Whitening]) -> dict[int, Whitening]:
    """``identity_error``: the largest absolute entry of the whitened rows' covariance minus the identity."""
    held = vectors.sparkSession.sparkContext.broadcast(models)

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("whitening")
        total: dict[int, np.ndarray] = {}
        for part in batches:
            for d, _, y in matrices(part, "v"):
                w = held.value[d].whiten(y - held.value[d].centre)
                w = np.column_stack((np.ones(len(w)), w))
                total[d] = total.get(d, 0.0) + w.T @ w  # of centred values
        for d, m in total.items():
            i, j = np.triu_indices(len(m))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), d, np.int32)), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(m[i, j])], names=["size", "i", "j", "v"])

    rows = vectors.mapInArrow(moments, "size int, i int, j int, v double").groupBy("size", "i", "j").agg(F.sum("v").alias("v")).collect()
    for d, model in models.items():
        k = len(model.values)
        m = np.zeros((k + 1, k + 1))
        for r in rows:
            if r["size"] == d:
                m[r["i"], r["j"]] = m[r["j"], r["i"]] = r["v"]
        mean = m[0, 1:] / model.n
        cov = m[1:, 1:] / model.n - np.outer(mean, mean)
        model.identity_error = float(np.abs(cov - np.eye(k)).max(initial=0.0))
    return models


def whiten(df: DataFrame, models: dict[int, Whitening], vec_col: str = "embedding", out: str = "whitened") -> DataFrame:
    """Usable rows of ``df``, with all their columns and a struct ``out``: components, explained shares, n, deviation, identity_error.

    ``deviation`` is null where it does not fit into a long; ``deviation_exact``, a
    decimal of 38 digits, holds it further.  A vector without any variance (all rows alike)
    has no components: empty arrays.  Repeated rows and null ids stay.  A column called
    ``out`` already is an error; other names are free.
    """
    if out in df.columns:
        raise ValueError(f"column exists already: {out}")
    held = df.sparkSession.sparkContext.broadcast(models)
    kind = StructType(
        [
            StructField("values", ArrayType(DoubleType())),
            StructField("explained", ArrayType(DoubleType())),
            StructField("n", LongType()),
            StructField("deviation", LongType()),
            StructField("deviation_exact", DecimalType(38, 0)),
            StructField("identity_error", DoubleType()),
        ]
    )
    digits38 = 10**38
    arrow = pa.struct([("values", pa.list_(pa.float64())), ("explained", pa.list_(pa.float64())), ("n", pa.int64()), ("deviation", pa.int64()), ("deviation_exact", pa.decimal128(38, 0)), ("identity_error", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from decimal import Context, Decimal

        claim("whitening")
        for part in batches:
            for d, at, y in matrices(part, vec_col):
                model = held.value[d]
                y = y - model.centre
                w = model.whiten(y)
                dev = model.deviations(y)
                k, n = len(model.values), len(w)
                offs = pa.array(np.arange(n + 1, dtype=np.int32) * k)
                shares = np.tile(model.values / model.trace if k else model.values, n)
                wide = Context(prec=50)
                cols = [
                    pa.ListArray.from_arrays(offs, pa.array(w.ravel())),
                    pa.ListArray.from_arrays(offs, pa.array(shares)),
                    pa.array(np.full(n, model.n)),
                    pa.array([v if v < 2**63 else None for v in dev], pa.int64()),
                    pa.array([wide.create_decimal(Decimal(v)) if v < digits38 else None for v in dev], pa.decimal128(38, 0)),
                    pa.array(np.full(n, model.identity_error)),
                ]
                kept = part.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([*kept.columns, pa.StructArray.from_arrays(cols, fields=list(arrow))], names=[*kept.schema.names, out])

    return df.mapInArrow(run, StructType([*df.schema.fields, StructField(out, kind)]))
