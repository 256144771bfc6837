"""Embedding whitening from an exact covariance.

Vectors become integers, so the covariance is a matter of whole numbers.  The fitted vectors are
centred without rounding (``n * x - S``), cut into limbs of ``LIMB`` bits, and the limbs' products are
taken by float64 matrix products that stay exact, as every partial sum is below 2 ** 53.  Each task adds
its products as big integers; their digits are summed by Spark, so the merge is exact too, in any order.
The driver gets one matrix, whatever the number of rows, and its eigenvectors are refined until they are
right to double precision even where the eigenvalues span many orders of magnitude.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, release

SCALE = 256
COMPONENTS = 4
LIMB = 20  # balanced limbs are within 2 ** 19, so 2 ** 15 products of two sum to 2 ** 53 at most
BLOCK = 1 << 15
_DIGIT = 40  # the merge's digits
_BITS = 160  # fixed point of the refinement
_LONG = 2**63


def _limbs(a: np.ndarray) -> list[np.ndarray]:
    """``a`` (int64 within 2 ** 62, or Python integers) as float64 limbs, lowest first: sum of limb_k * 2 ** (LIMB * k)."""
    out, half = [], 1 << (LIMB - 1)
    while not out or a.any():
        low = ((a + half) & ((1 << LIMB) - 1)) - half
        out.append(low.astype(np.float64))
        a = (a - low) >> LIMB
    return out


def sliced_product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The exact matrix product of integer matrices as Python integers, by float64 products of their limbs."""
    total = np.zeros((a.shape[0], b.shape[1]), object)
    for at in range(0, a.shape[1], BLOCK):
        left, right = _limbs(a[:, at : at + BLOCK]), _limbs(b[at : at + BLOCK])
        by_shift: dict[int, np.ndarray] = {}
        for i, x in enumerate(left):
            for j, y in enumerate(right):
                part = (x @ y).astype(np.int64)
                # sums of up to 1,023 such products fit
                by_shift[i + j] = by_shift[i + j] + part if i + j in by_shift else part
        for shift, part in by_shift.items():
            total += part.astype(object) << (LIMB * shift)
    return total


def integer_vectors(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(vec_id, x): floor(scale * c) of each entry; rows whose vector is null or holds null or non-finite entries go.

    Entries beyond a long stay at its ends, as Spark's cast has it."""
    rows = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("c"))
    finite = F.forall("c", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return rows.where(F.col("c").isNotNull() & finite).select("vec_id", F.transform("c", lambda c: F.floor(c * F.lit(float(scale))).cast("long")).alias("x"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S without rounding: int64 where that is safe, else Python integers."""
    if x.size and n * (max(-int(x.min()), int(x.max()), 1)) + max(map(abs, sums)) < 2**62:
        return x * np.int64(n) - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def _sums(fit: DataFrame, width: int) -> tuple[int, list[int]]:
    """n and S.  Halves of 32 bits are summed apart, so that no sum overflows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros((2, width), np.int64)
        for batch in batches:
            x = _matrix(batch.column("x"), width)
            n += len(x)
            total += [(x >> 32).sum(0), (x & 0xFFFFFFFF).sum(0)]
        yield pa.record_batch([pa.array(range(width), pa.int32()), pa.array(total[0]), pa.array(total[1]), pa.array([n] * width, pa.int64())], names=["k", "high", "low", "n"])

    found = fit.select("x").mapInArrow(run, "k int, high long, low long, n long")
    whole = lambda c: F.sum(F.col(c).cast("decimal(28,0)")).alias(c)
    found = sorted(found.groupBy("k").agg(whole("high"), whole("low"), F.sum("n").alias("n")).collect())  # one row a dimension
    return (found[0].n if found else 0), [int(r.high) * 2**32 + int(r.low) for r in found]


def _gram(fit: DataFrame, width: int, n: int, sums: list[int]) -> np.ndarray:
    """The exact sum of y y' over the fitted vectors, y being centred."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width), object)
        for batch in batches:
            y = centred(_matrix(batch.column("x"), width), n, sums)
            total += sliced_product(y.T, y)
        rows, columns = np.triu_indices(width)
        left, digit = total[rows, columns], 0
        while digit == 0 or left.any():
            low = ((left + (1 << (_DIGIT - 1))) & ((1 << _DIGIT) - 1)) - (1 << (_DIGIT - 1))
            yield pa.record_batch([pa.array(rows, pa.int32()), pa.array(columns, pa.int32()), pa.array([digit] * len(rows), pa.int32()), pa.array(low.astype(np.int64))], names=["i", "j", "digit", "part"])
            left, digit = (left - low) >> _DIGIT, digit + 1

    parts = fit.select("x").mapInArrow(run, "i int, j int, digit int, part long").groupBy("i", "j", "digit").agg(F.sum("part").alias("part"))
    out = np.zeros((width, width), object)
    for r in parts.toLocalIterator():  # the digits of one matrix
        out[r.i, r.j] += r.part << (_DIGIT * r.digit)
    return out + np.triu(out, 1).T


def _jacobi(s: np.ndarray) -> np.ndarray:
    """Rotations that make the symmetric ``s`` diagonal, each pair to the measure of its own two entries."""
    s, turn, floor = s.copy(), np.eye(len(s)), 2.0**-100 * np.abs(s).max()
    for _ in range(40):
        size = np.sqrt(np.maximum(np.abs(np.diag(s)), floor))
        off = np.abs(s) / np.outer(size, size)
        np.fill_diagonal(off, 0)
        for p, q in np.argwhere(np.triu(off, 1) > 1e-18):
            if s[p, q] == 0:
                continue
            theta = (s[q, q] - s[p, p]) / (2 * s[p, q])
            t = math.copysign(1, theta) / (abs(theta) + math.hypot(theta, 1))
            c = 1 / math.hypot(t, 1)
            g = np.array([[c, t * c], [-t * c, c]])
            s[[p, q]] = g.T @ s[[p, q]]
            s[:, [p, q]] = s[:, [p, q]] @ g
            s[p, q] = s[q, p] = 0
            turn[:, [p, q]] = turn[:, [p, q]] @ g
        if off.max() < 1e-13:
            break
    return turn


def _three_minus(gram: np.ndarray) -> np.ndarray:
    out = -gram
    for k in range(len(gram)):
        out[k, k] += 3 << _BITS
    return out


def principal(m: np.ndarray, count: int) -> list[tuple[int, list[float]]]:
    """Up to ``count`` pairs (eigenvalue of ``m`` times 2 ** _BITS, unit eigenvector), falling; eigenvalues that are 0 beside the first are left out.

    ``m`` holds exact integers.  A double-precision decomposition is refined in fixed point: the basis is made orthonormal, ``m`` is
    taken into it exactly, and what is off the diagonal is rotated away, until nothing is left of it beside the diagonal's own entries.
    """
    bits = max((abs(v).bit_length() for v in m.flat), default=0)
    if not bits:
        return []
    ratio = lambda a, by: np.array([[v / by for v in row] for row in a])  # noqa: E731  (quotients of integers, rounded once)
    fixed = np.frompyfunc(lambda v: int(v * 2.0**1000) >> (1000 - _BITS) if abs(v) < 1e-30 else int(math.ldexp(v, _BITS)), 1, 1)
    basis = fixed(np.linalg.eigh(ratio(m, 1 << bits))[1][:, ::-1])
    for _ in range(12):
        for _ in range(3):  # Newton's iteration: errors of 1e-15, 1e-30, 1e-60
            gram = sliced_product(basis.T, basis) >> _BITS
            basis = sliced_product(basis, _three_minus(gram)) >> (_BITS + 1)
        turned = sliced_product(basis.T, sliced_product(m, basis)) >> _BITS
        s = ratio(turned, 1 << (bits + _BITS))
        order = np.argsort(-np.diag(s), kind="stable")
        basis, turned, s = basis[:, order], turned[np.ix_(order, order)], s[np.ix_(order, order)]
        values = np.diag(s)
        kept = int((values[:count] > 2.0**-90 * values[0]).sum())
        size = np.sqrt(np.maximum(values, 2.0**-100 * values[0]))
        off = np.abs(s) / np.outer(size, size)
        np.fill_diagonal(off, 0)
        if off[:kept].max(initial=0) < 1e-17:
            break
        basis = sliced_product(basis, fixed(_jacobi((s + s.T) / 2))) >> _BITS
    return [(turned[k, k], [v / (1 << _BITS) for v in basis[:, k]]) for k in range(kept)]


@dataclass
class Whitening:
    """The fitted model: of a size set by the vectors' width alone."""

    width: int
    n: int
    sums: list[int]
    vectors: np.ndarray  # width x components, unit columns
    scales: list[float]  # of a component's projection of n * x - S: 1 / (n * sqrt(e))
    eigenvalues: list[float]
    explained: list[float]

    def project(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        y = centred(x, self.n, self.sums)
        return y, (y.astype(np.float64) @ self.vectors) * np.array(self.scales)


def fit_list(vectors: DataFrame) -> tuple[DataFrame, int]:
    """Each distinct x once, as a written table, and the width: that of most distinct vectors, of equals the widest."""
    fit = materialize(vectors.select("x").distinct(), "fit-list")
    widths = fit.groupBy(F.size("x").alias("width")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("width")).first()
    return fit, (widths.width if widths else 0)


def fit_whitening(fit: DataFrame, width: int, components: int = COMPONENTS) -> Whitening:
    """The covariance over ``fit`` (divisor n) and its leading components."""
    fit = fit.where(F.size("x") == width)
    n, sums = _sums(fit, width) if width else (0, [])
    m = _gram(fit, width, n, sums) if n else np.zeros((0, 0), object)
    found = principal(m, components)  # m is n ** 3 times the covariance
    trace = sum(m[k, k] for k in range(len(m)))
    one = 1 << _BITS
    return Whitening(
        width, n, sums, np.array([v for _, v in found]).reshape(len(found), width).T, [math.sqrt((n * one) / e) for e, _ in found],
        [e / (one * n**3) for e, _ in found], [e / (one * trace) for e, _ in found],
    )


def identity_error(fit: DataFrame, model: Whitening) -> float:
    """The largest absolute entry of the whitened fit list's covariance minus the identity, measured by a pass over it."""
    k = len(model.scales)
    if not k:
        return 0.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k))
        for batch in batches:
            z = model.project(_matrix(batch.column("x"), model.width))[1]
            total += np.vstack([z.T @ z, z.sum(0)])
        yield pa.record_batch([pa.array(np.arange(k * (k + 1)), pa.int64()), pa.array(total.ravel())], names=["at", "part"])

    found = fit.where(F.size("x") == model.width).select("x").mapInArrow(run, "at long, part double").groupBy("at").agg(F.sum("part").alias("part")).collect()
    total = np.zeros(k * (k + 1))
    for r in found:
        total[r["at"]] = r.part
    products, mean = total[: k * k].reshape(k, k) / model.n, total[k * k :] / model.n
    return float(np.abs(products - np.outer(mean, mean) - np.eye(k)).max())


def whiten(vectors: DataFrame, model: Whitening) -> DataFrame:
    """Per row and component: vec_id, component (from 1), n, deviation, whitened, explained.  Narrow: no shuffle.

    ``deviation`` is the exact sum of (n * x - S) ** 2 over the dimensions, null where that is beyond a long.
    """
    k = len(model.scales)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows or not k:
                continue
            y, z = model.project(_matrix(batch.column("x"), model.width))
            if y.dtype == object or model.width * max(-int(y.min()), int(y.max())) ** 2 >= _LONG:
                exact = [v if v < _LONG else None for v in (y.astype(object) ** 2).sum(1)]
            else:
                exact = (y * y).sum(1)
            each = pa.array(np.repeat(np.arange(len(z)), k))
            columns = [batch.column("vec_id").take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(z))), pa.array(np.full(len(z) * k, model.n)), pa.array(exact, pa.int64()).take(each), pa.array(z.ravel()), pa.array(np.tile(model.explained, len(z)))]
            yield pa.record_batch(columns, names=["vec_id", "component", "n", "deviation", "whitened", "explained"])

    return vectors.where(F.size("x") == model.width).mapInArrow(run, "vec_id long, component int, n long, deviation long, whitened double, explained double")


def whitened_embeddings(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """Per row and component up to ``components``: vec_id, component, n, deviation, whitened, explained, identity_error.

    Rows without a finite vector go.  Components of variance 0 are none, so fewer than ``components`` come out where the distinct
    vectors span less, and no row where there are under two distinct vectors, or none.  Vectors of another width than most have no
    place in the covariance: these rows go too.  Repeated rows are whitened each and fitted once, null ids stay, and columns of
    other names have no part in it.
    """
    vectors = integer_vectors(rows, id_col, vec_col)
    fit, width = fit_list(vectors)
    model = fit_whitening(fit, width, components)
    error = identity_error(fit, model)
    release(fit)
    return whiten(vectors, model).withColumn("identity_error", F.lit(error))
