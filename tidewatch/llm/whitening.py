"""Whitening of embeddings on the leading eigenvectors of their covariance, found by spectrum slicing.

Spark computes what grows with the rows, in five passes over the vectors and without moving any of them: the length, the sums by
dimension, the products of the centred entries, the covariance of the whitened values, and the result. Entries are
integers and are centred on an integer before they are multiplied, so sums are exact: their order, the number of
partitions and repeated tasks change nothing. A task hands over one row for each pair of dimensions (its own sums, in
limbs of 42 bits), whatever it read; d (d + 1) / 2 sums reach the driver.

There the LDL^T factorisation of the covariance minus a shift tells how many eigenvalues lie above the shift (Sylvester's
law of inertia). Bisection on these counts isolates each leading eigenvalue, inverse and then Rayleigh quotient iteration
converges in the isolated interval, and two more counts, just above and just below what was found, certify its number.
Eigenvalues closer than rounding can tell apart share an interval; their vectors are kept orthogonal.

Defined results: rows whose vector is null, or holds a null or non-finite entry, have no result; nor have those with an
entry for which floor(1024 c) + 100000 is over 2^61 in magnitude and so is no exact long, and vectors shorter than the
longest ones, which lack entries. Repeated rows and ids count each for themselves, null ids stay. Components without
variance (eigenvalue at most d 2^-50 of the trace: equal vectors, fewer rows than dimensions) are not given, so a table of
equal vectors gives no rows. ``deviation`` is null where the exact value is beyond a long; ``deviation_digits`` always
has it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import map_batches

COMPONENTS = 8
SCALE, OFFSET = 1024.0, 100_000
#: Bits of a limb of an exact sum; magnitude up to which scaled entries are taken.
LIMB, LARGEST = 42, 2.0**61
EPS = 2.0**-52


# --- eigenvalues by counts


def eigenvalues_above(matrix: np.ndarray, shift: float) -> int:
    """How many eigenvalues of a symmetric matrix are above the shift: positive pivots of its LDL^T, by Bunch and Kaufman."""
    a = matrix - shift * np.eye(len(matrix))
    n, k, above, alpha = len(a), 0, 0, (1 + 17**0.5) / 8
    while k < n:
        own, step, swap = abs(a[k, k]), 1, k
        below = np.abs(a[k + 1 :, k])
        most = below.max(initial=0.0)
        if most == 0:
            above += a[k, k] > 0
            k += 1
            continue
        if own < alpha * most:
            r = k + 1 + int(below.argmax())
            row = np.abs(a[r, k:])
            row[r - k] = 0
            rowmost = row.max()
            if own * rowmost < alpha * most * most:
                swap, step = r, 1 if abs(a[r, r]) >= alpha * rowmost else 2
        at = k + step - 1
        if swap != at:
            a[[at, swap], k:] = a[[swap, at], k:]
            a[k:, [at, swap]] = a[k:, [swap, at]]
        left = a[k + step :, k : k + step]
        if step == 1:
            above += a[k, k] > 0
            a[k + 1 :, k + 1 :] -= np.outer(left[:, 0], left[:, 0] / a[k, k])
        else:  # one eigenvalue of such a block is positive, one negative
            above += 1
            a[k + 2 :, k + 2 :] -= left @ np.linalg.solve(a[k : k + 2, k : k + 2], left.T)
        k += step
    return int(above)


def _solve(matrix: np.ndarray, shift: float, right: np.ndarray, nudge: float) -> np.ndarray:
    while True:
        try:
            found = np.linalg.solve(matrix - shift * np.eye(len(matrix)), right)
            if np.isfinite(found).all() and found.any():
                return found
        except np.linalg.LinAlgError:
            pass
        shift, nudge = shift + nudge, 2 * nudge


def leading_eigenpairs(matrix: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``most`` largest eigenvalues of a covariance that are not zero, falling, and their unit vectors as rows."""
    d, trace = len(matrix), float(np.trace(matrix))
    if not d or trace <= 0:
        return np.zeros(0), np.zeros((0, d))
    close = 4 * d * EPS * trace  # nearer than this, counts cannot tell eigenvalues apart
    known = {-close: d, trace + close: 0}  # shift to the number of eigenvalues above it

    def count(shift: float) -> int:
        if shift not in known:
            known[shift] = eigenvalues_above(matrix, shift)
        return known[shift]

    values: list[float] = []
    vectors = np.zeros((0, d))

    def unit(x: np.ndarray) -> np.ndarray:
        for _ in range(2):
            x = x / np.linalg.norm(x)
            x = x - vectors.T @ (vectors @ x)
        return x / np.linalg.norm(x)

    for k in range(1, min(most, d) + 1):
        low, high = max(s for s, c in known.items() if c >= k), min(s for s, c in known.items() if c < k)
        while True:
            apart = count(low) == k and count(high) == k - 1
            if apart or high - low <= close:
                x, middle = unit(np.random.default_rng(k).standard_normal(d)), (low + high) / 2
                for _ in range(3):
                    x = unit(_solve(matrix, middle, x, close * EPS))
                value, left = float(x @ matrix @ x), np.inf
                for _ in range(12):
                    residual = float(np.linalg.norm(matrix @ x - value * x))
                    if residual >= left / 2:
                        break
                    left, best = residual, (value, x)
                    x = unit(_solve(matrix, value, x, close * EPS))
                    value = float(x @ matrix @ x)
                value, x = best
                if left <= close and count(value - 2 * close) >= k > count(value + 2 * close):
                    break
            if high - low <= close:
                raise ArithmeticError(f"eigenvalue {k} could not be certified")
            middle = (low + high) / 2
            low, high = (middle, high) if count(middle) >= k else (low, middle)
        if value <= d * 4 * EPS * trace:
            break
        values.append(value)
        vectors = np.vstack([vectors, x])
    order = np.argsort(-np.array(values), kind="stable")  # a cluster's values differ by rounding only
    return np.array(values)[order], vectors[order]


# --- exact sums


def _limbs(sums: np.ndarray) -> list[np.ndarray]:
    """Whole numbers (as objects) in three limbs, the last one signed."""
    mask = (1 << LIMB) - 1
    parts = [sums & mask, (sums >> LIMB) & mask, sums >> (2 * LIMB)]
    return [p.astype(np.int64) for p in parts]


def _exact(row: dict) -> int:
    return sum(row[f"l{i}"] << (LIMB * i) for i in range(3))


def _products(y: np.ndarray) -> np.ndarray:
    """y^T y of whole numbers, exactly."""
    most = max(int(y.max(initial=0)), -int(y.min(initial=0)))
    if most * most * len(y) < 1 << 53:
        part = y.astype(np.float64)
        return (part.T @ part).astype(np.int64).astype(object)
    y = y.astype(object)
    return y.T @ y


def _scaled(batch: dict) -> np.ndarray:
    """The entries of a batch as whole numbers, a row a vector; all vectors of a call have one length."""
    flat = batch["__vec"].flatten().to_numpy(zero_copy_only=False)
    return (np.floor(SCALE * flat).astype(np.int64) + OFFSET).reshape(len(batch["__vec"]), -1)


def usable(rows: DataFrame, vec_col: str) -> DataFrame:
    """Rows with a vector without null, non-finite or too large entries, as ``__vec array<double>``."""
    c = F.col(vec_col)
    bad = F.exists(c, lambda e: e.isNull() | F.isnan(e.cast("double")) | (F.abs(e.cast("double")) * SCALE >= LARGEST))
    return rows.filter(c.isNotNull() & (F.size(c) > 0) & ~bad).withColumn("__vec", c.cast("array<double>"))


@dataclass
class Spectrum:
    """What was learnt from the fit list: count, exact sums by dimension, trace, eigenvalues and unit vectors as rows."""

    n: int = 0
    sums: list[int] = field(default_factory=list)
    trace: float = 0.0
    values: np.ndarray = field(default_factory=lambda: np.zeros(0))
    vectors: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))

    @property
    def dimension(self) -> int:
        return len(self.sums)

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n x - S, exactly: longs where they hold it, else Python's numbers."""
        most = max(int(x.max(initial=0)), -int(x.min(initial=0)), 1)
        if self.n * most < 1 << 62:
            return self.n * x - np.array(self.sums, np.int64)
        return self.n * x.astype(object) - np.array(self.sums, object)

    def whitened(self, centred: np.ndarray) -> np.ndarray:
        return (centred / self.n).astype(np.float64) @ (self.vectors / np.sqrt(self.values)[:, None]).T


def fit(rows: DataFrame, vec_col: str = "embedding", components: int = COMPONENTS) -> Spectrum:
    """Learn from every usable vector of the greatest length. Three passes; what reaches the driver depends on d alone."""
    vectors = usable(rows, vec_col).select("__vec")
    d = vectors.agg(F.max(F.size("__vec"))).first()[0]
    if d is None:
        return Spectrum()
    same = vectors.filter(F.size("__vec") == d)

    def sums(batches: Iterator[dict]) -> Iterator[dict]:
        n, s = 0, np.zeros(d, object)
        for b in batches:
            x = _scaled(b)
            n, s = n + len(x), s + (x >> 32).sum(0).astype(object) * (1 << 32) + (x & 0xFFFFFFFF).sum(0).astype(object)
        if n:
            yield {"i": range(d), "n": [n] * d} | {f"l{i}": p for i, p in enumerate(_limbs(s))}

    fields = "l0 long, l1 long, l2 long"
    limbs = [F.sum(f"l{i}").alias(f"l{i}") for i in range(3)]
    first = map_batches(same, f"i int, n long, {fields}", sums).groupBy("i").agg(F.sum("n").alias("n"), *limbs).collect()
    found = sorted((r.asDict() for r in first), key=lambda r: r["i"])
    out = Spectrum(found[0]["n"], [_exact(r) for r in found])
    n = out.n
    middle = np.array([(2 * s + n) // (2 * n) for s in out.sums], np.int64)
    upper = np.triu_indices(d)

    def products(batches: Iterator[dict]) -> Iterator[dict]:
        total, any_row = np.zeros((d, d), object), False
        for b in batches:
            total, any_row = total + _products(_scaled(b) - middle), True
        if any_row:
            yield {"i": upper[0], "j": upper[1]} | {f"l{i}": p for i, p in enumerate(_limbs(total[upper]))}

    second = map_batches(same, f"i int, j int, {fields}", products).groupBy("i", "j").agg(*limbs)
    rest = [s - n * int(m) for s, m in zip(out.sums, middle, strict=True)]  # sums of the entries less their centre
    covariance = np.zeros((d, d))
    for r in second.collect():
        i, j = r["i"], r["j"]
        covariance[i, j] = covariance[j, i] = (n * _exact(r.asDict()) - rest[i] * rest[j]) / (n * n)
    out.trace = float(np.trace(covariance))
    out.values, out.vectors = leading_eigenpairs(covariance, components)
    return out


def _identity_error(vectors: DataFrame, model: Spectrum) -> float:
    """Largest absolute entry of the whitened values' covariance minus the identity; the values' mean is zero but for rounding."""
    k = len(model.values)
    upper = np.triu_indices(k)

    def work(batches: Iterator[dict]) -> Iterator[dict]:
        total, mean, any_row = np.zeros((k, k)), np.zeros(k), False
        for b in batches:
            w = model.whitened(model.centred(_scaled(b)))
            total, mean, any_row = total + w.T @ w, mean + w.sum(0), True
        if any_row:
            yield {"i": [*upper[0], *range(k)], "j": [*upper[1], *[-1] * k], "s": [*total[upper], *mean]}

    sums = {(r["i"], r["j"]): r["s"] for r in map_batches(vectors, "i int, j int, s double", work).groupBy("i", "j").agg(F.sum("s").alias("s")).collect()}
    mean = [sums[i, -1] / model.n for i in range(k)]
    return max(abs(sums[i, j] / model.n - mean[i] * mean[j] - (i == j)) for i, j in zip(*upper, strict=True))


def whiten(rows: DataFrame, model: Spectrum, vec_col: str = "embedding", id_col: str = "vec_id") -> DataFrame:
    """(id, component, n, deviation, deviation_digits, whitened, explained, identity_error): a row for each vector and component."""
    schema = f"{id_col} {dict(rows.dtypes)[id_col]}, component int, n long, deviation long, deviation_digits string, whitened double, explained double, identity_error double"
    k = len(model.values)
    if not k:
        return rows.sparkSession.createDataFrame([], schema)
    vectors = usable(rows, vec_col).filter(F.size("__vec") == model.dimension).select(id_col, "__vec")
    error = _identity_error(vectors.select("__vec"), model)
    share = model.values / model.trace

    def work(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            centred = model.centred(_scaled(b))
            most = max(int(centred.max(initial=0)), -int(centred.min(initial=0)))
            if most * most * model.dimension < 1 << 63:
                squares = (centred * centred).sum(1)
            else:
                squares = (centred.astype(object) ** 2).sum(1)
            rows = len(centred)
            at = np.repeat(np.arange(rows), k)
            digits = [str(s) for s in squares.tolist()]
            yield {
                id_col: b[id_col].take(pa.array(at)), "component": np.tile(np.arange(1, k + 1, dtype=np.int32), rows), "n": np.full(rows * k, model.n),
                "deviation": pa.array([s if s < 1 << 63 else None for s in squares.tolist()], pa.int64()).take(pa.array(at)), "deviation_digits": pa.array(digits).take(pa.array(at)),
                "whitened": model.whitened(centred).ravel(), "explained": np.tile(share, rows), "identity_error": np.full(rows * k, error),
            }

    return map_batches(vectors, schema, work)


def whitened_rows(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    return whiten(embeddings, fit(embeddings, components=components))
