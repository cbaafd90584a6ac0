"""Whitening of embeddings by cyclic Jacobi rotations.

Components become integers, x = floor(64 * c) + 1000000. Two passes of ``treeAggregate``
over blocks of rows give the sums S and then the scatter, centred before multiplying: at
q = floor(S / n), so that what is multiplied are small integers. The rest of the centring,
by (S - q n) / n, is below one and exact in the sums: V = (n T - r r') / n^2 with r = S - q n, each entry
rounded once. Products of a block go through float64 BLAS where the block's largest
magnitude keeps their sums below 2^53, fewer rows at a time or Python integers otherwise.
Only d x d sums reach the driver.

The driver turns V diagonal by Jacobi rotations, pair after pair in a fixed cycle in which
disjoint pairs turn together, until every off-diagonal entry is below d * 2^-52 of the
geometric mean of its diagonal entries. That criterion is relative, so small eigenvalues keep
their accuracy. The sorted, scaled eigenvectors are sent to every task; a third pass
measures the covariance of the whitened rows, a fourth gives the rows.

Cases: rows whose vector is null or holds null or non-finite entries are dropped; vectors of
zeros and repeated rows count like others; vectors of different lengths are whitened
length by length, each with its own n, up to ``LENGTHS`` lengths (more raise ValueError); a
length under 32 has as many components as entries, and an empty vector none; a component
without variance (eigenvalue at most d * 2^-52 of the largest; one row, or equal rows) is
whitened to 0 and takes no part in identity_error, which is 0 where none has variance;
equal eigenvalues have any orthonormal basis of their space; an entry beyond a long is cut
to it; a deviation beyond a long is given as the largest long; a null id stays null; an
empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from kinelake.llm import vectors
from kinelake.llm.scratch import map_batches, materialise
from kinelake.llm.vectors import EXACT, LONG, as_objects, column_sums, integers, matrix

SCALE, OFFSET, COMPONENTS, LENGTHS = 64, 1_000_000, 32, 64


def entries(values: np.ndarray) -> np.ndarray:
    """x of each component: float64 below 2^53, Python integers (cut to a long) beyond."""
    x = integers(values, SCALE)
    if x.dtype != object and np.abs(x).max(initial=0) + OFFSET < EXACT:
        return x + OFFSET
    return as_objects([max(-LONG - 1, min(LONG, int(v) + OFFSET)) for v in x.ravel()]).reshape(x.shape)


def shifted(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """x - q, exact."""
    if x.dtype != object and np.abs(x).max(initial=0) + max(map(abs, q), default=0) < EXACT:
        return x - q.astype(np.float64)
    y = as_objects(x.ravel()).reshape(x.shape) - q
    return y.astype(np.float64) if max((abs(v) for v in y.ravel()), default=0) < EXACT else y


def products(y: np.ndarray) -> np.ndarray:
    """y'y in Python integers."""
    d = y.shape[1]
    out = np.zeros((d, d), dtype=object)
    most = int(np.abs(y).max(initial=0)) ** 2
    if y.dtype == object or most >= EXACT:
        y = as_objects(y.ravel()).reshape(y.shape)
        return out + y.T @ y
    step = max(1, min(len(y), (EXACT - 1) // max(most, 1)))
    for a in range(0, len(y), step):
        part = y[a : a + step]
        out += as_objects((part.T @ part).ravel()).reshape(d, d)
    return out


def merged(a: dict, b: dict) -> dict:
    return {d: tuple(x + y for x, y in zip(a[d], b[d], strict=True)) if d in a and d in b else a.get(d) or b[d] for d in a.keys() | b.keys()}


def jacobi(v: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (falling) and unit eigenvectors (columns) of a symmetric matrix; of each vector the entry of largest magnitude is positive."""
    a, d = np.array(v, dtype=np.float64), len(v)
    u = np.eye(d)
    eps = d * np.finfo(np.float64).eps
    floor = np.finfo(np.float64).eps ** 2 * float(np.abs(np.diag(a)).max(initial=0))
    seats = list(range(d + d % 2))
    for _ in range(sweeps):
        turned = False
        for _ in range(len(seats) - 1):
            half = len(seats) // 2
            pairs = np.array([(min(i, j), max(i, j)) for i, j in zip(seats[:half], reversed(seats[half:]), strict=True) if max(i, j) < d], dtype=np.int64).reshape(-1, 2)
            seats = [seats[0], seats[-1], *seats[1:-1]]
            p, q = pairs[:, 0], pairs[:, 1]
            off, one, two = a[p, q], a[p, p], a[q, q]
            active = np.abs(off) > np.maximum(eps * np.sqrt(np.abs(one)) * np.sqrt(np.abs(two)), floor)
            if not active.any():
                continue
            turned = True
            p, q, off, one, two = p[active], q[active], off[active], one[active], two[active]
            with np.errstate(over="ignore"):
                tau = (two - one) / (2 * off)
                t = np.where(tau >= 0, 1.0, -1.0) / (np.abs(tau) + np.hypot(1.0, tau))
            c = 1 / np.hypot(1.0, t)
            s = t * c
            rows_p, rows_q = a[p], a[q]
            a[p], a[q] = c[:, None] * rows_p - s[:, None] * rows_q, s[:, None] * rows_p + c[:, None] * rows_q
            for m in (a, u):
                columns_p, columns_q = m[:, p], m[:, q]
                m[:, p], m[:, q] = c * columns_p - s * columns_q, s * columns_p + c * columns_q
            a[p, p], a[q, q] = one - t * off, two + t * off
            a[p, q] = a[q, p] = 0.0
        if not turned:
            break
    else:
        raise RuntimeError("Jacobi rotations did not settle")
    order = np.argsort(-np.diag(a), kind="stable")
    u = u[:, order]
    sign = np.sign(u[np.abs(u).argmax(axis=0), np.arange(d)]) if d else np.ones(0)
    return np.diag(a)[order], u * sign


@dataclass
class Whitening:
    n: int
    q: np.ndarray  # floor of the mean, Python integers
    r: np.ndarray  # S - q n
    weights: np.ndarray  # eigenvectors over the root of their eigenvalue; 0 without variance
    explained: np.ndarray
    varies: np.ndarray
    identity_error: float = 0.0

    def apply(self, x: np.ndarray) -> np.ndarray:
        return (shifted(x, self.q).astype(np.float64) - (self.r / self.n).astype(np.float64)) @ self.weights

    def deviation(self, x: np.ndarray) -> np.ndarray:
        """Sum over the entries of (n x - S)^2, exact."""
        y = shifted(x, self.q)
        bound = y.shape[1] * (self.n * int(np.abs(y).max(initial=0)) + self.n) ** 2
        if y.dtype != object and bound <= LONG:
            return ((self.n * y.astype(np.int64) - self.r.astype(np.int64)) ** 2).sum(axis=1)
        wide = as_objects(y.ravel()).reshape(y.shape)
        return np.array([min(LONG, v) for v in ((self.n * wide - self.r) ** 2).sum(axis=1)], dtype=np.int64)


def solve(n: int, total: np.ndarray, q: np.ndarray, scatter: np.ndarray, components: int) -> Whitening:
    r = total - q * n
    d = len(q)
    v = np.array([[(n * int(scatter[i, j]) - int(r[i]) * int(r[j])) / (n * n) for j in range(d)] for i in range(d)], dtype=np.float64).reshape(d, d)
    values, columns = jacobi(v)
    trace = float(np.trace(v))
    values, columns = values[:components], columns[:, :components]
    varies = values > d * np.finfo(np.float64).eps * (values[0] if len(values) else 0.0)
    scale = np.where(varies, 1 / np.sqrt(np.where(varies, values, 1.0)), 0.0)
    explained = np.maximum(values, 0.0) / trace if trace > 0 else np.zeros(len(values))
    return Whitening(n, q, r, columns * scale, explained, varies)


def fit(packed: DataFrame, kind: str, components: int = COMPONENTS) -> dict[int, Whitening]:
    """The whitening of each length of vector, from three passes over the blocks."""
    rdd = packed.select("d", "v").rdd.map(lambda row: (row[0], entries(matrix(row[1], row[0], kind)))).filter(lambda row: row[0] > 0)
    sums = rdd.treeAggregate({}, lambda acc, row: merged(acc, {row[0]: (len(row[1]), column_sums(row[1]))}), merged)
    if len(sums) > LENGTHS:
        raise ValueError(f"vectors of {len(sums)} lengths; at most {LENGTHS} are whitened at once")
    floors = {d: s // n for d, (n, s) in sums.items()}
    scatter = rdd.treeAggregate({}, lambda acc, row: merged(acc, {row[0]: (products(shifted(row[1], floors[row[0]])),)}), merged)
    models = {d: solve(n, s, floors[d], scatter[d][0], components) for d, (n, s) in sums.items()}

    def moments(acc, row):
        z = models[row[0]].apply(row[1])
        return merged(acc, {row[0]: (z.sum(axis=0), z.T @ z)})

    for d, (one, two) in rdd.treeAggregate({}, moments, merged).items():
        model = models[d]
        own = np.flatnonzero(model.varies)
        mean = one / model.n
        error = (two / model.n - np.outer(mean, mean))[np.ix_(own, own)] - np.eye(len(own))
        model.identity_error = float(np.abs(error).max(initial=0.0))
    return models


def whiten(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of every row kept and every component."""
    packed = vectors.blocks(rows, id_col, vector_col)
    kind = vectors.component_type(packed)
    packed = materialise(packed, "whitening-blocks")
    models = fit(packed, kind, components)
    names = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]

    def run(batches):
        for batch in batches:
            for d, ids, raw in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                if not d:
                    continue
                model, x = models[d], entries(matrix(raw.as_py(), d, kind))
                k = len(model.explained)
                owner = np.repeat(np.arange(len(x)), k)
                columns = [ids.values.take(pa.array(owner)), np.tile(np.arange(1, k + 1, dtype=np.int32), len(x)), np.full(len(owner), model.n), model.deviation(x)[owner], model.apply(x).ravel(), np.tile(model.explained, len(x)), np.full(len(owner), model.identity_error)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)

    return map_batches(packed, run, "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
