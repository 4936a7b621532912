"""Whitening of embeddings: principal components by Jacobi-Davidson, with the covariance only as distributed products."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreloom.llm._common import written

SCALE, SHIFT = 1024, 100_000
EPS = float(np.finfo(np.float64).eps)
#: A residual of this many roundings of the largest eigenvalue counts as double precision.
ROUNDINGS = 32
#: Rounds without progress after which a residual under STALLED times the largest eigenvalue is as small as the products' rounding lets it be.
PATIENCE, STALLED = 3, 1e-12
#: Products in one solution of the correction equations, and rounds in all.
INNER, OUTER = 6, 200

Product = Callable[[np.ndarray], np.ndarray]


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [np.asarray(x.values, dtype="<i8").tobytes() for x in batch.column("x")]
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(rows, pa.binary())], names=["vec_id", "x"])


def fit_list(embeddings: DataFrame) -> DataFrame:
    """(vec_id, x) of each row of embeddings (vec_id, embedding) with a vector of finite entries: x = floor(1024 * entry) + 100000 as packed longs.

    Rows whose vector is null, empty or holds null or non-finite entries go. An entry over 2**53 / 1024 has no exact product and raises an error.
    """
    c = F.transform("embedding", lambda v: v.cast("double"))
    good = (F.size("c") > 0) & F.forall("c", lambda v: F.coalesce(F.abs(v) < float("inf"), F.lit(False)))
    exact = F.when(F.exists("c", lambda v: F.abs(v) * SCALE >= float(1 << 53)), F.raise_error(F.lit("an entry of a vector is too large")).cast("array<bigint>"))
    x = exact.otherwise(F.transform("c", lambda v: F.floor(v * SCALE) + SHIFT))
    # NaN compares as larger than any number, so it fails the test for finite entries
    return embeddings.select("vec_id", c.alias("c")).where(good).select("vec_id", x.alias("x")).mapInArrow(_packed, "vec_id long, x binary")


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype="<i8").reshape(-1, d)


def _cells(values: np.ndarray, kind: pa.DataType) -> pa.RecordBatch:
    flat = values.reshape(-1)
    return pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat)), pa.int32()), pa.array(flat, kind)], names=["cell", "value"])


def _summed(rows: DataFrame, partial: Callable[[Iterator[pa.RecordBatch]], np.ndarray | None], size: int, kind: str = "double") -> np.ndarray:
    """The sum over tasks of `partial`, an array of `size` cells: added up cell by cell in Spark, so the driver gets `size` numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = partial(batches)
        if found is not None:
            yield _cells(found, pa.float64() if kind == "double" else pa.int64())

    out = np.zeros(size, np.float64 if kind == "double" else np.int64)
    for r in rows.mapInArrow(run, f"cell int, value {kind}").groupBy("cell").agg(F.sum("value").alias("value")).collect():
        out[r.cell] = r.value
    return out


def _sums(d: int):
    def partial(batches: Iterator[pa.RecordBatch]) -> np.ndarray | None:
        found = None
        for b in batches:
            if b.num_rows:
                own = _matrix(b.column("x"), d).sum(axis=0)
                found = own if found is None else found + own
        return found

    return partial


def _centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """x - sums / n, rounded once: the difference is taken in whole numbers."""
    return (n * x - sums) / n


def covariance_product(rows: DataFrame, n: int, sums: np.ndarray) -> Product:
    """V times a block of columns, V the covariance of rows (x): one pass over the rows, in which each task centres its own and multiplies
    them, first with the block and then back. V itself is never made."""
    d = len(sums)

    def product(block: np.ndarray) -> np.ndarray:
        def partial(batches: Iterator[pa.RecordBatch]) -> np.ndarray | None:
            found = None
            for b in batches:
                if b.num_rows:
                    c = _centred(_matrix(b.column("x"), d), n, sums)
                    own = c.T @ (c @ block)
                    found = own if found is None else found + own
            return found

        return _summed(rows, partial, block.size).reshape(block.shape) / n

    return product


def orthonormal(block: np.ndarray, against: np.ndarray) -> np.ndarray:
    """An orthonormal basis of what the columns of block have outside of `against`, which is orthonormal; columns without any go."""
    out = against
    for v in block.T:
        size = np.linalg.norm(v)
        for _ in range(3):
            v = v - out @ (out.T @ v)
        left = np.linalg.norm(v)
        if left > 1e-10 * size and left > 0:
            v = v / left
            v = v - out @ (out.T @ v)
            out = np.column_stack([out, v / np.linalg.norm(v)])
    return out[:, against.shape[1] :]


def minres(product: Product, shifts: np.ndarray, right: np.ndarray, against: np.ndarray, steps: int) -> np.ndarray:
    """Approximate solutions t of P (A - shift) P t = right, P the projection away from `against`, for each column with its own shift.

    MINRES after `steps` products; the columns go along in step, as one product serves them all. right lies in P's range.
    """
    away = lambda v: v - against @ (against.T @ v)
    dots = lambda a, b: np.einsum("ij,ij->j", a, b)
    safe = lambda a: np.where(a == 0, 1.0, a)
    k = right.shape[1]
    beta = np.sqrt(dots(right, right))
    alive = beta > 0
    v_old, v = np.zeros_like(right), right / safe(beta)
    w_old, w = np.zeros_like(right), np.zeros_like(right)
    c_old, c, s_old, s = np.ones(k), np.ones(k), np.zeros(k), np.zeros(k)
    t, eta, b = np.zeros_like(right), beta.copy(), np.zeros(k)
    scale = 0.0
    for _ in range(steps):
        u = away(product(v) - shifts * v)
        a = dots(v, u)
        u = away(u - a * v - b * v_old)
        b_new = np.sqrt(dots(u, u))
        scale = max(scale, float(np.max(np.abs(a), initial=0)), float(np.max(b_new, initial=0)))
        low, high = c * a - c_old * s * b, s * a + c_old * c * b
        far = s_old * b
        size = np.hypot(low, b_new)
        ok = alive & (size > EPS * max(scale, 1e-300))
        c_old, s_old = c, s
        c, s = np.where(ok, low / safe(size), 1.0), np.where(ok, b_new / safe(size), 0.0)
        w_new = (v - far * w_old - high * w) / safe(size)
        t = t + np.where(ok, c * eta, 0.0) * w_new
        w_old, w = w, np.where(ok, w_new, 0.0)
        eta = -s * eta
        alive = ok & (b_new > 1e-14 * scale)
        if not alive.any():
            break
        v_old, v, b = v, np.where(alive, u / safe(b_new), 0.0), np.where(alive, b_new, 0.0)
    return t


@dataclass(frozen=True)
class Components:
    """values fall; vectors holds their unit eigenvectors as columns; residuals are |V u - e u|; products counts passes over the rows."""

    values: np.ndarray
    vectors: np.ndarray
    residuals: np.ndarray
    products: int


def eigenpairs(product: Product, d: int, wanted: int = 8, seed: int = 5) -> Components:
    """The `wanted` largest eigenvalues of a positive semidefinite matrix of order d and their eigenvectors, by block Jacobi-Davidson.

    Each round takes the Ritz pairs of a subspace (Rayleigh-Ritz; products with its basis are kept, so only new directions cost a pass),
    locks the leading ones whose residuals reach double precision, and adds for each of the others that are wanted a solution of its
    projected correction equation, by MINRES. A subspace that grows too large starts again from its best Ritz vectors.

    When all are locked, a fresh random block outside of them is refined by a few products; if something larger than the least that was
    found shows up, the search goes on with it. Eigenvectors of the null space are found like others, with values of about 0.
    """
    wanted = min(wanted, d)
    rng, count = np.random.default_rng(seed), 0

    def times(block: np.ndarray) -> np.ndarray:
        nonlocal count
        count += 1
        return product(block)

    most, least = min(d, max(6 * wanted, 20)), min(d, 2 * wanted + 2)
    locked, values, residuals = np.zeros((d, 0)), np.zeros(0), np.zeros(0)
    basis = orthonormal(rng.normal(size=(d, least)), locked)
    image, checked = times(basis), False
    best, waited = np.inf, 0
    for _ in range(OUTER):
        h = basis.T @ image
        ritz, s = np.linalg.eigh((h + h.T) / 2)
        ritz, s = ritz[::-1], s[:, ::-1]
        vectors, images = basis @ s, image @ s
        top = max(float(np.max(values, initial=0)), float(np.max(ritz, initial=0)), 0.0)
        rest = images - vectors * ritz
        rest = rest - locked @ (locked.T @ rest)
        sizes = np.linalg.norm(rest, axis=0)
        need = wanted - locked.shape[1]
        worst = float(sizes[0]) if len(sizes) else 0.0
        best, waited = (worst, 0) if worst < 0.5 * best else (best, waited + 1)
        limit = ROUNDINGS * EPS * top if waited < PATIENCE else STALLED * top
        new = 0
        while new < min(need, len(sizes)) and sizes[new] <= limit:
            new += 1
        if new:
            locked = np.column_stack([locked, vectors[:, :new]])
            values, residuals = np.append(values, ritz[:new]), np.append(residuals, sizes[:new])
            basis, image = vectors[:, new:], images[:, new:]
            ritz, sizes, vectors, images, rest = ritz[new:], sizes[new:], basis, image, rest[:, new:]
            need -= new
            best, waited = np.inf, 0
        if not need:
            if checked or locked.shape[1] + basis.shape[1] == d:
                break
            checked = True
            fresh = orthonormal(rng.normal(size=(d, wanted)), np.column_stack([locked, basis]))
            for _ in range(4):
                image = np.column_stack([image, times(fresh)])
                basis = np.column_stack([basis, fresh])
                fresh = orthonormal(image[:, -fresh.shape[1] :], np.column_stack([locked, basis]))
                if not fresh.shape[1]:
                    break
            h = basis.T @ image
            found = np.linalg.eigvalsh((h + h.T) / 2)[::-1]
            again = int(np.sum(found > values.min() + 1e-10 * top))
            if not again:
                break
            # what was overlooked is looked for in place of the smallest
            stay = np.argsort(-values)[: wanted - again]
            drop = np.setdiff1d(np.arange(len(values)), stay)
            basis, image = np.column_stack([basis, locked[:, drop]]), np.column_stack([image, locked[:, drop] * values[drop]])
            locked, values, residuals, checked = locked[:, stay], values[stay], residuals[stay], False
            continue
        if basis.shape[1] + need > most - locked.shape[1] and basis.shape[1] > need + 2:
            keep = min(basis.shape[1], need + wanted)
            basis, image = vectors[:, :keep], images[:, :keep]
        shifts, right = ritz[:need], -rest[:, :need]
        against = np.column_stack([locked, vectors[:, :need]])
        right = right - against @ (against.T @ right)
        right = right / np.maximum(np.linalg.norm(right, axis=0), 1e-300)
        open_ = sizes[:need] > ROUNDINGS * EPS * top
        steps = minres(times, shifts[open_], right[:, open_], against, INNER) if open_.any() else right
        fresh = orthonormal(steps, np.column_stack([locked, basis]))
        if not fresh.shape[1]:
            if locked.shape[1] + basis.shape[1] >= d:
                continue
            fresh = orthonormal(rng.normal(size=(d, need)), np.column_stack([locked, basis]))
        basis, image = np.column_stack([basis, fresh]), np.column_stack([image, times(fresh)])
    if locked.shape[1] < wanted:
        raise RuntimeError(f"{wanted - locked.shape[1]} of {wanted} eigenpairs didn't reach double precision in {OUTER} rounds")
    by = np.argsort(-values, kind="stable")
    vectors = locked[:, by]
    sign = np.sign(vectors[np.argmax(np.abs(vectors), axis=0), np.arange(vectors.shape[1])])
    return Components(values[by], vectors * sign, residuals[by], count)


OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(embeddings: DataFrame, wanted: int = 8) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) for each good row of embeddings and each component, up to `wanted`.

    Good rows are those of fit_list, n their number; repeated rows count as often as they are there. Components are numbered from 1 by
    falling eigenvalue e of the covariance V of the x-vectors; each vector's largest entry is positive. deviation is the sum over
    dimensions of (n * x - sum of x) squared, as an exact long; whitened is the centred x along the component, over the root of e;
    explained is e over the trace of V; identity_error is the largest absolute entry of whitened's covariance minus the identity.

    Components without variance (e under 64 * d roundings of the largest) have no whitened values and are left out, so equal vectors, or
    a single one, give no row, as an empty table and one without a good row do. A null vec_id is passed on. Vectors of different lengths
    raise a ValueError, and sums of squares beyond a long an error. Other columns are left out.

    The good rows are written once to the shared folder. Then each product with V is a pass over them of independent tasks, of which d
    numbers a column come to the driver, however many rows there are.
    """
    spark = embeddings.sparkSession
    rows = written(fit_list(embeddings), "whitening")
    n, shortest, longest = rows.agg(F.count("*"), F.min(F.octet_length("x")), F.max(F.octet_length("x"))).head()
    empty = spark.createDataFrame([], OUT)
    if shortest != longest:
        raise ValueError(f"vectors have from {shortest // 8} to {longest // 8} entries")
    d = (longest or 0) // 8
    if not n or not d:
        return empty
    sums = _summed(rows, _sums(d), d, "long")
    found = eigenpairs(covariance_product(rows, n, sums), d, wanted)
    top = float(found.values[0])
    k = int(np.sum(found.values > max(64 * d * EPS * top, 0.0)))
    if not k or top <= 0:
        return empty
    axes = found.vectors[:, :k] / np.sqrt(found.values[:k])

    def along(x: np.ndarray) -> np.ndarray:
        return _centred(x, n, sums) @ axes

    def totals(batches: Iterator[pa.RecordBatch]) -> np.ndarray | None:
        out = None
        for b in batches:
            if b.num_rows:
                x = _matrix(b.column("x"), d)
                own = np.append((_centred(x, n, sums) ** 2).sum(), along(x).sum(axis=0))
                out = own if out is None else out + own
        return out

    trace, *mean = _summed(rows, totals, k + 1) / n
    mean = np.array(mean)

    def spread(batches: Iterator[pa.RecordBatch]) -> np.ndarray | None:
        out = None
        for b in batches:
            if b.num_rows:
                y = along(_matrix(b.column("x"), d)) - mean
                out = y.T @ y if out is None else out + y.T @ y
        return out

    error = float(np.max(np.abs(_summed(rows, spread, k * k).reshape(k, k) / n - np.eye(k))))
    explained = found.values[:k] / trace

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column("x"), d)
            off = n * x - sums
            if len(off) and float((np.abs(off).max(axis=1).astype(np.float64) ** 2).max()) * d >= 2.0**62:
                deviation = [sum(int(v) ** 2 for v in r) for r in off]  # beyond a long, Arrow refuses it
            else:
                deviation = np.einsum("ij,ij->i", off, off)
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("vec_id").take(pa.array(np.repeat(np.arange(len(x)), k))), pa.array(np.tile(np.arange(1, k + 1), len(x)), pa.int32()), pa.array(np.full(len(x) * k, n)),
                    pa.array(np.repeat(np.array(deviation, dtype=object), k).tolist(), pa.int64()) if isinstance(deviation, list) else pa.array(np.repeat(deviation, k)),
                    pa.array(along(x).reshape(-1)), pa.array(np.tile(explained, len(x))), pa.array(np.full(len(x) * k, error)),
                ],
                names=[f.split()[0] for f in OUT.split(", ")],
            )

    return rows.mapInArrow(run, OUT)
