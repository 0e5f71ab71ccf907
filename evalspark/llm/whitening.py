"""Whitening of vectors by Golub-Kahan-Lanczos bidiagonalisation of the centred rows.

With A the centred rows, products p -> A p and u -> A'u alternate over the distributed rows and
reduce A to a small bidiagonal matrix whose SVD gives the components (right singular vectors) and
deviations. The left vectors are as long as the table, so they are never stored: each is A y for a
short y, which is kept in its place. Inner products with earlier left vectors, needed for their
full reorthogonalisation, are sums over rows like everything else. The right vectors are short and
are reorthogonalised on the driver. Both products of a step share one pass: A'u follows from A'A p
and the A'u of earlier steps, because reorthogonalisation is linear.

What leaves a task is a few sums, added up in a tree of fixed fan-in. The driver holds vectors of
the dimension of the data and one small matrix, whatever the number of rows. Vectors lie on an
integer grid, so counts, sums and squared deviations are exact in any order; for the passes they
are packed once into blocks of bytes.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspark.plans.durable import stored

SCALE, OFFSET = 1024, 100_000
WANTED = 8
TOL = 1e-13  # largest residual of a wanted singular triplet, against the largest singular value
FAN_IN = 64
LIMIT = 2.0**62
BLOCK = 1 << 20  # entries worked on at once


def usable(vector: Column) -> Column:
    """Not null or empty, without null or non-finite entries."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & fine


def on_grid(rows: DataFrame, id_col: str, vec_col: str, scale: int = SCALE, offset: int = OFFSET) -> tuple[DataFrame, int]:
    """(_id, x) of the usable rows: longs floor(scale * c) + offset, kept within 2**62. The
    dimension is the largest length of a usable vector; shorter ones lack entries and are left out."""
    narrow = rows.select(F.col(id_col).alias("_id"), F.col(vec_col).cast("array<double>").alias("_v")).where(usable(F.col("_v")))
    d = narrow.agg(F.coalesce(F.max(F.size("_v")), F.lit(0)).alias("d")).first().d
    cell = lambda c: F.greatest(F.lit(-LIMIT), F.least(F.lit(LIMIT), F.floor(F.greatest(F.lit(-LIMIT), F.least(F.lit(LIMIT), c * float(scale)))).cast("double"))).cast("long") + F.lit(offset).cast("long")
    return narrow.where(F.size("_v") == d).select("_id", F.transform("_v", cell).alias("x")), d


def blocks(batch: pa.RecordBatch, d: int) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, matrix of longs) in bounded pieces of a batch with a column ``x``."""
    step = max(1, BLOCK // max(1, d))
    for at in range(0, batch.num_rows, step):
        yield at, batch.column("x").slice(at, step).flatten().to_numpy().reshape(-1, d)


def packed(grid: DataFrame, d: int) -> DataFrame:
    """(width, data): the vectors of ``grid`` in blocks of whole numbers of 4 or 8 bytes, stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, x in blocks(batch, d):
                width = 4 if np.abs(x).max(initial=0) < 1 << 31 else 8
                yield pa.RecordBatch.from_pydict({"width": pa.array([width], pa.int32()), "data": pa.array([x.astype(f"<i{width}").tobytes()], pa.binary())})

    return stored(grid.select("x").mapInArrow(run, "width int, data binary"), "vectors-packed")


def unpacked(batch: pa.RecordBatch, d: int) -> Iterator[np.ndarray]:
    for width, data in zip(batch.column(0).to_pylist(), batch.column(1)):
        yield np.frombuffer(data.as_buffer(), f"<i{width}").reshape(-1, d).astype(np.int64)


def summed(pack: DataFrame, size: int, of: Callable[[np.ndarray], np.ndarray], d: int, kind: type = np.float64) -> np.ndarray:
    """The sum of ``of(matrix)``, ``size`` numbers, over all blocks: one partial per task, added up
    in levels of ``FAN_IN`` until few enough are left for the driver."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros(size, kind), False
        for batch in batches:
            for x in unpacked(batch, d):
                total += of(x)
                seen = True
        if seen:
            yield pa.RecordBatch.from_pydict({"part": pa.array([total.tobytes()], pa.binary())})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, kind)
        for batch in batches:
            for part in batch.column(0):
                total += np.frombuffer(part.as_py(), kind)
        yield pa.RecordBatch.from_pydict({"part": pa.array([total.tobytes()], pa.binary())})

    parts, count = pack.mapInArrow(partial, "part binary"), pack.rdd.getNumPartitions()
    while count > FAN_IN:
        count = -(-count // FAN_IN)
        parts = parts.repartition(count).mapInArrow(add, "part binary")
    return sum((np.frombuffer(r.part, kind) for r in parts.collect()), np.zeros(size, kind))


def exact_sums(pack: DataFrame, d: int) -> tuple[int, list[int]]:
    """(n, sums per dimension), exact: longs are summed in quarters of 16 bits, which overflow
    only beyond 2**47 rows."""
    quarter = (1 << 16) - 1
    of = lambda x: np.concatenate([[len(x)], *[(x >> shift if shift == 48 else (x >> shift) & quarter).sum(axis=0) for shift in (48, 32, 16, 0)]])
    total = [int(v) for v in summed(pack, 1 + 4 * d, of, d, np.int64)]
    parts = [total[1 + k * d : 1 + (k + 1) * d] for k in range(4)]
    return total[0], [(a << 48) + (b << 32) + (c << 16) + e for a, b, c, e in zip(*parts)]


class Centre:
    """Rows less their mean: the sum is split into whole part and remainder over n, so that no
    accuracy is lost to a large offset, and constant dimensions give exact zeros."""

    def __init__(self, n: int, sums: list[int]):
        self.n = n
        self.whole = np.array([s // n for s in sums], np.int64)
        self.rest = np.array([s % n for s in sums], np.int64)

    def rows(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole).astype(np.float64) - self.rest / self.n

    def deviations(self, x: np.ndarray) -> list[int]:
        """Exact sum over dimensions of (n x - S)**2 per row."""
        off = x - self.whole
        reach = (int(np.abs(off).max(initial=0)) + 1) * self.n
        if reach * reach * x.shape[1] < 1 << 63:
            return ((off * self.n - self.rest) ** 2).sum(axis=1).tolist()
        big = off.astype(object) * self.n - self.rest.astype(object)
        return (big * big).sum(axis=1).tolist()


@dataclass
class Whitening:
    """``components`` (one per row) by falling ``eigenvalues`` of the covariance, ``trace`` of the
    covariance, ``n`` rows with ``sums``, ``steps`` of the bidiagonalisation, and what covariance
    the whitened rows have beyond the identity at most."""

    n: int
    sums: list[int]
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float
    steps: int
    identity_error: float


def bidiagonalise(products: Callable, d: int, wanted: int, noise: float, tol: float = TOL, seed: int = 7) -> tuple[np.ndarray, np.ndarray, int]:
    """(singular values, right singular vectors as rows, steps), the largest ``wanted``.

    ``products(ys, p)`` gives the inner products of A p with every A y and with itself, and A'A p,
    of one pass. A chain that ends early has found an
    invariant subspace; it goes on with a random start orthogonal to it, so multiple singular
    values are found too. Singular values up to ``noise`` count as zero.
    """
    rng = np.random.default_rng(seed)
    rights: list[np.ndarray] = []  # v
    lefts: list[np.ndarray] = []  # y: the left vector is A y
    images: list[np.ndarray] = []  # A'A y
    cells: dict[tuple[int, int], float] = {}
    largest = 0.0
    start, beta = True, 0.0
    v = orthogonal(rng.normal(size=d), rights)
    while v is not None:
        rights.append(v)
        column = len(rights) - 1
        p = v - beta * lefts[-1] if not start else v.copy()
        before = math.inf
        while True:  # full reorthogonalisation, again where much was taken away
            inner, w = products(np.array(lefts).reshape(-1, d), p)
            taken = inner[:-1]
            if lefts:
                p, w = p - taken @ np.array(lefts), w - taken @ np.array(images)
            square = inner[-1] - taken @ taken
            if square > 0.5 * inner[-1] or inner[-1] <= noise**2 or inner[-1] >= before:
                break
            before = inner[-1]
        alpha = math.sqrt(max(0.0, square))
        tiny = max(noise, d * np.finfo(float).eps * largest)
        if alpha <= tiny:
            if start:
                break  # a random vector of the complement vanishes, so all of it does
            start, beta = True, 0.0
            v = orthogonal(rng.normal(size=d), rights)
            continue
        lefts.append(p / alpha)
        images.append(w / alpha)
        cells[len(lefts) - 1, column] = alpha
        w = images[-1]
        w = w - alpha * v
        for _ in range(2):
            w = w - np.array(rights).T @ (np.array(rights) @ w)
        beta = float(np.linalg.norm(w))
        largest = max(largest, math.hypot(alpha, beta))
        small = dense(cells, len(lefts), len(rights))
        left, values, _ = np.linalg.svd(small)
        if len(values) >= wanted and beta * np.abs(left[-1, :wanted]).max() <= tol * values[0] or len(rights) == d:
            break
        start = beta <= tiny
        if start:
            v = orthogonal(rng.normal(size=d), rights)
        else:
            v = w / beta
            cells[len(lefts) - 1, column + 1] = beta
    if not lefts:
        return np.zeros(0), np.zeros((0, d)), len(rights)
    _, values, right = np.linalg.svd(dense(cells, len(lefts), len(rights)), full_matrices=False)
    found = right @ np.array(rights)
    keep = min(wanted, int((values > max(noise, d * np.finfo(float).eps * values[0])).sum()))
    return values[:keep], found[:keep] / np.linalg.norm(found[:keep], axis=1, keepdims=True), len(rights)


def dense(cells: dict[tuple[int, int], float], rows: int, columns: int) -> np.ndarray:
    out = np.zeros((rows, columns))
    for (i, j), value in cells.items():
        if j < columns:
            out[i, j] = value
    return out


def orthogonal(v: np.ndarray, to: list[np.ndarray]) -> np.ndarray | None:
    """A unit vector, None if ``to`` spans everything."""
    if len(to) >= len(v):
        return None
    for _ in range(3):
        for u in to:
            v = v - (u @ v) * u
        v = v / np.linalg.norm(v)
    return v


def fit(grid: DataFrame, d: int, wanted: int = WANTED, tol: float = TOL) -> Whitening:
    """Components of all rows of ``grid``. No rows, or rows without variance: no components."""
    pack = packed(grid, d)
    n, sums = exact_sums(pack, d)
    if not n:
        return Whitening(0, sums, np.zeros((0, d)), np.zeros(0), 0.0, 0, 0.0)
    centre = Centre(n, sums)

    def products(ys: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        both = np.vstack([ys, p]).T
        k = both.shape[1]

        def of(x):
            rows = centre.rows(x)
            z = rows @ both
            return np.concatenate([z.T @ z[:, -1], z[:, -1] @ rows])

        out = summed(pack, k + d, of, d)
        return out[:k], out[k:]

    trace = summed(pack, 1, lambda x: np.square(centre.rows(x)).sum(keepdims=True).ravel(), d)[0] / n
    noise = 4 * np.finfo(float).eps * math.sqrt(n * d)
    values, components, steps = bidiagonalise(products, d, wanted, noise, tol)
    if len(values):
        components = components * np.sign(components[np.arange(len(values)), np.abs(components).argmax(axis=1)])[:, None]
    made = Whitening(n, sums, components, values**2 / n, float(trace), steps, 0.0)
    k = len(values)
    if k:
        basis = made.components.T / np.sqrt(made.eigenvalues)

        def of(x):
            w = centre.rows(x) @ basis
            return np.append(w.sum(axis=0), (w.T @ w).ravel())

        total = summed(pack, k + k * k, of, d) / n
        made.identity_error = float(np.abs(total[k:].reshape(k, k) - np.outer(total[:k], total[:k]) - np.eye(k)).max())
    return made


def transform(grid: DataFrame, made: Whitening, d: int) -> DataFrame:
    """(_id, deviation, whitened) per row of ``grid``: the exact squared deviation from the mean
    times n squared, null beyond 38 digits, and the whitened coordinates."""
    centre = Centre(made.n, made.sums) if made.n else None
    basis = made.components.T / np.sqrt(made.eigenvalues)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, x in blocks(batch, d):
                w = centre.rows(x) @ basis
                off = [str(v) if v < 10**38 else None for v in centre.deviations(x)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("_id").slice(at, len(x)), pa.array(off, pa.string()), pa.array(list(w), pa.list_(pa.float64()))], names=["_id", "deviation", "whitened"]
                )

    kind = grid.schema["_id"].dataType.simpleString()
    return grid.mapInArrow(run, f"_id {kind}, deviation string, whitened array<double>").withColumn("deviation", F.col("deviation").cast("decimal(38,0)"))


def whiten(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", wanted: int = WANTED) -> tuple[DataFrame, Whitening]:
    """(_id, deviation, whitened) of every usable row, and the fit over all of them.

    Rows whose vector is null, empty, or holds null or non-finite entries are left out, and so are
    vectors shorter than the longest. Null ids and repeated rows keep their rows, and count. Without
    usable rows or variance nothing is whitened: the lists are empty.
    """
    grid, d = on_grid(rows, id_col, vec_col)
    made = fit(grid, d, wanted)
    return transform(grid, made, d), made
