"""Embedding whitening: the leading principal directions by LOBPCG over distributed products.

A vector's entries c become integers x = floor(1024 c) + 100000. The covariance of x is never
formed: a product with a block of directions is one pass over the rows, each centred as the exact
integers n x - S over n before it is multiplied, and every task returns one partial block, summed
by dimension in Spark. The driver holds blocks of (dimensions x 3 blocks of directions) alone,
which grow with the vectors' width and not with the rows. A step is Rayleigh-Ritz on the iterate,
the residuals and the previous directions, all orthonormal; only the residuals' product needs a
pass. The iteration ends when products made anew, not carried along, certify residuals
|V u - e u| of at most `tol` times the largest eigenvalue, or when rounding lets them shrink no more.

Nulls and odd rows: null vectors, and vectors with null, NaN or infinite entries, are dropped; so
are vectors shorter than the longest whole one, whose missing entries count as null. A null id
is an id like others and repeated rows count as rows each. Entries beyond 2^31 saturate there.
Equal eigenvalues may give any basis of their space. Directions without variance (eigenvalue
within rounding of 0: few or equal rows, dependent dimensions) aren't components, so there may
be fewer than asked for, or none; an empty table gives an empty result. `deviation` is null where
it doesn't fit a long. Other columns pass through; those named whitened or deviation are replaced.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

#: Fixed values of the contract.
SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
#: Directions in a block: those beyond the components widen the gap that convergence depends on.
GUARDED = 3
TOL, MAX_STEPS = 1e-13, 300
#: Eigenvalues below this part of the largest are rounding.
RANK = 1e-12
#: Rows that are held as doubles at a time.
SLICE = 4096


@dataclass
class Whitening:
    """What a fit found: sums per dimension, unit directions (columns) by falling eigenvalue, certified residuals."""

    n: int = 0
    sums: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    directions: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    eigenvalues: np.ndarray = field(default_factory=lambda: np.zeros(0))
    residuals: np.ndarray = field(default_factory=lambda: np.zeros(0))
    trace: float = 0.0
    passes: int = 0


def whole_vectors(vectors: pa.Array, width: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Which vectors are whole, of finite entries, and of this width (None: of the greatest here), and their integers."""
    sizes = np.asarray(pc.fill_null(pc.list_value_length(vectors), -1))
    flat = pc.list_flatten(vectors)
    values = np.asarray(flat.cast(pa.float64()).to_numpy(zero_copy_only=False), np.float64)
    of = np.repeat(np.arange(len(sizes)), np.maximum(sizes, 0))
    odd = np.zeros(len(sizes), bool)
    odd[of[~np.isfinite(values)]] = True
    whole = (sizes > 0) & ~odd
    width = int(sizes[whole].max(initial=0)) if width is None else width
    whole &= sizes == width
    rows = values[whole[of]].reshape(-1, width) if width else np.zeros((0, 0))
    return whole, np.clip(np.floor(rows * SCALE) + SHIFT, -(2.0**31), 2.0**31).astype(np.int64)


def scaled(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n x - S, exactly: in longs, or in Python's integers where these could overflow."""
    far = n * int(np.abs(x).max(initial=0)) >= 1 << 62
    return n * x.astype(object) - sums.astype(object) if far else n * x - sums


def _slices(batches: Iterator[pa.RecordBatch], width: int | None = None) -> Iterator[np.ndarray]:
    for batch in batches:
        for i in range(0, batch.num_rows, SLICE):
            yield whole_vectors(batch.column(0).slice(i, SLICE), width)[1]


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """This task's count and sums of its widest whole vectors."""
    width, n, total = 0, 0, np.zeros(0, np.int64)
    for x in _slices(batches):
        if x.shape[1] > width:
            width, n, total = x.shape[1], 0, np.zeros(x.shape[1], np.int64)
        if x.shape[1] == width and width:
            n, total = n + len(x), total + x.sum(0)
    if n:
        yield pa.RecordBatch.from_pydict({"width": np.full(width, width), "dim": np.arange(width), "n": np.full(width, n), "s": total})


def _gather(df: DataFrame, task: Callable, keys: list[int]) -> dict[int, np.ndarray]:
    """The sums over tasks of what each returns: a row (dim, v0, v1, ...) for each of a known, small number of dims."""
    columns = [f"v{j}" for j in keys]
    parts = df.mapInArrow(task, "dim long, " + ", ".join(f"{c} double" for c in columns))
    return {r["dim"]: np.array(r[1:], np.float64) for r in parts.groupBy("dim").agg(*(F.sum(c).alias(c) for c in columns)).collect()}


def product(vectors: DataFrame, n: int, sums: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, float]:
    """V B for a block of directions B, and the trace of V, in one pass over the rows."""
    d, m = block.shape

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, spread = np.zeros((d, m)), 0.0
        for x in _slices(batches, d):
            centred = scaled(x, n, sums).astype(np.float64) / n
            out += centred.T @ (centred @ block)
            spread += float(np.square(centred).sum())
        rows = np.vstack([out, np.full((1, m), spread)]) / n
        yield pa.RecordBatch.from_pydict({"dim": np.append(np.arange(d), -1)} | {f"v{j}": rows[:, j] for j in range(m)})

    found = _gather(vectors, task, list(range(m)))
    return np.vstack([found[i] for i in range(d)]), float(found[-1][0])


def _apart(block: np.ndarray, *others: np.ndarray) -> np.ndarray:
    """An orthonormal basis of what a block adds to the others, which are orthonormal."""
    norms = np.linalg.norm(block, axis=0)
    block = block[:, norms > 0] / norms[norms > 0]
    for _ in range(3):
        for other in others:
            block = block - other @ (other.T @ block)
        if not block.size:
            return block
        u, s, _ = np.linalg.svd(block, full_matrices=False)
        block = u[:, s > 1e-8 * max(1.0, s[0])]
    return block


def lobpcg(apply: Callable[[np.ndarray], np.ndarray], d: int, components: int, tol: float = TOL, max_steps: int = MAX_STEPS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(eigenvalues, unit eigenvectors as columns, residuals) of the symmetric d x d matrix that apply multiplies blocks with."""
    m = min(d, GUARDED * components)
    k = min(d, components)
    x = np.linalg.qr(np.random.default_rng(0).standard_normal((d, m)))[0]
    p, ap = np.zeros((d, 0)), np.zeros((d, 0))
    best, lowest, waited, certified, fresh = None, np.inf, 0, 0, True
    ax = apply(x)
    for step in range(max_steps):
        e, c = np.linalg.eigh((x.T @ ax + ax.T @ x) / 2)
        x, ax, e = x @ c[:, ::-1], ax @ c[:, ::-1], e[::-1]
        r = ax - x * e
        sizes = np.linalg.norm(r, axis=0)
        worst, size = sizes[:k].max(), max(e[0], 0.0)
        if fresh:
            certified += 1
            if best is None or worst < best[0]:
                best = (worst, e[:k].copy(), x[:, :k].copy(), sizes[:k].copy())
        lowest, waited = (worst, 0) if worst < 0.5 * lowest else (lowest, waited + (worst <= 1e-9 * size))
        w = _apart(r[:, sizes > 0], x, p)
        done = worst <= tol * size or waited >= 3 or not w.shape[1]
        if fresh and (done or certified > 3) or step == max_steps - 1 and best is not None and best[0] <= worst:
            break
        if done or step >= max_steps - 2:  # certify by a product made anew, the iterate orthonormal again
            x = np.linalg.qr(x)[0]
            ax, p, ap, fresh, lowest, waited = apply(x), p[:, :0], ap[:, :0], True, np.inf, 0
            continue
        s, as_ = np.hstack([x, w, p]), np.hstack([ax, apply(w), ap])
        c = np.linalg.eigh((s.T @ as_ + as_.T @ s) / 2)[1][:, ::-1][:, :m]
        previous = _apart(np.vstack([np.zeros((m, m)), c[m:]]), c)
        x, ax, p, ap, fresh = s @ c, as_ @ c, s @ previous, as_ @ previous, False
    return best[1], best[2], best[3]


def fit(df: DataFrame, vector_col: str = "embedding", components: int = COMPONENTS, tol: float = TOL) -> Whitening:
    """Directions of the covariance of all whole vectors. df is read once for each pass, so pass a stored table."""
    vectors = df.select(vector_col)
    parts = vectors.mapInArrow(_sums, "width long, dim long, n long, s long").groupBy("width", "dim").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    width = parts.agg(F.max("width")).first()[0]
    if width is None:
        return Whitening()
    rows = sorted(parts.where(F.col("width") == width).collect(), key=lambda r: r["dim"])
    model = Whitening(n=rows[0]["n"], sums=np.array([r["s"] for r in rows], np.int64))

    def apply(block: np.ndarray) -> np.ndarray:
        out, model.trace = product(vectors, model.n, model.sums, block)
        model.passes += 1
        return out

    e, u, r = lobpcg(apply, width, components, tol)
    real = e > RANK * max(e[0], 0.0)
    sign = np.sign(u[np.abs(u).argmax(0), np.arange(u.shape[1])])
    model.eigenvalues, model.directions, model.residuals = e[real], (u * sign)[:, real], r[real]
    return model


def identity_error(df: DataFrame, model: Whitening, vector_col: str = "embedding") -> float:
    """The largest absolute entry of the whitened rows' covariance, measured over all rows, minus the identity."""
    n, sums, to = model.n, model.sums, model.directions / np.sqrt(model.eigenvalues)
    k = to.shape[1]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        second, first = np.zeros((k, k)), np.zeros(k)
        for x in _slices(batches, len(sums)):
            y = (scaled(x, n, sums).astype(np.float64) / n) @ to
            second, first = second + y.T @ y, first + y.sum(0)
        rows = np.vstack([second, first]) / n
        yield pa.RecordBatch.from_pydict({"dim": np.arange(k + 1)} | {f"v{j}": rows[:, j] for j in range(k)})

    found = _gather(df.select(vector_col), task, list(range(k)))
    mean = found.pop(k)
    return float(np.abs(np.vstack([found[i] for i in range(k)]) - np.outer(mean, mean) - np.eye(k)).max())


def deviations(centred: np.ndarray) -> list[int | None]:
    """Sums of squares of exact integers, null beyond a long."""
    near = np.square(centred.astype(np.float64)).sum(1) < 2.0**62
    sums = np.zeros(len(centred), object)
    sums[near] = np.square(centred[near].astype(np.int64)).sum(1)
    sums[~near] = [sum(int(v) ** 2 for v in row) for row in centred[~near]]
    return [int(v) if v < 1 << 63 else None for v in sums]


def transform(df: DataFrame, model: Whitening, vector_col: str = "embedding") -> DataFrame:
    """The rows with whole vectors, with `whitened` (an entry per component) and `deviation`."""
    own = [f for f in df.schema.fields if f.name not in ("whitened", "deviation")]
    schema = StructType([*own, StructField("whitened", ArrayType(DoubleType())), StructField("deviation", LongType())])
    n, sums, at = model.n, model.sums, [f.name for f in own].index(vector_col)
    to = model.directions / np.sqrt(model.eigenvalues)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, SLICE):
                part = batch.slice(i, SLICE)
                whole, x = whole_vectors(part.column(at), len(sums))
                if not len(x):
                    continue
                exact = scaled(x, n, sums)
                y = (exact.astype(np.float64) / n) @ to
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(y) + 1) * y.shape[1], pa.int32()), pa.array(y.ravel()))
                kept = part.filter(pa.array(whole))
                yield pa.RecordBatch.from_arrays([*kept.columns, lists, pa.array(deviations(exact), pa.int64())], names=schema.names)

    if not model.n:
        return df.sparkSession.createDataFrame([], schema)
    return df.select(*(f.name for f in own)).mapInArrow(task, schema)
