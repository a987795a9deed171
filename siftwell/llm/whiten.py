"""Embedding whitening: principal components by QDWH spectral divide-and-conquer.

Entries become integers x = floor(scale * c) + shift. The fit list holds each distinct vector of
integers once; its covariance is summed from centred vectors in tasks, one matrix a task. The
components come from polar decompositions of the shifted covariance: the unitary factor of
V - s I (QDWH iteration) gives the projector onto the eigenvectors above s, whose range and
complement are invariant subspaces; each is split again until it is one component, the upper side
first, so that only subspaces that hold wanted components are split. Mean and components (a few
vectors) are broadcast, and every row is projected where it is read.

Rows whose vector is null or holds null or non-finite entries are dropped. Vectors meet only
vectors of their own length: each length has a fit list and components of its own; an empty vector
has no component and so no row. Repeated rows are repeated in the result but count once in the
fit; a null id stays null. A component without variance (eigenvalue zero to double precision, as
with one distinct vector) has whitened null and takes no part in the identity error, which is 0 if
there is no other. Integers are cut to 62 bits, a deviation to the range of a long. An empty table
gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm.common import stored

COMPONENTS, SCALE, SHIFT = 16, 64.0, 1_000_000
#: Tasks that each sum one matrix, at most, and numbers handled at once in a task.
SUMS, VALUES = 2048, 1 << 20
EPS = 2.0**-52
EDGE, LONG = 2.0**62, (1 << 63) - 1
RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def polar_factor(a: np.ndarray) -> np.ndarray:
    """The orthogonal factor of a symmetric matrix, by QDWH: dynamically weighted Halley steps.

    Steps with large weights use a QR factorisation, the others a Cholesky one; at most nine are
    needed for singular values down to the rounding of doubles.
    """
    size = len(a)
    x = a / max(np.linalg.norm(a), np.finfo(float).tiny)
    low = EPS / 8
    for _ in range(12):
        d = np.cbrt(4 * (1 - low * low) / low**4)
        root = np.sqrt(1 + d)
        u = root + np.sqrt(max(0.0, 8 - 4 * d + 8 * (2 - low * low) / (low * low * root))) / 2
        v = (u - 1) ** 2 / 4
        w = u + v - 1
        if w > 100:
            q = np.linalg.qr(np.concatenate([np.sqrt(w) * x, np.eye(size)]))[0]
            new = v / w * x + (u - v / w) / np.sqrt(w) * (q[:size] @ q[size:].T)
        else:
            c = np.linalg.cholesky(np.eye(size) + w * (x.T @ x))
            new = v / w * x + (u - v / w) * np.linalg.solve(c.T, np.linalg.solve(c, x.T)).T
        new = (new + new.T) / 2
        low = min(1.0, low * (u + v * low * low) / (1 + w * low * low))
        moved, x = np.linalg.norm(new - x), new
        if low > 1 - 8 * EPS and moved < np.cbrt(4 * EPS):
            break
    return x


def halves(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Orthonormal bases of the invariant subspaces above and below a shift, both of one dimension at least.

    The middle of the diagonal is the first shift; others follow while a shift meets an eigenvalue or
    leaves a side empty. The mean of the eigenvalues has some on either side unless all are equal.
    """
    size = len(a)
    mean = np.trace(a) / size
    spread = np.linalg.norm(a - mean * np.eye(size)) / np.sqrt(size)
    draw = np.random.default_rng(size).normal(size=(size, size))
    best = None
    for shift in (np.median(np.diag(a)), mean, *(mean + f * spread for f in (0.11, -0.13, 0.37, -0.41, 0.73, -0.79))):
        u = polar_factor(a - shift * np.eye(size))
        k = round((np.trace(u) + size) / 2)
        if not 0 < k < size:
            continue
        p, q = (np.eye(size) + u) / 2, draw
        for _ in range(2):  # ranges of the projector and of its complement
            q = np.linalg.qr(np.concatenate([p @ q[:, :k], q[:, k:] - p @ q[:, k:]], axis=1))[0]
        left = np.linalg.norm(q[:, :k].T @ a @ q[:, k:])
        if best is None or left < best[0]:
            best = left, q[:, :k], q[:, k:]
        if left <= 8 * size * EPS * np.linalg.norm(a):
            break
    if best is None:  # eigenvalues that no double between them tells apart
        return np.eye(size)[:, :1], np.eye(size)[:, 1:]
    return best[1:]


def components(v: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The greatest eigenvalues of a symmetric matrix, falling, and their unit vectors as rows; signs are fixed."""
    size, whole = len(v), np.linalg.norm(v)
    values: list[float] = []
    vectors: list[np.ndarray] = []
    waiting = [np.eye(size)]  # bases of disjoint invariant subspaces, the uppermost last
    while waiting and len(values) < count:
        basis = waiting.pop()
        a = basis.T @ v @ basis
        a = (a + a.T) / 2
        if len(a) == 1 or np.linalg.norm(a - np.diag(np.diag(a))) <= EPS * whole:
            order = np.argsort(-np.diag(a), kind="stable")
            values += np.diag(a)[order].tolist()
            vectors += list(basis.T[order])
            continue
        upper, lower = halves(a)
        waiting += [basis @ lower, basis @ upper]
    order = np.argsort(-np.array(values), kind="stable")[:count]
    found = np.array([vectors[k] for k in order]).reshape(len(order), size)
    found /= np.linalg.norm(found, axis=1, keepdims=True)
    signs = np.where(found[np.arange(len(found)), np.abs(found).argmax(1)] < 0, -1.0, 1.0) if size else np.zeros(0)
    return np.array([values[k] for k in order]), found * signs[:, None]


def whole(vectors: DataFrame, id_col: str, vector_col: str, scale: float, shift: int) -> DataFrame:
    """vec_id, dim, x: the rows that take part; x is the bytes of the integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            at = np.asarray(lists.offsets, np.int64)
            c = lists.values.to_numpy(zero_copy_only=False).astype(np.float64)
            bad = np.concatenate([[0], np.cumsum(~np.isfinite(c))])
            keep = np.flatnonzero((bad[at[1:]] == bad[at[:-1]]) & np.asarray(lists.is_valid()))
            with np.errstate(invalid="ignore", over="ignore"):
                x = np.clip(np.nan_to_num(np.floor(c * scale), posinf=EDGE, neginf=-EDGE), -EDGE, EDGE).astype("<i8") + shift
            data = [x[at[i] : at[i + 1]].tobytes() for i in keep]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep)), pa.array(np.diff(at)[keep], pa.int32()), pa.array(data, pa.binary())], names=["vec_id", "dim", "x"])

    own = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("c")).where("c is not null")
    return own.mapInArrow(run, "vec_id long, dim int, x binary")


def blocks(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, rows, integers) of the vectors of each length, a bounded number at once."""
    dims = batch.column(batch.schema.get_field_index("dim")).to_numpy()
    data = batch.column(batch.schema.get_field_index("x"))
    for dim in np.unique(dims[dims > 0]).tolist():
        of = np.flatnonzero(dims == dim)
        step = max(1, VALUES // dim)
        for start in range(0, len(of), step):
            rows = of[start : start + step]
            yield dim, rows, np.frombuffer(b"".join(data.take(pa.array(rows)).to_pylist()), "<i8").reshape(len(rows), dim)


def sums(fit: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """Of each length: the number of vectors and the exact sum of each dimension (two numbers a dimension and task)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list] = {}
        for batch in batches:
            for dim, rows, x in blocks(batch):
                own = found.setdefault(dim, [0, np.zeros(dim, np.int64), np.zeros(dim, np.int64)])
                own[0] += len(rows)
                own[1] += (x >> 32).sum(0)
                own[2] += (x & 0xFFFFFFFF).sum(0)
        for dim, (n, high, low) in found.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(dim, dim, np.int32)), pa.array(np.arange(dim, dtype=np.int32)), pa.array(np.full(dim, n)), pa.array(high), pa.array(low)], names=["dim", "pos", "n", "high", "low"])

    each = fit.mapInArrow(run, "dim int, pos int, n long, high long, low long")
    total = each.groupBy("dim", "pos").agg(F.sum("n").alias("n"), *(F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("high", "low")))
    out: dict[int, tuple[int, list[int]]] = {}
    for r in total.orderBy("dim", "pos").collect():  # a row for each dimension
        out.setdefault(r["dim"], (r["n"], []))[1].append((int(r["high"]) << 32) + int(r["low"]))
    return out


class Mean:
    """Whole part and rest of the mean, so that centring loses nothing: x - S / n = (x - m) - r / n."""

    def __init__(self, n: int, total: list[int]) -> None:
        self.n = n
        self.m = np.array([s // n for s in total], np.int64)
        self.r = [s % n for s in total]
        self.part = np.array([r / n for r in self.r])

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.m).astype(np.float64) - self.part

    def deviation(self, x: np.ndarray) -> np.ndarray:
        """The exact sum of (n x - S) ** 2 of each row, cut to the range of a long."""
        y = x - self.m
        most = self.n * (int(np.abs(y).max(initial=0)) + 1)
        if most * most * max(1, x.shape[1]) < LONG:
            t = y * self.n - np.array(self.r, np.int64)
            return (t * t).sum(1)
        return np.array([min(LONG, sum((int(v) * self.n - r) ** 2 for v, r in zip(row, self.r, strict=True))) for row in y], np.int64)


class Projection:
    """Vectors of integers to whitened components; those without variance are nan."""

    def __init__(self, mean: Mean, e: np.ndarray, q: np.ndarray, trace: float) -> None:
        self.mean = mean
        self.fine = e > max(trace, 0.0) * q.shape[1] * EPS
        self.turned = (q / np.sqrt(np.where(self.fine, e, 1.0))[:, None]).T
        self.explained = e / trace if trace > 0 else np.zeros(len(e))

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return np.where(self.fine, self.mean.centred(x) @ self.turned, np.nan)

    def with_one(self, x: np.ndarray) -> np.ndarray:
        """The components, 0 for those without variance, and a 1 that sums them."""
        return np.concatenate([np.nan_to_num(self(x)), np.ones((len(x), 1))], axis=1)


def summed(fit: DataFrame, made: dict, name: str) -> DataFrame:
    """dim, i, line: rows of the summed products of ``made[dim](vectors)`` with themselves, over the fit list.

    Each task sums one matrix of its own; a line of all tasks' matrices is then added up in one place.
    """
    shared = fit.sparkSession.sparkContext.broadcast(made)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            for dim, _, x in blocks(batch):
                y = shared.value[dim](x)
                product = y.T @ y
                found[dim] = found[dim] + product if dim in found else product
        for dim, matrix in found.items():
            for start in range(0, len(matrix), 256):
                lines = [row.tobytes() for row in matrix[start : start + 256]]
                i = np.arange(start, start + len(lines), dtype=np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), dim, np.int32)), pa.array(i), pa.array(lines, pa.binary())], names=["dim", "i", "line"])

    def added(frame: pd.DataFrame) -> pd.DataFrame:
        out = np.zeros(len(frame["line"].iloc[0]) // 8)
        for line in frame["line"]:
            out += np.frombuffer(line)
        return pd.DataFrame({"dim": frame["dim"].iloc[:1], "i": frame["i"].iloc[:1], "line": [out.tobytes()]})

    each = fit.coalesce(SUMS).mapInArrow(run, "dim int, i int, line binary")
    return stored(each.groupBy("dim", "i").applyInPandas(added, "dim int, i int, line binary"), name)


def solved(lines: DataFrame, means: dict[int, Mean], count: int) -> dict[int, tuple[np.ndarray, np.ndarray, float]]:
    """Of each length: eigenvalues and vectors of the greatest components, and the trace; a length is one task's work."""
    n = {dim: mean.n for dim, mean in means.items()}

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        dim = int(frame["dim"].iloc[0])
        v = np.array([np.frombuffer(x) for x in frame.sort_values("i")["line"]]) / n[dim]
        v = (v + v.T) / 2
        values, vectors = components(v, min(count, dim))
        return pd.DataFrame({"dim": [dim], "e": [values.tobytes()], "q": [vectors.tobytes()], "trace": [float(np.trace(v))]})

    found = lines.groupBy("dim").applyInPandas(run, "dim int, e binary, q binary, trace double").collect()  # count vectors a length
    return {r["dim"]: (np.frombuffer(bytes(r["e"])), np.frombuffer(bytes(r["q"])).reshape(-1, r["dim"]), r["trace"]) for r in found}


def whiten(vectors: DataFrame, count: int = COMPONENTS, scale: float = SCALE, shift: int = SHIFT, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for each vector and component."""
    rows = whole(vectors, id_col, vector_col, scale, shift)
    fit = stored(rows.where("dim > 0").select("dim", "x").distinct(), "whiten-fit")
    means = {dim: Mean(*found) for dim, found in sums(fit).items()}
    if not means:
        return vectors.sparkSession.createDataFrame([], RESULT)
    models = solved(summed(fit, {dim: mean.centred for dim, mean in means.items()}, "whiten-covariance"), means, count)

    projections = {dim: Projection(means[dim], *models[dim]) for dim in means}
    errors = dict.fromkeys(means, 0.0)
    gathered: dict[int, list] = {}
    for r in summed(fit, {dim: p.with_one for dim, p in projections.items()}, "whiten-identity").collect():  # count + 1 lines a length
        gathered.setdefault(r["dim"], []).append((r["i"], np.frombuffer(bytes(r["line"]))))
    for dim, lines in gathered.items():
        s = np.array([line for _, line in sorted(lines, key=lambda x: x[0])])
        n, fine = s[-1, -1], np.flatnonzero(np.diag(s)[:-1] > 0)
        center = s[-1, :-1] / n
        off = (s[:-1, :-1] / n - np.outer(center, center))[np.ix_(fine, fine)] - np.eye(len(fine))
        errors[dim] = float(np.abs(off).max(initial=0.0))
    shared = vectors.sparkSession.sparkContext.broadcast((projections, errors))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, at, x in blocks(batch):
                own, error = (table[dim] for table in shared.value)
                y, k = own(x), len(own.explained)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(np.repeat(at, k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(at))), pa.array(np.full(len(at) * k, own.mean.n)),
                        pa.array(np.repeat(own.mean.deviation(x), k)), pa.array(y.ravel(), mask=np.isnan(y.ravel())), pa.array(np.tile(own.explained, len(at))), pa.array(np.full(len(at) * k, error)),
                    ],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return rows.mapInArrow(run, RESULT)
