"""Whitening of embeddings on eigenvectors refined in mixed precision.

Sums and second moments are taken by tasks over integers, exactly, and so is the
covariance. Its eigenvectors are computed in float32 and then corrected by the
iterations of Ogita and Aishima, which consist of matrix products only, here in
extended precision; where eigenvalues lie closer together than the error of the
vectors, the small problem inside such a cluster is solved by itself first.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WIDE = np.longdouble
LIMIT = 1 << 40  # entries are taken as integers up to this size


def _clusters(values: np.ndarray, delta: float) -> list[np.ndarray]:
    """Places of eigenvalues that follow each other at a distance of at most delta, two or more."""
    order = np.argsort(values, kind="stable")
    near = np.diff(values[order]) <= delta
    parts = np.split(order, np.flatnonzero(~near) + 1)
    return [p for p in parts if len(p) > 1]


def _measure(a: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """What is missing to orthonormal columns, the rotated matrix, its eigenvalues, and how far they can be trusted."""
    r = np.eye(len(a), dtype=WIDE) - x.T @ x
    s = x.T @ (a @ x)
    s = (s + s.T) / 2
    values = np.diag(s) / (1 - np.diag(r))
    off = s - np.diag(values)
    norm = np.sqrt((a * a).sum())
    delta = 2 * (np.sqrt((off * off).sum()) + norm * np.sqrt((r * r).sum()))
    # below this distance eigenvalues differ by rounding only
    return r, s, values, max(delta, 64 * len(a) * np.finfo(WIDE).eps * norm)


def eigen(matrix: np.ndarray, rounds: int = 40) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of a symmetric matrix, falling, and unit eigenvectors as columns, to double precision.

    The matrix may be in extended precision. The sign of a vector is such that its
    entry of largest size, the first of them, is positive.
    """
    a = np.asarray(matrix, dtype=WIDE)
    d = len(a)
    scale = np.abs(a).max() if d else WIDE(0)
    if not scale:
        return np.zeros(d), np.eye(d)
    a = a / scale
    x = np.linalg.eigh(a.astype(np.float32))[1].astype(WIDE)
    tolerance = 8 * d * np.finfo(WIDE).eps
    best, stale = (np.inf, x), 0
    for _ in range(rounds):
        r, s, values, delta = _measure(a, x)
        for near in _clusters(values, delta):
            block = s[np.ix_(near, near)]
            middle = values[near].mean()
            # x is not orthonormal yet: the part of the middle value that it lacks or has too much
            block = block - middle * (np.eye(len(near), dtype=WIDE) - r[np.ix_(near, near)])
            size = np.abs(block).max()
            if size > tolerance * tolerance:
                x[:, near] = x[:, near] @ np.linalg.eigh((block / size).astype(np.float64))[1].astype(WIDE)
        r, s, values, delta = _measure(a, x)
        off = s - np.diag(np.diag(s))
        error = max(np.abs(r).max(), np.abs(off).max())
        # close eigenvalues may make the error grow for a round or two
        best, stale = ((error, x), 0) if error < best[0] else (best, stale + 1)
        if error <= tolerance or stale > 4:
            break
        gap = values[None, :] - values[:, None]
        apart = np.abs(gap) > delta
        with np.errstate(divide="ignore", invalid="ignore"):
            x = x + x @ np.where(apart, (s + values[None, :] * r) / gap, r / 2)
    x = best[1]
    x = x / np.sqrt((x * x).sum(axis=0))
    values = np.diag(x.T @ (a @ x))
    order = np.argsort(-values, kind="stable")
    x, values = x[:, order], values[order] * scale
    largest = np.abs(x.astype(float)).argmax(axis=0)
    x = x * np.where(x[largest, np.arange(d)] < 0, -1, 1)
    return values.astype(float), x.astype(float)


def _matrix(batch, d: int, scale: int, shift: int) -> tuple[pa.Array, np.ndarray]:
    """Ids and integer vectors of the rows that take part."""
    vectors = batch.column("vector")
    mine = pc.fill_null(pc.equal(pc.list_value_length(vectors), d), False)
    values = vectors.filter(mine).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, d)
    whole = np.isfinite(values).all(axis=1)
    limit = float(LIMIT)
    numbers = np.clip(np.floor(values[whole] * scale), -limit, limit).astype(np.int64) + shift
    return batch.column("id").filter(mine).filter(pa.array(whole)), numbers


def _gram(x: np.ndarray) -> np.ndarray:
    """Sum of the products of all pairs of columns, exactly."""
    most = int(np.abs(x).max(initial=0))
    if most * most * max(len(x), 1) < 1 << 53:
        f = x.astype(float)
        return (f.T @ f).astype(np.int64).astype(object)
    x = x.astype(object)
    return x.T @ x


def _summed(rows: DataFrame, size: int, blocks: Callable[[Iterator], Iterator[np.ndarray]]) -> list[int]:
    """Exact sums of ``size`` integers over all blocks of all tasks; one line a number reaches the driver."""

    def partial(batches):
        total = np.zeros(size, dtype=object)
        for block in blocks(batches):
            total = total + block
        # Spark adds up decimals of 38 digits: larger numbers are sent in two parts
        low = [int(v) % (1 << 60) for v in total]
        high = [int(v) >> 60 for v in total]
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(size), pa.int32()), pa.array(low, pa.int64()), pa.array(high, pa.int64())], names=["at", "low", "high"]
        )

    total = F.sum(F.col("low").cast("decimal(38,0)")), F.sum(F.col("high").cast("decimal(38,0)"))
    sums = rows.mapInArrow(partial, "at int, low bigint, high bigint").groupBy("at").agg(*total).collect()
    out = [0] * size
    for at, low, high in sums:
        out[at] = int(low) + (int(high) << 60)
    return out


class Whitener:
    """The fitted numbers: exact sums, the covariance, its components."""

    def __init__(self, d: int, n: int, sums: list[int], middle: list[int], moments: np.ndarray, components: int):
        self.d, self.n, self.middle = d, n, np.array(middle, dtype=np.int64)
        # of the vectors less the rounded mean; what rounding left is taken off exactly
        self.rest = [s - n * m for s, m in zip(sums, middle)]
        numer = moments * n - np.outer(np.array(self.rest, dtype=object), np.array(self.rest, dtype=object))
        whole = n * n
        covariance = np.array([[_ratio(v, whole) for v in row] for row in numer], dtype=WIDE).reshape(d, d)
        self.covariance = covariance.astype(float)
        self.trace = float(np.trace(covariance))
        values, vectors = eigen(covariance)
        k = min(components, d)
        self.values, self.vectors = values[:k], vectors[:, :k]
        # a direction without variance cannot be scaled to one
        self.live = self.values > max(values[:1].max(initial=0.0), 0.0) * d * np.finfo(float).eps
        self.explained = [float(v) / self.trace if self.trace > 0 else 0.0 for v in self.values]

    def parts(self, numbers: np.ndarray) -> tuple[list, np.ndarray]:
        """Deviation and whitened values (NaN for a direction without variance) of integer vectors."""
        x = numbers - self.middle
        most = self.n * int(np.abs(x).max(initial=0)) + max(map(abs, self.rest), default=0)
        if most * most * self.d < 1 << 63:
            y = x * self.n - np.array(self.rest, dtype=np.int64)
            deviation = (y * y).sum(axis=1).tolist()
        else:
            y = x.astype(object) * self.n - np.array(self.rest, dtype=object)
            deviation = [v if v < 1 << 63 else None for v in (y * y).sum(axis=1)]
        centred = x - np.array([_ratio(r, self.n) for r in self.rest], dtype=WIDE).astype(float)
        out = np.full((len(x), len(self.values)), np.nan)
        out[:, self.live] = centred @ (self.vectors[:, self.live] / np.sqrt(self.values[self.live]))
        return deviation, out


def _ratio(a: int, b: int) -> np.longdouble:
    """a / b in extended precision."""
    high = int(a) / int(b)
    p, q = high.as_integer_ratio()
    return WIDE(high) + WIDE((int(a) * q - p * int(b)) / (int(b) * q))


def fit(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 32, scale: int = 64, shift: int = 1_000_000
) -> tuple[DataFrame, Whitener | None]:
    """The rows as ``id, vector``, and the numbers fitted on them; none if no row takes part.

    Vectors that are null, empty or hold null or non-finite entries take no part, and
    neither do those of another length than most have (the greater length in a tie).
    """
    v = F.col(vector_col)
    rows = vectors.select(F.col(id_col).alias("id"), v.cast("array<double>").alias("vector"))
    fine = ~F.exists("vector", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    lengths = rows.where(fine & (F.size("vector") > 0)).groupBy(F.size("vector").alias("d")).count()
    top = lengths.orderBy(F.desc("count"), F.desc("d")).first()
    if top is None:
        return rows, None
    d, n = top["d"], top["count"]

    def each(batches):
        for batch in batches:
            yield _matrix(batch, d, scale, shift)[1]

    def sums(batches):
        for x in each(batches):
            yield x.sum(axis=0).astype(object)

    total = _summed(rows, d, sums)
    middle = [(2 * s + n) // (2 * n) for s in total]
    upper = np.triu_indices(d)

    def moments(batches):
        for x in each(batches):
            yield _gram(x - np.array(middle, dtype=np.int64))[upper]

    gram = np.zeros((d, d), dtype=object)
    gram[upper] = _summed(rows, d * (d + 1) // 2, moments)
    gram.T[upper] = gram[upper]
    return rows, Whitener(d, n, total, middle, gram, components)


def identity_error(rows: DataFrame, model: Whitener, scale: int, shift: int) -> float:
    """Largest entry, by size, of the whitened values' covariance minus the identity."""
    k = int(model.live.sum())
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def partial(batches):
        total = np.zeros((k, k + 1))
        for batch in batches:
            x = _matrix(batch, shared.value.d, scale, shift)[1]
            white = shared.value.parts(x)[1][:, shared.value.live]
            total[:, :k] += white.T @ white
            total[:, k] += white.sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(range(total.size), pa.int32()), pa.array(total.ravel())], names=["at", "v"])

    sums = rows.mapInArrow(partial, "at int, v double").groupBy("at").agg(F.sum("v")).collect()
    total = np.zeros(k * (k + 1))
    for at, v in sums:
        total[at] = v
    total = total.reshape(k, k + 1) / model.n
    shared.unpersist()
    # the values were centred before; their mean is what rounding leaves
    covariance = total[:, :k] - np.outer(total[:, k], total[:, k])
    return float(np.abs(covariance - np.eye(k)).max(initial=0.0))


def whiten(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    components: int = 32,
    scale: int = 64,
    shift: int = 1_000_000,
) -> DataFrame:
    """A row for each remaining row and component: id, component, n, deviation, whitened, explained, identity_error.

    An entry c counts as floor(scale * c) + shift (|scale * c| up to 2^40). See ``fit`` for
    the rows left out; repeated and null ids are rows like others, extra columns are left
    out, and a table without a usable vector gives no row. ``deviation`` is null where it
    is beyond 63 bits; ``whitened`` is null for a component without variance (eigenvalue
    within rounding of zero: all of them if all vectors are equal), which identity_error
    leaves out.
    """
    rows, model = fit(vectors, id_col, vector_col, components, scale, shift)
    kind = rows.schema["id"].dataType.simpleString()
    if model is None:
        return rows.sparkSession.createDataFrame(
            [], f"{id_col} {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
        )
    error = identity_error(rows, model, scale, shift)
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for batch in batches:
            ids, x = _matrix(batch, m.d, scale, shift)
            deviation, white = m.parts(x)
            k = white.shape[1]
            flat = pa.array(white.ravel(), pa.float64(), from_pandas=True)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * k), flat)
            yield pa.RecordBatch.from_arrays([ids, pa.array(deviation, pa.int64()), lists], names=["id", "deviation", "white"])

    found = rows.mapInArrow(run, f"id {kind}, deviation bigint, white array<double>")
    each = found.select("id", "deviation", F.posexplode("white").alias("_at", "whitened"))
    explained = F.array(*[F.lit(e) for e in model.explained])
    return each.select(
        F.col("id").alias(id_col), (F.col("_at") + 1).cast("int").alias("component"), F.lit(model.n).cast("bigint").alias("n"),
        "deviation", "whitened", explained[F.col("_at")].alias("explained"), F.lit(error).alias("identity_error"),
    )
