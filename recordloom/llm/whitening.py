"""Whitening of embeddings from an exact integer scatter matrix.

Entries become integers, a shift is subtracted, and each task adds up sums and cross-products exactly: a vector is cut
into signed limbs that are small enough for products of a whole block to be exact in doubles. The tasks' sums travel as
limbs of 30 bits in longs, which Spark adds up, so what reaches the driver is a matrix's worth of numbers, however many
rows there are. n·YᵀY - SSᵀ is formed in Python's integers; only then are there floats, which eigh decomposes.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the contract: an entry c becomes floor(64 c) + 1,000,000.
SCALE, SHIFT = 64, 1_000_000
#: Rows of a block, and bits of a limb: BLOCK products of two limbs stay below 2^53.
BLOCK, LIMB = 4096, 20
#: Bits of the limbs in which sums travel; so many of them.
SENT, PARTS = 30, 7
#: Bits behind the point with which whitened values are measured again.
MEASURE = 40
_LOW, _HIGH = -(1 << 63), (1 << 63) - 1 - SHIFT


class Whitening(NamedTuple):
    """What is fitted: rows, per-dimension sums of the shifted integers, components, their scales and shares."""

    n: int
    sums: list[int]
    axes: np.ndarray  # dimensions x components
    values: np.ndarray  # eigenvalues of the components, 0 where there is no variance
    explained: np.ndarray


def valid(vector: Column) -> Column:
    """Not null, and without null or non-finite entries."""
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def shifted(vectors: np.ndarray) -> np.ndarray:
    """x - SHIFT as int64; what a long can't hold becomes the nearest that it can."""
    return as_long(np.floor(vectors * SCALE))


def as_long(values: np.ndarray) -> np.ndarray:
    return np.clip(np.clip(values, -(2.0**63), 2.0**63 - 1024).astype(np.int64), _LOW, _HIGH)


def _limbs(y: np.ndarray) -> list[np.ndarray]:
    """Signed limbs of LIMB bits, lowest first, as doubles; as many as the largest entry needs."""
    out = []
    while y.any():
        low = y & (1 << LIMB) - 1
        low -= (low >> LIMB - 1) << LIMB
        out.append(low.astype(np.float64))
        y = (y - low) >> LIMB
    return out


class Scatter:
    """Exact sums and cross-products of rows of int64, gathered by the limbs' weight in longs, which are emptied into Python's integers in time."""

    def __init__(self, d: int):
        self.sums, self.products = np.zeros(d, object), np.zeros((d, d), object)
        self.waiting: dict[int, np.ndarray] = {}
        self.blocks = 0

    def add(self, y: np.ndarray) -> None:
        for begin in range(0, len(y), BLOCK):
            limbs = _limbs(y[begin : begin + BLOCK])
            for i, a in enumerate(limbs):
                self.sums += a.sum(axis=0).astype(np.int64).astype(object) << LIMB * i
                for j, b in enumerate(limbs[: i + 1]):
                    exact = (a.T @ b).astype(np.int64)
                    self.waiting[i + j] = self.waiting.get(i + j, 0) + (exact if i == j else exact + exact.T)
            self.blocks += 1
            if self.blocks % 256 == 0:  # each block adds less than 2^54
                self.empty()

    def empty(self) -> None:
        for weight, x in self.waiting.items():
            self.products += x.astype(object) << LIMB * weight
        self.waiting = {}


def _sent(value: int) -> list[int]:
    """Limbs of SENT bits whose weighted sum is the value; the last keeps the sign."""
    return [value >> SENT * k & (1 << SENT) - 1 if k < PARTS - 1 else value >> SENT * k for k in range(PARTS)]


def _matrix(column) -> list[tuple[np.ndarray, np.ndarray]]:
    """The vectors of an Arrow list column by length: their places and a matrix."""
    import pyarrow.compute as pc

    lengths = np.asarray(pc.list_value_length(column))
    flat, ends = np.asarray(column.flatten(), np.float64), np.cumsum(lengths)
    return [(at := np.flatnonzero(lengths == d), flat[(ends[at] - d)[:, None] + np.arange(d)]) for d in np.unique(lengths)]


def _partial(integers):
    """A task's n, sums and cross-products as (i, j, limbs): (-1, -1) for n, (-1, j) for sums, i <= j for products."""

    def run(batches):
        import pyarrow as pa

        n, totals = 0, {}
        for batch in batches:
            n += batch.num_rows
            for _, vectors in _matrix(batch.column(0)):
                totals.setdefault(d := vectors.shape[1], Scatter(d)).add(integers(vectors))
        out = [(-1, -1, _sent(n))]
        for total in totals.values():
            total.empty()
            out += [(-1, j, _sent(x)) for j, x in enumerate(total.sums.tolist())]
            out += [(i, j, _sent(x)) for i, row in enumerate(total.products.tolist()) for j, x in enumerate(row[i:], i)]
        columns = [pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.int32()), *[pa.array([x[2][k] for x in out], pa.int64()) for k in range(PARTS)]]
        yield pa.RecordBatch.from_arrays(columns, names=["i", "j", *(f"limb{k}" for k in range(PARTS))])

    return run


def exact_scatter(vectors: DataFrame, integers=shifted) -> tuple[int, list[int], list[list[int]]]:
    """n, S and n·YᵀY - SSᵀ over the first column's vectors, exactly. Shorter vectors count as continued with zeros."""
    partial = vectors.mapInArrow(_partial(integers), "i int, j int, " + ", ".join(f"limb{k} long" for k in range(PARTS)))
    rows = partial.groupBy("i", "j").agg(*[F.sum(f"limb{k}").alias(f"limb{k}") for k in range(PARTS)]).collect()
    values = {(r.i, r.j): sum(r[f"limb{k}"] << SENT * k for k in range(PARTS)) for r in rows}
    n, d = values.pop((-1, -1), 0), 1 + max((j for _, j in values), default=-1)
    sums = [values[-1, j] for j in range(d)]
    return n, sums, [[n * values[min(i, j), max(i, j)] - sums[i] * sums[j] for j in range(d)] for i in range(d)]


def decompose(n: int, sums: list[int], centred: list[list[int]], components: int = 32) -> Whitening:
    """The leading eigenvectors of the covariance centred / n². A direction whose variance is lost in rounding has eigenvalue 0."""
    if not n or not sums:
        return Whitening(n, sums, np.zeros((len(sums), 0)), np.zeros(0), np.zeros(0))
    covariance = np.array([[x / (n * n) for x in row] for row in centred])
    values, axes = np.linalg.eigh(covariance)
    values, axes = values[::-1][:components], axes[:, ::-1][:, :components]
    trace = sum(centred[i][i] for i in range(len(sums))) / (n * n)
    values = np.where(values > 4 * len(sums) * np.finfo(float).eps * max(values[0], 0.0), values, 0.0)
    return Whitening(n, sums, np.ascontiguousarray(axes), values, values / trace if trace else values)


def fit(embeddings: DataFrame, vector_col: str = "embedding", components: int = 32) -> Whitening:
    """The whitening of all valid vectors; see whiten()."""
    vector = F.col(vector_col)
    return decompose(*exact_scatter(embeddings.where(valid(vector)).select(vector.cast("array<double>").alias("v"))), components)


def _whitened(y: np.ndarray, fitted: Whitening) -> tuple[list[int], np.ndarray]:
    """deviation and the components of rows of shifted integers."""
    d = len(fitted.sums)
    y = np.pad(y, ((0, 0), (0, d - y.shape[1])))
    bound = fitted.n * max(abs(int(y.max(initial=0))), abs(int(y.min(initial=0)))) + max(map(abs, fitted.sums), default=0)
    wide = object if bound * bound * max(d, 1) >= 1 << 63 else np.int64
    centred = y.astype(wide) * fitted.n - np.array(fitted.sums, wide)
    scale = np.divide(1.0, np.sqrt(fitted.values), out=np.zeros_like(fitted.values), where=fitted.values > 0)
    return [int(x) for x in (centred * centred).sum(axis=1)], (centred.astype(np.float64) / fitted.n) @ (fitted.axes * scale)


def _apply(fitted: Whitening):
    def run(batches):
        import pyarrow as pa

        k = len(fitted.values)
        for batch in batches:
            deviations, out = [0] * batch.num_rows, np.zeros((batch.num_rows, k))
            for at, vectors in _matrix(batch.column(1)):
                found, out[at] = _whitened(shifted(vectors), fitted)
                for place, x in zip(at.tolist(), found, strict=True):
                    deviations[place] = x
            deviations = pa.array([str(x) for x in deviations], pa.string())
            values = pa.ListArray.from_arrays(pa.array(np.arange(0, batch.num_rows * k + 1, k) if k else np.zeros(batch.num_rows + 1), pa.int32()), pa.array(out.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), deviations, values], names=["id", "deviation", "whitened"])

    return run


def transform(embeddings: DataFrame, fitted: Whitening, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id, deviation (the exact sum's digits, a string) and whitened (an array over the components) of each valid vector.

    whitened is 0 along a component without variance. A vector longer than those of the fit can't be transformed; a
    shorter one counts as continued with zeros. Null ids and repeated rows stay, an empty table gives no rows, other
    columns aren't read.
    """
    vector = F.col(vector_col)
    rows = embeddings.where(valid(vector)).select(F.col(id_col).cast("long").alias("id"), vector.cast("array<double>").alias("v"))
    return rows.mapInArrow(_apply(fitted), "id long, deviation string, whitened array<double>")


def identity_error(transformed: DataFrame, fitted: Whitening) -> float:
    """The largest absolute entry of the whitened values' covariance less the identity, over components with variance.

    The values are added up exactly, after rounding to MEASURE bits behind the point.
    """
    n, _, centred = exact_scatter(transformed.select("whitened"), lambda w: as_long(np.rint(w * 2.0**MEASURE)))
    kept = np.flatnonzero(fitted.values > 0).tolist()
    if not n or not kept:
        return 0.0
    unit = (n << MEASURE) ** 2
    return max(abs(centred[i][j] - unit * (i == j)) / unit for i in kept for j in kept)


def whiten(embeddings: DataFrame, components: int = 32, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """A row for each valid vector and component: vec_id, component, n, deviation, whitened, explained, identity_error.

    Vectors that are null or hold null, NaN or infinite entries go. Shorter vectors count as continued with zeros.
    deviation is null where a long can't hold the sum. Fewer vectors than dimensions leave directions without variance,
    where whitened and explained are 0; identity_error covers the others. Ties of eigenvalues come in eigh's order.
    """
    fitted = fit(embeddings, vector_col, components)
    rows = transform(embeddings, fitted, id_col, vector_col)
    explained = F.array(*[F.lit(float(x)) for x in fitted.explained]) if len(fitted.explained) else F.array().cast("array<double>")
    spread = rows.select("id", F.expr("try_cast(deviation AS long)").alias("deviation"), F.posexplode("whitened").alias("place", "whitened"))
    return spread.select(F.col("id").alias("vec_id"), (F.col("place") + 1).alias("component"), F.lit(fitted.n).cast("long").alias("n"), "deviation", "whitened", F.get(explained, F.col("place")).alias("explained"), F.lit(identity_error(rows, fitted)).alias("identity_error"))
