"""Whitening of embeddings by exact integer covariances: variances of dimensions and of their pair sums give them all."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.topk import rows_of, scaled
from tidelog.tables import written

#: Rows whose sums a task adds at once, in longs where they can't overflow.
SLAB_ROWS = 256
EXACT = "decimal(38,0)"


def added(values: np.ndarray, bits: int) -> list[int]:
    """Exact column sums of integers of at most `bits` bits; in slabs of longs, or of Python's integers where those don't suffice."""
    slab = SLAB_ROWS if bits + SLAB_ROWS.bit_length() < 63 else 1
    if bits >= 63:
        values = values.astype(object)
    sums = [0] * values.shape[1]
    for a in range(0, len(values), slab):
        sums = [s + int(v) for s, v in zip(sums, values[a : a + slab].sum(axis=0), strict=True)]
    return sums


def bits_of(x: np.ndarray) -> int:
    return max(int(x.max(initial=0)), -int(x.min(initial=0))).bit_length()


def column_sums(fit: DataFrame) -> DataFrame:
    """(i, total, n): the exact sum of each dimension, and the rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, n = None, 0
        for batch in batches:
            for _, x in rows_of(batch.column("x")):
                own = added(x, bits_of(x))
                sums, n = own if sums is None else [a + b for a, b in zip(sums, own, strict=True)], n + len(x)
        if n:
            yield totals(np.arange(len(sums))[:, None], sums, n)

    return fit.mapInArrow(run, f"i int, total {EXACT}, n long").groupBy("i").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))


def totals(at: np.ndarray, sums: list[int], n: int | None = None) -> pa.RecordBatch:
    from decimal import Decimal

    names = ["i", "j"][: at.shape[1]]
    arrays = [*[pa.array(at[:, k].astype(np.int32)) for k in range(at.shape[1])], pa.array([Decimal(s) for s in sums], pa.decimal128(38, 0))]
    return pa.RecordBatch.from_arrays([*arrays, *([pa.array(np.full(len(sums), n))] if n is not None else [])], [*names, "total", *(["n"] if n is not None else [])])


def squared_sums(fit: DataFrame, centre: np.ndarray) -> DataFrame:
    """(i, j, total): exact sums of z_i ** 2 (j = i) and of (z_i + z_j) ** 2 (i < j), z = x - centre."""
    shared = fit.sparkSession.sparkContext.broadcast(centre)  # a number a dimension

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d, sums = len(shared.value), None
        i, j = np.triu_indices(d)
        for batch in batches:
            for _, x in rows_of(batch.column("x")):
                z = x - shared.value
                bits = 2 * (bits_of(z) + 1)
                if bits >= 63:
                    z = z.astype(object)
                own = []
                for k in range(d):
                    own += added(np.concatenate((z[:, k : k + 1] ** 2, (z[:, k : k + 1] + z[:, k + 1 :]) ** 2), axis=1), bits)
                sums = own if sums is None else [a + b for a, b in zip(sums, own, strict=True)]
        if sums is not None:
            yield totals(np.stack((i, j), axis=1), sums)

    return fit.mapInArrow(run, f"i int, j int, total {EXACT}").groupBy("i", "j").agg(F.sum("total").alias("total"))


@dataclass
class Whitening:
    """n fit rows; S = n * centre + rest of each dimension; components by falling eigenvalue, one a row; their shares of the trace."""

    n: int
    centre: np.ndarray
    rest: np.ndarray
    components: np.ndarray
    values: np.ndarray
    explained: np.ndarray

    def project(self, x: np.ndarray) -> np.ndarray:
        """Coordinates x - S / n along the components, each of variance 1 over the fit rows; NaN where a component has none."""
        centred = (x - self.centre) - self.rest / self.n
        scale = np.where(self.values > 0, np.sqrt(np.maximum(self.values, 0)), np.nan)
        return centred @ self.components.T / scale

    def deviations(self, x: np.ndarray) -> list[int]:
        """Exact sums over dimensions of (n * x - S) ** 2, from z = x - centre: n * n * zz - 2 * n * z rest + rest rest."""
        z, rest = x - self.centre, self.rest
        if 2 * max(bits_of(z), bits_of(rest)) + len(self.centre).bit_length() >= 63:
            z, rest = z.astype(object), rest.astype(object)
        last = sum(int(r) ** 2 for r in self.rest)
        return [self.n * (self.n * int(a) - 2 * int(b)) + last for a, b in zip((z * z).sum(axis=1), (z * rest).sum(axis=1), strict=True)]


def fitted(fit: DataFrame, d: int, components: int) -> Whitening:
    """Covariances of the distinct vectors `fit`, and their first eigenvectors.

    Squares are taken of distances to the whole number below the mean, so that they stay small, and the rest of the mean
    is taken off exactly: sum (x - S/n) ** 2 = sum z ** 2 - rest ** 2 / n. The variance of a pair sum less both variances is
    twice the covariance. All of it is integers until the last division. What comes to the driver are d (d + 1) / 2 sums.
    """
    sums = sorted(column_sums(fit).collect())
    n = int(sums[0].n)
    centre, rest = zip(*[divmod(int(r.total), n) for r in sums], strict=True)
    centre, rest = list(centre), list(rest)
    spread = {(r.i, r.j): int(r.total) for r in squared_sums(fit, np.array(centre, np.int64)).collect()}
    # n * sum (centred sum of dimensions) ** 2
    one = [n * spread[i, i] - rest[i] ** 2 for i in range(d)]
    cov, trace = np.zeros((d, d)), sum(one)
    for (i, j), total in spread.items():
        if i == j:
            cov[i, i] = float(Fraction(one[i], n * n))
        else:
            cov[i, j] = cov[j, i] = float(Fraction(n * total - (rest[i] + rest[j]) ** 2 - one[i] - one[j], 2 * n * n))
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(-values, kind="stable")[:components]
    values, chosen = values[order], vectors[:, order].T
    largest = np.take_along_axis(chosen, np.abs(chosen).argmax(axis=1)[:, None], axis=1)
    chosen = chosen * np.where(largest < 0, -1.0, 1.0)
    values = np.where(values > 1e-12 * max(float(Fraction(trace, n * n)), 0.0), values, 0.0)
    explained = values / float(Fraction(trace, n * n)) if trace else np.full(len(values), np.nan)
    return Whitening(n, np.array(centre, np.int64), np.array(rest, np.int64), chosen, values, explained)


def identity_error(fit: DataFrame, model: Whitening) -> float | None:
    """Largest distance of the covariances of the whitened fit rows to the identity; of components with variance."""
    shared, some = fit.sparkSession.sparkContext.broadcast(model), np.flatnonzero(model.values > 0).tolist()
    if not some:
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, x in rows_of(batch.column("x")):
                yield pa.RecordBatch.from_arrays([pa.array(w) for w in shared.value.project(x).T[some]], [f"w{k}" for k in some])

    pairs = [(i, j) for i in some for j in some if i <= j]
    white = fit.mapInArrow(run, ", ".join(f"w{k} double" for k in some))
    found = white.agg(*[F.covar_pop(f"w{i}", f"w{j}").alias(f"c{i}_{j}") for i, j in pairs]).first()  # centred as it is summed
    return max(abs(found[f"c{i}_{j}"] - (i == j)) for i, j in pairs)


def whitened(vectors: DataFrame, components: int = 4, scale: int = 256, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """One row per vector and component: vec_id, component, n, deviation (exact, decimal), whitened, explained, identity_error.

    Components x become floor(scale * x), longs. The fit rows are each distinct vector once: n, with sums S. A component is a unit
    eigenvector of their covariance (divisor n), numbered by falling eigenvalue, its largest entry positive; `whitened` is x - S/n
    along it over the root of the eigenvalue, `explained` the eigenvalue's share of the trace, `deviation` the sum over
    dimensions of (n * x - S) ** 2. Vectors that are null or hold null or non-finite components have no rows. Those of another
    length than the commonest (the shorter on a tie) aren't fitted; their rows have null deviations and whitened values. Where a
    component has no variance `whitened` is null, and `explained` too where nothing has; a vector of few dimensions has as many components.
    Rows that repeat an id have rows each.

    Distinct vectors are found by one shuffle with partial aggregation, so that a vector that fills the table travels once a
    task; sums are added in tasks, and d (d + 1) / 2 of them come to the driver, as many as the covariance has entries.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(f"`{id_col}`").alias("vec_id"), scaled(F.col(f"`{vec_col}`"), scale).alias("x")).where("x is not null")
    kind = vectors.schema[id_col].dataType.simpleString()
    columns = f"vec_id {kind}, component int, n long, deviation {EXACT}, whitened double, explained double, identity_error double"
    lengths = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    if not lengths or not lengths[0]["d"]:
        return spark.createDataFrame([], columns)
    d = lengths[0]["d"]
    fit = written(rows.where(F.size("x") == d).select("x").distinct())
    model = fitted(fit, d, min(components, d))
    error = identity_error(fit, model)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from decimal import Decimal

        m = shared.value
        k = len(m.values)
        for batch in batches:
            for at, x in rows_of(batch.column("x")):
                fits = x.shape[1] == d
                white = m.project(x).ravel() if fits else np.full(len(x) * k, np.nan)
                deviation = [Decimal(v) if fits else None for v in (m.deviations(x) if fits else range(len(x))) for _ in range(k)]
                share = np.tile(m.explained, len(x))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("vec_id").take(pa.array(np.repeat(at, k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(len(x) * k, m.n)), pa.array(deviation, pa.decimal128(38, 0)),
                        pa.array(white, mask=np.isnan(white)), pa.array(share, mask=np.isnan(share)), pa.array([error] * (len(x) * k), pa.float64()),
                    ],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return rows.mapInArrow(run, columns)
