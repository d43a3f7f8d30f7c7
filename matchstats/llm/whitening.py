"""Whitening of embeddings with exact scatter from bit planes.

Each entry c becomes a whole number x = floor(1024 c) + 100000. In blocks of rows, each dimension is shifted by its
least value there and cut into bit planes, which are packed across rows into 64-bit words. The cross-product of two
dimensions is the sum of 2^(a + b) times the popcount of plane a of the one AND plane b of the other; the shifts are put
back in whole numbers. A block sends its sums and cross-products once, as decimals, and Spark adds them up: exact
whatever the order, and as many numbers as there are pairs of dimensions, whatever the rows.

With n rows, sums S and cross-products Q, n^2 times the covariance is n Q - S S' in whole numbers: it is centred before
anything is rounded, and each entry of the covariance is rounded once. Its eigenvectors, by falling eigenvalue, give the
components. Projections are written to the shared folder, and the covariance of what came out is measured there.

Cases: rows whose vector is null, or holds null, nan or infinite entries, are dropped; so are those whose vector has
another length than most (of equally many, the longest): they have no place in one covariance. Components without
variance (as in a table of one row, or of equal rows) have no scale, and have no rows. A deviation that does not fit in a
long is null; the operator has it as a decimal. Entries that are not below 2^50 in size raise an error. Repeated vec_ids and null ones are rows like others; an
empty table gives an empty result; other columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, python_workers

SCALE, ORIGIN = 1024, 100_000
COMPONENTS = 8
#: Rows of a block, and of an Arrow batch.
BLOCK = 8192
#: Entries at or above this do not become whole numbers exactly enough.
LARGEST = float(1 << 50)
_WHOLE = "decimal(38,0)"


def vectors(table: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Written table of key and vector of the rows that remain."""
    v = F.col("v")
    d = table.select(table[key].alias("key"), table[vector].cast("array<double>").alias("v"))
    bad = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    d = d.where(v.isNotNull() & ~F.coalesce(bad, F.lit(True)))
    lengths = d.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("rows"))
    most = lengths.agg(F.max(F.struct("rows", "d"))["d"].alias("d")).first()["d"]
    return d.where(F.size("v") == (most or 0))


def whole(v: np.ndarray) -> np.ndarray:
    """x of each entry."""
    if v.size and np.abs(v).max() >= LARGEST:
        raise ValueError("an entry is not below 2^50 in size")
    return np.floor(SCALE * v).astype(np.int64) + ORIGIN


def bit_planes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Least value of each column, the dimension and weight (power of two) of each plane, and the planes as words."""
    low = x.min(axis=0)
    y = (x - low).astype(np.uint64)
    rows, dims = y.shape
    words = -(-rows // 64)
    which, planes = [], []
    for j in range(dims):
        for a in range(int(y[:, j].max()).bit_length()):
            bits = np.zeros(words * 64, dtype=np.uint8)
            bits[:rows] = (y[:, j] >> np.uint64(a)) & np.uint64(1)
            which.append((j, a))
            planes.append(np.packbits(bits, bitorder="little").view(np.uint64))
    return low, np.array(which, dtype=np.int64).reshape(-1, 2), np.array(planes, dtype=np.uint64).reshape(-1, words)


def scatter(x: np.ndarray) -> tuple[list[int], list[int]]:
    """Exact sums of the columns of ``x``, and cross-products of the columns j <= k, row by row of the triangle."""
    rows, dims = x.shape
    low, which, planes = bit_planes(x)
    low = [int(v) for v in low]
    ones = np.bitwise_count(planes).sum(axis=1, dtype=np.int64)
    total, cross = [0] * dims, [[0] * dims for _ in range(dims)]
    for (j, a), n in zip(which.tolist(), ones.tolist(), strict=True):
        total[j] += n << a
    weight = which[:, 1].tolist()
    first = np.searchsorted(which[:, 0], np.arange(dims + 1))
    for p, (j, a) in enumerate(which.tolist()):
        # with the planes of the same dimension and of those after it
        both = np.bitwise_count(planes[first[j] :] & planes[p]).sum(axis=1, dtype=np.int64).tolist()
        for at, n in enumerate(both, start=int(first[j])):
            cross[j][which[at, 0]] += n << (a + weight[at])
    sums = [t + rows * m for t, m in zip(total, low, strict=True)]
    pairs = [cross[j][k] + low[j] * total[k] + low[k] * total[j] + rows * low[j] * low[k] for j in range(dims) for k in range(j, dims)]
    return sums, pairs


def _blocks(batches: Iterator) -> Iterator:
    """One row a block: rows, sums, cross-products."""
    import pyarrow as pa

    kind = pa.list_(pa.decimal128(38, 0))
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(0)
        x = whole(column.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1))
        sums, pairs = scatter(x)
        yield pa.RecordBatch.from_arrays(
            [pa.array([batch.num_rows], pa.int64()), *(pa.array([[Decimal(v) for v in values]], kind) for values in (sums, pairs))], names=["n", "sums", "pairs"]
        )


class Fit:
    """Row count, exact sums and centred cross-products of a table of vectors, and its components."""

    def __init__(self, rows: DataFrame, components: int = COMPONENTS):
        blocks = rows.select("v").mapInArrow(_blocks, f"n bigint, sums array<{_WHOLE}>, pairs array<{_WHOLE}>")
        blocks = materialise(blocks, "scatter-blocks")
        self.n = int(blocks.agg(F.sum("n")).first()[0] or 0)
        self.sums, pairs = self._added(blocks, "sums"), self._added(blocks, "pairs")
        self.dims = len(self.sums)
        centred = [[0] * self.dims for _ in range(self.dims)]
        at = iter(pairs)
        for j in range(self.dims):
            for k in range(j, self.dims):
                centred[j][k] = centred[k][j] = self.n * next(at) - self.sums[j] * self.sums[k]
        #: n^2 times the covariance, in whole numbers
        self.centred = centred
        square = self.n * self.n
        self.covariance = np.array([[c / square for c in row] for row in centred], dtype=np.float64).reshape(self.dims, self.dims)
        values, axes = np.linalg.eigh(self.covariance) if self.dims else (np.zeros(0), np.zeros((0, 0)))
        values, axes = values[::-1], axes[:, ::-1]
        self.trace = sum(centred[j][j] for j in range(self.dims)) / square if self.n else 0.0
        kept = [k for k in range(min(components, self.dims)) if values[k] > self.trace * self.dims * np.finfo(np.float64).eps]
        self.values, self.axes = values[kept], axes[:, kept]

    @staticmethod
    def _added(blocks: DataFrame, column: str) -> list[int]:
        """Sums over the blocks, place by place: as many numbers as a block has."""
        each = blocks.select(F.posexplode(column).alias("at", "x")).groupBy("at").agg(F.sum("x").cast(_WHOLE).alias("x"))
        return [int(r["x"]) for r in each.orderBy("at").collect()]

    def projector(self):
        """From (key, v) to key, the deviation in three limbs, and the whitened projections."""
        n, sums = self.n, self.sums
        base, mean = [s // n for s in sums], np.array([(s % n) / n for s in sums])
        rest = np.array([s % n for s in sums], dtype=object)
        axes = self.axes / np.sqrt(self.values)

        def run(batches: Iterator) -> Iterator:
            import pyarrow as pa

            floor = np.array(base, dtype=np.int64)
            for batch in batches:
                if not batch.num_rows:
                    continue
                x = whole(batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)) - floor
                w = (x - mean) @ axes
                far = int(np.abs(x).max()) + 1
                if n * far < 1 << 51:  # squares of both limbs add up in 64 bits
                    t = np.abs(n * x - rest.astype(np.int64))
                    high, low = t >> 26, t & ((1 << 26) - 1)
                    limbs = [(a * b).sum(axis=1).tolist() for a, b in ((high, high), (high, low), (low, low))]
                    deviation = [(h << 52) + (m << 27) + s for h, m, s in zip(*limbs, strict=True)]
                else:
                    deviation = [int(v) for v in ((n * x.astype(object) - rest) ** 2).sum(axis=1)]
                whole_part = pa.array([Decimal(v) if v < 10**38 else None for v in deviation], pa.decimal128(38, 0))
                at = np.arange(0, w.size + 1, w.shape[1], dtype=np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0), whole_part, pa.ListArray.from_arrays(pa.array(at), pa.array(w.ravel()))], names=["key", "deviation", "whitened"])

        return run

    def identity_error(self, whitened: DataFrame) -> float:
        """Largest absolute entry of the covariance of the whitened rows less the identity."""
        k = len(self.values)
        w = [F.col("whitened")[i] for i in range(k)]
        entries = [F.abs(F.covar_pop(w[i], w[j]) - F.lit(float(i == j))) for i in range(k) for j in range(i, k)]
        return float(whitened.agg(F.array_max(F.array(*entries))).first()[0])


def whitened(table: DataFrame, components: int = COMPONENTS, key: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, Fit]:
    """Written table of key, deviation (decimal, sum of (n x - S)^2 over dimensions) and whitened (array) of each remaining row, and the fit."""
    spark = table.sparkSession
    python_workers(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BLOCK))
    rows = vectors(table, key, vector)
    fit = Fit(rows, components)
    kind = f"key {rows.schema['key'].dataType.simpleString()}, deviation {_WHOLE}, whitened array<double>"
    if not len(fit.values):
        return spark.createDataFrame([], kind), fit
    return materialise(rows.mapInArrow(fit.projector(), kind), "whitened"), fit


def op12(embeddings: DataFrame) -> DataFrame:
    d, fit = whitened(embeddings)
    error = fit.identity_error(d) if len(fit.values) else 0.0
    explained = F.array(*(F.lit(float(v / fit.trace)) for v in fit.values)) if len(fit.values) else F.array().cast("array<double>")
    d = d.select(F.col("key").alias("vec_id"), F.expr("try_cast(deviation AS bigint)").alias("deviation"), F.posexplode("whitened").alias("at", "whitened"))
    return d.select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(fit.n).cast("long").alias("n"), "deviation", "whitened",
        F.get(explained, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"),
    )
