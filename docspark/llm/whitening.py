"""Embedding whitening: polarisation covariance.

Entries become whole numbers, so all sums are exact whatever the order in which
tasks add them. One pass adds up the vectors. A second one centres each entry at
the whole number next to its mean and adds up the squares of every dimension and
of the sum of every two dimensions. From these the variances of x_i and of
x_i + x_j are known exactly, and

    cov(x_i, x_j) = (var(x_i + x_j) - var(x_i) - var(x_j)) / 2

gives all cross-covariances, rounded once. ``eigh`` of that matrix gives the
axes; a third pass measures the covariance of the whitened vectors.

A task adds up its own rows and returns one row of sums; these are added in two
steps of groups, so neither a task nor the driver meets more than a few of them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Entries become floor(SCALE * c) + OFFSET; what lies beyond HELD is held there.
SCALE, OFFSET, HELD = 64.0, 1_000_000, float(1 << 60)
COMPONENTS = 32
#: A component whose share of the variance is below this has none: rounding is all that is left of it.
LEAST = 1e-13
#: Entries worked on at a time, and the groups in which tasks' sums are added.
ENTRIES, GROUPS = 1 << 20, (1024, 32)
_SUMS = "d int, part int, n long, sums array<string>"


@dataclass(frozen=True)
class Whitening:
    """What whitens the vectors of one length: ``near`` and ``rest`` are n, the whole numbers next to the means and what remains of the sums; ``axes`` are unit columns."""

    n: int
    near: np.ndarray
    rest: list[int]
    axes: np.ndarray
    variances: np.ndarray
    total: float
    error: float | None = None

    @property
    def known(self) -> np.ndarray:
        """Components that have a variance."""
        return self.variances > LEAST * self.total

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """Whitened coordinates of rows of whole numbers; not a number where a component has no variance."""
        centred = (x - self.near).astype(np.float64) - np.array([r / self.n for r in self.rest])
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(self.known, (centred @ self.axes) / np.sqrt(np.where(self.known, self.variances, 1.0)), np.nan)

    def deviations(self, x: np.ndarray) -> list[int] | np.ndarray:
        """Sum over dimensions of (n x - S) squared, exact."""
        u = x - self.near
        top = self.n * int(np.abs(u).max(initial=0)) + max(map(abs, self.rest), default=0)
        if top * top * max(u.shape[1], 1) < 1 << 63:
            w = u * self.n - np.array(self.rest, dtype=np.int64)
            return np.einsum("ij,ij->i", w, w)
        w = u.astype(object) * self.n - np.array(self.rest, dtype=object)
        return list((w * w).sum(1))


def _vectors(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, whole numbers) of the usable vectors of a batch, those of one length together and a bounded number at a time."""
    column = batch["_v"]
    size = pc.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    entries = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)  # a null entry is not a number
    start = np.cumsum(size) - size
    for d in np.unique(size[size > 0]):
        same = np.flatnonzero(size == d)
        for s in range(0, len(same), step := max(1, ENTRIES // int(d))):
            rows = same[s : s + step]
            c = entries[start[rows, None] + np.arange(d)]
            good = np.isfinite(c).all(1)
            with np.errstate(over="ignore"):
                x = np.clip(np.floor(SCALE * c[good]), -HELD, HELD).astype(np.int64) + OFFSET
            yield rows[good], x


def _added(values: np.ndarray) -> np.ndarray:
    """Column sums, exact."""
    top = int(np.abs(values).max(initial=0))
    return (values if top * len(values) < 1 << 62 else values.astype(object)).sum(0)


def squares(u: np.ndarray) -> list[int]:
    """Sums over the rows of u_i squared and of (u_i + u_j) squared for i < j, row by row of the upper triangle, exact."""
    d, top = u.shape[1], int(np.abs(u).max(initial=0))
    if 4 * top * top * max(len(u), 1) >= 1 << 63:
        u = u.astype(object)
    out: list[int] = []
    for i in range(d):
        pair = u[:, i:] + u[:, i : i + 1]
        pair[:, 0] = u[:, i]
        out += [int(s) for s in (np.einsum("ij,ij->j", pair, pair) if u.dtype != object else (pair * pair).sum(0))]
    return out


def _gather(rows: DataFrame, add_up: Callable[[np.ndarray], list], number: Callable = int) -> dict[int, tuple[int, list]]:
    """For each length of vectors: how many there are, and the sums over all of them of ``add_up``."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        for b in batches:
            for _, x in _vectors(b):
                if not len(x):
                    continue
                told = sums.setdefault(x.shape[1], [0, None])
                new = add_up(x)
                told[0] += len(x)
                told[1] = new if told[1] is None else [a + c for a, c in zip(told[1], new)]
        part = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays([
            pa.array(list(sums), pa.int32()), pa.array([part] * len(sums), pa.int32()), pa.array([n for n, _ in sums.values()], pa.int64()),
            pa.array([[repr(x) for x in s] for _, s in sums.values()], pa.list_(pa.string())),
        ], ["d", "part", "n", "sums"])

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        total = None
        for s in group["sums"]:
            new = [number(x) for x in s]
            total = new if total is None else [a + c for a, c in zip(total, new)]
        return pd.DataFrame({"d": [group["d"].iloc[0]], "part": [group["part"].iloc[0]], "n": [int(group["n"].sum())], "sums": [[repr(x) for x in total]]})

    parts = rows.mapInArrow(partial, _SUMS)
    for groups in GROUPS:
        parts = parts.withColumn("part", F.col("part") % groups).groupBy("d", "part").applyInPandas(merge, _SUMS)
    out: dict[int, tuple[int, list]] = {}
    for r in parts.orderBy("d", "part").collect():  # at most 32 rows a length
        new = [number(x) for x in r["sums"]]
        n, total = out.get(r["d"], (0, None))
        out[r["d"]] = (n + r["n"], new if total is None else [a + c for a, c in zip(total, new)])
    return out


def covariance(n: int, rest: list[int], sums: list[int]) -> np.ndarray:
    """Covariances from the squares of dimensions and of sums of two, each rounded once from its exact value."""
    d = len(rest)
    at = lambda i, j: i * d - i * (i - 1) // 2 + (j - i)
    own = [n * sums[at(i, i)] - rest[i] ** 2 for i in range(d)]  # n squared times the variance
    out = np.empty((d, d))
    for i in range(d):
        out[i, i] = own[i] / n**2
        for j in range(i + 1, d):
            both = n * sums[at(i, j)] - (rest[i] + rest[j]) ** 2
            out[i, j] = out[j, i] = (both - own[i] - own[j]) / (2 * n**2)
    return out


def fit_whitening(vectors: DataFrame, components: int = COMPONENTS, vector_col: str = "embedding") -> dict[int, Whitening]:
    """For each length of vectors in the table, what whitens them: at most ``components`` axes by falling variance.

    Vectors that are null, empty or hold null or non-finite entries are left
    out; repeated ones count as often as they occur. Of equal variances the order
    is any; an axis's largest entry is positive. No vectors give an empty dict.
    """
    rows = vectors.select(F.col(vector_col).alias("_v"))
    totals = _gather(rows, lambda x: [int(s) for s in _added(x)])
    near = {d: np.array([(2 * s + n) // (2 * n) for s in sums], dtype=np.int64) for d, (n, sums) in totals.items()}
    fits = {}
    for d, (n, sums) in _gather(rows, lambda x: squares(x - near[x.shape[1]])).items() if near else ():
        rest = [s - n * int(m) for s, m in zip(totals[d][1], near[d])]
        v = covariance(n, rest, sums)
        size = float(np.abs(v).max()) or 1.0
        e, axes = np.linalg.eigh(v / size)
        e, axes = np.maximum(e[::-1][:components], 0.0) * size, axes[:, ::-1][:, :components]
        axes = axes * np.where(axes[np.abs(axes).argmax(0), np.arange(axes.shape[1])] < 0, -1.0, 1.0)
        fits[d] = Whitening(n, near[d], rest, axes, e, float(np.trace(v)))

    def products(x: np.ndarray) -> list[float]:
        y = np.nan_to_num(fits[x.shape[1]](x))
        return [*map(float, y.sum(0)), *map(float, (y.T @ y).ravel())]

    for d, (n, sums) in _gather(rows, products, float).items() if fits else ():
        f = fits[d]
        k = len(f.variances)
        mean = np.array(sums[:k]) / n
        apart = np.abs(np.array(sums[k:]).reshape(k, k) / n - np.outer(mean, mean) - np.eye(k))[np.ix_(f.known, f.known)]
        fits[d] = Whitening(f.n, f.near, f.rest, f.axes, f.variances, f.total, float(apart.max()) if apart.size else None)
    return fits


def whiten(vectors: DataFrame, fits: dict[int, Whitening] | None = None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``id_col``, component, n, deviation, whitened, explained, identity_error: a row for each usable vector and component.

    Null and empty vectors and those with null or non-finite entries are left
    out, as are those of a length that ``fits`` does not have; each length is
    whitened by itself. Repeated rows and null ids give rows like any other. Where
    a component has no variance, ``whitened`` is null (``explained`` too if there
    is none at all). ``deviation`` is a decimal of 38 digits, null beyond. Entries
    beyond 2 ** 60 after scaling are held there. An empty table gives no rows.
    Other columns are not carried, so their names cannot clash.
    """
    fits = fit_whitening(vectors, vector_col=vector_col) if fits is None else fits
    kind = vectors.schema[id_col].dataType.simpleString()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, x in _vectors(b):
                f = fits.get(x.shape[1])
                if f is None or not len(at):
                    continue
                k, n = len(f.variances), len(at)
                far = f.deviations(x)
                far = pa.array(far).cast(pa.decimal128(38, 0)) if isinstance(far, np.ndarray) else pa.array([Decimal(v) if v < 10**38 else None for v in far], pa.decimal128(38, 0))
                part = f.variances / f.total if f.total > 0 else np.full(k, np.nan)
                each = np.repeat(np.arange(n), k)
                yield pa.RecordBatch.from_arrays([
                    b["_id"].take(pa.array(at[each])), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), n)), pa.array(np.full(n * k, f.n)), far.take(pa.array(each)),
                    pa.array(f(x).ravel(), from_pandas=True), pa.array(np.tile(part, n), from_pandas=True), pa.array([f.error] * (n * k), pa.float64()),
                ], ["_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    told = f"_id {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    return vectors.select(F.col(id_col).alias("_id"), F.col(vector_col).alias("_v")).mapInArrow(rows, told).withColumnRenamed("_id", id_col)


def report(vectors: DataFrame) -> DataFrame:
    """Rows of query ``op13``; a deviation beyond a long is null."""
    return whiten(vectors.select("vec_id", "embedding")).withColumn("deviation", F.col("deviation").try_cast("long"))


#: Of ``whitening_deviations``: number of vectors and deviation of each. Components have no SQL.
DEVIATIONS_SQL = """
WITH v AS (SELECT row_number() OVER () AS r, vec_id, embedding::DOUBLE[] AS e FROM embeddings),
x AS (SELECT r, vec_id, unnest(range(1, len(e) + 1)) AS i, unnest(list_transform(e, lambda c: floor(64 * c)::HUGEINT + 1000000)) AS x
      FROM v WHERE e IS NOT NULL AND len(list_filter(e, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
s AS (SELECT i, sum(x)::HUGEINT AS s, count(*)::HUGEINT AS n FROM x GROUP BY i)
SELECT any_value(vec_id) AS vec_id, max(n)::BIGINT AS n, sum((n * x - s) * (n * x - s))::BIGINT AS deviation FROM x JOIN s USING (i) GROUP BY r
"""
