"""Operator 13 against exact arithmetic on small tables."""

from fractions import Fraction
from math import floor

import numpy as np
import pytest
from pyspark.sql import functions as F

from docspark.llm import whitening as W

DIR = "/root/testdata/sf0.001"


def whole(v):
    return [floor(Fraction(c) * 64) + 1_000_000 for c in v]


def exact(vectors):
    """n, deviation of each vector, and the covariance, in exact arithmetic."""
    x = [whole(v) for v in vectors]
    n, d = len(x), len(x[0])
    s = [sum(r[i] for r in x) for i in range(d)]
    c = [[n * r[i] - s[i] for i in range(d)] for r in x]
    cov = np.array([[float(Fraction(sum(r[i] * r[j] for r in c), n**3)) for j in range(d)] for i in range(d)])
    return n, [sum(a * a for a in r) for r in c], cov, np.array([[float(Fraction(a, n)) for a in r] for r in c])


def compare(df, vectors, ids):
    n, deviation, cov, centred = exact(vectors)
    e, axes = np.linalg.eigh(cov)
    e, axes = e[::-1][:32], axes[:, ::-1][:, :32]
    y = centred @ axes / np.sqrt(e)
    rows = {(r["vec_id"], r["component"]): r for r in df.collect()}
    assert len(rows) == len(ids) * len(e)
    got = np.array([[rows[i, k + 1]["whitened"] for k in range(len(e))] for i in ids])
    assert np.abs(got * np.sign((got * y).sum(0)) - y).max() < 1e-7
    assert np.abs(got.T @ got / n - np.eye(len(e))).max() < 1e-7
    for i, dev in zip(ids, deviation):
        r = rows[i, 1]
        assert (r["n"], int(r["deviation"])) == (n, dev) and r["identity_error"] < 1e-7
    assert np.allclose([rows[ids[0], k + 1]["explained"] for k in range(len(e))], e / np.trace(cov), rtol=1e-9)


def test_whole_table(spark):
    table = spark.read.parquet(f"{DIR}/embeddings.parquet")
    rows = [r for r in table.orderBy("vec_id").collect() if r["embedding"] is not None and all(c is not None and np.isfinite(c) for c in r["embedding"])]
    compare(W.report(table), [r["embedding"] for r in rows], [r["vec_id"] for r in rows])


def test_many_tasks_and_extra_columns(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(900, 7)) * 10.0 ** rng.integers(-1, 4, 7)
    df = spark.createDataFrame([(i, x.tolist(), 1, 2) for i, x in enumerate(v)], "vec_id long, embedding array<double>, component int, deviation int").repartition(70)
    compare(W.report(df), v.tolist(), list(range(900)))


def test_wide_values_stay_exact(spark):
    rng = np.random.default_rng(4)
    v = (rng.normal(size=(40, 3)) * [1e11, 1e11, 1e10]).tolist()
    df = spark.createDataFrame([(i, x) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    compare(W.whiten(df), v, list(range(40)))
    assert W.report(df).where("deviation IS NULL").count() == 40 * 3  # beyond a long


@pytest.mark.parametrize("top", [1, 1000, 1 << 30, 1 << 45])
def test_squares(top):
    u = np.random.default_rng(top).integers(-top, top + 1, (60, 5))
    want = [sum(int(r[i]) ** 2 if i == j else (int(r[i]) + int(r[j])) ** 2 for r in u) for i in range(5) for j in range(i, 5)]
    assert W.squares(u) == want


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0]), (2, None), (3, []), (4, [1.0, None]), (5, [nan, 1.0]), (6, [inf, 1.0]), (1, [1.0, 2.0]), (None, [3.0, 1.0]), (8, [5.0]), (9, [0.0, -4.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = W.whiten(df).collect()
    assert sorted((r["vec_id"] is None, r["vec_id"], r["component"], r["n"]) for r in out if r["vec_id"] is not None) == sorted((False, i, k, n) for i, d, n in ((1, 2, 4), (1, 2, 4), (8, 1, 1), (9, 2, 4)) for k in range(1, d + 1))
    assert sum(r["vec_id"] is None for r in out) == 2
    alone = next(r for r in out if r["vec_id"] == 8)  # one vector has no variance
    assert alone["whitened"] is None and alone["explained"] is None and alone["identity_error"] is None and alone["deviation"] == 0
    flat = spark.createDataFrame([(i, [float(i), 2.0 * i, 7.0]) for i in range(5)], "vec_id long, embedding array<double>")
    told = W.whiten(flat).collect()
    assert all((r["whitened"] is None) == (r["component"] > 1) for r in told) and all(r["identity_error"] < 1e-9 for r in told)
    assert W.whiten(df.where("false")).count() == 0 and W.fit_whitening(df.where("false")) == {}
    text = W.whiten(df.select(F.concat(F.lit("v-"), F.col("vec_id")).alias("vec_id"), "embedding"))
    assert {r["vec_id"] for r in text.collect()} == {"v-1", "v-8", "v-9", None}


def test_fits_can_be_reused(spark):
    table = spark.read.parquet(f"{DIR}/embeddings.parquet")
    fits = W.fit_whitening(table, components=5)
    few = W.whiten(table.where("vec_id < 10"), fits).select("component", "n").distinct().collect()
    assert {r["component"] for r in few} == {1, 2, 3, 4, 5} and len({r["n"] for r in few}) == 1
