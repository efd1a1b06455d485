"""Connected components of a distributed edge list, and helpers for work on groups inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .staging import release, stage


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of ``edges``; a component is named by its smallest node.

    Alternating large-star and small-star steps: each keeps at most as many
    edges as before, and a hub's edges are joined, never gathered into one task.
    """
    smaller = F.when(F.col(a) < F.col(b), F.struct(F.col(b).alias("u"), F.col(a).alias("v"))).otherwise(F.struct(F.col(a).alias("u"), F.col(b).alias("v")))
    # a key that only equals the grouping key makes a join of its own exchanges, which Spark can split at a hub
    own = lambda c: F.substring(F.col(c), 1, 1 << 30) if kind in ("binary", "string") else F.col(c) + F.lit(0)
    kind = edges.schema[a].dataType.typeName()
    now = stage(edges.where(F.col(a) != F.col(b)).select(smaller.alias("e")).select("e.u", "e.v").distinct(), "cc")
    state = _state(now)
    while state[0]:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(own("u").alias("n"), F.least("m", "u").alias("m"))
        large = both.where(F.col("v") > F.col("u")).join(least, F.col("u") == F.col("n")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(low.select(own("u").alias("n"), "m"), F.col("u") == F.col("n")).select(F.col("v").alias("u"), F.col("m").alias("v")).where(F.col("u") != F.col("v"))
        after = stage(moved.union(low.select("u", F.col("m").alias("v"))).distinct(), "cc")
        told = _state(after)
        release(now)
        now, same, state = after, told == state, told
        if same:
            break
    out = now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
    out._folder = now._folder  # so that it can be released
    return out


def stars(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest row reachable from each of ``n`` rows by the pairs (i, j)."""
    label = np.arange(n)
    while len(i):
        new = label.copy()
        low = np.minimum(label[i], label[j])
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    return label


def whole_groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """The groups of a partition sorted by ``keys``, one after the other, with no rows of a group left in a later batch."""
    rest: list[pd.DataFrame] = []
    for b in batches:
        if not len(b):
            continue
        rest.append(b)
        last = b.iloc[-1]
        if all(rest[0].iloc[0][k] == last[k] for k in keys):
            continue
        whole = pd.concat(rest, ignore_index=True) if len(rest) > 1 else b.reset_index(drop=True)
        change = np.zeros(len(whole), dtype=bool)
        for k in keys:
            v = whole[k].to_numpy()
            change[1:] |= v[1:] != v[:-1]
        at = [0, *np.flatnonzero(change), len(whole)]
        for s, e in zip(at[:-2], at[1:-1]):
            yield whole.iloc[s:e]
        rest = [whole.iloc[at[-2] :]]
    if rest:
        yield pd.concat(rest, ignore_index=True)


def with_tiles(df: DataFrame, tiles: Column, key: str) -> DataFrame:
    """Deal the rows of a group of ``tiles`` tiles to pairs of tiles, so that every two rows meet in exactly one pair.

    Adds ``ti``, ``tj`` (ti <= tj) and ``side`` (0: of tile ti, 1: of tile tj). A group of one tile is not repeated.
    """
    out = df.withColumn("_tiles", F.greatest(tiles.cast("int"), F.lit(1)))
    out = out.withColumn("_own", F.pmod(F.xxhash64(F.col(key), F.lit(7)), F.col("_tiles").cast("long")).cast("int"))
    out = out.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_tiles") - 1)))
    return out.withColumns({
        "ti": F.least("_own", "_other"), "tj": F.greatest("_own", "_other"), "side": F.when(F.col("_own") <= F.col("_other"), 0).otherwise(1),
    }).drop("_own", "_other", "_tiles")
