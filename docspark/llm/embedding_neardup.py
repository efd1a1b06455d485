"""Embedding near-duplicates: subspace pigeonhole join.

Unit vectors with cosine at least ``t`` are at most ``2 - 2t`` apart in squared
distance. They are rotated (principal axes of a bounded sample, dealt over the
blocks) and split into blocks of about eight axes; each block gets a part of
that distance in proportion to its variance. By the pigeonhole principle a pair
within the whole distance is within its part in some block. Each block is a
range join: cells are boxes over as many of its axes as the table's size asks
for, and a row that is within the block's radius below a cut is a guest of the
next cell as well. Inside a cell, rows are sorted along the first axis and
compared by the block's coordinates only; the pairs that are near enough there
are the candidates, and their whole distance decides. A pair counts in the
first block that finds it and in the cell of its upper corner.

Rows travel with single-precision coordinates. Where these leave a pair in
doubt, its cosine is computed in double precision from the vectors themselves.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components, stars
from .staging import release, stage

THRESHOLD = 0.95
#: Blocks at most, and the axes that a block should have (of those that vary).
BLOCKS, BLOCK_AXES = 8, 8
#: Vectors whose axes give the rotation and the cuts; they steer speed only, never the result.
SAMPLE = 4096
#: One side of a comparison: rows at most, and bytes of coordinates. Cells of a block at most; fuller cells are compared tile by tile.
TILE, TILE_BYTES, CELLS = 131_072, 48 << 20, 4096
#: Rows dealt at a time.
DEALT = 500
#: Room for single-precision rounding in a block's distance.
SLACK = 1e-5


def _unit(v) -> np.ndarray | None:
    if v is None:
        return None
    x = np.asarray(v, dtype=np.float64).reshape(-1) + 0.0
    if not len(x) or not np.isfinite(x).all() or not (top := np.abs(x).max()) > 0:
        return None
    x = x / top
    return x / np.sqrt((x * x).sum())


def _prepare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        units = [_unit(v) for v in b["_v"]]
        yield pd.DataFrame({
            "_id": b["_id"],
            "key": pd.Series([None if u is None else hashlib.blake2b(u.tobytes(), digest_size=16).digest() for u in units], dtype=object),
            "unit": pd.Series([None if u is None else u.tobytes() for u in units], dtype=object),
        })


def rotation(sample: np.ndarray, blocks: int, budget: float) -> tuple[np.ndarray, list[slice], np.ndarray]:
    """Axes (columns), the blocks' columns, and the blocks' parts of ``budget``."""
    d = sample.shape[1]
    m = min(blocks, d)
    values, axes = np.linalg.eigh(np.cov(sample.T).reshape(d, d) if len(sample) > 1 else np.eye(d))
    values, axes = np.maximum(values[::-1], 0), axes[:, ::-1]
    deal = [[] for _ in range(m)]
    for i in range(d):
        turn, at = divmod(i, m)
        deal[at if turn % 2 == 0 else m - 1 - at].append(i)
    share = np.array([values[c].sum() for c in deal])
    share = np.maximum(share / share.sum() if share.sum() > 0 else np.full(m, 1 / m), 0.04 / m)
    ends = np.cumsum([0, *map(len, deal)])
    return axes[:, [i for c in deal for i in c]].copy(), [slice(a, b) for a, b in zip(ends[:-1], ends[1:])], budget * share / share.sum()


def block_count(sample: np.ndarray) -> int:
    """As many blocks as leave each about BLOCK_AXES axes that vary (by the participation ratio of the variances)."""
    v = np.linalg.eigvalsh(np.cov(sample.T).reshape(sample.shape[1], -1)) if len(sample) > 1 else np.ones(sample.shape[1])
    effective = v.sum() ** 2 / max((v * v).sum(), 1e-300)
    return int(np.clip(round(effective / BLOCK_AXES), 1, BLOCKS))


def cuts(values: np.ndarray, radius: float, cells: int) -> list[np.ndarray]:
    """Cut points axis by axis (columns of ``values``): quantiles at least ``radius`` apart, until there are about ``cells`` boxes.

    An axis is cut where that saves a quarter of the comparisons at least, rows
    counted in each slice they are guests of; one no wider than the radius saves none.
    """
    out: list[np.ndarray] = []
    for x in np.sort(values, axis=0).T:
        if cells <= 1:
            break
        best, met = np.zeros(0, dtype=np.float32), 0.75
        for slices in range(2, min(cells, 32) + 1):
            points: list[float] = []
            for p in x[len(x) * np.arange(1, slices) // slices]:
                if p > x[0] and (not points or p - points[-1] > radius * 1.001):
                    points.append(p)
            ends = np.append(np.searchsorted(x, points), len(x))
            begins = np.append(0, np.searchsorted(x, np.array(points) - radius))
            share = (((ends - begins) / len(x)) ** 2).sum()
            if points and share < met:
                best, met = np.array(points, dtype=np.float32), share
        out.append(best)
        cells = -(-cells // (len(best) + 1))
    return out


class Space:
    """The blocks of vectors of one dimension: their columns, parts, radii and cuts."""

    def __init__(self, sample: np.ndarray, threshold: float, rows: int, blocks: int | None = None):
        d = sample.shape[1]
        self.budget = 2 - 2 * threshold
        self.axes, self.blocks, self.parts = rotation(sample, blocks or block_count(sample), self.budget)
        self.tile = max(min(TILE, TILE_BYTES // (4 * d)), 1)
        wanted = min(-(-rows // self.tile), CELLS)
        rotated = (sample @ self.axes).astype(np.float32)
        self.radii = np.sqrt(self.parts + 2 * SLACK)
        self.cuts = [cuts(rotated[:, c], r, wanted) for c, r in zip(self.blocks, self.radii)]
        #: more than rounding can change a sum of squared differences by
        self.doubt = 2e-6 + 2e-8 * d

    def corner(self, block: int, x: np.ndarray) -> np.ndarray:
        """Own slice of each row along the cut axes of ``block``."""
        first = self.blocks[block].start
        return np.stack([np.searchsorted(c, x[:, first + k], side="right") for k, c in enumerate(self.cuts[block])], 1) if self.cuts[block] else np.zeros((len(x), 0), dtype=np.int64)

    def number(self, block: int, corner: np.ndarray) -> np.ndarray:
        out = np.zeros(len(corner), dtype=np.int64)
        for k, c in enumerate(self.cuts[block]):
            out = out * (len(c) + 1) + corner[:, k]
        return out

    def cells(self, block: int, x: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Rows of ``x`` with the number of each cell they belong to: their own, and those they are guests of."""
        own, first = self.corner(block, x), self.blocks[block].start
        near = np.stack([
            (own[:, k] < len(c)) & (np.append(c, np.inf)[own[:, k]] - x[:, first + k] <= self.radii[block]) for k, c in enumerate(self.cuts[block])
        ], 1) if self.cuts[block] else np.zeros((len(x), 0), dtype=bool)
        for up in itertools.product(*[(0, 1) if len(c) else (0,) for c in self.cuts[block]]):
            step = np.array(up, dtype=np.int64)
            rows = np.flatnonzero((near | (step == 0)).all(1))
            if len(rows):
                yield rows, self.number(block, own[rows] + step)


def pairs_within(a: np.ndarray, b: np.ndarray | None, block: int, cell: int, space: Space) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows of ``a`` and ``b`` (or of ``a`` alone, each pair once) that ``block`` is the first to find and that meet in ``cell``, with their whole squared distance."""
    c, part = space.blocks[block], np.float32(space.parts[block] + 2 * SLACK)
    starts = [x.start for x in space.blocks]
    limits = (space.parts + SLACK).astype(np.float32)
    oa = np.argsort(a[:, c.start], kind="stable")
    a = a[oa]
    ob, b, self_join = (oa, a, True) if b is None else (order := np.argsort(b[:, c.start], kind="stable"), b[order], False)
    ca = space.corner(block, a)
    cb = ca if self_join else space.corner(block, b)
    xa, xb = a[:, c], b[:, c]
    # one product gives |x|^2 + |y|^2 - 2xy
    left = np.concatenate([xa, (xa * xa).sum(1, keepdims=True), np.ones((len(a), 1), dtype=np.float32)], 1)
    right = np.concatenate([-2 * xb, np.ones((len(b), 1), dtype=np.float32), (xb * xb).sum(1, keepdims=True)], 1).T.copy()
    low = np.searchsorted(xb[:, 0], xa[:, 0] - np.float32(space.radii[block] + SLACK))
    high = np.searchsorted(xb[:, 0], xa[:, 0] + np.float32(space.radii[block] + SLACK), side="right")
    for s in range(0, len(a), 256):
        e = min(s + 256, len(a))
        for t in range(max(low[s], s if self_join else 0), high[e - 1], 2048):
            u = min(t + 2048, high[e - 1])
            at = np.flatnonzero((left[s:e] @ right[:, t:u]).reshape(-1) <= part)
            for k in range(0, len(at), 16_384):
                i, j = np.divmod(at[k : k + 16_384], u - t)
                i, j = i + s, j + t
                if self_join:
                    i, j = i[i < j], j[i < j]
                gap = a[i] - b[j]
                blocks = np.add.reduceat(gap * gap, starts, axis=1)
                within = blocks <= limits
                good = within[:, block] & (within.argmax(1) == block)
                i, j, total = i[good], j[good], blocks[good].sum(1, dtype=np.float64)
                here = space.number(block, np.maximum(ca[i], cb[j])) == cell
                near = here & (total <= space.budget + space.doubt)
                if near.any():
                    yield oa[i[near]], ob[j[near]], total[near]


def _cosines(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for a, b in batches:
        yield pd.Series([float(np.frombuffer(x, dtype=np.float64) @ np.frombuffer(y, dtype=np.float64)) for x, y in zip(a, b)], dtype="float64")


def find_links(points: DataFrame, spaces: dict[int, Space]) -> DataFrame:
    """(num, other, links, doubt): links of a vector found in a cell and a vector it is reached with; pairs in doubt one by one.

    ``points``: num, n (rows of that vector), d, x (single-precision coordinates).
    """

    def stacked(b: pd.DataFrame) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        for d in b["d"].unique():
            rows = np.flatnonzero(b["d"].to_numpy() == d)
            yield int(d), rows, np.stack([np.frombuffer(x, dtype=np.float32) for x in b["x"].iloc[rows]])

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for d, _, x in stacked(b):
                for block in range(len(spaces[d].blocks)):
                    for _, cell in spaces[d].cells(block, x):
                        v, c = np.unique(cell, return_counts=True)
                        out.append(pd.DataFrame({"d": d, "block": block, "cell": v, "n": c}))
            yield pd.concat(out).astype({"d": "int32", "block": "int32"})

    counted = points.select("d", "x").mapInPandas(count, "d int, block int, cell long, n long").groupBy("d", "block", "cell").agg(F.sum("n").alias("n"))
    tiles = {(r["d"], r["block"], r["cell"]): -(-r["n"] // spaces[r["d"]].tile) for r in counted.where(F.col("n") > 1).collect()}  # at most CELLS a block

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in (whole.iloc[at : at + DEALT] for whole in batches for at in range(0, len(whole), DEALT)):
            out = []
            for d, at, x in stacked(b):
                own = (b["num"].to_numpy()[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
                for block in range(len(spaces[d].blocks)):
                    for rows, cells in spaces[d].cells(block, x):
                        # a cell of one row has no tiles and is not sent
                        for cell in np.unique(cells):
                            g = tiles.get((d, block, int(cell)), 0)
                            mine = rows[cells == cell]
                            tile = (own[mine] % np.uint64(max(g, 1))).astype(np.int64)
                            for other in range(g):
                                out.append((d, block, cell, np.minimum(tile, other), np.maximum(tile, other), (tile > other).astype(np.int32), at[mine]))
            if not out:
                continue
            row = np.concatenate([o[6] for o in out])
            each = [len(o[6]) for o in out]
            pick = b.iloc[row]
            yield pd.DataFrame({
                "d": np.repeat([o[0] for o in out], each).astype(np.int32), "block": np.repeat([o[1] for o in out], each).astype(np.int32), "cell": np.repeat([o[2] for o in out], each),
                "ti": np.concatenate([o[3] for o in out]).astype(np.int32), "tj": np.concatenate([o[4] for o in out]).astype(np.int32), "side": np.concatenate([o[5] for o in out]),
                "num": pick["num"].to_numpy(), "n": pick["n"].to_numpy(), "x": pick["x"].to_numpy(),
            })

    def join(key, group: pd.DataFrame) -> pd.DataFrame:
        d, block, cell, ti, tj = map(int, key)
        a, b = (group, None) if ti == tj else (group[group["side"] == 0], group[group["side"] == 1])
        told = [pd.DataFrame({"num": np.zeros(0, dtype=np.int64), "other": np.zeros(0, dtype=np.int64), "links": np.zeros(0, dtype=np.int64), "doubt": np.zeros(0, dtype=bool)})]
        if not len(a) or (b is not None and not len(b)):
            return told[0]
        floats = lambda g: np.stack([np.frombuffer(x, dtype=np.float32) for x in g["x"]])
        space, every = spaces[d], a if b is None else pd.concat([a, b])
        num, n, links, label = every["num"].to_numpy(), every["n"].to_numpy(), np.zeros(len(every), dtype=np.int64), np.arange(len(every))
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def fold() -> np.ndarray:
            i, j = (np.concatenate([h[k] for h in held]) for k in (0, 1))
            held.clear()
            np.add.at(links, i, n[j])
            np.add.at(links, j, n[i])
            return stars(len(num), np.concatenate([np.arange(len(num)), i]), np.concatenate([label, j]))

        for i, j, total in pairs_within(floats(a), None if b is None else floats(b), block, cell, space):
            j = j if b is None else j + len(a)
            sure = total < space.budget - space.doubt
            if not sure.all():
                told.append(pd.DataFrame({"num": num[i[~sure]], "other": num[j[~sure]], "links": 0, "doubt": True}))
            held.append((i[sure], j[sure]))
            if sum(len(h[0]) for h in held) >= 1 << 20:
                label = fold()
        if held:
            label = fold()
        some = np.flatnonzero(links)
        told.append(pd.DataFrame({"num": num[some], "other": num[label[some]], "links": links[some], "doubt": False}))
        return pd.concat(told).astype({"links": "int64", "doubt": "bool"})

    dealt = points.mapInPandas(deal, "d int, block int, cell long, ti int, tj int, side int, num long, n long, x binary")
    return stage(dealt.groupBy("d", "block", "cell", "ti", "tj").applyInPandas(join, "num long, other long, links long, doubt boolean"), "vector-found")


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, blocks: int | None = None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``id_col``, ``n_links``, ``component_id``, ``kept`` and ``class_size`` for every row of ``vectors``.

    Null, empty, zero and non-finite vectors link with nothing and are their own
    components. Ids may be of any type that has an order; ``component_id`` is of the
    same. Equal directions are one class, compared once. Vectors of
    different lengths never link. Repeated rows count as rows; a null id takes
    part but is never the smallest. An empty table gives an empty result. Other
    columns are not carried, so their names cannot clash.
    """
    kind = vectors.schema[id_col].dataType.simpleString()
    rows = stage(vectors.select(F.col(id_col).alias("_id"), F.col(vector_col).alias("_v")).mapInPandas(_prepare, f"_id {kind}, key binary, unit binary"), "vectors")
    classes = rows.where("key IS NOT NULL").groupBy("key").agg(F.min("_id").alias("rep"), F.count(F.lit(1)).alias("n"), F.first("unit").alias("unit"))
    classes = stage(classes.withColumn("num", F.monotonically_increasing_id()).withColumn("d", (F.octet_length("unit") / 8).cast("int")), "vector-classes")
    many = {r["d"]: r["c"] for r in classes.groupBy("d").agg(F.count(F.lit(1)).alias("c")).collect()}  # one row a length
    # a part of all by hash, and one of each length at least
    part = min(1.0, SAMPLE / max(sum(many.values()), 1))
    chosen = classes.where(F.xxhash64("key") / 2.0**64 + 0.5 < part).select("unit").limit(2 * SAMPLE).unionByName(classes.groupBy("d").agg(F.first("unit").alias("unit")).select("unit"))
    sample: dict[int, list] = {}
    for r in chosen.collect():
        u = np.frombuffer(bytes(r["unit"]), dtype=np.float64)
        sample.setdefault(len(u), []).append(u)
    spaces = {d: Space(np.stack(x), threshold, many[d], blocks) for d, x in sample.items()}

    def rotate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for d, g in b.groupby("d"):
                for s in range(0, len(g), DEALT):
                    rows = g.iloc[s : s + DEALT]
                    x = (np.frombuffer(b"".join(rows["unit"]), dtype=np.float64).reshape(-1, d) @ spaces[d].axes).astype(np.float32)
                    yield pd.DataFrame({"num": rows["num"], "n": rows["n"], "d": rows["d"], "x": pd.Series([r.tobytes() for r in x], dtype=object, index=rows.index)})

    # written once, so that every comparison reads the same bits
    points = stage(classes.select("num", "n", "d", "unit").mapInPandas(rotate, "num long, n long, d int, x binary"), "vector-points")
    found = find_links(points, spaces)
    one = lambda side: classes.select(F.col("num").alias(side), F.col("n").alias(f"{side}_n"), F.col("unit").alias(f"{side}_u"))
    doubts = found.where("doubt").select("num", "other").join(one("num"), "num").join(one("other"), "other")
    doubts = doubts.where(F.pandas_udf(_cosines, "double")("num_u", "other_u") >= threshold)
    both = F.explode(F.array(F.struct(F.col("num"), F.col("other"), F.col("other_n").alias("links")), F.struct(F.col("other").alias("num"), F.col("num").alias("other"), F.col("num_n").alias("links"))))
    sure = stage(found.where("NOT doubt").select("num", "other", "links").unionByName(doubts.select(both.alias("l")).select("l.*")), "vector-links")
    links = sure.groupBy("num").agg(F.sum("links").alias("links"))
    comps = connected_components(sure, "num", "other")
    full = classes.select("num", "key", "rep", "n").join(links, "num", "left").join(comps.withColumnRenamed("node", "num"), "num", "left")
    full = stage(full.select("key", "rep", "n", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "num").alias("comp")), "vector-components")
    release(classes, points, found, sure, comps)
    least = full.groupBy("comp").agg(F.min("rep").alias("component_id"))
    told = full.join(least, "comp").select("key", "n", (F.col("links") + F.col("n") - 1).alias("n_links"), "component_id")
    out = rows.select("_id", "key").join(told, "key", "left")
    comp = F.coalesce("component_id", "_id")
    return out.select(
        F.col("_id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), comp.alias("component_id"),
        F.coalesce(F.col("_id") == comp, F.lit(False)).alias("kept"), F.coalesce("n", F.lit(1)).cast("long").alias("class_size"),
    )


def report(vectors: DataFrame) -> DataFrame:
    """Rows of query ``op2``."""
    return near_duplicates(vectors.select("vec_id", "embedding")).withColumn("component_id", F.col("component_id").cast("long"))


ORACLE_SQL = """
WITH RECURSIVE
v AS (SELECT row_number() OVER () AS r, vec_id, embedding::DOUBLE[] AS e FROM embeddings),
ok AS (SELECT * FROM v WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_dot_product(e, e) > 0),
l AS (SELECT a.r AS a, b.r AS b, b.vec_id AS bv FROM ok a JOIN ok b ON a.r <> b.r AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95),
reach(a, b) AS (SELECT a, b FROM l UNION SELECT reach.a, l.b FROM reach JOIN l ON reach.b = l.a),
c AS (SELECT reach.a, min(v.vec_id) AS m FROM reach JOIN v ON v.r = reach.b GROUP BY reach.a),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT v.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, least(v.vec_id, coalesce(c.m, v.vec_id))::BIGINT AS component_id,
       v.vec_id = least(v.vec_id, coalesce(c.m, v.vec_id)) AS kept,
       greatest(1, (SELECT count(*) FROM v w WHERE w.e = v.e))::BIGINT AS class_size
FROM v LEFT JOIN n ON n.a = v.r LEFT JOIN c ON c.a = v.r
"""
