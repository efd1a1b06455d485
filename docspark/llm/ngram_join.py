"""N-gram Jaccard join with Bayesian candidate pruning.

Documents are sets of five-word shingles. MinHash bands name candidate groups;
inside a group, signatures are compared a few hashes at a time and a pair is
dropped as soon as the posterior probability that its similarity reaches the
threshold is below a tolerance. A pair counts in the first band it shares, so it
survives in one group only. The survivors of a group, kept as bits beside its
members, are then decided by the exact similarity of their sets, and no others.
Pairs never become rows: tasks return links per document and spanning edges.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components, stars, whole_groups, with_tiles
from .staging import release, stage

WORDS = 5
THRESHOLD = 0.8
#: Bands of rows: a pair at the threshold is missed by all bands with a probability of 3 in a million.
BANDS, ROWS = 32, 5
HASHES = BANDS * ROWS
#: Hashes compared at a time, and the posterior probability below which a pair is dropped.
CHUNK, TOLERANCE = 32, 1e-6
#: One side of a comparison on average: signatures, and bytes of shingle sets.
SIGNATURE_TILE, SET_BYTES = 1024, 16 << 20
#: Identifiers of candidates up to this many are broadcast (8 MB); more are joined by a shuffle.
BROADCAST_IDS = 1_000_000

_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Sorted distinct 64-bit shingle hashes of a text; words are split at ASCII white space, A-Z folded.

    A text of one to four words is one shingle; one without words has none.
    """

    def __init__(self, words: int = WORDS):
        self.words, self.powers, self.inverses = words, np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)
        self.inverse = pow(_BASE, -1, 1 << 64)

    def _grow(self, n: int) -> None:
        if n > len(self.powers):
            size = 1 << n.bit_length()
            self.powers, self.inverses = (self._powers_of(x, size) for x in (_BASE, self.inverse))

    @staticmethod
    def _powers_of(x: int, n: int) -> np.ndarray:
        out = np.full(n, x, dtype=np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)

    @staticmethod
    def edges(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the words of a text's bytes begin and end."""
        inside = np.concatenate([[False], ~_SPACE[data], [False]])
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        return edge[::2], edge[1::2]

    def hashes(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        self._grow(len(data) + 1)
        total = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.powers[: len(data)], dtype=np.uint64)])
        return _mix((total[end] - total[start]) * self.inverses[start] + (end - start).astype(np.uint64))

    def word_hashes(self, text: str) -> np.ndarray:
        data = np.frombuffer(text.encode("utf-8", "surrogatepass").lower(), dtype=np.uint8)
        return self.hashes(data, *self.edges(data))

    def __call__(self, text: str) -> np.ndarray:
        h = self.word_hashes(text)
        k = min(self.words, len(h))
        if not k:
            return h
        out = np.full(len(h) - k + 1, k, dtype=np.uint64)
        for i in range(k):
            out = _mix(out + h[i : len(h) - k + 1 + i])
        return np.unique(out)


def _seeds() -> tuple[np.ndarray, np.ndarray]:
    x = _mix(np.arange(1, 2 * HASHES + 1, dtype=np.uint64) * np.uint64(_BASE))
    return x[:HASHES] | np.uint64(1), x[HASHES:]


def signature(shingles: np.ndarray) -> np.ndarray:
    a, b = _seeds()
    low = np.full(HASHES, 0xFFFFFFFF, dtype=np.uint64)
    for s in range(0, len(shingles), 4096):
        part = shingles[s : s + 4096, None] * a
        part += b
        part >>= np.uint64(32)
        low = np.minimum(low, part.min(0))
    return low


def band_keys(sig: np.ndarray) -> np.ndarray:
    rows = sig.reshape(BANDS, ROWS)
    out = np.arange(1, BANDS + 1, dtype=np.uint64)
    for r in range(ROWS):
        out = _mix(out * np.uint64(_BASE) + rows[:, r])
    return out.view(np.int64)


def class_key(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE, chunk: int = CHUNK) -> dict[int, int]:
    """After n compared hashes, the fewest matches that keep a pair.

    With a uniform prior the posterior after m matches of n is Beta(m+1, n-m+1),
    and its mass above ``threshold`` is P(Binomial(n+1, threshold) <= m).
    """
    out = {}
    for n in range(chunk, HASHES + 1, chunk):
        term, total, m = (1 - threshold) ** (n + 1), 0.0, 0
        while total + term < tolerance:
            total += term
            term *= (n + 1 - m) / (m + 1) * threshold / (1 - threshold)
            m += 1
        out[n] = m
    return out


def survivors(a: np.ndarray, b: np.ndarray | None, least: dict[int, int], band: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of signature rows that no step of the comparison drops and that share no band before ``band``."""
    other = a if b is None else b
    left, right = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    steps = sorted(least)
    for s in range(0, len(a), 512):
        x = a[s : s + 512]
        same = np.zeros((len(x), len(other)), dtype=np.uint8)
        for k in range(steps[0]):
            same += x[:, k, None] == other[None, :, k]
        i, j = np.nonzero(same >= least[steps[0]])
        m, i = same[i, j].astype(np.int64), i + s
        if b is None:
            up = i < j
            i, j, m = i[up], j[up], m[up]
        for k in range(0, band * ROWS, ROWS):
            if not len(i):
                break
            new = np.zeros(len(i), dtype=bool)
            for t in range(0, len(i), 65536):
                new[t : t + 65536] = (a[i[t : t + 65536], k : k + ROWS] != other[j[t : t + 65536], k : k + ROWS]).any(1)
            i, j, m = i[new], j[new], m[new]
        done = steps[0]
        for n in steps[1:]:
            if not len(i):
                break
            for t in range(0, len(i), 65536):
                m[t : t + 65536] += (a[i[t : t + 65536], done:n] == other[j[t : t + 65536], done:n]).sum(1)
            keep = m >= least[n]
            i, j, m, done = i[keep], j[keep], m[keep], n
        left.append(i)
        right.append(j)
    return np.concatenate(left), np.concatenate(right)


def reaches(common: np.ndarray, union: np.ndarray, threshold: float) -> np.ndarray:
    """Whole numbers are compared, so a similarity that equals the threshold reaches it."""
    return (common > 0) & (common >= threshold * union - 1e-9)


def agree(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray, threshold: float = THRESHOLD) -> np.ndarray:
    """Which of the pairs (i, j) of shingle sets have an exact Jaccard similarity of at least ``threshold``.

    Few pairs are merged one by one; where most of a group's sets meet, their
    common shingles are counted by products of 0/1 blocks.
    """
    size = np.array([len(x) for x in sets], dtype=np.int64)
    if len(i) <= 4 * len(sets):
        common = np.zeros(len(i), dtype=np.int64)
        for t in np.flatnonzero(np.minimum(size[i], size[j]) >= threshold * np.maximum(size[i], size[j]) - 1e-9):
            common[t] = len(np.intersect1d(sets[i[t]], sets[j[t]], assume_unique=True))
        return reaches(common, size[i] + size[j] - common, threshold)
    owner, flat = np.repeat(np.arange(len(sets)), size), np.concatenate(sets)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    column = np.cumsum(np.concatenate([[True], flat[1:] != flat[:-1]])) - 1
    shared = np.bincount(column)[column] > 1
    owner, column = owner[shared], column[shared]
    grids = np.zeros((len(sets), len(sets)), dtype=np.float32)  # whole numbers below 2**24 are exact
    if len(column):
        _, column = np.unique(column, return_inverse=True)
        for s in range(0, column[-1] + 1, 8192):
            lo, hi = np.searchsorted(column, [s, s + 8192])
            grid = np.zeros((len(sets), min(8192, column[-1] + 1 - s)), dtype=np.float32)
            grid[owner[lo:hi], column[lo:hi] - s] = 1
            grids += grid @ grid.T
    common = grids[i, j].astype(np.int64)
    return reaches(common, size[i] + size[j] - common, threshold)


def _sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    shingler = Shingler()
    for b in batches:
        keys, sigs, bands, sizes = [], [], [], []
        for t in b["_text"]:
            s = shingler(t if isinstance(t, str) else "")
            keys.append(class_key(s))
            sig = (signature(s) & np.uint64(0xFFFF)).astype(np.uint16)
            sigs.append(sig.tobytes() if len(s) else b"")
            bands.append(band_keys(sig.astype(np.uint64)) if len(s) else np.zeros(0, dtype=np.int64))
            sizes.append(s.nbytes)
        yield pd.DataFrame({
            "_id": b["_id"], "key": pd.Series(keys, dtype=object), "sig": pd.Series(sigs, dtype=object), "bands": pd.Series(bands, dtype=object), "bytes": pd.Series(sizes, dtype="int64"),
        })


def _sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    shingler = Shingler()
    for b in batches:
        sets = [shingler(t if isinstance(t, str) else "") for t in b["_text"]]
        yield pd.DataFrame({"key": pd.Series([class_key(s) for s in sets], dtype=object), "shingles": pd.Series([s.tobytes() for s in sets], dtype=object)})


TILE = ["band", "ti", "tj"]


def candidates(classes: DataFrame, least: dict[int, int]) -> DataFrame:
    """Members of the groups with surviving pairs: (band, ti, tj, at, key, n, pairs).

    ``at`` numbers the members of a tile with a surviving pair from 0; bit k of
    ``pairs`` tells whether the pair with member k survives (k behind ``at``).
    ``classes``: key, n, sig, bands, bytes. Bands that name the same members are
    one group, named by the first of them: the first band a pair shares always
    names its own group, so each pair is looked at in one group only.
    """
    banded = classes.select("key", "bytes", F.posexplode("bands").alias("place", "band"))
    groups = banded.groupBy("band").agg(
        F.min("place").alias("place"), F.count(F.lit(1)).alias("c"), F.sum("bytes").alias("all"), F.bit_xor(F.xxhash64("key")).alias("x"), F.bit_xor(F.xxhash64("key", F.lit(1))).alias("y")
    ).where("c > 1").groupBy("c", "x", "y").agg(F.min_by(F.struct("band", "place", "all"), "place").alias("g")).select("g.band", "c", "g.all")
    members = banded.select("key", "place", "band").join(groups, "band").join(classes.select("key", "sig", "n"), "key")
    tiles = F.greatest(F.ceil(F.col("c") / SIGNATURE_TILE), F.ceil(F.col("all") / SET_BYTES))
    tiled = with_tiles(members, tiles, "key").select(*TILE, "side", "place", "key", "n", "sig")

    def prune(batches):
        for g in whole_groups(batches, TILE):
            one = g["ti"].iloc[0] == g["tj"].iloc[0]
            a, b = (g, None) if one else (g[g["side"] == 0], g[g["side"] == 1])
            if not len(a) or (b is not None and not len(b)):
                continue
            sa = np.stack([np.frombuffer(s, dtype=np.uint16) for s in a["sig"]])
            sb = None if b is None else np.stack([np.frombuffer(s, dtype=np.uint16) for s in b["sig"]])
            i, j = survivors(sa, sb, least, int(g["place"].iloc[0]))
            if not len(i):
                continue
            rows = a if b is None else pd.concat([a, b])
            j = j if b is None else j + len(a)
            some, place = np.unique(np.concatenate([i, j]), return_inverse=True)
            grid = np.zeros((len(some), len(some)), dtype=bool)
            grid[place[: len(i)], place[len(i) :]] = True
            kept = rows.iloc[some]
            yield pd.DataFrame({
                "band": kept["band"].to_numpy(), "ti": kept["ti"].to_numpy(), "tj": kept["tj"].to_numpy(), "at": np.arange(len(some), dtype=np.int32), "key": kept["key"].to_numpy(), "n": kept["n"].to_numpy(),
                "pairs": pd.Series([r.tobytes() for r in np.packbits(grid, axis=1)], dtype=object),
            })

    dealt = tiled.repartition(*TILE).sortWithinPartitions(*TILE)
    return stage(dealt.mapInPandas(prune, "band long, ti int, tj int, at int, key binary, n long, pairs binary"), "candidates")


def verified(likely: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """(key, other, links) of the members of ``likely`` with a pair whose sets reach ``threshold``: links of the pairs it is in, and a member it is reached with."""

    def verify(batches):
        for g in whole_groups(batches, TILE):
            g = g.sort_values("at")
            grid = np.unpackbits(np.stack([np.frombuffer(x, dtype=np.uint8) for x in g["pairs"]]), axis=1)
            i, j = np.nonzero(grid)
            good = agree([np.frombuffer(s, dtype=np.uint64) for s in g["shingles"]], i, j, threshold)
            i, j = i[good], j[good]
            if not len(i):
                continue
            keys, n, links = g["key"].to_numpy(), g["n"].to_numpy(), np.zeros(len(g), dtype=np.int64)
            np.add.at(links, i, n[j])
            np.add.at(links, j, n[i])
            some = np.flatnonzero(links)
            yield pd.DataFrame({"key": keys[some], "other": keys[stars(len(keys), i, j)][some], "links": links[some]})

    met = likely.join(sets, "key").select(*TILE, "at", "key", "n", "pairs", "shingles")
    return stage(met.repartition(*TILE).sortWithinPartitions(*TILE).mapInPandas(verify, "key binary, other binary, links long"), "links")


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``class_id``, ``n_links``, ``component_id``, ``kept`` for every row of ``docs``.

    Documents with the same shingle set are one class (all texts without words
    are one) and link with each other; classes link at an exact similarity of
    at least ``threshold``. ``n_links`` counts the other rows linked directly,
    ``component_id`` is the smallest id reachable. A null text is empty; a null
    id takes part but is never the smallest; an empty table gives no rows. Very
    long texts are read whole: tiles are cut by the bytes of their sets. Other
    columns are not carried, so their names cannot clash.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    rows = stage(source.mapInPandas(_sign, f"_id {kind}, key binary, sig binary, bands array<bigint>, bytes long"), "signatures")
    same = [F.first(c).alias(c) for c in ("sig", "bands", "bytes")]
    classes = stage(rows.groupBy("key").agg(F.min("_id").alias("rep"), F.count(F.lit(1)).alias("n"), *same), "classes")
    likely = candidates(classes, least_matches(threshold))

    # the sets of the members are made again from one text of each class
    ids = likely.select("key").distinct().join(classes.select("key", "rep"), "key").select(F.col("rep").alias("_rep")).distinct()
    ids = stage(ids, "candidate-ids")
    wanted = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    sets = source.join(wanted, F.col("_id").eqNullSafe(F.col("_rep")), "left_semi").mapInPandas(_sets, "key binary, shingles binary")
    found = verified(likely, sets.groupBy("key").agg(F.first("shingles").alias("shingles")), threshold)
    links = found.groupBy("key").agg(F.sum("links").alias("links"))
    comps = connected_components(found.select(F.col("key").alias("a"), F.col("other").alias("b")))
    full = classes.select("key", "rep", "n").join(links, "key", "left").join(comps.withColumnRenamed("node", "key"), "key", "left")
    full = stage(full.select("key", "rep", "n", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "key").alias("comp")), "components")
    release(classes, likely, ids, found, comps)
    low = full.groupBy("comp").agg(F.min("rep").alias("component_id"))
    told = full.join(low, "comp").select("key", "rep", (F.col("links") + F.col("n") - 1).alias("n_links"), "component_id")
    out = rows.select("_id", "key").join(told, "key")
    return out.select(
        F.col("_id").alias(id_col), F.col("rep").alias("class_id"), F.col("n_links").cast("long").alias("n_links"), "component_id",
        F.coalesce(F.col("_id") == F.col("component_id"), F.lit(False)).alias("kept"),
    )


def row_key(doc_id: Column, kind: str) -> Column:
    """Binary key of a row that sorts by id (null behind all others), then by the hash of its text, its last 16 bytes."""
    known = F.unhex(F.lpad(F.hex(doc_id.cast("long").bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")) if kind in ("long", "integer", "short", "byte") else F.concat(F.encode(doc_id.cast("string"), "utf-8"), F.unhex(F.lit("00")))
    behind = F.unhex(F.lit("FF" * 9))
    return F.concat(F.coalesce(known, behind), F.unhex(F.md5(F.coalesce("text", F.lit("")))))


def keep_one(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row of each group, with the columns of ``docs``: the one with the smallest id, and of these the first by text.

    Rows are told apart by id and text, so texts that share an id are decided
    each for itself. A null id stands behind all others. Repeated rows (equal in
    both) are copies: one of them stays, as does one of all null, empty and blank
    texts, which have no shingles. Very long texts are compared whole. An empty
    table gives no rows; other columns stay whatever their names.
    """
    whole = docs.select(F.struct("*").alias("_row"), row_key(F.col("doc_id"), docs.schema["doc_id"].dataType.typeName()).alias("_key"), "text")
    found = near_duplicates(whole.select("_key", "text"), threshold, "_key")
    own = lambda c: F.expr(f"substring({c}, 1, length({c}) - 16)")
    keys = found.groupBy("_key").agg(F.min("component_id").alias("_group"), F.count(F.lit(1)).alias("n")).withColumn("first", own("_key") == own("_group"))
    keys = stage(keys, "duplicates")
    several = keys.where("first").groupBy("_group").agg(F.sum("n").alias("rows")).where("rows > 1").select("_group")
    gone, many = keys.where("NOT first").select("_key"), stage(keys.where("first").join(several, "_group").select("_key", "_group"), "duplicates")
    sizes = (gone.count(), many.count())
    hint = lambda df, n: F.broadcast(df) if n <= BROADCAST_IDS else df
    left = whole.join(hint(gone, sizes[0]), "_key", "left_anti")
    if sizes[1]:
        repeated = left.join(hint(many, sizes[1]), "_key")
        once = repeated.groupBy("_group").agg(F.min_by("_row", F.struct("text", F.to_json("_row"))).alias("_row"))
        left = left.join(hint(many.select("_key"), sizes[1]), "_key", "left_anti").select("_row").unionByName(once.select("_row"))
    return left.select("_row.*")


def report(docs: DataFrame) -> DataFrame:
    """Rows of query ``op5``."""
    return near_duplicates(docs.select("doc_id", "text"))


ORACLE_SQL = r"""
WITH RECURSIVE
w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
g AS (SELECT DISTINCT doc_id, s FROM (SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' ')) END) AS s FROM w)),
z AS (SELECT w.doc_id, coalesce(n, 0) AS n, coalesce(k, '') AS k FROM w LEFT JOIN (SELECT doc_id, count(*) AS n, md5(string_agg(s, '|' ORDER BY s)) AS k FROM g GROUP BY 1) q ON q.doc_id = w.doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN z x ON x.doc_id = p.a JOIN z y ON y.doc_id = p.b WHERE 5 * c >= 4 * (x.n + y.n - c)
      UNION ALL SELECT x.doc_id, y.doc_id FROM z x JOIN z y ON x.n = 0 AND y.n = 0 AND x.doc_id <> y.doc_id),
r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
m AS (SELECT a, min(b) AS c FROM r GROUP BY 1), n AS (SELECT a, count(*) AS n FROM l GROUP BY 1)
SELECT z.doc_id, min(z.doc_id) OVER (PARTITION BY z.k) AS class_id, coalesce(n.n, 0)::BIGINT AS n_links,
       least(z.doc_id, coalesce(m.c, z.doc_id)) AS component_id, z.doc_id = least(z.doc_id, coalesce(m.c, z.doc_id)) AS kept
FROM z LEFT JOIN m ON m.a = z.doc_id LEFT JOIN n ON n.a = z.doc_id
"""
