"""Operators 2 and 5 against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from docspark.llm import embedding_neardup as E
from docspark.llm import ngram_join as J

DIR = "/root/testdata/sf0.001"


def components(ids, links):
    at = {i: i for i in ids}

    def root(i):
        while at[i] != i:
            i = at[i]
        return i

    for a, b in links:
        x, y = sorted((root(a), root(b)))
        at[y] = x
    return {i: root(i) for i in ids}


def shingles(text):
    w = [x for x in __import__("re").split(r"[\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if x]
    k = min(5, len(w))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if k else set()


def brute(rows, t=0.8):
    sets = {i: shingles(x) for i, x in rows}
    ids = sorted(sets)
    links = [(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if sets[a] == sets[b] or (sets[a] and sets[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]))]
    comp = components(ids, links)
    return {i: (sum(i in p for p in links), comp[i], comp[i] == i) for i in ids}


def got(df):
    return {r["doc_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in df.collect()}


def test_jaccard_all_pairs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    assert got(J.near_duplicates(docs)) == brute([tuple(r) for r in docs.collect()])


def test_jaccard_tiles_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(J, "SIGNATURE_TILE", 7)
    monkeypatch.setattr(J, "SET_BYTES", 4096)
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in rng.integers(0, 10_000, 120)]
    rows = [(1000, None), (1001, ""), (1002, " \n"), (1003, "one two"), (1004, "One  two"), (1005, "x" * 50_000), (1006, "one two three")]
    for i in range(40):
        w = list(base)
        for p in rng.integers(0, 120, i % 4):
            w[p] = f"z{rng.integers(0, 50)}"
        rows.append((i, " ".join(w)))
    rows.append((500, " ".join(f"y{i}" for i in range(30_000))))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(J.near_duplicates(docs.repartition(5))) == brute(rows)


def test_keep_one(spark):
    text = " ".join(f"a{i}" for i in range(60))
    rows = [(1, text, "x"), (1, text, "x"), (2, text + " b", "y"), (3, "other words here", None), (None, "lonely text of a null id", "z"), (None, text, "n"), (3, text + " c", "late"), (8, text + " c d", None), (None, "lonely text of a null id", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key string")
    out = J.keep_one(docs)
    assert out.columns == docs.columns and sorted((r["doc_id"] or 0) for r in out.collect()) == [0, 1, 3]
    assert J.keep_one(docs.limit(0)).count() == 0


def test_keep_one_decides_each_text_of_an_id(spark):
    text = " ".join(f"b{i}" for i in range(60))
    rows = [(5, text), (7, text + " x"), (5, "an unrelated text that sorts first"), (-4, "one text of an id"), (-4, "two unrelated words stay"), (9, "z " + text.replace("b", "c")), (9, "y " + text.replace("b", "c"))]
    want = sorted(r for r in rows if r[0] != 7 and not r[1].startswith("z "))
    for kind in ("long", "string"):
        docs = spark.createDataFrame([(i if kind == "long" else str(i), x) for i, x in rows], f"doc_id {kind}, text string")
        assert sorted((int(r["doc_id"]), r["text"]) for r in J.keep_one(docs).collect()) == want


def test_posterior_bound():
    least = J.least_matches()
    assert sorted(least) == [32, 64, 96, 128, 160] and all(0 < m < n for n, m in least.items()) and least[160] / 160 < 0.8


def test_cosine_all_pairs(spark, duck):
    want = {r[0]: r[1:] for r in duck.execute(f"SELECT vec_id, n_links, component_id, kept FROM ({E.ORACLE_SQL})").fetchall()}
    have = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in E.report(spark.read.parquet(f"{DIR}/embeddings.parquet")).collect()}
    assert have == want


def test_cosine_tiles_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(E, "TILE", 16)
    rng = np.random.default_rng(3)
    centre = rng.normal(size=12)
    rows = [(i, [float(x) for x in (centre + rng.normal(size=12) * 0.25) * rng.uniform(0.1, 9)]) for i in range(80)]
    rows += [(100, rows[5][1]), (101, [2 * x for x in rows[5][1]]), (102, None), (103, [0.0] * 12), (104, [float("nan")] * 12), (105, [None] * 12), (106, []), (107, [float("inf")] + [0.0] * 11), (108, [1.0]), (109, [3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    unit = {i: E._unit(v) for i, v in rows}
    ids = [i for i, _ in rows]
    links = [(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if unit[a] is not None and unit[b] is not None and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.95]
    comp = components(ids, links)
    want = {i: (sum(i in p for p in links), comp[i], comp[i] == i) for i in ids}
    assert {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in E.near_duplicates(df.repartition(3)).collect()} == want
    assert E.near_duplicates(df.limit(0)).count() == 0


def test_blocks_cover_the_distance():
    rng = np.random.default_rng(1)
    axes, blocks, parts = E.rotation(rng.normal(size=(50, 10)), 4, 0.1)
    assert np.allclose(axes.T @ axes, np.eye(10)) and sorted(i for b in blocks for i in range(b.start, b.stop)) == list(range(10)) and parts.sum() == pytest.approx(0.1)


def test_cosine_of_a_decaying_spectrum(spark, monkeypatch):
    """Cells over several axes, guests of two cells, tiles inside a dense cell, and pairs too near the threshold for single precision."""
    monkeypatch.setattr(E, "TILE", 40)
    rng = np.random.default_rng(8)
    spread = 1 / np.arange(1, 33)
    x = rng.normal(size=(600, 32)) * spread
    x[450:] = x[0] + rng.normal(size=(150, 32)) * spread * 0.15
    flat = np.eye(32)[0]
    exact = [0.95 * flat + np.sqrt(1 - 0.95**2) * np.eye(32)[k] for k in range(1, 9)]  # cosines of 0.95, give or take a last bit
    rows = [(i, [float(y) for y in v]) for i, v in enumerate([*x, flat, *exact])]
    units = np.stack([E._unit(v) for _, v in rows])
    space = E.Space(units, 0.95, len(rows))
    assert max(len(c) for c in space.cuts) > 1
    cos = np.stack([units @ u for u in units])
    links = [(a, b) for a, b in zip(*np.nonzero(np.triu(cos >= 0.95, 1)))]
    assert len(links) > 5000
    comp = components(range(len(rows)), links)
    n = np.bincount(np.array(links).reshape(-1), minlength=len(rows))
    border = set(range(600, len(rows)))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for r in E.near_duplicates(df.repartition(3)).collect():
        if r["vec_id"] not in border:
            assert (r["n_links"], r["component_id"]) == (n[r["vec_id"]], comp[r["vec_id"]])
        else:  # the cosine in double precision of such a pair is 0.95 but for its last bits
            assert abs(r["n_links"] - sum(cos[r["vec_id"]] >= 0.95)) <= 8


@pytest.mark.parametrize("block", [0, 1, 2])
def test_every_near_pair_meets_once(block):
    rng = np.random.default_rng(block)
    x = rng.normal(size=(400, 24)) * 0.6 ** np.arange(24)
    units = x / np.linalg.norm(x, axis=1, keepdims=True)
    space = E.Space(units, 0.9, 20 * E.TILE, 3)
    points = (units @ space.axes).astype(np.float32)
    gap = ((points[:, None, space.blocks[block]] - points[None, :, space.blocks[block]]) ** 2).sum(2)
    i, j = np.nonzero(np.triu(gap <= space.parts[block] + E.SLACK / 2, 1))
    cells = {}
    for rows, numbers in space.cells(block, points):
        for r, c in zip(rows, numbers):
            cells.setdefault(int(c), set()).add(int(r))
    upper = space.number(block, np.maximum(space.corner(block, points)[i], space.corner(block, points)[j]))
    assert len(i) > 100 and all(a in cells[int(c)] and b in cells[int(c)] for a, b, c in zip(i, j, upper))


def test_chain_verifies_survivors_only(spark):
    """A chain of 2,000 texts, each near its neighbours only, is one component; only pairs of near neighbours are decided exactly."""
    words = [f"w{i}" for i in range(2000 * 4 + 100)]
    rows = [(i, " ".join(words[4 * i : 4 * i + 100])) for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = J.near_duplicates(docs).toPandas()
    near = sum(5 * (96 - 4 * k) >= 4 * (96 + 4 * k) for k in range(1, 24))  # texts k steps apart share 96 - 4k of 96 + 4k shingles
    want = [min(i, near) + min(1999 - i, near) for i in out["doc_id"]]
    assert near == 2 and (out["n_links"] == want).all() and (out["component_id"] == 0).all()
    signed = docs.select(F.col("doc_id").alias("_id"), F.col("text").alias("_text")).mapInPandas(J._sign, "_id long, key binary, sig binary, bands array<bigint>, bytes long")
    likely = J.candidates(signed.withColumn("n", F.lit(1).cast("long")), J.least_matches()).toPandas()
    verified = sum(int(np.unpackbits(np.frombuffer(b, dtype=np.uint8)).sum()) for b in likely["pairs"])
    assert near * 2000 - 3 <= verified < 8 * 2000  # of 1,999,000


def test_agree_by_either_way():
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 60, n).astype(np.uint64)) for n in rng.choice([5, 60, 150, 200], 30)]
    i, j = np.triu_indices(30, 1)
    want = [5 * len(set(sets[a]) & set(sets[b])) >= 4 * len(set(sets[a]) | set(sets[b])) for a, b in zip(i, j)]
    assert J.agree(sets, i, j).tolist() == want and any(want)
    assert J.agree(sets, i[:100], j[:100]).tolist() == want[:100]


def test_staged_tables_go(spark):
    import os

    from docspark.llm import staging

    folder = staging.shared_folder(spark).removeprefix("file://")
    before = set(os.listdir(folder))
    J.near_duplicates(spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text")).count()
    left = {x.rsplit("-", 1)[0] for x in set(os.listdir(folder)) - before}
    assert left == {"signatures", "components"}  # the result reads these
    point = staging.mark()
    kept = staging.stage(spark.range(3).toDF("a"), "kept")
    staging.stage(spark.range(3).toDF("a"), "gone")
    staging.release_since(point, spark, [kept])
    assert kept.count() == 3 and not [x for x in os.listdir(folder) if x.startswith("gone-")]
    staging.release(kept)


def test_embeddings_with_text_ids(spark):
    rng = np.random.default_rng(8)
    base = rng.normal(size=(6, 12))
    rows = [(f"{'ab'[i % 2]}-{i}", (base[i % 6] + 0.02 * rng.normal(size=12)).tolist()) for i in range(30)] + [(None, base[0].tolist()), ("z", None)]
    df = spark.createDataFrame(rows, "vec_id string, embedding array<double>")
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v in rows if i is not None and v is not None}
    links = [(a, b) for a in unit for b in unit if a < b and unit[a] @ unit[b] >= 0.95]
    comp = components(list(unit), links)
    got_ = {r["vec_id"]: r for r in E.near_duplicates(df).collect()}
    assert got_["z"]["component_id"] == "z" and got_["z"]["n_links"] == 0
    for i in unit:
        assert got_[i]["component_id"] == comp[i] and got_[i]["kept"] == (comp[i] == i)
        assert got_[i]["n_links"] == sum(i in p for p in links) + int(unit[i] @ (base[0] / np.linalg.norm(base[0])) >= 0.95)
