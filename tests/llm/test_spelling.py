"""Operator 12 against all pairs in plain Python."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest

from docspark.llm import spelling as S

DIR = "/root/testdata/sf0.001"


def words_of(rows):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 97 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += 1
    return {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}


def edited(a, b):
    """Whether one insertion, deletion or replacement leads from a to b."""
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    a, b = sorted((a, b), key=len)
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(n):
    near = {w: [v for v in n if edited(w, v)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    out = {}
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None)
    return out


def got(df):
    rows = df.collect()
    out = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in rows}
    assert len(out) == len(rows)
    return out


def test_whole_table(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    assert got(S.report(docs)) == brute(words_of([(r["doc_id"], r["text"]) for r in docs.collect()]))


@pytest.mark.parametrize("crowd", [2, 64])
def test_crowded_chunks(spark, crowd):
    rng = np.random.default_rng(crowd)
    words = {"".join(rng.choice(list("abß"), int(rng.integers(2, 9)))) for _ in range(400)}
    words |= {f"interest{''.join(rng.choice(list('abc'), int(rng.integers(1, 6))))}" for _ in range(300)}
    n = {w: int(rng.integers(3, 60)) for w in sorted(words)} | {"x" * 5000: 9, "x" * 5001: 4, "x" * 2500 + "y" + "x" * 2500: 3}
    df = spark.createDataFrame(list(n.items()), "word string, n long")
    assert got(S.group_variants(df, crowd=crowd)) == brute(n)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "Hello hello HELLO hallo Hallo HALLO hell0"), (3, "Hello hello HELLO hallo Hallo HALLO hell0"), (None, "hello " * 20_000), (5, "Ärger ärger ärger ärger ÷÷÷÷÷×× ñandú \n" * 3), (6, "z" * 60_000 + " ")]
    df = spark.createDataFrame([(i, t, "a", 1, 2) for i, t in rows], "doc_id long, text string, word string, n int, size int")
    assert got(S.report(df)) == brute(words_of(rows))
    assert S.report(df.where("false")).count() == 0 and S.report(df.where("doc_id < 3")).count() == 0
    text_ids = df.selectExpr("concat('d-', doc_id) AS doc_id", "text")
    assert got(S.group_variants(S.words_of(text_ids))) == brute(words_of([(None if i is None else f"d-{i}", t) for i, t in rows]))


def test_ties_and_chains(spark):
    n = {"aaaaa": 3, "aaaab": 6, "aaaac": 6, "aaabb": 12, "aabbb": 24, "zzzzz": 3, "zzzzy": 5, "qqqqq": 3}
    out = got(S.group_variants(spark.createDataFrame(list(n.items()), "word string, n long")))
    assert out["aaaaa"] == ("aaaab", "aabbb", 3, 2, 6)  # the smaller of two forms that occur as often
    assert out["zzzzz"] == (None, "zzzzz", 3, 1, None) and out["qqqqq"] == (None, "qqqqq", 3, 0, None)


def test_candidates_stay_linear(spark):
    """Words that share a chunk are split until few share the rest: verified pairs are few for each word."""
    words = [f"grundstück{i:05d}" for i in range(3000)]
    words = ["".join(chr(ord("a") + int(c)) if c.isdigit() else c for c in w) for w in words]
    df = spark.createDataFrame([(w, 3) for w in words], "word string, n long")
    level, rows = S._halves(df.selectExpr("word", "n", "length(word) AS size", "false AS longer", "0 AS lo", "length(word) AS hi")), []
    while level.count():
        sizes = level.groupBy("key").count()
        rows.append(sum(r["count"] ** 2 for r in sizes.where(f"count <= {S.CROWD}").collect()))
        level = S._halves(level.join(sizes.where(f"count > {S.CROWD}"), "key", "left_semi").where("hi - lo > 1"))
    assert sum(rows) <= 8 * S.CROWD * len(words)
    assert got(S.group_variants(df))["grundstückaaaaa"][3] == 9 + 9 + 9 + 2  # of numbers up to 2999
