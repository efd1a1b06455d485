"""Operator 11: label model and voters against plain Python, held-out accuracy, odd rows."""

import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from docspark.llm import toxicity as T
from docspark.llm.ngram_join import Shingler, _mix

ODD = [(1, None), (2, ""), (3, " \n"), (4, "a"), (5, "you are an idiot"), (5, "you are an idiot"), (None, "YOU ARE ALL LOSERS and id1ots!"), (8, "word " * 30_000), (9, "x" * 80_000), (10, "“Idiot” — naïve ÉCOLE\xa0trash… 💥")]


def plain_votes(text, lexicon):
    """Votes word by word."""
    low = re.sub("[\xa0-\xbf -ⁿ]", " ", text.lower())
    letter = lambda c: "a" <= c <= "z" or ord(c) > 127
    words = "".join(c if letter(c) else " " for c in low).split(" ")
    words = [w for w in words if w]
    bad = lexicon | set(T.SEEDS)
    hits = [w for w in words if w in bad]
    read = "".join(c if letter(c) else T.LEET.get(c, " ") for c in low)
    disguised = False
    for m in re.finditer("[^ ]+", read):
        raw = low[m.start() : m.end()]
        if any(c in T.LEET for c in raw) and any(letter(c) for c in raw) and m[0] in bad:
            disguised = True
    near = any(words[j] in T.ADDRESS and abs(i - j) <= 3 for i, w in enumerate(words) if w in bad for j in range(max(i - 3, 0), min(i + 4, len(words))))
    long = [w for w in text.split() if len(w) > 2]
    shouted = len(long) >= 5 and 2 * sum(w.isupper() for w in long) >= len(long)
    votes = {f"lexicon_{int(_mix(Shingler().word_hashes(w))[0] % np.uint64(T.LEXICONS))}" for w in hits if w in lexicon}
    rest = {
        "seeds": any(w in T.SEEDS for w in hits), "dense": bool(hits) and 100 * len(hits) >= len(words), "varied": len(set(hits)) > 1, "addressed": near, "disguised": disguised, "shouted": shouted,
        "harmless": not hits and not disguised and len(words) >= 20, "calm": not shouted and "!" not in text,
    }
    return [int(v in votes or rest.get(v, False)) for v in T.VOTERS]


def test_votes():
    rng = np.random.default_rng(1)
    lexicon = {"zork", "blörp", "quax"}
    voters, shingler = T.Voters(T._hashes(lexicon)), Shingler()
    pieces = ["zork", "Blörp", "QUAX", "idiot", "1diot", "z0rk", "you", "dich", "the", "house,", "GREEN", "tree!", "5", "“zork”", "a-b", "é", "…", "\xa0", "trash.", "bl$rp"]
    for _ in range(1500):
        text = " ".join(rng.choice(pieces[int(rng.integers(0, 8)) :], int(rng.integers(0, 40))))
        assert voters(T.Text(shingler, text)).tolist() == plain_votes(text, lexicon), text
    for _, text in ODD:
        assert voters(T.Text(shingler, text or "")).tolist() == plain_votes(text or "", lexicon)


def test_label_model_recovers_posteriors():
    """Votes drawn from two known trees; one voter is a copy of another and must count once."""
    rng = np.random.default_rng(2)
    n, k = 200_000, len(T.VOTERS)
    y = rng.random(n) < 0.15
    on1, on0 = np.linspace(0.3, 0.8, k), np.linspace(0.01, 0.2, k)
    votes = (rng.random((n, k)) < np.where(y[:, None], on1, on0)).astype(np.int8)
    votes[:, 3] = votes[:, 7]  # copies
    votes[:, 5] = np.where(rng.random(n) < 0.9, votes[:, 8], votes[:, 5])
    labelled = rng.random(n) < 0.05
    patterns, of = np.unique(votes, axis=0, return_inverse=True)
    of = of.reshape(-1)
    counts = np.stack([np.bincount(of, w, len(patterns)) for w in (labelled & ~y, labelled & y, ~labelled)], 1)
    post = T.fit_votes(patterns, counts)
    # Bayes with the copy left out and the chances of the dependent voter
    free = [i for i in range(k) if i not in (3, 5)]
    p = lambda on: np.prod(np.where(votes[:, free] == 1, on[free], 1 - on[free]), axis=1) * np.where(votes[:, 5] == votes[:, 8], 0.9 + 0.1 * np.where(votes[:, 8] == 1, on[5], 1 - on[5]), 0.1 * np.where(votes[:, 5] == 1, on[5], 1 - on[5]))
    bayes = 0.15 * p(on1) / (0.15 * p(on1) + 0.85 * p(on0))
    assert np.abs(post[of] - bayes).mean() < 0.01
    assert np.mean((post[of] > 0.5) == y) > np.mean((bayes > 0.5) == y) - 0.002
    parent, speaks = T._tree(counts[:, 1], patterns)
    assert 3 in (parent[7], *np.flatnonzero(parent == 7)) or 7 in np.flatnonzero(parent == 3)


def test_label_model_without_labels():
    votes = np.array([[0] * len(T.VOTERS), [1, 1] + [0] * (len(T.VOTERS) - 2), [0, 1, 1] + [0] * (len(T.VOTERS) - 3)], dtype=np.int8)
    post = T.fit_votes(votes, np.array([[0, 0, 900], [0, 0, 60], [0, 0, 40]]))
    assert post[0] < 0.1 and post[1] > 0.9 and post[2] > 0.8


def test_lexicon_needs_different_neighbours(spark):
    """A word of many toxic texts is learned, the words of one text copied many times are not."""
    rng = np.random.default_rng(5)
    common = [f"w{c}{d}" for c in "abcdefgh" for d in "abcdefghij"]
    text = lambda n: list(rng.choice(common, n))
    rows = [(" ".join(text(20)), 0) for _ in range(400)]
    for _ in range(40):
        w = text(20)
        w[int(rng.integers(0, 20))] = "snarf"
        rows.append((" ".join(w), 1))
    rows += [("alpha beta gamma delta epsilon " + " ".join(common[:10]), 1)] * 30
    got = T.learn_lexicon(spark.createDataFrame(rows, "_text string, toxic int"))
    assert T._hashes(["snarf"])[0] in got and not set(got) & set(T._hashes(["alpha", "beta", "gamma", "delta", "epsilon"]))


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    rows = T.report(docs, labels).join(labels.select("doc_id", "toxic"), "doc_id", "left").collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r["held_out"] and r["toxic"] is not None]
    toxic, clean = [r for r in held if r["toxic"]], [r for r in held if not r["toxic"]]
    assert sum(r["predicted"] for r in toxic) >= 0.9 * len(toxic) and sum(r["predicted"] for r in clean) <= 0.01 * len(clean)


def test_held_out_labels_are_not_learned(spark):
    """Turning the labels of held-out rows, or any other column, over changes no score."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    turned = labels.withColumn("toxic", F.when(T.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    other = docs.withColumn("lang", F.lit("xx")).withColumn("source", F.lit("none"))
    scores = lambda d, x: {r["doc_id"]: r["score"] for r in T.report(d, x).collect()}
    assert scores(docs, labels) == scores(other, turned)


def test_odd_rows(spark):
    docs = spark.createDataFrame([(i, t, 1, 2, 3) for i, t in ODD], "doc_id long, text string, toxic int, h int, _toxicity int")
    labels = spark.createDataFrame([(4, 0), (5, 1), (5, 0), (None, 1), (8, None), (77, 1)], "doc_id long, toxic int")
    out = T.score_toxicity(docs, labels)
    assert out.columns == [*docs.columns, "_toxicity_"]
    rows = out.collect()
    assert len(rows) == len(ODD) and all(0 <= r["_toxicity_"]["score"] <= 1 for r in rows)
    twice = [r["_toxicity_"]["score"] for r in rows if r["doc_id"] == 5]
    assert twice[0] == twice[1] > next(r["_toxicity_"]["score"] for r in rows if r["doc_id"] == 8)
    for x in (T.report(docs, labels.where("false")), T.report(docs, labels)):
        assert x.count() == len(ODD)
    assert T.report(docs.where("false"), labels).count() == 0
    named = T.score_toxicity(docs.selectExpr("concat('d', doc_id) AS name", "text AS body"), labels.selectExpr("concat('d', doc_id) AS name", "toxic AS bad"), id_col="name", text_col="body", label_col="bad")
    assert named.count() == len(ODD)
